"""From recognised lines to page text, and from page text to table rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import Rule, apply_fix_rules, parse_markup, trim_all
from folioflow.operators.islands import ordered
from folioflow.operators.layout import drop_edge_lines, order_by_region, reading_order
from folioflow.operators.table import dehyphenate, drop_noise_records, moving_average, overlay_corrections, stitch_pages, tag_color_runs, threshold_runs
from folioflow.plans.structures import ColumnSpec, conform

#: Which column of the content structure takes which kind of text.
TARGETS = {"text": "formula_text_from_ms", "rubric": "rite_name_from_ms", "function": "function_id", "subrubric": "subrite_name_from_ms"}


def load_transcription(pages: DataFrame, structure: list[ColumnSpec] | None = None) -> DataFrame:
    """Pages (project_id, page_id, name, text) as rows: markup split, page breaks stitched, page position kept.

    Without a structure: project_id, seq, text, rubric, function, subrubric, page position from and to.
    """
    w = ordered(["project_id"], ["page_id"])
    p = pages.withColumn("page_no", F.row_number().over(w))
    rows = p.select("project_id", "page_no", F.col("text").alias("page_text"), F.posexplode(parse_markup(F.col("text"))).alias("_i", "x"))
    kind = lambda k: F.when(F.col("x.kind") == k, F.col("x.text"))
    rows = rows.select("project_id", "page_no", "page_text", "_i", *(kind(k).alias(k) for k in TARGETS))
    rows = rows.withColumn("seq", F.row_number().over(ordered(["project_id"], ["page_no", "_i"]))).drop("_i")
    out = stitch_pages(rows, ["project_id"], "seq", "page_no", "page_text")
    out = out.withColumn("seq", F.row_number().over(ordered(["project_id"], ["seq"])).cast("long"))
    if structure is None:
        return out
    named = out.select("project_id", F.col("seq").alias("sequence_in_ms"), F.col("from_page").alias("digital_page_number"), *(F.col(k).alias(v) for k, v in TARGETS.items()))
    return conform(named, structure, keep=("project_id",))


def color_pieces(pieces: DataFrame, signal: DataFrame, threshold: float = 0.0, window: int = 80, min_len: int = 5) -> DataFrame:
    """pieces with `color` from a signal (page_id, line_no, x, redness): red where the run under a piece's middle is above.

    The signal is averaged over `window` places and cut into runs; pieces of lines without a run are black.
    """
    keys = ["page_id", "line_no"]
    runs = threshold_runs(moving_average(signal, keys, "x", "redness", window), keys, "x", "average", threshold, min_len)
    spans = runs.groupBy(*keys).agg(F.collect_list(F.struct("start", "end", "above")).alias("_runs"))
    middle = (F.col("left") + F.col("right")) / 2
    red = F.exists("_runs", lambda r: r["above"] & (r["start"] <= middle) & (middle < r["end"]))
    return pieces.drop("color").join(spans, keys, "left").withColumn("color", F.when(red, "red").otherwise("black")).drop("_runs")


def line_order(boxes: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """(page_id, line_no, position): by regions on pages with two or more of them, else by columns."""
    order = reading_order(boxes, ["page_id"]).groupBy("page_id", "line_no").agg(F.min("position").alias("position"))
    if regions is None:
        return order
    many = regions.groupBy("page_id").agg(F.count("*").alias("_n")).where("_n >= 2").select("page_id")
    by_region = order_by_region(boxes.join(many, "page_id", "left_semi"), regions, ["page_id"]).select("page_id", "line_no", F.col("position").alias("_p"))
    return order.join(by_region, ["page_id", "line_no"], "left").select("page_id", "line_no", F.coalesce("_p", "position").alias("position"))


def transcribe_postprocess(
    lines: DataFrame, rules: Iterable[Rule] = (), fixes: DataFrame | None = None, page_break: bool = True, regions: DataFrame | None = None, signal: DataFrame | None = None, red_threshold: float = 0.0
) -> DataFrame:
    """(page_id, text) from recognised pieces of lines.

    lines: page_id, page_w, line_no, piece_no, color (unless a colour signal is given), text, baseline, left, top, right,
    bottom. Lines come in the order of the regions, else in reading order; short edge lines and noise are dropped, hyphenated words
    joined within a colour, red runs tagged, rules applied, corrections (page_id, fixed, error) laid over, and a page break added.
    """
    kept = drop_edge_lines(lines if signal is None else color_pieces(lines, signal, red_threshold))
    boxes = kept.groupBy("page_id", "line_no").agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.max("page_w").alias("page_w"))
    pieces = drop_noise_records(kept.join(line_order(boxes, regions), ["page_id", "line_no"]), letters=True)
    w = ordered(["page_id"], ["position", "piece_no"])
    pieces = pieces.withColumn("changed", F.when(F.lag("color").over(w).eqNullSafe(F.col("color")), 0).otherwise(1))
    pieces = pieces.withColumn("run", F.sum("changed").over(w)).withColumn("seq", F.row_number().over(w))
    joined = dehyphenate(pieces.select("page_id", "color", "run", "seq", "text"), ["page_id", "color", "run"], "seq")
    pages = tag_color_runs(joined, ["page_id"], ["seq"])
    pages = pages.withColumn("text", apply_fix_rules(F.col("text"), rules))
    if fixes is not None:
        pages = overlay_corrections(pages, fixes)
    text = trim_all(F.col("text"))
    return pages.select("page_id", (F.concat(text, F.lit("⏎")) if page_break else text).alias("text"))
