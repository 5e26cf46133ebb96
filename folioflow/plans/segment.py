"""Cutting the running text of projects at phrases of a dictionary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import blank, cut_on_space, tokenize
from folioflow.operators.joins import segment_pages
from folioflow.operators.lineage import checkpointed
from folioflow.operators.match import phrase_packs, with_best

FRAGMENT = 5674


def project_text(content: DataFrame, key: str = "row_id", text: str = "text", page: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """(project_id, text) with all words of a project in row order, and (project_id, page_id, page_start, page_end)."""
    words = F.array_join(tokenize(F.col(text)), " ")
    rows = content.select("project_id", key, page, words.alias("_w")).where("_w <> ''")
    w = Window.partitionBy("project_id").orderBy(key)
    ends = F.sum(F.length("_w") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("_end", ends - 1).withColumn("_start", F.col("_end") - F.length("_w"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "_w"))), lambda x: x["_w"]), " ")
    whole = rows.groupBy("project_id").agg(joined.alias("text"))
    pages = placed.groupBy("project_id", page).agg(F.min("_start").alias("page_start"), F.max("_end").alias("page_end"))
    return whole, pages.withColumnRenamed(page, "page_id")


def fragments(whole: DataFrame, size: int = FRAGMENT) -> DataFrame:
    """(project_id, seg_start, text): each project's text cut at word ends into pieces of at most `size` characters."""
    pieces = F.regexp_extract_all("text", F.lit(rf"[\s\S]{{1,{size}}}(?=\s|$)\s?|[\s\S]{{1,{size}}}"), F.lit(0))
    p = whole.select("project_id", F.posexplode(pieces).alias("_i", "text"))
    w = Window.partitionBy("project_id").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    return p.select("project_id", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).cast("long").alias("seg_start"), "text")


def segment_by_phrases(content: DataFrame, phrases: DataFrame, threshold: float = 75.0, blocking: bool = True, size: int = FRAGMENT) -> DataFrame:
    """(project_id, sequence, seg_start, seg_end, text, phrase_id, similarity, found, from_page, to_page).

    Each pass looks for the best phrase in every open piece of all projects at once and cuts it into before, match and
    after; pieces without a match are halved at a space as long as they are longer than the shortest phrase. It ends when
    no piece is open: each pass leaves shorter ones. A pass reads and writes only the pieces that the one before left open
    or closed. Pieces of a project join to its text again. Where no phrase has enough in common with any part of a piece,
    its halves are not searched.
    """
    spark = content.sparkSession
    whole, pages = project_text(content)
    kind = phrases.schema["id"].dataType
    none, zero = F.lit(None).cast(kind), F.lit(None).cast("double")
    made = fragments(whole, size).select("project_id", "seg_start", "text", none.alias("phrase_id"), zero.alias("similarity"), (~blank(F.col("text"))).alias("open"), F.lit(True).alias("hope"))
    shortest = phrases.where(~blank(F.col("text"))).agg(F.min(F.length("text"))).first()[0] or 1
    packs = phrase_packs(phrases, cutoff=threshold, blocking=blocking)
    passes = [checkpointed(made, spark)]
    while not passes[-1].where("open").isEmpty():
        j = with_best(passes[-1].where("open").select("project_id", "seg_start", "text", F.when(F.col("hope"), F.col("text")).alias("_search")), packs, "_search", kind)
        part = lambda a, b: F.substring("text", a + 1, b - a)
        s, e, n = F.col("_best.start"), F.col("_best.end"), F.length("text")
        row = lambda at, text, pid, sim, still: F.struct((F.col("seg_start") + at).cast("long").alias("seg_start"), text.alias("text"), pid.alias("phrase_id"), sim.alias("similarity"), still.alias("open"))
        left = F.length(cut_on_space(F.col("text"))["left"])
        left = F.when(left > 0, left).otherwise(F.floor(n / 2).cast("int"))  # a space in front would leave the piece as it is
        small = n <= 2 * shortest
        matched = F.array(row(F.lit(0), part(F.lit(0), s), none, zero, F.lit(True)), row(s, part(s, e), F.col("_best.key"), F.col("_best.score"), F.lit(False)), row(e, part(e, n), none, zero, F.lit(True)))
        halved = F.when(small, F.array(row(F.lit(0), F.col("text"), none, zero, F.lit(False)))).otherwise(
            F.array(row(F.lit(0), part(F.lit(0), left), none, zero, F.lit(True)), row(left, part(left, n), none, zero, F.lit(True)))
        )
        new = j.select("project_id", F.explode(F.when(F.col("_best.key").isNotNull(), matched).otherwise(halved)).alias("x"), F.col("_best.hope").alias("hope")).select("project_id", "x.*", "hope").where("text <> ''")
        passes.append(checkpointed(new.withColumn("open", F.col("open") & ~blank(F.col("text"))), spark))
    done = reduce(DataFrame.unionByName, (p.where("not open") for p in passes)).withColumn("seg_end", F.col("seg_start") + F.length("text"))
    where = segment_pages(done.select("project_id", "seg_start", "seg_end"), pages, ["project_id"])
    w = Window.partitionBy("project_id").orderBy("seg_start")
    return done.join(where, ["project_id", "seg_start", "seg_end"], "left").select(
        "project_id", F.row_number().over(w).cast("long").alias("sequence"), "seg_start", "seg_end", "text", "phrase_id", "similarity",
        F.col("phrase_id").isNotNull().alias("found"), "from_page", "to_page",
    )
