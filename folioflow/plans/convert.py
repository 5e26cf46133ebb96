"""Converting tables between structures, and validating them against their structure and dictionaries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import add_prefix, blank, extract_parenthesised, nonblank, page_range_join, page_range_split, strip_prefix
from folioflow.operators.joins import mapping_join, reference_violations
from folioflow.operators.table import sequence_conflicts
from folioflow.plans.structures import STRUCTURES, ColumnSpec, quoted, rule_error


@dataclass(frozen=True)
class Rule:
    """One source column: copied to `targets`, or computed by `make` (overwrites), or mapped by files (fills blanks)."""

    source: str
    targets: tuple[str, ...] = ()
    make: Callable[[], dict[str, Column]] | None = None
    mappings: tuple[tuple[str, str], ...] = ()


def _c(name: str) -> Column:
    return F.col(quoted(name)).cast("string")


def _pages() -> dict[str, Column]:
    parts = page_range_split(_c("PAGE NUMBER (ORIGINAL)"))
    return {"where_in_ms_from": parts["first"], "where_in_ms_to": parts["last"]}


# Which column becomes which, and the mapping files that are needed.
RULES: dict[tuple[str, str], list[Rule]] = {
    ("content", "usuarium"): [
        Rule("rism_id", make=lambda: {"SOURCE": add_prefix(_c("rism_id"), "RISM:")}),
        Rule("text_standarization__usu_id", make=lambda: {"STANDARD ITEM": extract_parenthesised(_c("text_standarization__usu_id"))}),
        Rule("formula_text_from_ms", ("ITEM",)),
        Rule("digital_page_number", ("PAGE NUMBER (DIGITAL)",)),
        Rule("where_in_ms_from", make=lambda: {"PAGE NUMBER (ORIGINAL)": page_range_join(_c("where_in_ms_from"), _c("where_in_ms_to"))}),
        Rule("genre", ("GENRE",)),
        Rule("function_id", mappings=(("GENRE", "function_id_to_genre.tsv"),)),
        Rule("subfunction_id", mappings=(("GENRE", "subfunction_id_to_genre.tsv"),)),
    ],
    ("usuarium", "content"): [
        Rule("SOURCE", make=lambda: {"rism_id": strip_prefix(_c("SOURCE"), "RISM:")}),
        Rule("ITEM", ("formula_text_from_ms",)),
        Rule("PAGE NUMBER (DIGITAL)", ("digital_page_number",)),
        Rule("PAGE NUMBER (ORIGINAL)", make=_pages),
        Rule("REMARK", ("comments",)),
        Rule("LAYER", ("layer",)),
        Rule("GENRE", mappings=(("genre", "genre_to_genre.tsv"), ("function_id", "genre_to_function_id.tsv"), ("subfunction_id", "genre_to_subfunction_id.tsv"))),
    ],
    ("cantus", "content"): [
        Rule("field_folio", ("where_in_ms_from",)),
        Rule("field_full_text_original", ("formula_text_from_ms",)),
        Rule("field_rubrics", ("rite_name_from_ms",)),
        Rule("field_notes_chant", ("comments",)),
        Rule("field_imageref_from_chant", ("digital_page_number",)),
        Rule("field_cantus_id", make=lambda: {"reference_to_other_items": add_prefix(_c("field_cantus_id"), "CANTUS:")}),
        Rule("field_office", mappings=(("mass_hour", "cantus_office_to_mass_hour.tsv"),)),
        Rule("field_genre", mappings=(("genre", "cantus_genre_to_genre.tsv"), ("function_id", "cantus_genre_to_function_id.tsv"))),
        Rule("field_marginalia", mappings=(("original_or_added", "cantus_marginalia_to_original_or_added.tsv"),)),
    ],
}


def convert_structure(df: DataFrame, src: str, dst: str, mappings: dict[str, DataFrame] | None = None, keys: tuple[str, ...] = (), order: str = "pos") -> DataFrame:
    """df of structure src as structure dst (all columns as text but the sequence), numbered by `order` within keys.

    Rules apply in order: computed values overwrite, copies and mappings fill blank targets. mappings: file name to
    (source, target); a mapping that is not given maps nothing. Pairs without rules are refused.
    """
    rules = RULES[(src, dst)]
    target = STRUCTURES[dst]
    out = df
    names = {c.name: f"_to_{i}" for i, c in enumerate(target)}
    extra = [t for r in rules for t in (r.make() if r.make else {}) if t not in names]
    names |= {t: f"_to_x{i}" for i, t in enumerate(extra)}
    for spec in target:
        out = out.withColumn(names[spec.name], F.lit(None if spec.default is None else str(spec.default)).cast("string"))
    for t in extra:
        out = out.withColumn(names[t], F.lit(None).cast("string"))
    for rule in rules:
        if rule.source not in df.columns:
            continue
        if rule.make:
            out = out.withColumns({names[t]: v for t, v in rule.make().items()})
        for t in rule.targets:
            out = out.withColumn(names[t], F.coalesce(nonblank(F.col(names[t])), _c(rule.source)))
        for t, file in rule.mappings:
            if mappings and file in mappings:
                out = mapping_join(out, mappings[file], rule.source, names[t])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long") if keys else F.col(order).cast("long")
    cols = [place.alias(s.name) if s.type == "sequence" else F.col(names[s.name]).alias(s.name) for s in target]
    return out.select(*keys, *cols, *(F.col(names[t]).alias(t) for t in extra))


def validate_table(df: DataFrame, structure: list[ColumnSpec], dictionaries: dict[str, DataFrame], key: str, keys: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """(key, column, message): one row for each violation of a rule, a unique number or a dictionary.

    dictionaries: file name to (value, label); columns whose dictionary is not given are not looked up.
    """
    specs = [s for s in structure if s.name in df.columns]
    checks = [(s, rule_error(s)) for s in specs]
    cells = [F.struct(F.lit(s.name).alias("column"), e.alias("message")) for s, e in checks if e is not None]
    out = df.select(key, F.explode(F.array(*cells)).alias("e")).select(key, "e.*").where("message is not null")
    for s in specs:
        if s.type == "sequence":
            again = sequence_conflicts(df, s.name, keys).select(key, F.lit(s.name).alias("column"), F.lit("Sequence must be unique").alias("message"))
            out = out.unionByName(again)
        if s.dictionary in dictionaries and s.parent is None and s.type in ("select", "list", "number"):
            renamed = df.select(key, F.col(quoted(s.name)).cast("string").alias("_cell"))
            if s.type == "number":
                renamed = renamed.withColumn("_cell", F.regexp_replace("_cell", r"\.0$", ""))
            bad = reference_violations(renamed, dictionaries[s.dictionary], key, "_cell", s.type)
            out = out.unionByName(bad.select(key, F.lit(s.name).alias("column"), F.concat(F.lit("Not in dictionary: "), "value").alias("message")))
    return out


def validation_summary(errors: DataFrame, key: str, order: str = "message") -> tuple[DataFrame, DataFrame]:
    """(key, column, message) with the last message of each cell, and (column, errors)."""
    cells = errors.groupBy(key, "column").agg(F.max_by("message", order).alias("message"))
    return cells, errors.groupBy("column").agg(F.count("*").alias("errors"))


def blank_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.count_if(blank(F.col(quoted(c)).cast("string"))).alias(c) for c in columns))
