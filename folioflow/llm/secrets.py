"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong kinds (assign, access, hex) are reported wherever they match. Weak kinds are reported only where complementary
parts stand in one scope: a key identifier (id) needs a secret, a bare secret (key) needs an identifier, and an
endpoint (host) needs both. Parts meet in an interval join: each candidate falls into the buckets of `SCOPE` code points of its
start and its end, and two parts link if they are no more than `SCOPE` apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import materialize, table

SCOPE = 300
_SEP = r"""["']?\x20*[:=]\x20*["']?"""
#: kind -> (pattern, group that is measured, least length of that group); kinds in the order of reports.
STRONG = {
    "assign": (rf"((?i:password|passwd|secret|token|api_?key)){_SEP}([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
WEAK = {
    "id": (rf"(?i:access|client|account|tenant)[_-]?(?i:key)?[_-]?(?i:id){_SEP}[A-Za-z0-9._-]{{6,}}", 0, 0),
    "key": (r"(?<![A-Za-z0-9+/=])(?=[A-Za-z+/]*+[0-9])(?=[a-z0-9+/]*+[A-Z])[A-Za-z0-9+/]{20,}+={0,2}(?![A-Za-z0-9+/=])", 0, 0),
    # a name is taken whole, once, from its first label on: repeats are possessive, which Java runs as loops
    "host": (
        r"(?i:https?)://[A-Za-z0-9.-]+"
        r"|(?<![a-z0-9-])(?<![a-z0-9-]\.)[a-z0-9-]++(?:\.[a-z0-9-]++)++(?<=\.internal|\.local|\.amazonaws\.com)(?![A-Za-z0-9])",
        0,
        0,
    ),
}
KINDS = [*STRONG, *WEAK]


def _candidates(kind: str, pattern: str, group: int, least: int) -> Column:
    """For a text with matches, (kind, number, code points before it since the last match, its length, whether it counts)."""
    whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    gaps = F.split("text", pattern, -1)
    rows = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("hit"), part.alias("part")),
        lambda x, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            i.alias("number"),
            F.length(x["gap"]).alias("gap"),
            F.length(x["hit"]).alias("size"),
            (F.length(x["part"]) >= least).alias("counts"),
        ),
    )
    return F.when(F.col("text").rlike(pattern), rows)


def matches(docs: DataFrame) -> DataFrame:
    """(row_key, kind, start, end) of all candidates, kind as a number; rows alike in doc_id and text are one row."""
    per_kind = [_candidates(k, *v) for k, v in (STRONG | WEAK).items()]
    none = F.array().cast("array<struct<kind:int,number:int,gap:int,size:int,counts:boolean>>")
    rows = docs.select("row_key", F.explode(F.concat(*(F.coalesce(c, none) for c in per_kind))).alias("x")).select("row_key", "x.*")
    so_far = Window.partitionBy("row_key", "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    return (
        rows.dropDuplicates(["row_key", "kind", "number"])
        .withColumn("end", end)
        .where("counts")
        .select("row_key", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    )


def _near(parts: DataFrame, other: DataFrame, scope: int) -> DataFrame:
    """parts with a row of other in the same text, no more than scope apart and not overlapping."""
    spread = other.select(
        F.col("row_key").alias("o_row"),
        F.col("start").alias("o_start"),
        F.col("end").alias("o_end"),
        F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))).alias("o_bucket"),
    )
    # the end that faces the other part lies no more than scope from it, and so in one of its buckets
    ends = F.array_distinct(F.array(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope)))
    return parts.withColumn("bucket", F.explode(ends)).join(
        spread,
        (F.col("row_key") == F.col("o_row"))
        & (F.col("bucket") == F.col("o_bucket"))
        & ((F.col("start") >= F.col("o_end")) & (F.col("start") <= F.col("o_end") + scope) | (F.col("end") <= F.col("o_start")) & (F.col("o_start") <= F.col("end") + scope)),
        "left_semi",
    ).drop("bucket").distinct()


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Strong candidates, and the weak ones whose complementary parts stand within scope."""
    of = lambda *kinds: found.where(F.col("kind").isin(*(KINDS.index(k) for k in kinds)))
    ids, secrets = of("access", "id"), of("assign", "hex", "key")
    linked = [
        of(*STRONG),
        _near(of("id"), secrets, scope),
        _near(of("key"), ids, scope),
        _near(_near(of("host"), ids, scope), secrets, scope),
    ]
    return reduce(DataFrame.unionByName, linked)


def _report(spans: Column) -> Column:
    named = F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"]))
    return F.array_join(named, ",")


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Counts, digest of the base spans and all spans for each row of docs.

    Offsets are code points, ends exclusive. Null and empty texts have no spans; repeated rows get the same result; a
    null doc_id is kept; other columns are ignored, whatever their names; an empty table gives an empty result. Texts
    are told apart by a 64-bit hash of doc_id and text, by chance 2**-64 a pair alike.
    """
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    found = materialize(matches(rows))
    spans = link(found, scope).distinct().groupBy("row_key").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("s")
    )
    spans = materialize(spans)
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    s = F.coalesce("s", none)
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", "row_key").join(spans, "row_key", "left").select(
        "doc_id",
        *(count(k) for k in STRONG),
        F.sha2(_report(F.filter(s, lambda x: x["kind"] < len(STRONG))).cast("binary"), 256).alias("base_sha256"),
        _report(s).alias("spans"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
