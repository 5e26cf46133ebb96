"""Queries of the readers and writers: columns of the given tables go to files of the shared folder and come back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators.lineage import scratch
from folioflow.plans.catalog import NATIONS_SQL, nations, query
from folioflow.plans.structures import CONTENT, columns
from folioflow.sources import files as S


def csv_of(df: DataFrame, sep: str = ",", single: bool = False) -> str:
    """Where df was written as header CSV; single: as one file, for what counts the order of the file's rows."""
    path = scratch(df.sparkSession)
    (df.coalesce(1) if single else df).write.csv(path, header=True, sep=sep, quote='"', escape='"', quoteAll=True)
    return path


@query("SELECT c_custkey::VARCHAR AS id, lower(c_name) AS name, lower(c_mktsegment) AS text FROM customer")
def s1_read_dictionary(t):
    c = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.upper("c_mktsegment").alias("text"))
    return S.read_dictionary(c.sparkSession, csv_of(c, "\t"))


@query("SELECT c_name AS value, c_name AS label, c_custkey::VARCHAR AS export_value FROM customer WHERE c_custkey % 5 <> 0")
def s2_read_dictionary_columns(t):
    name = F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.col("c_name"))
    c = t("customer").select(name.alias("name"), F.col("c_custkey").alias("short_name"))
    return S.read_dictionary_columns(c.sparkSession, csv_of(c), export="short_name")


@query("SELECT item_id::VARCHAR AS id, md5(text) AS text FROM benchmark")
def s3_read_phrases(t):
    # each id twice, with quotes and line breaks in the texts; the later row counts
    b = t("benchmark").select(F.col("item_id").alias("id"), "text")
    twice = b.select("id", F.concat(F.lit('"old", '), "text").alias("text"), F.lit(0).alias("n")).union(b.select("id", "text", F.lit(1).alias("n")))
    read = S.read_phrases(b.sparkSession, csv_of(twice.orderBy("n", "id").drop("n"), single=True))
    return read.select("id", F.md5("text").alias("text"))


@query("SELECT n_name AS mistake, lower(n_name) AS replacement, n_nationkey % 2 = 0 AS full_word FROM nation WHERE n_nationkey % 4 <> 3")
def s4_read_fix_rules(t):
    k = F.col("n_nationkey")
    n = t("nation").select(
        F.lit("FALSE").alias("is error"), F.when(k % 2 == 0, " true").otherwise("FALSE").alias("is full word"), F.col("n_name").alias("Mistake"),
        F.when(k % 4 != 3, F.lower("n_name")).otherwise(" ").alias("Should be replaced with"), F.lit("").alias("instructions"),
    )
    return S.read_fix_rules(n.sparkSession, csv_of(n, "\t"))


@query("SELECT (c_custkey % 40)::VARCHAR AS source, max_by(c_name, c_custkey) AS target FROM customer GROUP BY 1")
def s5_read_mapping(t):
    c = t("customer").orderBy("c_custkey").select((F.col("c_custkey") % 40).alias("source"), F.col("c_name").alias("target"))
    return S.read_mapping(c.sparkSession, csv_of(c, single=True))


@query("SELECT c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'http://m/' || c_custkey ELSE '' END AS iiif_url, CASE WHEN c_custkey % 2 = 0 THEN 'iiif' ELSE 'files' END AS type FROM customer WHERE c_custkey % 3 <> 0")
def s6_read_project_manifest(t):
    k = F.col("c_custkey")
    name = F.when(k % 3 != 0, F.concat(F.lit(" "), "c_name")).otherwise(" ")
    c = t("customer").select(name.alias("Project name"), F.when(k % 2 == 0, F.concat(F.lit("http://m/"), k)).alias("IIIF manifest"))
    return S.read_project_manifest(c.sparkSession, csv_of(c, ";"))


@query("SELECT event_id AS sequence_in_ms, event_type AS formula_text_from_ms, (user_id % 7)::DOUBLE AS manuscript_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id::DOUBLE END AS formula_id FROM events")
def s7_import_table(t):
    # headers by name, and by display name in other spelling; cells that are no numbers are empty
    e = t("events").select(
        F.col("event_id").alias("sequence-in MS"), F.col("event_type").alias("formula_text_from_ms"), (F.col("user_id") % 7).alias("manuscriptID"),
        F.when(F.col("user_id") % 3 == 0, "none").otherwise(F.col("user_id").cast("string")).alias("formula_id"), F.lit("x").alias("levenshtein"), F.lit("y").alias("unknown"),
    )
    read = S.import_table(e.sparkSession, csv_of(e), CONTENT)
    return read.select("sequence_in_ms", "formula_text_from_ms", "manuscript_id", "formula_id")


@query("SELECT c_custkey % 17 AS folder, sum(strlen(c_name) + 1)::BIGINT AS bytes FROM customer WHERE c_custkey % 17 <> 3 GROUP BY 1")
def s10_scan_page_files(t):
    # a folder for each remainder; files of another extension are left out
    c = t("customer").select("c_name", (F.col("c_custkey") % 17).alias("folder"))
    path = scratch(c.sparkSession)
    c.where("folder <> 3").write.partitionBy("folder").text(path)
    c.where("folder = 3").select("c_name").write.csv(f"{path}/folder=3")
    found = S.scan_page_files(c.sparkSession, path, ("txt",))
    return found.groupBy(F.regexp_extract("path", r"folder=(\d+)", 1).cast("long").alias("folder")).agg(F.sum("length").cast("long").alias("bytes"))


@query(r"""SELECT conv_id::INTEGER * 1000 + turn::INTEGER AS n, 'from ' || role AS source, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS ocr, md5(upper(role)) AS ref
FROM conversations WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND turn % 3 <> 1""")
def s11_read_eval_pairs(t):
    # every third pair lacks its second side
    c = t("conversations")
    n = (F.col("conv_id") * 1000 + F.col("turn")).cast("string")
    ref = F.when(F.col("turn") % 3 != 1, F.upper("role")).otherwise(" ")
    page = F.concat(F.lit("Example "), n, F.lit(" from "), "role", F.lit("\n1. Original OCR\n"), "text", F.lit("\n1. Fixed by human\n"), ref)
    path = scratch(c.sparkSession)
    c.select(page.alias("value")).write.text(path)
    read = S.read_eval_pairs(c.sparkSession, path)
    return read.select("n", "source", F.md5("ocr").alias("ocr"), F.md5("ref").alias("ref"))


# A small structure with a column of each kind that is replaced on export.
_KINDS = columns(
    """
key | Key | number
kind | Kind | select | dict=nations:id:id:id
shown | Shown | automatic | parent=kind dict=nations:id:id:id
many | Many | list | dict=nations:id:id:id
free | Free | text
"""
)


@query(f"""WITH n AS {NATIONS_SQL} SELECT s_suppkey::VARCHAR AS key, coalesce(a.export_value, CASE WHEN s_suppkey % 6 = 0 THEN 'none' ELSE NULL END) AS kind, coalesce(a.export_value, 'N/A') AS shown,
  coalesce(b.export_value, '') || ', x' AS many, s_name AS free
FROM supplier LEFT JOIN n a ON a.value = CASE WHEN s_suppkey % 6 = 0 THEN 'none' ELSE s_nationkey::VARCHAR END LEFT JOIN n b ON b.value = ((s_nationkey + 1) % 25)::VARCHAR""")
def s13_export_table(t):
    s = t("supplier").select(
        F.col("s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 6 == 0, "none").otherwise(F.col("s_nationkey").cast("string")).alias("kind"),
        F.concat(((F.col("s_nationkey") + 1) % 25).cast("string"), F.lit("; x,,")).alias("many"), F.col("s_name").alias("free"),
    )
    return S.export_table(s, _KINDS, {"nations": nations(t)}, key="key").select("key", "kind", "shown", "many", "free")
