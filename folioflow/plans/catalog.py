"""Registered queries of the text and table operators over the given tables, and their SQL.

`conversations` stands for projects (conv_id) of pages (turn), `events` for numbered table rows, line
boxes of pages (users), signals and job events, `benchmark` for a dictionary of phrases, TPC-like tables for dictionaries and shares.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import geometry as G
from folioflow.functions import text as X
from folioflow.functions.similarity import indel_ratio, partial_alignment, seq_ratio
from folioflow.functions.tables import register
from folioflow.operators import joins as J
from folioflow.operators import layout as L
from folioflow.operators import match as M
from folioflow.operators import projects as P
from folioflow.operators import table as T
from folioflow.operators.lineage import spread
from folioflow.plans import convert as C
from folioflow.plans import evaluate as E
from folioflow.plans.segment import segment_by_phrases
from folioflow.plans.structures import CONTENT, ColumnSpec, computed, conform, displayed
from folioflow.plans.transcription import load_transcription, transcribe_postprocess
from folioflow.sources import files as S
from folioflow.streaming.stream import fix_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a table reader under its own name, with its SQL if there is one."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- derived inputs -------------------------------------------------------------------------------------------------

#: Numbered lines of a user's events.
LINES_SQL = """(SELECT user_id AS l_orderkey, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS l_linenumber, event_id AS l_partkey, user_id + event_id AS l_suppkey,
  upper(event_type[1:1]) AS l_returnflag, CASE WHEN event_id % 2 = 0 THEN 'O' ELSE 'F' END AS l_linestatus, event_id % 50 AS l_quantity, (event_id % 11) / 100.0::DOUBLE AS l_discount FROM events)"""
#: Every third page is blank.
PAGES_SQL = "(SELECT conv_id AS project_id, turn AS page_id, role AS name, CASE WHEN turn % 3 = 1 THEN '' ELSE text END AS text FROM conversations)"
#: A row's number is missing at every seventh part and doubled at every fifth.
ROWS_SQL = f"""(SELECT l_orderkey AS project_id, l_linenumber::BIGINT AS row_id, CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN 1 ELSE l_linenumber END::BIGINT AS seq,
  l_returnflag || ' ' || l_linestatus AS text, l_suppkey AS supp FROM {LINES_SQL})"""
#: Boxes of lines on a page of 1000 by 1500.
BOXES_SQL = f"""(SELECT l_orderkey AS page_id, l_linenumber AS line_no, (l_partkey % 700)::DOUBLE AS "left", (floor(l_quantity) * 20)::DOUBLE AS top,
  (l_partkey % 700 + 40 + l_suppkey % 200)::DOUBLE AS "right", (floor(l_quantity) * 20 + 10 + l_linenumber)::DOUBLE AS bottom, 1000.0::DOUBLE AS page_w FROM {LINES_SQL})"""
RULES: list[X.Rule] = [("and", "et", True), ("the", "le", True), ("der", "d'", True), ("of", "de", True), ("with", "cum", True)]
RULES_SQL = "MAP {'and': 'et', 'the': 'le', 'der': 'd''', 'of': 'de', 'with': 'cum'}"
_TOKENS_SQL = r"regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]')"
FIXED_SQL = f"array_to_string(list_transform({_TOKENS_SQL}, lambda x: coalesce({RULES_SQL}[x], x)), '')"


def pages_of(t) -> DataFrame:
    return t("conversations").select(
        F.col("conv_id").alias("project_id"), F.col("turn").alias("page_id"), F.col("role").alias("name"), F.when(F.col("turn") % 3 == 1, "").otherwise(F.col("text")).alias("text")
    )


def lines_of(t) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    return t("events").select(
        F.col("user_id").alias("l_orderkey"), n.alias("l_linenumber"), F.col("event_id").alias("l_partkey"), (F.col("user_id") + F.col("event_id")).alias("l_suppkey"),
        F.upper(F.substring("event_type", 1, 1)).alias("l_returnflag"), F.when(F.col("event_id") % 2 == 0, "O").otherwise("F").alias("l_linestatus"),
        (F.col("event_id") % 50).alias("l_quantity"), (F.col("event_id") % 11 / 100.0).alias("l_discount"),
    )


def rows_of(t) -> DataFrame:
    seq = F.when(F.col("l_partkey") % 7 == 0, None).when(F.col("l_partkey") % 5 == 0, 1).otherwise(F.col("l_linenumber")).cast("long")
    return lines_of(t).select(
        F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").cast("long").alias("row_id"), seq.alias("seq"),
        F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("text"), F.col("l_suppkey").alias("supp"),
    )


def boxes_of(t) -> DataFrame:
    left, top = (F.col("l_partkey") % 700).cast("double"), F.floor("l_quantity").cast("double") * 20
    return lines_of(t).select(
        F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("line_no"), left.alias("left"), top.alias("top"),
        (left + 40 + F.col("l_suppkey") % 200).alias("right"), (top + 10 + F.col("l_linenumber")).alias("bottom"), F.lit(1000.0).alias("page_w"),
    )


def nations(t) -> DataFrame:
    return t("nation").select(F.col("n_nationkey").cast("string").alias("value"), F.initcap(F.lower("n_name")).alias("label"), F.concat(F.lit("N"), "n_nationkey").alias("export_value"))


NATIONS_SQL = "(SELECT n_nationkey::VARCHAR AS value, upper(n_name[1:1]) || lower(n_name[2:]) AS label, 'N' || n_nationkey AS export_value FROM nation)"


def phrases_of(t) -> DataFrame:
    return t("benchmark").select(F.col("item_id").alias("id"), "text")


# ---- functions ------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({FIXED_SQL}) AS fixed FROM documents")
def f1_apply_fix_rules(t):
    return t("documents").select("doc_id", F.md5(X.apply_fix_rules(F.col("text"), RULES)).alias("fixed"))


_MARKUP_SQL = """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'rubric' ELSE 'text' END AS kind, md5(CASE WHEN turn % 2 = 0 THEN trim(text, ' ' || chr(10)) ELSE text END) AS part FROM conversations WHERE trim(text, ' ' || chr(10)) <> ''
UNION ALL SELECT conv_id, turn, 'function', md5(role) FROM conversations"""


def _marked(t) -> DataFrame:
    shown = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<red>"), "text", F.lit("</red>"))).otherwise(F.col("text"))
    return t("conversations").select("conv_id", "turn", F.concat(shown, F.lit("⏎<func> "), "role", F.lit("</func>")).alias("marked"))


@query(_MARKUP_SQL)
def f2_parse_markup(t):
    return _marked(t).select("conv_id", "turn", F.explode(X.parse_markup(F.col("marked"))).alias("x")).select("conv_id", "turn", "x.kind", F.md5("x.text").alias("part"))


@query(_MARKUP_SQL)
def u4_markup_rows(t):
    pages = _marked(t)
    register(pages.sparkSession)
    return pages.sparkSession.sql("SELECT conv_id, turn, m.kind, md5(m.text) AS part FROM {pages} AS p, LATERAL markup_rows(p.marked) AS m", pages=pages)


def _grams_sql(key: str, table: str) -> str:
    """Distinct trigrams (k, gram) by windows over single characters."""
    return rf"""(SELECT DISTINCT k, gram FROM (SELECT k, ch || lead(ch, 1) OVER w || lead(ch, 2) OVER w AS gram FROM (SELECT k, unnest(string_split(c, '')) AS ch, unnest(range(1, length(c) + 1)) AS i
  FROM (SELECT {key} AS k, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM {table})) WINDOW w AS (PARTITION BY k ORDER BY i)) WHERE gram IS NOT NULL)"""


@query(f"SELECT doc_id, coalesce(n, 0)::BIGINT AS n FROM documents LEFT JOIN (SELECT k, count(*) AS n FROM {_grams_sql('doc_id', 'documents')} GROUP BY k) ON k = doc_id")
def f3_ngrams(t):
    return t("documents").select("doc_id", F.size(X.ngrams(F.col("text"))).cast("long").alias("n"))


@query("""SELECT a.n_nationkey AS a, b.n_nationkey AS b, levenshtein(a.n_name, b.n_name)::INTEGER AS distance,
  printf('%.2f%%', (greatest(length(a.n_name), length(b.n_name)) - levenshtein(a.n_name, b.n_name)) / greatest(length(a.n_name), length(b.n_name)) * 100) AS label
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey""")
def f4_f5_levenshtein(t):
    a = t("nation").select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x"), "n_regionkey")
    b = t("nation").select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"), "n_regionkey")
    return a.join(b, "n_regionkey").select("a", "b", F.levenshtein("x", "y").alias("distance"), X.lev_label(F.col("x"), F.col("y")).alias("label"))


@query("""WITH RECURSIVE p AS (SELECT p_partkey, string_split(p_name, '') AS a, string_split(p_type, '') AS b FROM part), dp(k, i, r) AS (
  SELECT p_partkey, 0::BIGINT, list_transform(range(len(b) + 1), lambda x: 0::BIGINT) FROM p
  UNION ALL SELECT k, i + 1, list_transform(x, lambda v, j: list_max(x[1:j])) FROM (
    SELECT k, i, list_transform(r, lambda v, j: CASE WHEN j > 1 AND a[i + 1] = b[j - 1] THEN r[j - 1] + 1 ELSE v END) AS x FROM dp JOIN p ON k = p_partkey WHERE i < len(a)))
SELECT p_partkey, 200.0::DOUBLE * r[len(r)] / (len(a) + len(b)) AS ratio FROM dp JOIN p ON p_partkey = k AND i = len(a)""")
def f6_indel_ratio(t):
    p = t("part").select("p_partkey", "p_name", "p_type")
    return p.select("p_partkey", indel_ratio("p_name", "p_type").alias("ratio"))


@query(f"""WITH d AS (SELECT p_partkey, p_name AS phrase, repeat('.', (p_partkey % 7)::INTEGER) || p_name || repeat('-', (p_partkey % 5)::INTEGER) AS held FROM part)
SELECT p_partkey, (p_partkey % 7)::INTEGER AS first, (p_partkey % 7 + length(phrase))::INTEGER AS last, 100.0::DOUBLE AS score FROM d""")
def f7_partial_alignment(t):
    # each name between marks that no name has, so the best window is known
    dots, lines = F.expr("repeat('.', int(p_partkey % 7))"), F.expr("repeat('-', int(p_partkey % 5))")
    return spread(t("part")).select("p_partkey", partial_alignment("p_name", F.concat(dots, "p_name", lines)).alias("a")).select("p_partkey", F.col("a.start").alias("first"), F.col("a.end").alias("last"), "a.score")


@query("SELECT p_partkey, length(p_name) AS a, length(p_type) AS b, coalesce(2.0::DOUBLE * (p_partkey % 9) / nullif(length(p_name) + length(p_type), 0), 0.0) AS score FROM part")
def f8_dice(t):
    a, b = F.length("p_name"), F.length("p_type")
    return t("part").select("p_partkey", a.cast("long").alias("a"), b.cast("long").alias("b"), X.dice(F.col("p_partkey") % 9, a, b).alias("score"))


@query("SELECT conv_id, turn, CASE WHEN text = '' OR turn % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS echo FROM conversations")
def f16_echo_ratio(t):
    # every second output copies its input, the others share no word with it
    c = t("conversations")
    return c.select("conv_id", "turn", E.echo_ratio(F.col("text"), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("0000 1111")).alias("echo"))


@query("""SELECT c_custkey, lower(replace(c_name, '#', '')) AS name FROM customer""")
def f20_normalize_header(t):
    return t("customer").select("c_custkey", X.normalized_header(F.concat(F.lit(" "), F.replace(F.col("c_name"), F.lit("#"), F.lit("_ -")), F.lit(" "))).alias("name"))


@query("SELECT event_id, event_id % 4 IN (0, 1) AS whole, event_id % 4 IN (0, 1, 2) AS number FROM events")
def f23_is_integer(t):
    k, n = F.col("event_id") % 4, F.col("event_id").cast("string")
    cell = F.when(k == 0, n).when(k == 1, F.concat(F.lit("-"), n)).when(k == 2, F.concat(n, F.lit(".5"))).otherwise(F.concat(n, F.lit("x")))
    return t("events").select("event_id", cell.alias("c")).select("event_id", F.coalesce(X.is_integer(F.col("c")), F.lit(False)).alias("whole"), F.coalesce(X.is_float(F.col("c")), F.lit(False)).alias("number"))


@query(f"""SELECT page_id, line_no, CASE WHEN line_no % 2 = 0 THEN "left" - 1 ELSE "left" END AS l, CASE WHEN line_no % 2 = 0 THEN top ELSE top + 1 END AS t,
  CASE WHEN line_no % 2 = 0 THEN "right" ELSE "right" + 2 END AS r, CASE WHEN line_no % 2 = 0 THEN bottom + 3 ELSE bottom END AS b FROM {BOXES_SQL}""")
def f33_bbox(t):
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    b = boxes_of(t)
    line = F.array(point(F.col("left"), F.col("bottom")), point(F.col("right") + 2, F.col("top") + 1))
    around = F.array(point(F.col("left") - 1, F.col("top")), point(F.col("right"), F.col("bottom") + 3))
    around = F.when(F.col("line_no") % 2 == 0, around)  # every second line has a baseline only
    return b.select("page_id", "line_no", G.bbox(around, line).alias("x")).select("page_id", "line_no", F.col("x.left").alias("l"), F.col("x.top").alias("t"), F.col("x.right").alias("r"), F.col("x.bottom").alias("b"))


@query()
def f15_seq_ratio(t):
    c = t("conversations").select("conv_id", "turn", X.normalise_words(F.col("text")).alias("a"), X.normalise_words(X.apply_fix_rules(F.col("text"), RULES)).alias("b"))
    return c.select("conv_id", "turn", seq_ratio("a", "b").alias("ratio"))


@query()
def f14_word_error_rate(t):
    c = t("conversations")
    return c.select("conv_id", "turn", E.error_rate(F.col("text"), X.apply_fix_rules(F.col("text"), RULES)).alias("wer"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::INTEGER AS words, md5(regexp_replace(text, '[^\p{L}\p{N}_]+', '', 'g')) AS clean FROM documents")
def f9_f10_words(t):
    return t("documents").select("doc_id", F.size(X.tokenize(F.col("text"))).alias("words"), F.md5(X.clean_string(F.col("text"))).alias("clean"))


@query("""WITH h AS (SELECT doc_id, text, length(text) // 2 AS m, instr(reverse(substring(text, 1, length(text) // 2 + 1)), ' ') AS s FROM documents),
c AS (SELECT doc_id, text, CASE WHEN s > 0 THEN m + 1 - s ELSE m END AS pos FROM h)
SELECT doc_id, md5(substring(text, 1, pos)) AS l, md5(substring(text, pos + 1)) AS r FROM c""")
def f11_cut_on_space(t):
    cut = X.cut_on_space(F.col("text"))
    return t("documents").select("doc_id", F.md5(cut["left"]).alias("l"), F.md5(cut["right"]).alias("r"))


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END::INTEGER AS lines FROM documents")
def f12_line_count(t):
    return t("documents").select("doc_id", X.line_count(F.col("text")).alias("lines"))


@query(r"""SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(translate(replace(translate(lower(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[^\p{L}\p{N}_\s\p{Z}]', ' ', 'g')), 'jv', 'iu'), 'ae', 'e'), 'y', 'i'), '\s+'), lambda x: x <> ''), ' ')) AS words FROM documents""")
def f13_normalise_words(t):
    return t("documents").select("doc_id", F.md5(F.array_join(X.normalise_words(F.col("text")), " ")).alias("words"))


@query("SELECT doc_id, md5(text || ' <0xC3> <0xFF><0x41>') AS decoded FROM documents")
def f17_decode_byte_tokens(t):
    # line breaks and two-byte letters are spelled as byte tokens, and read back; runs that spell nothing stay
    spelled = F.regexp_replace(F.regexp_replace("text", "\n", "<0x0A>"), "é", "<0xC3><0xA9>")
    spelled = F.concat(F.regexp_replace(spelled, "ñ", "<0xc3><0xb1>"), F.lit(" <0xC3> <0xFF><0x41>"))
    return t("documents").select("doc_id", F.md5(X.decode_byte_tokens(spelled)).alias("decoded"))


@query(r"""SELECT page_id, CASE WHEN replace(trim(regexp_replace(url, '[^\p{L}\p{N} _-]', '', 'g')), ' ', '_') = '' THEN 'page_' || page_id ELSE replace(trim(regexp_replace(url, '[^\p{L}\p{N} _-]', '', 'g')), ' ', '_') END AS label,
  lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS domain FROM pages""")
def f18_f19_labels(t):
    return t("pages").select("page_id", X.sanitize_label(F.col("url"), F.col("page_id")).alias("label"), X.url_domain(F.col("url")).alias("domain"))


@query("""SELECT event_id, CASE WHEN user_id % 4 = 0 THEN true WHEN user_id % 4 = 1 THEN false WHEN user_id % 4 = 2 THEN NULL ELSE NULL END AS flag, CASE WHEN user_id % 3 = 0 THEN NULL ELSE value END AS number,
  user_id % 3 <> 0 AS ok_number, user_id % 2 = 0 AS ok_folio FROM events""")
def f21_f25_coercion(t):
    u = F.col("user_id")
    raw_flag = F.when(u % 4 == 0, " TRUE").when(u % 4 == 1, "0").when(u % 4 == 2, "").otherwise("x")
    raw_number = F.when(u % 3 == 0, "1x").otherwise(F.col("value").cast("string"))
    raw_folio = F.when(u % 2 == 0, F.concat((u % 90).cast("string"), F.lit("r"))).otherwise("r7")
    return t("events").select("event_id", X.parse_bool(raw_flag).alias("flag"), X.parse_number(raw_number).alias("number"), X.is_float(raw_number).alias("ok_number"), X.is_folio(raw_folio).alias("ok_folio"))


@query("""SELECT c_custkey, 'RISM:' || c_name AS added, c_name AS stripped, c_mktsegment AS inner_id, c_custkey || ' - ' || c_nationkey AS joined, c_custkey::VARCHAR AS first FROM customer""")
def f26_f29_references(t):
    c = t("customer")
    name = X.add_prefix(F.col("c_name"), "RISM:")
    joined = X.page_range_join(F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"))
    return c.select(
        "c_custkey", name.alias("added"), X.strip_prefix(name, "RISM:").alias("stripped"),
        X.extract_parenthesised(F.concat(F.lit("x ("), "c_mktsegment", F.lit(") (y)"))).alias("inner_id"), joined.alias("joined"), X.page_range_split(joined)["first"].alias("first"),
    )


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<(/?)strong(?:\s[^>]*)?>', '<\1b>', 'gi'),
 '<(/?)b(?:\s[^>]*)?>', '<\1red>', 'gi'), '<(/?)i(?:\s[^>]*)?>', '<\1func>', 'gi'), '<(/?)u(?:\s[^>]*)?>', '<\1subrub>', 'gi'), '<div(?:\s[^>]*)?>', '<br>', 'gi'), '</div>', '', 'gi'), '<br\s*/?>', chr(10), 'gi'), '&nbsp;|\x{A0}', ' ', 'gi')) AS tags FROM pages""")
def f31_html_to_tags(t):
    return t("pages").select("page_id", F.md5(X.html_to_tags(F.col("html"))).alias("tags"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '<red>', '<b>'), '</red>', '</b>'), '<func>', '<i>'), '</func>', '</i>'), chr(10), '<br>')) AS html FROM pages")
def f30_tags_to_html(t):
    return t("pages").select("page_id", F.md5(X.tags_to_html(F.col("html"))).alias("html"))


@query("""SELECT doc_id, md5(replace(text, 'th', '$1\\')) AS replaced, len(string_split(text, 'th')) - 1 AS hits FROM documents""")
def f32_find_replace(t):
    return t("documents").select("doc_id", F.md5(X.find_replace_all(F.col("text"), "th", "$1\\")).alias("replaced"), (F.size(F.split("text", "th", -1)) - 1).cast("long").alias("hits"))


@query("""SELECT doc_id, md5(regexp_replace(text, 'tH', '<$1>', 'gi')) AS replaced, len(regexp_extract_all(text, '(?i)tH'))::BIGINT AS hits,
CASE WHEN regexp_matches(text, '(?i)tH') THEN length(regexp_extract(text, '(?is)^(.*?)tH', 1)) ELSE -1 END AS first_at FROM documents""")
def f32_find_replace_any_case(t):
    at = X.occurrences(F.col("text"), "tH", ignore_case=True)
    replaced = X.find_replace_all(F.col("text"), "tH", "<$1>", ignore_case=True)
    return t("documents").select("doc_id", F.md5(replaced).alias("replaced"), F.size(at).cast("long").alias("hits"), F.coalesce(F.get(at, F.lit(0)), F.lit(-1)).cast("long").alias("first_at"))


@query("""WITH p AS (SELECT event_id, (user_id % 256)::DOUBLE / 255 AS r, (event_id % 256)::DOUBLE / 255 AS g, ((user_id + event_id) % 256)::DOUBLE / 255 AS b FROM events),
m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM p), c AS (SELECT *, hi - lo AS d, (hi + lo) / 2 AS l FROM m)
SELECT event_id, round(CASE WHEN d = 0 THEN 0 WHEN hi = b THEN ((r - g) / d + 4) / 6 WHEN hi = g THEN ((b - r) / d + 2) / 6 ELSE ((g - b) / d + CASE WHEN g < b THEN 6 ELSE 0 END) / 6 END, 9) AS h,
 round(CASE WHEN d = 0 THEN 0 WHEN l > 0.5 THEN d / (2 - hi - lo) ELSE d / (hi + lo) END, 9) AS s, round(l, 9) AS l FROM c""")
def f34_rgb_to_hsl(t):
    e = t("events").select("event_id", G.rgb_to_hsl(F.col("user_id") % 256, F.col("event_id") % 256, (F.col("user_id") + F.col("event_id")) % 256).alias("c"))
    return e.select("event_id", *(F.round(f"c.{x}", 9).alias(x) for x in "hsl"))


@query("""WITH c AS (SELECT user_id, (200 + user_id % 56) / 255.0::DOUBLE AS r, (event_id % 90) / 255.0::DOUBLE AS g, (event_id % 70) / 255.0::DOUBLE AS b FROM events),
m AS (SELECT *, greatest(g, b) AS top, least(g, b) AS lo, r - least(g, b) AS d FROM c),
h AS (SELECT user_id, ((g - b) / d / 6 + CASE WHEN g < b THEN 1 ELSE 0 END) AS h, (r + lo) / 2 AS l, CASE WHEN (r + lo) / 2 > 0.5 THEN d / (2 - r - lo) ELSE d / (r + lo) END AS s FROM m)
SELECT user_id, round(avg(CASE WHEN h <= 0.1 THEN exp(-power(h / 0.05, 2) / 2) WHEN h >= 0.91 THEN exp(-power((h - 1) / 0.05, 2) / 2) ELSE 0 END * CASE WHEN l BETWEEN 0.25 AND 0.8 THEN exp(-power((l - 0.5) / 0.15, 2) / 2) ELSE 0 END
  * CASE WHEN s BETWEEN 0.3 AND 1.0 THEN exp(-power((s - 1) / 0.2, 2) / 2) ELSE 0 END * 100), 6) AS redness FROM h GROUP BY user_id""")
def f35_redness(t):
    e = t("events").select("user_id", G.rgb_to_hsl(200 + F.col("user_id") % 56, F.col("event_id") % 90, F.col("event_id") % 70).alias("c"))
    return e.groupBy("user_id").agg(F.round(F.avg(G.redness(F.col("c.h"), F.col("c.s"), F.col("c.l"))), 6).alias("redness"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE '' END AS shown FROM events")
def f37_display_value(t):
    return t("events").select("event_id", X.display_value(F.col("event_type"), ["click", "view"]).alias("shown"))


# ---- filters --------------------------------------------------------------------------------------------------------


@query(f"SELECT project_id, page_id FROM {PAGES_SQL} WHERE text IS NOT NULL AND text <> ''")
def p1_has_transcription(t):
    return T.has_transcription(pages_of(t)).select("project_id", "page_id")


@query(f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY page_id) AS pos, count(*) OVER (PARTITION BY project_id) AS n FROM {PAGES_SQL}),
q AS (SELECT *, min(CASE WHEN trim(coalesce(text, '')) = '' THEN pos END) OVER (PARTITION BY project_id) AS f FROM p)
SELECT 'skip' AS mode, project_id, page_id FROM q WHERE trim(coalesce(text, '')) = '' UNION ALL SELECT 'continue', project_id, page_id FROM q WHERE pos >= f
UNION ALL SELECT 'range', project_id, page_id FROM q WHERE n >= 4 AND pos BETWEEN 2 AND 4 UNION ALL SELECT 'override', project_id, page_id FROM q""")
def p2_select_pages(t):
    parts = [T.select_pages(pages_of(t), m, 2, 4).select(F.lit(m).alias("mode"), "project_id", "page_id") for m in ("skip", "continue", "range", "override")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(f"""SELECT page_id, line_no FROM {BOXES_SQL} WHERE NOT ("right" - "left" < 250 AND ("left" < 50 OR "right" > 950))""")
def p3_drop_edge_lines(t):
    point = lambda x: F.struct(F.col(x).alias("x"), F.col("bottom").alias("y"))
    return L.drop_edge_lines(boxes_of(t).withColumn("baseline", F.array(point("left"), point("right")))).select("page_id", "line_no")


@query("SELECT doc_id FROM documents WHERE length(text) > 2 AND regexp_matches(text, '[a-zA-Z]')")
def p4_drop_noise_records(t):
    return T.drop_noise_records(T.drop_noise_records(t("documents")), letters=True).select("doc_id")


@query("SELECT event_id::DOUBLE AS id, event_type AS comments, '' AS edition_index FROM events")
def p5_conform(t):
    e = t("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("comments"))
    return conform(e, CONTENT).select("id", "comments", "edition_index")


@query(f"SELECT project_id, page_id FROM {PAGES_SQL} WHERE trim(coalesce(text, '')) <> ''")
def p6_meaningful_rows(t):
    return T.meaningful_rows(pages_of(t), ["text"]).select("project_id", "page_id")


@query(f"SELECT l_orderkey, l_linenumber FROM {LINES_SQL} WHERE l_linenumber = 2 OR l_discount >= 0.05")
def p8_confident_regions(t):
    r = lines_of(t).withColumn("score", F.when(F.col("l_linenumber") != 2, F.col("l_discount")))
    return L.confident_regions(r, 0.05).select("l_orderkey", "l_linenumber")


@query(f"""WITH p AS (SELECT o_orderkey AS project_id, CASE WHEN o_orderkey % 4 = 0 THEN 1 + 1 WHEN o_orderkey % 4 = 1 THEN 2 + 1 WHEN o_orderkey % 4 = 2 THEN 1 END AS start FROM orders)
SELECT project_id, start::BIGINT AS start, l_linenumber AS page_no FROM p JOIN {LINES_SQL} ON l_orderkey = project_id AND l_linenumber >= start UNION ALL SELECT project_id, NULL, NULL FROM p WHERE start IS NULL""")
def p9_resume_pages(t):
    k = F.col("o_orderkey") % 4
    p = t("orders").select(
        F.col("o_orderkey").alias("project_id"), F.when(k == 0, "cancelled").alias("job_status"), F.lit(1).alias("current"), F.lit(2).alias("existing"),
        F.when(k == 1, "append").when(k == 2, "restart").alias("choice"),
    )
    return P.resume_pages(lines_of(t).select(F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").alias("page_no")), p)


@query(f"""SELECT project_id, row_id, row_number() OVER (PARTITION BY project_id ORDER BY seq NULLS LAST, row_id) AS seq FROM {ROWS_SQL} WHERE row_id NOT IN (3, 5)""")
def p10_delete_rows(t):
    gone = lines_of(t).select(F.col("l_linenumber").cast("long").alias("row_id")).where("row_id in (3, 5)")
    return T.delete_rows(rows_of(t), gone).select("project_id", "row_id", "seq")


# ---- joins ----------------------------------------------------------------------------------------------------------


@query(f"""SELECT c_custkey, coalesce(d.label, e.label, k) AS k_display, coalesce(d.export_value, e.export_value, k) AS k_export FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ' ' || upper(n_name) || ' ' WHEN c_custkey % 11 = 0 THEN 'none' ELSE c_nationkey::VARCHAR END AS k FROM customer JOIN nation ON n_nationkey = c_nationkey) c
LEFT JOIN {NATIONS_SQL} d ON d.value = k LEFT JOIN {NATIONS_SQL} e ON lower(e.label) = lower(trim(k))""")
def j1_dict_lookup(t):
    c = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    k = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), F.upper("n_name"), F.lit(" "))).when(F.col("c_custkey") % 11 == 0, "none").otherwise(F.col("c_nationkey").cast("string"))
    return J.dict_lookup(c.select("c_custkey", k.alias("k")), nations(t), "k").select("c_custkey", "k_display", "k_export")


@query(f"SELECT s_suppkey, coalesce(label, 'N/A') AS nation FROM supplier LEFT JOIN {NATIONS_SQL} ON value = (CASE WHEN s_suppkey % 5 = 0 THEN 99 ELSE s_nationkey END)::VARCHAR")
def j2_automatic_column(t):
    s = t("supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 == 0, 99).otherwise(F.col("s_nationkey")).alias("k"))
    return J.automatic_column(s, nations(t), "k", "nation").select("s_suppkey", "nation")


@query(f"""SELECT c_custkey, coalesce(a.label, '') || ', x, ' || coalesce(b.label, '') AS names FROM customer LEFT JOIN {NATIONS_SQL} a ON a.value = c_nationkey::VARCHAR LEFT JOIN {NATIONS_SQL} b ON b.value = ((c_nationkey + 1) % 25)::VARCHAR""")
def j3_list_lookup(t):
    c = t("customer").select("c_custkey", F.concat(F.col("c_nationkey"), F.lit("; x,, "), (F.col("c_nationkey") + 1) % 25).alias("list"))
    return J.list_lookup(c, nations(t), "list", "c_custkey", "names").select("c_custkey", "names")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'kept' ELSE coalesce(n_name, '') END AS target FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20")
def j4_mapping_join(t):
    m = t("nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("source"), F.col("n_name").alias("target"))
    c = t("customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 2 == 0, "kept").otherwise("").alias("target"))
    return J.mapping_join(c.withColumnRenamed("target", "_t"), m, "c_nationkey", "_t").select("c_custkey", F.col("_t").alias("target"))


_ASCII = "[^ -~]"


def _candidates_sql(queries: str, dictionary: str) -> str:
    """CTEs ending in r (k, id, shared, score, place): the candidates of queries (k, text) in a dictionary (k, text)."""
    return f"""q AS {queries}, d AS {dictionary}, qg AS {_grams_sql("k", "q")}, dg AS {_grams_sql("k", "d")}, qn AS (SELECT k, count(*) AS n FROM qg GROUP BY k), dn AS (SELECT k, count(*) AS n FROM dg GROUP BY k),
p AS (SELECT qg.k, dg.k AS id, count(*) AS shared FROM qg JOIN dg USING (gram) GROUP BY 1, 2),
s AS (SELECT p.k, id, length(text) AS len, shared, 2.0 * shared / (qn.n + dn.n) AS score FROM p JOIN qn ON qn.k = p.k JOIN dn ON dn.k = id JOIN q ON q.k = p.k),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, shared DESC, id) AS place FROM s),
r AS (SELECT k, id, shared, score::DOUBLE AS score, place::INTEGER AS place FROM ranked WHERE place <= CASE WHEN len < 30 THEN 500 WHEN len < 60 THEN 300 WHEN len < 150 THEN 60 WHEN len < 300 THEN 30 ELSE 20 END
UNION ALL SELECT q.k, d.k, 0, 0.0::DOUBLE, row_number() OVER (PARTITION BY q.k ORDER BY d.k)::INTEGER FROM q, d WHERE q.k NOT IN (SELECT k FROM p))"""


@query(f"WITH {_candidates_sql('(SELECT doc_id AS k, text FROM documents)', '(SELECT item_id AS k, text FROM benchmark)')} SELECT k AS doc_id, id, shared, score, place FROM r")
def j5_fuzzy_candidates(t):
    return M.fuzzy_candidates(t("documents"), phrases_of(t), "doc_id", "text")


@query(f"""WITH {_candidates_sql(f"(SELECT conv_id || ':' || turn AS k, regexp_replace(text, '{_ASCII}', '', 'g') AS text FROM conversations)", f"(SELECT item_id AS k, regexp_replace(text, '{_ASCII}', '', 'g') AS text FROM benchmark)")}
SELECT r.k AS page, id, levenshtein(q.text, d.text)::INTEGER AS distance, round((greatest(length(q.text), length(d.text)) - levenshtein(q.text, d.text)) / greatest(length(q.text), length(d.text))::DOUBLE * 100, 6) AS similarity
FROM r JOIN q ON q.k = r.k JOIN d ON d.k = r.id QUALIFY row_number() OVER (PARTITION BY r.k ORDER BY levenshtein(q.text, d.text), place) = 1""")
def j6_fuzzy_rerank(t):
    # without other letters, of which DuckDB counts the bytes
    plain = F.regexp_replace("text", _ASCII, "").alias("text")
    turns, phrases = t("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("page"), plain), phrases_of(t).select("id", plain)
    found = M.fuzzy_rerank(M.fuzzy_candidates(turns, phrases, "page", "text"), turns, phrases, "page", "text")
    return found.where("rank = 1").select("page", "id", "distance", F.round("similarity", 6).alias("similarity"))


_MISSPELT_SQL = "CASE WHEN c_custkey % 3 = 0 THEN 'X' || n_name[2:] WHEN c_custkey % 3 = 1 THEN n_name || 'QZ' ELSE n_name END"


@query(f"""WITH c AS (SELECT c_custkey, {_MISSPELT_SQL} AS text, CASE WHEN c_custkey % 2 = 0 THEN 7 END AS k FROM customer JOIN nation ON n_nationkey = c_nationkey),
{_candidates_sql("(SELECT DISTINCT text AS k, text FROM c)", "(SELECT n_nationkey AS k, n_name AS text FROM nation)")},
b AS (SELECT r.k, id, levenshtein(q.text, d.text) AS n, greatest(length(q.text), length(d.text)) AS len FROM r JOIN q ON q.k = r.k JOIN d ON d.k = r.id QUALIFY row_number() OVER (PARTITION BY r.k ORDER BY levenshtein(q.text, d.text), place) = 1)
SELECT c_custkey, coalesce(c.k, CASE WHEN (len - n) / len::DOUBLE * 100 >= 75 THEN id END) AS k FROM c JOIN b ON b.k = c.text""")
def j7_autofill(t):
    # names of nations with other letters, half of the keys already there
    d = t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("text"))
    k = F.col("c_custkey") % 3
    name = F.when(k == 0, F.concat(F.lit("X"), F.expr("substring(n_name, 2)"))).when(k == 1, F.concat("n_name", F.lit("QZ"))).otherwise(F.col("n_name"))
    c = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, 7).cast("int").alias("k"), name.alias("n_name"))
    return M.autofill(c, d, "c_custkey", "k", "n_name", 75.0).select("c_custkey", "k")


@query()
def j8_best_match(t):
    vocabulary = t("benchmark").select("item_id", F.posexplode(X.tokenize(F.col("text"))).alias("at", "word"))
    return M.best_match(M.words_of(t("conversations")), vocabulary.select("word", (F.col("item_id") * (1 << 20) + F.col("at")).alias("n")), order="n")


@query()
def j8_keyed_match(t):
    vocabulary = t("benchmark").select("item_id", F.posexplode(X.tokenize(F.col("text"))).alias("at", "word"))
    return M.best_match(M.words_of(t("documents")), vocabulary.select("word", (F.col("item_id") * (1 << 20) + F.col("at")).alias("n")), order="n", keyed=True)


@query("""SELECT c.conv_id || ':' || c.turn AS seg, item_id AS id, round(100.0::DOUBLE * (length(b.text) - length(b.text) // 9) / length(b.text), 6) AS score FROM conversations c JOIN benchmark b ON item_id = (c.conv_id + c.turn) % 40""")
def j9_align_phrases(t):
    # each turn quotes a phrase with every ninth letter lost: no window holds more of it, and no other phrase is as near
    lost = F.regexp_replace("quoted", r"(?s)(.{8}).", "$1\u25a1")
    quotes = phrases_of(t).select(F.col("id").alias("k"), F.col("text").alias("quoted")).select("k", lost.alias("quoted"))
    c = t("conversations").withColumn("k", (F.col("conv_id") + F.col("turn")) % 40).join(quotes, "k")
    c = c.select(F.concat_ws(":", "conv_id", "turn").alias("seg"), F.concat_ws(" ", "text", "quoted").alias("text"))
    return M.align_phrases(c, phrases_of(t), "seg", "text", cutoff=60.0).select("seg", "id", F.round("score", 6).alias("score"))


@query("""SELECT doc_id, min(item_id) AS id, (min_by(instr(d.text, b.text), item_id) - 1)::INTEGER AS first, 100.0::DOUBLE AS score FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY doc_id""")
def j9_exact_phrases(t):
    # at a cutoff of 100 the best window is the first place of a phrase that the text holds
    found = M.align_phrases(t("documents"), phrases_of(t), "doc_id", "text", cutoff=100.0)
    return found.select("doc_id", "id", F.col("start").alias("first"), "score")


@query("SELECT DISTINCT c_custkey AS project_id FROM customer WHERE c_nationkey = 3 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 25 = 3)")
def j10_accessible_projects(t):
    projects = t("customer").select(F.col("c_custkey").alias("project_id"), F.col("c_nationkey").alias("owner_id"))
    shares = t("orders").select(F.col("o_custkey").alias("project_id"), (F.col("o_orderkey") % 25).alias("user_id"))
    return J.accessible_projects(projects, shares, F.lit(3)).select("project_id")


@query("SELECT o_orderkey AS project_id, c_name AS username FROM orders JOIN customer ON c_custkey = o_custkey")
def j11_shared_users(t):
    users = t("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))
    shares = t("orders").select(F.col("o_orderkey").alias("project_id"), F.col("o_custkey").alias("user_id"))
    return J.shared_users(users, shares).select("project_id", "username")


_REGIONS_SQL = f"""(SELECT page_id, line_no AS region_no, "left" AS rl, top AS rt, "right" + 150 AS rr, bottom + 300 AS rb FROM {BOXES_SQL} WHERE line_no <= 3)"""


@query(f"""WITH j AS (SELECT b.page_id, b.line_no, r.region_no, ("left" + "right") / 2 BETWEEN rl AND rr AND (top + bottom) / 2 BETWEEN rt AND rb AS i, power((rl + rr) / 2 - ("left" + "right") / 2, 2) + power((rt + rb) / 2 - (top + bottom) / 2, 2) AS d
FROM {BOXES_SQL} b JOIN {_REGIONS_SQL} r USING (page_id)) SELECT page_id, line_no, region_no FROM j QUALIFY row_number() OVER (PARTITION BY page_id, line_no ORDER BY NOT i, CASE WHEN i THEN 0 ELSE d END, region_no) = 1""")
def j12_assign_region(t):
    b = boxes_of(t)
    return L.assign_region(b, regions_of(t), ["page_id"]).select("page_id", "line_no", "region_no")


def regions_of(t) -> DataFrame:
    return boxes_of(t).where("line_no <= 3").select("page_id", F.col("line_no").alias("region_no"), "left", "top", (F.col("right") + 150).alias("right"), (F.col("bottom") + 300).alias("bottom"))


@query(f"""WITH p AS (SELECT l_orderkey AS k, l_linenumber AS page_id, (l_linenumber - 1) * 3000 AS a, l_linenumber * 3000 AS b FROM {LINES_SQL}),
s AS (SELECT l_orderkey AS k, (l_linenumber - 1) * 2500 AS s, (l_linenumber - 1) * 2500 + 2000 AS e FROM {LINES_SQL})
SELECT k AS project_id, s::BIGINT AS seg_start, e::BIGINT AS seg_end, min(page_id) AS from_page, max(page_id) AS to_page FROM s JOIN p USING (k) WHERE a < e AND b > s GROUP BY ALL""")
def j13_segment_pages(t):
    n = F.col("l_linenumber").cast("long")
    li = lines_of(t).select(F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").alias("page_id"), n.alias("n"))
    pages = li.select("project_id", "page_id", ((F.col("n") - 1) * 3000).alias("page_start"), (F.col("n") * 3000).alias("page_end"))
    segments = li.select("project_id", ((F.col("n") - 1) * 2500).alias("seg_start"), ((F.col("n") - 1) * 2500 + 2000).alias("seg_end"))
    return J.segment_pages(segments, pages, ["project_id"])


@query("SELECT doc_id AS page_id, md5(CASE WHEN doc_id % 3 = 0 THEN 'fixed' ELSE text END) AS text FROM documents")
def j14_overlay_corrections(t):
    d = t("documents").select(F.col("doc_id").alias("page_id"), "text")
    k = F.col("page_id") % 3
    fixes = d.select("page_id", F.when(k == 0, "fixed").when(k == 1, " ").otherwise("broken").alias("fixed"), F.when(k == 2, "timeout").alias("error"))
    return T.overlay_corrections(d, fixes).select("page_id", F.md5("text").alias("text"))


@query("SELECT c_custkey, 'k' AS \"column\", c_nationkey::VARCHAR AS value FROM customer WHERE c_nationkey >= 20")
def j15_reference_violations(t):
    d = nations(t).where("cast(value as int) < 20")
    return J.reference_violations(t("customer").select("c_custkey", F.col("c_nationkey").alias("k")), d, "c_custkey", "k")


# ---- aggregations ---------------------------------------------------------------------------------------------------


@query(f"""WITH c AS (SELECT project_id, count(*) AS n, count(*) FILTER (text <> '') AS d, min_by(name, page_id) AS f FROM {PAGES_SQL} GROUP BY 1)
SELECT project_id, n AS image_count, d AS transcribed_count, f AS first_image, project_id % 2 = 0 AS is_owner, CASE WHEN project_id % 3 = 0 THEN 'completed' ELSE 'running' END AS job_status,
CASE WHEN project_id % 2 = 0 THEN (project_id % 7) || ',' || (project_id % 7 + 10) END AS shared FROM c""")
def a1_project_rollup(t):
    r = rollup_of(t)
    return r.select("project_id", "image_count", "transcribed_count", "first_image", "is_owner", "job_status", F.array_join(F.transform("shared_with", lambda x: x.cast("string")), ",").alias("shared"))


def rollup_of(t) -> DataFrame:
    pages = pages_of(t)
    ids = pages.select("project_id").distinct()
    projects = ids.select("project_id", (F.col("project_id") % 2).alias("owner_id"), F.when(F.col("project_id") % 4 < 2, "iiif").otherwise("files").alias("type"), F.lit("http://x").alias("iiif_url"))
    a, b = (ids.select("project_id", (F.col("project_id") % 7 + k).alias("user_id")) for k in (0, 10))
    jobs = ids.select("project_id", F.when(F.col("project_id") % 3 == 0, "completed").otherwise("running").alias("status"), F.lit(1).alias("current"), F.lit(2).alias("total"))
    return P.project_rollup(projects, pages, a.union(b), jobs, F.lit(0))


@query("SELECT DISTINCT conv_id AS project_id, true AS pick FROM conversations")
def p7_eligible_projects(t):
    return P.eligible_projects(rollup_of(t)).select("project_id", F.lit(True).alias("pick"))


@query(r"""WITH w AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS word FROM benchmark),
c AS (SELECT word, count(*) AS popularity, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS ids FROM w GROUP BY word) SELECT word, row_number() OVER (ORDER BY word) AS token_id, popularity, ids FROM c""")
def a2_concordance(t):
    return M.concordance(phrases_of(t)).select("word", F.col("token_id").cast("long"), "popularity", F.array_join(F.transform("phrase_ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(r"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM benchmark), u AS (SELECT item_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
n AS (SELECT word, row_number() OVER (ORDER BY word) AS id FROM (SELECT DISTINCT word FROM u)) SELECT item_id AS id, string_agg(n.id::VARCHAR, ' ' ORDER BY i) AS tokens FROM u JOIN n USING (word) GROUP BY item_id""")
def a3_phrase_tokens(t):
    p = phrases_of(t)
    return M.phrase_tokens(p, M.concordance(p)).select("id", F.array_join(F.transform("tokens", lambda x: x.cast("string")), " ").alias("tokens"))


@query(f"SELECT gram, count(*) AS entries FROM {_grams_sql('item_id', 'benchmark')} GROUP BY gram")
def a4_ngram_index(t):
    return M.ngram_index(phrases_of(t))[0].groupBy("gram").agg(F.count("*").alias("entries"))


@query(f"""SELECT l_orderkey AS g, min(l_linenumber) AS n, string_agg(l_returnflag, ' ' ORDER BY l_linenumber) AS text, min_by(l_suppkey, l_linenumber) AS l_suppkey, min(l_linenumber) AS from_page, max(l_linenumber) AS to_page
FROM {LINES_SQL} GROUP BY l_orderkey""")
def a5_merge_rows(t):
    li = lines_of(t).select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("text"), "l_suppkey", F.col("l_linenumber").alias("page"))
    return T.merge_rows(li, ["g"], "n", "text", page="page").drop("page")


@query(rf"""SELECT matched, count(*) AS hits, {RULES_SQL}[matched] AS replacement FROM (SELECT unnest({_TOKENS_SQL}) AS matched FROM documents) WHERE {RULES_SQL}[matched] IS NOT NULL GROUP BY matched""")
def a6_rule_hits(t):
    return E.rule_hits(t("documents"), RULES).select("matched", "hits", "replacement")


@query(rf"""SELECT matched, count(*) AS hits FROM (SELECT unnest({_TOKENS_SQL}) AS matched FROM benchmark) WHERE {RULES_SQL}[matched] IS NOT NULL AND matched <> 'of' GROUP BY matched""")
def a7_false_positive_audit(t):
    return E.false_positive_audit(t("benchmark"), RULES, ignore=("of",)).select("matched", "hits")


@query("""WITH r AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'raw' ELSE event_type END AS label, value FROM events), s AS (SELECT label, avg(value) AS v, count(*) AS n FROM r GROUP BY label)
SELECT label, round(v, 6) AS similarity, n, round(v - (SELECT v FROM s WHERE label = 'raw'), 6) AS sim_delta FROM s""")
def a8_eval_summary(t):
    r = t("events").select(F.when(F.col("user_id") % 3 == 0, "raw").otherwise(F.col("event_type")).alias("label"), *(F.col("value").alias(c) for c in ("similarity", "wer", "seconds", "prompt_tokens", "echo")))
    return E.eval_summary(r).select("label", F.round("similarity", 6).alias("similarity"), "n", F.round("sim_delta", 6).alias("sim_delta"))


@query("""SELECT coalesce(user_id::VARCHAR, 'MEAN') AS example, round(avg(value), 6) AS sim_before, round(avg(value * 2), 6) AS sim_after, round(avg(value * 2) - avg(value), 6) AS sim_delta FROM events GROUP BY ROLLUP (user_id)""")
def a9_before_after(t):
    e = t("events").select(F.col("user_id").alias("n"), F.col("value").alias("sim_before"), (F.col("value") * 2).alias("sim_after"), F.col("value").alias("wer_before"), F.col("value").alias("wer_after"))
    return E.before_after(e).select("example", *(F.round(c, 6).alias(c) for c in ("sim_before", "sim_after", "sim_delta")))


@query(f"SELECT l_orderkey AS row, l_returnflag AS \"column\", max(l_linenumber::VARCHAR) AS message FROM {LINES_SQL} GROUP BY 1, 2")
def a10_validation_summary(t):
    errors = lines_of(t).select(F.col("l_orderkey").alias("row"), F.col("l_returnflag").alias("column"), F.col("l_linenumber").cast("string").alias("message"))
    return C.validation_summary(errors, "row")[0]


@query(f"""SELECT page_id, coalesce(median(bottom - top) FILTER (bottom > top), 1.0)::DOUBLE AS height FROM {BOXES_SQL} GROUP BY page_id""")
def a11_line_height_median(t):
    return L.line_height_median(boxes_of(t), ["page_id"])


@query("SELECT page_id, lang, count(*) OVER (PARTITION BY lang) AS label_count FROM (SELECT doc_id AS page_id, lang FROM documents)")
def a12_label_counts(t):
    d = t("documents").select(F.col("doc_id").alias("page_id"), "lang", F.lit(1).alias("m"))
    return T.label_counts(d, ["m"], "lang").drop("m")


@query(f"""SELECT project_id, count(*) = count(s) AS complete, coalesce(bool_and(s = floor(s)), true) AS integral, count(s) = count(DISTINCT s) AS "unique"
FROM (SELECT project_id, CASE WHEN supp % 29 = 0 THEN seq + 0.5 ELSE seq END::DOUBLE AS s FROM {ROWS_SQL}) GROUP BY project_id""")
def a13_sequence_quality(t):
    # some numbers are not whole
    seq = F.when(F.col("supp") % 29 == 0, F.col("seq") + 0.5).otherwise(F.col("seq")).cast("double")
    return T.sequence_quality(rows_of(t).withColumn("seq", seq))


# ---- ordered rows ---------------------------------------------------------------------------------------------------



#: Ranges that a scan of one group is cut into.
PARTS = 16


@query(f"""SELECT supp, row_id, row_number() OVER (ORDER BY seq NULLS LAST, supp, row_id) AS seq FROM {ROWS_SQL}""")
def w1_one_project(t):
    # all rows are one project's
    rows = rows_of(t).withColumn("project_id", F.lit(1)).withColumn("pos", F.struct("supp", "row_id"))
    return T.renumber(rows, preserve=True, parts=PARTS).select("supp", "row_id", "seq")


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents), u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w)
SELECT doc_id AS row_id, md5(string_agg(word || row, ' ' ORDER BY i)) AS words FROM (SELECT *, row_number() OVER (ORDER BY doc_id, i) AS row FROM u) GROUP BY doc_id""")
def w4_one_project(t):
    rows = T.numbered_texts(t("documents").select(F.lit(1).alias("project_id"), F.col("doc_id").alias("row_id"), "text"), PARTS)
    listed = F.array_join(F.transform("words", lambda x: F.concat(x["word"], x["word_no"])), " ")
    return rows.select("row_id", F.md5(listed).alias("words"))


@query("""WITH b AS (SELECT *, conv_id * 100 + turn AS pos FROM conversations), s AS (SELECT *, coalesce(CASE WHEN lag(pos) OVER w <> pos AND NOT lag(role = 'user') OVER w THEN 0 END, 1) AS s FROM b WINDOW w AS (ORDER BY pos)),
r AS (SELECT *, sum(s) OVER (ORDER BY pos) AS r FROM s) SELECT min(pos) AS seq, md5(string_agg(text, '' ORDER BY pos)) AS text, min(pos) AS from_page, max(pos) AS to_page FROM r GROUP BY r""")
def w8_one_project(t):
    at = F.col("conv_id") * 100 + F.col("turn")
    c = t("conversations").select(F.lit(1).alias("project_id"), at.alias("seq"), at.alias("page"), F.when(F.col("role") == "user", "x⏎").otherwise("x").alias("page_text"), "text")
    return T.stitch_pages(c, ["project_id"], "seq", "page", "page_text", parts=PARTS).select("seq", F.md5("text").alias("text"), "from_page", "to_page")


@query("""WITH l AS (SELECT event_id AS n, CASE WHEN event_id % 3 = 0 THEN event_type || 'a' ELSE ' ' || user_id || 'b' END AS t, event_id % 3 = 0 AS h FROM events),
s AS (SELECT *, CASE WHEN coalesce(lag(h) OVER (ORDER BY n), false) THEN 0 ELSE 1 END AS f FROM l), g AS (SELECT *, sum(f) OVER (ORDER BY n) AS r FROM s)
SELECT min(n) AS n, string_agg(CASE WHEN f = 1 THEN t ELSE ltrim(t) END, '' ORDER BY n) AS text FROM g GROUP BY r""")
def w9_one_project(t):
    text = F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit("a¬ "))).otherwise(F.concat(F.lit(" "), "user_id", F.lit("b")))
    return T.dehyphenate(t("events").select(F.lit(1).alias("k"), F.col("event_id").alias("n"), text.alias("text")), ["k"], "n", parts=PARTS).select("n", "text")


@query("""WITH e AS (SELECT event_id AS x, value > 20 AS a FROM events), s AS (SELECT *, CASE WHEN lag(a) OVER (ORDER BY x) = a THEN 0 ELSE 1 END AS f FROM e),
r AS (SELECT *, sum(f) OVER (ORDER BY x) AS k, max(x) OVER () + 1 AS last FROM s), u AS (SELECT k, a, last, min(x) AS x FROM r GROUP BY k, a, last HAVING count(*) >= 3)
SELECT x AS start, coalesce(lead(x) OVER (ORDER BY x), last) AS "end", a AS above FROM u""")
def w12_one_line(t):
    e = t("events").select(F.lit(1).alias("g"), "event_id", "value")
    return T.threshold_runs(e, ["g"], "event_id", "value", 20.0, 3, parts=PARTS).drop("g")

@query(f"""WITH q AS (SELECT *, count(seq) OVER p = count(*) OVER p AND count(DISTINCT seq) OVER p = count(*) OVER p AS fine, row_number() OVER (PARTITION BY project_id ORDER BY seq NULLS LAST, row_id) AS n FROM {ROWS_SQL} WINDOW p AS (PARTITION BY project_id))
SELECT project_id, row_id, CASE WHEN fine THEN seq ELSE n END AS seq FROM q""")
def w1_renumber(t):
    return T.renumber(rows_of(t), pos="row_id", preserve=True).select("project_id", "row_id", "seq")


@query(f"""WITH u AS (SELECT project_id, row_id, seq, 1 AS o FROM {ROWS_SQL} UNION ALL SELECT DISTINCT user_id, -1, 2, 0 FROM events)
SELECT project_id, row_id, row_number() OVER (PARTITION BY project_id ORDER BY seq NULLS LAST, o, row_id) AS seq FROM u""")
def w2_insert_rows(t):
    new = t("events").select(F.col("user_id").alias("project_id")).distinct().select("project_id", F.lit(-1).cast("long").alias("row_id"), F.lit(2).cast("long").alias("seq"))
    rows = rows_of(t).select("project_id", "row_id", "seq")
    return T.insert_rows(rows, new, tie="row_id")


@query("""WITH d AS (SELECT doc_id, text, instr(text, 'the') AS pos FROM documents), p AS (
SELECT doc_id, 1 AS i, trim(substring(text, 1, pos - 1), ' ' || chr(10)) AS t FROM d WHERE pos > 0 UNION ALL SELECT doc_id, 2, 'the' FROM d WHERE pos > 0 UNION ALL SELECT doc_id, 3, trim(substring(text, pos + 3), ' ' || chr(10)) FROM d WHERE pos > 0 UNION ALL SELECT doc_id, 1, text FROM d WHERE pos = 0)
SELECT doc_id AS row_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS seq, md5(t) AS text FROM p WHERE t <> ''""")
def w3_split_rows(t):
    d = t("documents").select(F.col("doc_id").alias("project_id"), F.col("doc_id").alias("row_id"), F.lit(1).cast("long").alias("seq"), "text")
    return T.split_rows(d, d.select("row_id", F.lit("the").alias("selected"))).select("row_id", "seq", F.md5("text").alias("text"))


@query(r"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM conversations), u AS (SELECT conv_id, turn, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w)
SELECT conv_id AS project_id, turn AS row_id, word, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS word_no FROM u""")
def w4_number_words(t):
    return T.number_words(t("conversations").select(F.col("conv_id").alias("project_id"), F.col("turn").alias("row_id"), "text"))


@query()
def w5_merge_split_words(t):
    c = t("conversations").select(F.col("conv_id").alias("project_id"), F.col("turn").alias("row_id"), "text")
    vocabulary = t("benchmark").select(F.explode(X.tokenize(F.col("text"))).alias("word")).distinct()
    return M.merge_split_words(T.number_words(c).select("project_id", "word_no", "word"), vocabulary, ["project_id"])


#: Marker rows (turn % 4 = 0) joined with the row after them.
_MARKERS_SQL = """m AS (SELECT conv_id AS project_id, turn::INTEGER AS seq, CASE WHEN turn % 4 <> 0 THEN text ELSE '' END AS text, CASE WHEN turn % 4 = 0 THEN role END AS function_id,
  CASE WHEN turn % 4 = 1 THEN role END AS subrubric, CASE WHEN turn % 4 = 2 THEN 'R' || turn END AS rubric, CASE WHEN turn % 4 = 2 THEN turn::VARCHAR END AS rubric_id FROM conversations),
l AS (SELECT *, function_id IS NOT NULL AND lead(seq) OVER w IS NOT NULL AS leads FROM m WINDOW w AS (PARTITION BY project_id ORDER BY seq)),
f AS (SELECT *, coalesce(lag(leads) OVER (PARTITION BY project_id ORDER BY seq), false) AS follows FROM l),
g AS (SELECT *, sum(CASE WHEN follows THEN 0 ELSE 1 END) OVER (PARTITION BY project_id ORDER BY seq) AS n FROM f),
j AS (SELECT project_id, min(seq) AS seq, coalesce(string_agg(text, ' ' ORDER BY seq) FILTER (trim(text, ' ' || chr(10)) <> ''), '') AS text, NULL::VARCHAR AS ident, min(function_id) AS function_id, NULL::VARCHAR AS subfunction_id,
  min(subrubric) AS subrubric, min(rubric) AS rubric, min(rubric_id) AS rubric_id FROM g GROUP BY project_id, n)"""


@query(f"WITH {_MARKERS_SQL} SELECT * FROM j")
def w6_merge_markers(t):
    return T.merge_markers(markers_of(t), ["function_id"], ["project_id"], "seq", "text", "ident")


def markers_of(t) -> DataFrame:
    k = F.col("turn") % 4
    return t("conversations").select(
        F.col("conv_id").alias("project_id"), F.col("turn").cast("int").alias("seq"), F.when(k != 0, F.col("text")).otherwise("").alias("text"), F.lit("").alias("ident"),
        F.when(k == 0, F.col("role")).alias("function_id"), F.lit(None).cast("string").alias("subfunction_id"), F.when(k == 1, F.col("role")).alias("subrubric"),
        F.when(k == 2, F.concat(F.lit("R"), "turn")).alias("rubric"), F.when(k == 2, F.col("turn").cast("string")).alias("rubric_id"),
    )


@query(f"""WITH {_MARKERS_SQL}, r AS (SELECT *, last_value(rubric IGNORE NULLS) OVER w AS name, last_value(rubric_id IGNORE NULLS) OVER w AS id FROM j WINDOW w AS (PARTITION BY project_id ORDER BY seq))
SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY seq)::INTEGER AS seq, text, ident, function_id, subfunction_id, subrubric, coalesce(rubric, name) AS rubric, coalesce(rubric_id, id) AS rubric_id FROM r WHERE trim(text, ' ' || chr(10)) <> ''""")
def w7_propagate(t):
    return T.propagate(markers_of(t), ["project_id"], "seq", "text", "ident")


@query("""WITH b AS (SELECT *, coalesce(CASE WHEN lag(turn) OVER w <> turn AND NOT lag(role = 'user') OVER w THEN 0 END, 1) AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT conv_id AS project_id, min(turn) AS seq, md5(string_agg(text, '' ORDER BY turn)) AS text, min(turn) AS from_page, max(turn) AS to_page FROM g GROUP BY conv_id, k""")
def w8_stitch_pages(t):
    c = t("conversations").select(F.col("conv_id").alias("project_id"), F.col("turn").alias("seq"), F.col("turn").alias("page"), F.when(F.col("role") == "user", "x⏎").otherwise("x").alias("page_text"), "text")
    return T.stitch_pages(c, ["project_id"], "seq", "page", "page_text").withColumn("text", F.md5("text"))


@query(f"""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_partkey % 3 = 0 THEN l_returnflag || 'a' ELSE ' ' || l_linestatus || 'b' END AS t, l_partkey % 3 = 0 AS h FROM {LINES_SQL}),
s AS (SELECT *, CASE WHEN coalesce(lag(h) OVER w, false) THEN 0 ELSE 1 END AS f FROM l WINDOW w AS (PARTITION BY k ORDER BY n)), g AS (SELECT *, sum(f) OVER (PARTITION BY k ORDER BY n) AS r FROM s)
SELECT k, min(n) AS n, string_agg(CASE WHEN f = 1 THEN t ELSE ltrim(t) END, '' ORDER BY n) AS text FROM g GROUP BY k, r""")
def w9_dehyphenate(t):
    text = F.when(F.col("l_partkey") % 3 == 0, F.concat("l_returnflag", F.lit("a¬ "))).otherwise(F.concat(F.lit(" "), "l_linestatus", F.lit("b")))
    return T.dehyphenate(lines_of(t).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), text.alias("text")), ["k"], "n")


@query(f"""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_returnflag = 'N' THEN 'red' ELSE 'black' END AS c, l_partkey::VARCHAR AS t FROM {LINES_SQL}),
s AS (SELECT *, CASE WHEN lag(c) OVER w = c THEN 0 ELSE 1 END AS f FROM l WINDOW w AS (PARTITION BY k ORDER BY n)), g AS (SELECT *, sum(f) OVER (PARTITION BY k ORDER BY n) AS r FROM s),
u AS (SELECT k, r, CASE WHEN c = 'red' THEN '<red> ' || string_agg(t, ' ' ORDER BY n) || '</red>' ELSE string_agg(t, ' ' ORDER BY n) END AS t FROM g GROUP BY k, r, c)
SELECT k, string_agg(t, ' ' ORDER BY r) AS text FROM u GROUP BY k""")
def w10_tag_color_runs(t):
    color = F.when(F.col("l_returnflag") == "N", "red").otherwise("black")
    return T.tag_color_runs(lines_of(t).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), color.alias("color"), F.col("l_partkey").cast("string").alias("text")), ["k"], ["n"])


@query("""SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 40 PRECEDING AND 39 FOLLOWING) / least(80, count(*) OVER (PARTITION BY user_id)) + 1e-9, 3) AS average FROM events""")
def w11_moving_average(t):
    e = t("events").select("user_id", "event_id", "value")
    return T.moving_average(e, ["user_id"], "event_id", "value", 80).select("user_id", "event_id", F.round(F.col("average") + 1e-9, 3).alias("average"))


@query("""WITH e AS (SELECT user_id % 10 AS g, event_id AS x, value > 20 AS a FROM events), s AS (SELECT *, CASE WHEN lag(a) OVER w = a THEN 0 ELSE 1 END AS f FROM e WINDOW w AS (PARTITION BY g ORDER BY x)),
r AS (SELECT *, sum(f) OVER (PARTITION BY g ORDER BY x) AS k, max(x) OVER (PARTITION BY g) + 1 AS last FROM s), u AS (SELECT g, k, a, last, min(x) AS x FROM r GROUP BY g, k, a, last HAVING count(*) >= 3)
SELECT g, x AS start, coalesce(lead(x) OVER (PARTITION BY g ORDER BY x), last) AS "end", a AS above FROM u""")
def w12_threshold_runs(t):
    e = t("events").select((F.col("user_id") % 10).alias("g"), "event_id", "value")
    return T.threshold_runs(e, ["g"], "event_id", "value", 20.0, 3)


@query(f"""SELECT l_orderkey, l_linenumber AS page_no, CASE WHEN count(*) OVER (PARTITION BY l_orderkey, l_returnflag) > 1 THEN l_returnflag || '_' || row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) ELSE l_returnflag END AS label FROM {LINES_SQL}""")
def w13_unique_labels(t):
    return T.unique_labels(lines_of(t).select("l_orderkey", F.col("l_linenumber").alias("page_no"), F.col("l_returnflag").alias("label")), ["l_orderkey"])


@query(f"SELECT project_id, row_id, seq FROM {ROWS_SQL} WHERE seq IS NOT NULL QUALIFY count(*) OVER (PARTITION BY project_id, seq) > 1")
def w14_sequence_conflicts(t):
    return T.sequence_conflicts(rows_of(t)).select("project_id", "row_id", "seq")


_ROWS_OF_BOXES = f"""h AS (SELECT page_id, coalesce(median(bottom - top) FILTER (bottom > top), 1.0) AS height FROM {BOXES_SQL} GROUP BY page_id), b AS (SELECT *, (top + bottom) / 2 AS y FROM {BOXES_SQL} JOIN h USING (page_id)),
s AS (SELECT *, CASE WHEN y - lag(y) OVER w > greatest(1.0, 0.55 * height) THEN 1 ELSE 0 END AS f FROM b WINDOW w AS (PARTITION BY page_id ORDER BY y, line_no)), r AS (SELECT *, sum(f) OVER (PARTITION BY page_id ORDER BY y, line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS row_no FROM s)"""


@query(f"WITH {_ROWS_OF_BOXES} SELECT page_id, line_no, row_no FROM r")
def w15_cluster_rows(t):
    return L.cluster_rows(boxes_of(t), ["page_id"]).select("page_id", "line_no", "row_no")


@query(f"""WITH {_ROWS_OF_BOXES}, m AS (SELECT * FROM r WHERE "right" - "left" <= 600 QUALIFY count(*) OVER (PARTITION BY page_id, row_no) > 1),
i AS (SELECT *, max("right") OVER (PARTITION BY page_id ORDER BY "left", line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m)
SELECT page_id, line_no, sum(CASE WHEN "left" >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY "left", line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS band_no FROM i""")
def w16_interval_bands(t):
    return L.interval_bands(L.cluster_rows(boxes_of(t), ["page_id"]), ["page_id"]).select("page_id", "line_no", "band_no")


@query()
def w17_w18_reading_order(t):
    return L.reading_order(columns_of(t), ["page_id"])


def columns_of(t) -> DataFrame:
    """Two columns of events of a user, some of them over both."""
    n = F.col("event_id") % 40
    left = F.when(n % 2 == 0, 60).otherwise(520).cast("double")
    return t("events").select(
        F.col("user_id").alias("page_id"), F.col("event_id").alias("line_no"), left.alias("left"), (100 + F.floor(n / 2) * 30).cast("double").alias("top"),
        F.when(n % 13 == 0, 920.0).otherwise(left + 380 + n % 20).alias("right"), (120 + F.floor(n / 2) * 30).cast("double").alias("bottom"), F.lit(1000.0).alias("page_w"),
    )


@query()
def w19_xy_cut_order(t):
    return L.xy_cut_order(regions_of(t), ["page_id"])


@query()
def w20_order_by_region(t):
    return L.order_by_region(boxes_of(t), regions_of(t), ["page_id"]).select("page_id", "line_no", "position")


# ---- order and sets -------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders)
SELECT o_custkey, o_orderkey, place::INTEGER AS place FROM s WHERE place <= CASE WHEN o_custkey % 400 < 30 THEN 500 WHEN o_custkey % 400 < 60 THEN 300 WHEN o_custkey % 400 < 150 THEN 60 WHEN o_custkey % 400 < 300 THEN 30 ELSE 20 END""")
def o1_top_k_rows(t):
    # a customer's dearest orders, as many as a text of so many characters would keep
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = t("orders").withColumn("place", F.row_number().over(w))
    return o.where(F.col("place") <= M.adaptive_k(F.col("o_custkey") % 400)).select("o_custkey", "o_orderkey", "place")


@query("SELECT p_partkey, CASE WHEN length(p_name) * 10 < 30 THEN 500 WHEN length(p_name) * 10 < 60 THEN 300 WHEN length(p_name) * 10 < 150 THEN 60 WHEN length(p_name) * 10 < 300 THEN 30 ELSE 20 END::INTEGER AS k FROM part")
def o1_top_k_adaptive(t):
    return t("part").select("p_partkey", M.adaptive_k(F.length("p_name") * 10).alias("k"))


@query("SELECT value, label FROM " + NATIONS_SQL)
def o2_order_by_label(t):
    return J.order_by_label(nations(t)).select("value", "label")


@query(f"SELECT project_id, page_id FROM {PAGES_SQL} QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY page_id) BETWEEN 2 AND 3")
def o3_page_slice(t):
    return T.page_slice(pages_of(t), 2, 3).select("project_id", "page_id")


@query("SELECT c_custkey AS project_id FROM customer WHERE c_nationkey < 5 UNION SELECT o_custkey FROM orders")
def x1_union_ids(t):
    return J.union_ids(t("customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("project_id")), t("orders").select(F.col("o_custkey").alias("project_id")))


@query("""WITH cur AS (SELECT o_orderkey AS p, o_custkey AS u FROM orders), want AS (SELECT o_orderkey AS p, o_custkey + o_orderkey % 2 AS u FROM orders), own AS (SELECT o_orderkey AS p, o_orderkey % 100 AS u FROM orders)
SELECT p AS project_id, u AS user_id, 'add' AS action FROM (SELECT * FROM want WHERE u IN (SELECT c_custkey FROM customer) EXCEPT SELECT * FROM cur EXCEPT SELECT * FROM own) UNION ALL SELECT p, u, 'remove' FROM (SELECT * FROM cur EXCEPT SELECT * FROM want)""")
def x2_share_diff(t):
    o = t("orders")
    pair = lambda u: o.select(F.col("o_orderkey").alias("project_id"), u.cast("long").alias("user_id"))
    projects = o.select(F.col("o_orderkey").alias("project_id"), (F.col("o_orderkey") % 100).alias("owner_id"))
    return J.share_diff(pair(F.col("o_custkey")), pair(F.col("o_custkey") + F.col("o_orderkey") % 2), t("customer").select(F.col("c_custkey").alias("user_id")), projects)


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'delete' ELSE 'update' END AS action FROM orders WHERE o_orderkey % 4 < 3""")
def x3_content_diff(t):
    o, k = t("orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderkey") % 4
    edited = o.where(k != 1).withColumn("o_orderstatus", F.when(k == 2, "?").otherwise(F.col("o_orderstatus")))
    return J.content_diff(o.where(k != 0), edited, "o_orderkey", ["o_orderstatus"])


# ---- sources and sinks over tables ----------------------------------------------------------------------------------


@query("SELECT event_id AS content_id, user_id AS project_id, event_type AS comments, value AS quire_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence_in_ms FROM events WHERE event_id % 5 <> 0")
def s8_read_content(t):
    obj = F.to_json(F.struct(F.col("event_type").alias("comments"), F.col("value").alias("quire_id")))
    data = F.when(F.col("event_id") % 5 == 0, "[1]").otherwise(obj)
    e = t("events").select(F.col("event_id").alias("content_id"), F.col("user_id").alias("project_id"), data.alias("data"))
    return S.read_content(e, CONTENT).select("content_id", "project_id", "comments", "quire_id", "sequence_in_ms")


@query(f"""SELECT l_orderkey AS manifest_id, row_number() OVER w AS page_no, CASE WHEN count(*) OVER p > 1 THEN l_returnflag || '_' || row_number() OVER (p ORDER BY l_linenumber) ELSE l_returnflag END AS label,
 'http://i/' || l_partkey AS image_url FROM {LINES_SQL} WHERE l_linenumber <> 2 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber), p AS (PARTITION BY l_orderkey, l_returnflag)""")
def s9_flatten_iiif_manifest(t):
    image = F.when(F.col("l_linenumber") != 2, F.struct(F.concat(F.lit("http://i/"), "l_partkey").alias("id"), F.lit("Image").alias("type")))
    note = F.struct(F.lit("Annotation").alias("type"), F.lit("painting").alias("motivation"), image.alias("body"))
    page = F.struct(F.lit("AnnotationPage").alias("type"), F.array(note).alias("items"))
    canvas = F.struct(F.lit("Canvas").alias("type"), F.struct(F.array("l_returnflag").alias("none")).alias("label"), F.array(page).alias("items"))
    made = lines_of(t).groupBy(F.col("l_orderkey").alias("manifest_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", canvas.alias("c")))).alias("x"))
    made = made.select("manifest_id", F.to_json(F.struct(F.transform("x", lambda x: x["c"]).alias("items"))).alias("data"))
    return S.flatten_iiif_manifest(made).select("manifest_id", F.col("page_no").cast("long"), "label", "image_url")


_V2_SQL = f"""SELECT l_orderkey AS manifest_id, row_number() OVER w AS page_no, CASE WHEN l_linenumber % 3 = 0 THEN 'page_' || row_number() OVER w ELSE 'f' || l_linenumber END AS label,
 'http://i/' || l_partkey AS image_url, CASE WHEN l_linenumber % 2 = 0 THEN 'http://s/' || l_partkey END AS service_url FROM {LINES_SQL} WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)"""


def _manifests(t) -> DataFrame:
    # labels are texts, first values of a list, or missing; every second image has a service
    n = F.col("l_linenumber")
    service = F.when(n % 2 == 0, F.struct(F.concat(F.lit("http://s/"), "l_partkey").alias("@id")))
    resource = F.struct(F.concat(F.lit("http://i/"), "l_partkey").alias("@id"), service.alias("service"))
    text = F.to_json(F.struct(F.array(F.struct(resource.alias("resource"))).alias("images")))
    label = F.when(n % 3 == 1, F.concat(F.lit('"label":"f'), n, F.lit('",'))).when(n % 3 == 2, F.concat(F.lit('"label":[{"@value":"f'), n, F.lit('"}],'))).otherwise("")
    canvas = F.concat(F.lit("{"), label, F.substring(text, 2, 1 << 20))
    made = lines_of(t).groupBy(F.col("l_orderkey").alias("manifest_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", canvas.alias("c")))).alias("x"))
    data = F.concat(F.lit('{"sequences":[{"canvases":['), F.array_join(F.transform("x", lambda x: x["c"]), ","), F.lit("]}]}"))
    return made.select("manifest_id", data.alias("data"))


@query(_V2_SQL)
def s9_iiif_version_2(t):
    return S.flatten_iiif_manifest(_manifests(t)).withColumn("page_no", F.col("page_no").cast("long"))


@query(_V2_SQL)
def u4_manifest_pages(t):
    manifests = _manifests(t)
    register(manifests.sparkSession)
    return manifests.sparkSession.sql("SELECT manifest_id, CAST(p.page_no AS LONG) AS page_no, p.label, p.image_url, p.service_url FROM {m} AS m, LATERAL manifest_pages(m.data) AS p", m=manifests)


@query(f"SELECT project_id, 'P' || project_id AS project_name, name AS image_name, md5(text) AS text FROM {PAGES_SQL} WHERE trim(text) <> ''")
def s12_export_transcriptions(t):
    pages = pages_of(t)
    projects = pages.select("project_id").distinct().withColumn("name", F.concat(F.lit("P"), "project_id"))
    return S.export_rows(projects, pages).withColumn("text", F.md5("text"))


@query("SELECT event_id, event_type AS t FROM events")
def s14_export_json(t):
    out = S.export_json(t("events").select("event_id", "event_type"))
    return out.select(X.json_get(F.col("value"), "event_id").cast("long").alias("event_id"), X.json_get(F.col("value"), "event_type").alias("t"))


@query("""SELECT o_orderkey AS row_id, o_custkey AS project_id, CASE WHEN o_orderkey % 3 = 1 THEN 'new' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT -o_orderkey, o_custkey, 'made' FROM orders""")
def s15_apply_changes(t):
    o, k = t("orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("project_id"), F.col("o_orderstatus").alias("s")), F.col("row_id") % 3
    made = o.withColumns({"row_id": -F.col("row_id"), "s": F.lit("made")})
    return J.apply_changes(o, made, o.where(k == 1).withColumn("s", F.lit("new")), o.where(k == 0))


# ---- pipelines ------------------------------------------------------------------------------------------------------


@query()
def c1_segment_by_phrases(t):
    c = t("conversations").select(F.col("conv_id").alias("project_id"), F.col("turn").alias("row_id"), F.col("turn").alias("page_id"), "text")
    return segment_by_phrases(c, phrases_of(t), 80.0)


@query("""SELECT event_id AS pos, 'RISM:' || user_id AS "SOURCE", event_type AS "ITEM", CASE WHEN user_id % 2 = 0 THEN '1r - 2v' ELSE '1r' END AS "PAGE NUMBER (ORIGINAL)", coalesce(n_name, '') AS "GENRE" FROM events LEFT JOIN nation ON n_nationkey = user_id % 50""")
def c2_convert_structure(t):
    e = t("events").select(
        F.col("event_id").alias("pos"), F.col("user_id").cast("string").alias("rism_id"), F.col("event_type").alias("formula_text_from_ms"), F.lit("1r").alias("where_in_ms_from"),
        F.when(F.col("user_id") % 2 == 0, "2v").alias("where_in_ms_to"), (F.col("user_id") % 50).cast("string").alias("function_id"),
    )
    m = t("nation").select(F.col("n_nationkey").cast("string").alias("source"), F.col("n_name").alias("target"))
    out = C.convert_structure(e, "content", "usuarium", {"function_id_to_genre.tsv": m})
    return out.select(F.col("_global_sequence").alias("pos"), "SOURCE", "ITEM", "`PAGE NUMBER (ORIGINAL)`", F.coalesce("GENRE", F.lit("")).alias("GENRE"))


@query("""SELECT o_orderkey AS pos, o_custkey::VARCHAR AS rism_id, o_orderpriority AS formula_text_from_ms, CASE WHEN o_orderkey % 2 = 0 THEN '1r' ELSE '3v' END AS where_in_ms_from,
CASE WHEN o_orderkey % 2 = 0 THEN '2v' ELSE '' END AS where_in_ms_to, o_orderstatus AS comments, coalesce(n_name, '') AS genre, coalesce(n_regionkey::VARCHAR, '') AS function_id
FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 50""")
def c2_usuarium_to_content(t):
    o = t("orders").select(
        F.col("o_orderkey").alias("pos"), F.concat(F.lit("RISM:"), "o_custkey").alias("SOURCE"), F.col("o_orderpriority").alias("ITEM"),
        F.when(F.col("o_orderkey") % 2 == 0, "1r - 2v").otherwise("3v").alias("PAGE NUMBER (ORIGINAL)"), F.col("o_orderstatus").alias("REMARK"), (F.col("o_custkey") % 50).cast("string").alias("GENRE"),
    )
    nation = lambda c: t("nation").select(F.col("n_nationkey").cast("string").alias("source"), F.col(c).cast("string").alias("target"))
    out = C.convert_structure(o, "usuarium", "content", {"genre_to_genre.tsv": nation("n_name"), "genre_to_function_id.tsv": nation("n_regionkey")})
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select(F.col("sequence_in_ms").alias("pos"), "rism_id", "formula_text_from_ms", "where_in_ms_from", *map(text, ("where_in_ms_to",)), "comments", *map(text, ("genre", "function_id")))


@query("""SELECT event_id AS pos, event_type AS formula_text_from_ms, user_id || 'r' AS where_in_ms_from, 'CANTUS:' || event_id AS reference_to_other_items,
coalesce(n_name, '') AS mass_hour, coalesce(r_name, '') AS original_or_added FROM events LEFT JOIN nation ON n_nationkey = user_id % 50 LEFT JOIN region ON r_regionkey = user_id % 10""")
def c2_cantus_to_content(t):
    e = t("events").select(
        F.col("event_id").alias("pos"), F.col("event_type").alias("field_full_text_original"), F.concat("user_id", F.lit("r")).alias("field_folio"), F.col("event_id").cast("string").alias("field_cantus_id"),
        (F.col("user_id") % 50).cast("string").alias("field_office"), (F.col("user_id") % 10).cast("string").alias("field_marginalia"),
    )
    office = t("nation").select(F.col("n_nationkey").cast("string").alias("source"), F.col("n_name").alias("target"))
    margin = t("region").select(F.col("r_regionkey").cast("string").alias("source"), F.col("r_name").alias("target"))
    out = C.convert_structure(e, "cantus", "content", {"cantus_office_to_mass_hour.tsv": office, "cantus_marginalia_to_original_or_added.tsv": margin})
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select(F.col("sequence_in_ms").alias("pos"), "formula_text_from_ms", "where_in_ms_from", "reference_to_other_items", *map(text, ("mass_hour", "original_or_added")))


#: A column that computes its value, two that show theirs otherwise, one with a check of its own.
ORDERS = [
    ColumnSpec("o_orderkey", "Order", "number", shown_as=lambda v: F.concat(F.lit("#"), v.cast("long"))),
    ColumnSpec("o_orderstatus", "Status", check=lambda v: F.when(v == "P", "Must be settled")),
    ColumnSpec("size", "Size", "computed", compute=lambda: F.length("o_orderpriority")),
    ColumnSpec("twice", "Twice", "computed", compute=lambda: F.concat("size", F.lit("/"), F.col("size").cast("int") * 2), shown_as=lambda v: F.concat(F.lit("="), v)),
]


@query("""SELECT '#' || o_orderkey AS o_orderkey, o_orderstatus, length(o_orderpriority)::VARCHAR AS size, '=' || length(o_orderpriority) || '/' || 2 * length(o_orderpriority) AS twice,
CASE WHEN o_orderstatus = 'P' THEN 'Must be settled' END AS message FROM orders""")
def u1_column_callables(t):
    o = computed(t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), ORDERS)
    wrong = C.validate_table(o, ORDERS, {}, "o_orderkey").select(F.col("o_orderkey").alias("k"), "message")
    rows = o.join(wrong, F.col("k") == F.col("o_orderkey"), "left").drop("k", "o_orderpriority")
    return displayed(rows, ORDERS)


@query(f"""WITH r AS {ROWS_SQL}, d AS (SELECT project_id * 10 + row_id AS k, project_id, seq, supp FROM r)
SELECT k, 'sequence_in_ms' AS "column", 'Must not be empty' AS message FROM d WHERE seq IS NULL
UNION ALL SELECT k, 'sequence_in_ms', 'Sequence must be unique' FROM (SELECT * FROM d WHERE seq IS NOT NULL QUALIFY count(*) OVER (PARTITION BY project_id, seq) > 1)
UNION ALL SELECT k, 'layer', 'Not in dictionary: ' || (supp % 40) FROM d WHERE supp % 40 >= 25""")
def c3_validate_table(t):
    r = rows_of(t).select((F.col("project_id") * 10 + F.col("row_id")).alias("k"), "project_id", F.col("seq").alias("sequence_in_ms"), (F.col("supp") % 40).cast("string").alias("layer"))
    return C.validate_table(r, CONTENT, {"layer.tsv": nations(t)}, "k")


@query("""WITH b AS (SELECT conv_id AS project_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page_no, turn, role, text FROM conversations),
r AS (SELECT project_id, page_no, turn, 0 AS i, '' AS text, role AS rubric FROM b UNION ALL SELECT project_id, page_no, turn, 1, text, NULL FROM b WHERE trim(text, ' ' || chr(10)) <> ''),
q AS (SELECT *, lag(page_no) OVER w AS lp, lag(turn) OVER w AS lt FROM r WINDOW w AS (PARTITION BY project_id ORDER BY page_no, i)),
g AS (SELECT *, sum(CASE WHEN lp <> page_no AND lt % 2 = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY project_id ORDER BY page_no, i) AS n FROM q)
SELECT project_id, n::BIGINT AS seq, string_agg(text, '' ORDER BY page_no, i) AS text, min(rubric) AS rubric, NULL::VARCHAR AS function, NULL::VARCHAR AS subrubric, min(page_no)::INTEGER AS from_page, max(page_no)::INTEGER AS to_page FROM g GROUP BY project_id, n""")
def c4_load_transcription(t):
    marked = F.concat(F.lit("<red>"), "role", F.lit("</red>"), "text", F.when(F.col("turn") % 2 == 0, "⏎").otherwise(""))
    return load_transcription(t("conversations").select(F.col("conv_id").alias("project_id"), F.col("turn").alias("page_id"), F.col("role").alias("name"), marked.alias("text")))


@query()
def c5_transcribe_postprocess(t):
    lines = columns_of(t).withColumns({"piece_no": F.lit(1), "color": F.when(F.col("line_no") % 3 == 0, "red").otherwise("black"), "text": F.concat(F.lit("the w"), "line_no")})
    point = lambda x: F.struct(F.col(x).alias("x"), F.col("bottom").alias("y"))
    return transcribe_postprocess(lines.withColumn("baseline", F.array(point("left"), point("right"))), RULES)


@query()
def c6_evaluate_fixes(t):
    d = t("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("n"), F.col("text").alias("ocr"), X.apply_fix_rules(F.col("text"), RULES[:2]).alias("ref"))
    return E.before_after(E.evaluate_fixes(d, RULES))


@query(rf"""SELECT doc_id, md5({FIXED_SQL}) AS text, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 0 ELSE 1 END::INTEGER AS parts FROM documents""")
def t1_fix_pages(t):
    return fix_pages(t("documents").select("doc_id", "text"), RULES).select("doc_id", F.md5("text").alias("text"), F.size("parts").alias("parts"))


@query("SELECT user_id AS project_id, max_by(event_type, ts) AS status, max_by(value, ts) AS progress FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY user_id")
def t2_progress_rollup(t):
    e = t("events").select(F.col("user_id").alias("project_id"), F.struct("ts", "event_id").alias("ts"), F.col("event_type").alias("status"), F.col("value").alias("progress"))
    return P.progress_rollup(e).select("project_id", "status", "progress")
