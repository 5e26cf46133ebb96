"""Golden cases of the text, table, layout, linkage and source operators."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.functions.similarity import adjusted_alignment, alignment, lcs_length, ratio
from folioflow.operators import joins as J
from folioflow.operators import layout as L
from folioflow.operators import match as M
from folioflow.operators import table as T
from folioflow.plans.convert import convert_structure, validate_table
from folioflow.plans.segment import segment_by_phrases
from folioflow.plans.structures import CANTUS, CONTENT, USUARIUM, ColumnSpec, computed, displayed
from folioflow.plans.transcription import load_transcription, transcribe_postprocess
from folioflow.sources import files as S
from folioflow.streaming.stream import stream_fix, stream_progress

RULES = [
    ("colis", "collecta", True),
    ("j", "i", False),
    ("Ps", "Psalmus", True),
    ("Off.", "Offertorium", True),
    ("dees", "deus", True),
    ("des", "deus", True),
    ("deliqu", "derelequ", False),
    ("officialis", "Offertorium", True),
]


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expr(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("Oremus colis Deum", "Oremus collecta Deum"),
        ("discolis", "discolis"),
        ("adjutor meus", "adiutor meus"),
        ("Et in terra pax hominibus", "Et in terra pax hominibus"),
        ("Ps. Off. dees", "Psalmus. Offertorium deus"),
        ("", ""),
        (None, None),
        ("<red>Off.</red> dees <func>Ps</func>", "<red>Offertorium</red> deus <func>Psalmus</func>"),
        ("des", "deus"),
        ("deliquit", "derelequit"),
        ("officialis", "Offertorium"),
        ("<subrub>j</subrub>", "<subrub>i</subrub>"),
    ],
)
def test_fix_rules(spark, before, after):
    assert one(spark, lambda c: X.apply_fix_rules(c, RULES), before) == after


def test_contradicting_rules():
    with pytest.raises(ValueError):
        X.fix_pattern([("a", "b", True), ("a", "c", True)])


def test_markup(spark):
    parts = lambda t: [tuple(p) for p in one(spark, X.parse_markup, t)]
    assert parts("abc <red>Rubr</red> text⏎<func>F</func>z") == [("text", "abc "), ("rubric", "Rubr"), ("text", " text"), ("function", "F"), ("text", "z")]
    assert parts("a <red>open rest") == [("text", "a ")]
    assert parts("1 < 2 <subrub> s </subrub>") == [("text", "1 < 2 "), ("subrubric", "s")]
    assert parts(" \n") == [] and parts(None) == []


def test_scalars(spark):
    assert one(spark, X.ngrams, " ab  cd ") == ["ab ", "b c", " cd"]
    assert one(spark, X.ngrams, "ab") == []
    assert tuple(one(spark, X.cut_on_space, "abc def ghi")) == ("abc", " def ghi")
    assert one(spark, X.decode_byte_tokens, "x<0xC3><0xA9>y<0xFF>") == "xéy<0xFF>"
    assert one(spark, lambda c: X.occurrences(c, "ab"), "abcabxab") == [0, 3, 6]
    assert one(spark, lambda c: X.word_error_rate(X.tokenize(c), X.tokenize(F.lit("a x c"))), "a b c d") == 0.5
    assert one(spark, X.html_to_tags, "<strong>x</strong><div>y</div>&nbsp;z") == "<red>x</red>\ny z"
    assert one(spark, X.normalise_words, "<red>Jvaey</red>, y.") == ["iuei", "i"]
    assert one(spark, lambda c: X.sanitize_label(c, F.lit(3)), "?!") == "page_3"
    assert [one(spark, X.is_folio, v) for v in ("12", "12.1", "3r", "x", None)] == [True, True, True, False, True]
    assert lcs_length("abcbdab", "bdcaba") == 4 and ratio("", "") == 100.0
    assert alignment("needle", "find the needle here")[:2] == (9, 15)


def test_lines_and_colours(spark):
    lines = spark.createDataFrame([(1, 1, "domi¬ "), (1, 2, "  ne deus"), (1, 3, "pax"), (2, 1, "fine¬")], "k int, n int, text string")
    assert sorted((r.k, r.n, r.text) for r in T.dehyphenate(lines, ["k"], "n").collect()) == [(1, 1, "domine deus"), (1, 3, "pax"), (2, 1, "fine")]
    runs = spark.createDataFrame([(1, i, c, t) for i, (c, t) in enumerate([("black", "a"), ("black", "b"), ("red", "c"), ("red", "d"), ("black", "e")])], "k int, n int, color string, text string")
    assert T.tag_color_runs(runs, ["k"], ["n"]).first()["text"] == "a b <red> c d</red> e"


def test_page_breaks(spark):
    pages = spark.createDataFrame([(1, 1, "a", "one"), (1, 2, "b", "two⏎"), (1, 3, "c", "three"), (2, 1, "d", "")], "project_id long, page_id long, name string, text string")
    got = sorted((r.project_id, r.seq, r.text, r.from_page, r.to_page) for r in load_transcription(pages).collect())
    assert got == [(1, 1, "onetwo", 1, 2), (1, 2, "three", 3, 3)]
    assert load_transcription(pages, CONTENT).columns[1:] == [c.name for c in CONTENT]


def test_greedy_pairs(spark):
    from folioflow.operators.islands import greedy_pairs

    flags = [1, 1, 1, 0, 1, 1, 0, 1]
    df = spark.createDataFrame([(1, i, bool(f)) for i, f in enumerate(flags)], "k int, n int, f boolean")
    got = {r.n: r._leads for r in greedy_pairs(df, F.col("f"), ["k"], ["n"]).collect()}
    exp, skip = {}, False
    for i, f in enumerate(flags):
        exp[i] = bool(f) and not skip and i + 1 < len(flags)
        skip = exp[i]
    assert got == exp


def page(spark, boxes, width=1000.0):
    rows = [(1, i, *map(float, b), width) for i, b in enumerate(boxes)]
    return spark.createDataFrame(rows, "page_id long, line_no int, left double, top double, right double, bottom double, page_w double")


def order(spark, boxes, width=1000.0, **how):
    got = L.reading_order(page(spark, boxes, width), ["page_id"], **how).orderBy("position").collect()
    return [f"{r.line_no}{r.part}" for r in got]


def test_reading_order(spark):
    title = (300, 50, 700, 90)
    two = [(100 + 450 * (i % 2), 150 + 50 * (i // 2), 450 + 450 * (i % 2), 190 + 50 * (i // 2)) for i in range(6)]
    assert order(spark, two) == ["0", "2", "4", "1", "3", "5"]
    assert order(spark, [title, *two]) == ["0", "1", "3", "5", "2", "4", "6"]
    assert order(spark, [title, *two, (400, 900, 600, 940)]) == ["0", "1", "3", "5", "2", "4", "6", "7"]
    single = [(100, 100 + 50 * i, 900, 140 + 50 * i) for i in range(5)]
    assert order(spark, single) == ["0", "1", "2", "3", "4"]
    assert order(spark, two[:3]) == ["0", "1", "2"]
    merged = [*two, (100, 300, 900, 340)]
    assert order(spark, merged) == ["0", "2", "4", "6:left", "1", "3", "5", "6:right"]


def test_regions(spark):
    regions = spark.createDataFrame([(1, 1, 0.0, 100.0, 40.0, 300.0), (1, 2, 60.0, 100.0, 100.0, 300.0), (1, 3, 0.0, 0.0, 100.0, 50.0)], "page_id long, region_no int, left double, top double, right double, bottom double")
    got = [r.region_no for r in L.xy_cut_order(regions, ["page_id"]).orderBy("region_rank").collect()]
    assert got == [3, 1, 2]
    lines = page(spark, [(62, 120, 90, 130), (5, 120, 30, 130), (10, 10, 90, 20), (5, 200, 30, 210)])
    assert [r.line_no for r in L.order_by_region(lines, regions, ["page_id"]).orderBy("position").collect()] == [2, 1, 3, 0]


def test_linkage(spark):
    phrases = spark.createDataFrame([(1, "dominus vobiscum et cum spiritu"), (2, "gloria in excelsis deo et in terra")], "id long, text string")
    texts = spark.createDataFrame([(10, "gloria in excelsis deo et in tera"), (11, "zzz")], "q long, t string")
    best = M.fuzzy_rerank(M.fuzzy_candidates(texts, phrases, "q", "t"), texts, phrases, "q", "t").where("rank = 1").collect()
    assert sorted((r.q, r.id, r.distance) for r in best) == [(10, 2, 1), (11, 1, 31)]  # without a shared gram all entries are ranked
    assert M.fuzzy_candidates(texts, phrases, "q", "t", fallback=False).where("q = 11").count() == 0
    words = spark.createDataFrame([("dominus",), ("dominvs",), ("xx",)], "word string")
    got = {r.word: r.match for r in M.best_match(words, spark.createDataFrame([("dominus",)], "word string")).collect()}
    assert got == {"dominus": "dominus", "dominvs": "dominus", "xx": None}


def test_alignment_is_the_best_of_all_windows():
    local = random.Random(3)
    text = lambda n: "".join(local.choice("aabcd ") for _ in range(n))
    for _ in range(300):
        phrase, t = text(local.randint(1, 70)), text(local.randint(1, 160))
        if local.random() < 0.5:
            t += "".join(c for c in phrase if local.random() < 0.8) + text(9)
        m, n = len(phrase), len(t)
        windows = [(max(0, at), min(n, at + m)) for at in range(1 - m, n)] if m < n else [(0, n)]
        score, s, e = min((-ratio(phrase, t[s:e]), s, e) for s, e in windows)
        got = alignment(phrase, t)
        assert (got[2], got[0]) == (-score, s) and ratio(phrase, t[got[0] : got[1]]) == -score
        least = local.choice([60.0, 80.0])
        assert alignment(phrase, t, least) == got if -score >= least else alignment(phrase, t, least)[2] < least


@pytest.mark.parametrize("cutoff", [60.0, 80.0, 85.0, 95.0])
def test_alignment_misses_no_pair(spark, cutoff):
    local = random.Random(7)
    phrases = ["".join(local.choice("abcdefghijklm") for _ in range(local.randint(2, 60))) for _ in range(12)]
    segments = ["".join(c if i % k else "#" for i, c in enumerate(p)) for p in phrases for k in (3, 4, 5, 12, 25)]
    segments += [f"xx {s} yy" for s in segments[::3]]
    exp = {}
    for i, s in enumerate(segments):
        best = min((-adjusted_alignment(p, s)[2], k) for k, p in enumerate(phrases))
        if -best[0] >= cutoff:
            exp[i] = best[1]
    got = M.align_phrases(spark.createDataFrame(list(enumerate(segments)), "seg long, s string"), spark.createDataFrame(list(enumerate(phrases)), "id long, text string"), "seg", "s", cutoff=cutoff)
    assert {r.seg: r.id for r in got.collect()} == exp and len(exp) > 1


def test_packs_find_what_one_pack_finds(spark):
    """Dictionaries cut into many packs, against plain loops."""
    local = random.Random(12)
    word = lambda n: "".join(local.choice("abcde") for _ in range(n))
    entries = [(i, " ".join(word(local.randint(1, 6)) for _ in range(local.randint(1, 5)))) for i in range(40)]
    texts = [(i, " ".join(word(local.randint(1, 6)) for _ in range(local.randint(0, 6)))) for i in range(60)] + [(60, "ZZZZ"), (61, None)]
    q, d = spark.createDataFrame(texts, "q long, t string"), spark.createDataFrame(entries, "id long, text string")
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    exp = []
    for i, t in texts:
        found = [(-2 * len(grams(t or "") & grams(e)) / ((len(grams(t or "")) + len(grams(e))) or 1), -len(grams(t or "") & grams(e)), k) for k, e in entries]
        some = sorted(f for f in found if f[1]) or sorted((0.0, 0, k) for _, _, k in found)
        exp += [(i, k, -c, round(-s, 9), n + 1) for n, (s, c, k) in enumerate(some[: 7 if some[0][1] else None])]
    for size in (10**6, 60):
        got = M.fuzzy_candidates(q, d, "q", "t", k=7, pack_chars=size).collect()
        assert sorted((r.q, r.id, r.shared, round(r.score, 9), r.place) for r in got) == sorted(exp)
    vocabulary = list(dict.fromkeys(w for _, e in entries for w in e.split()))
    tokens = sorted({w for _, t in texts for w in (t or "").split()} | {"x" * 70 + "a"})
    v = spark.createDataFrame(list(enumerate(vocabulary)), "n long, word string")
    for size in (10**6, 30):
        got = {r.word: (r.match, r.similarity) for r in M.best_match(spark.createDataFrame([(t,) for t in tokens], "word string"), v, cutoff=70.0, order="n", pack_chars=size).collect()}
        for t in tokens:
            s, n = min((-ratio(t, w), n) for n, w in enumerate(vocabulary))
            assert got[t] == ((vocabulary[n], -s) if -s >= 70 else (None, 0.0))
    segments = spark.createDataFrame([(i, t) for i, t in texts], "seg long, s string")
    one, many = (sorted(map(tuple, M.align_phrases(segments, d, "seg", "s", cutoff=70.0, pack_chars=size).collect())) for size in (10**6, 100))
    assert one == many and len(one) > 5
    halves = lambda phrases, text, cutoff: [(0, len(text), 100.0 if text.startswith(p) else 0.0) for p in phrases]
    assert {r.id for r in M.align_phrases(segments.where("length(s) > 9"), d.limit(1).select(F.lit(5).alias("id"), F.lit("a").alias("text")), "seg", "s", scorer=halves).collect()} == {5}


def test_segments_join_to_the_text(spark):
    content = spark.createDataFrame([(1, 1, 1, "ante dominus vobiscum et"), (1, 2, 2, "cum spiritu post multa")], "project_id long, row_id long, page_id long, text string")
    phrases = spark.createDataFrame([(7, "dominus vobiscum et cum spiritu")], "id long, text string")
    got = segment_by_phrases(content, phrases, 80.0).orderBy("sequence").collect()
    assert "".join(r.text for r in got) == "ante dominus vobiscum et cum spiritu post multa"
    found = [r for r in got if r.found]
    assert [(r.text, r.phrase_id, r.from_page, r.to_page) for r in found] == [("dominus vobiscum et cum spiritu", 7, 1, 2)]


def test_segments_are_cut_until_none_is_open(spark):
    """Of equal matches the first is cut out in each pass; a long word after a space is no end of halving."""
    whole = " ".join(["pax domini"] * 15 + ["z" * 50])
    content = spark.createDataFrame([(1, 1, 1, whole)], "project_id long, row_id long, page_id long, text string")
    got = segment_by_phrases(content, spark.createDataFrame([(7, "pax domini")], "id long, text string"), 100.0).orderBy("sequence").collect()
    assert "".join(r.text for r in got) == whole
    assert [r.text for r in got if r.found] == ["pax domini"] * 15


def test_changes_of_other_projects_fail(spark):
    df = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "row_id long, project_id long, t string")
    wrong = spark.createDataFrame([(2, 1, "c")], "row_id long, project_id long, t string")
    with pytest.raises(Exception, match="another project"):
        J.apply_changes(df, df.where("false"), wrong, df.where("false")).collect()


def test_files(spark, tmp_path):
    put = lambda name, text: str((tmp_path / name).write_text(text, encoding="utf-8") and tmp_path / name)
    rules = S.read_fix_rules(spark, put("r.tsv", "is error\tis full word\tMistake\tShould be replaced with\tinstructions\nFALSE\tTRUE\tdees\tdeus\t\nFALSE\tFALSE\tj\ti\t\nFALSE\tTRUE\t\tx\t\n"))
    assert sorted(S.rule_list(rules)) == [("dees", "deus", True), ("j", "i", False)]
    assert [(r.id, r.text) for r in S.read_phrases(spark, put("p.csv", "id,text\n007,old\n007,new\n")).collect()] == [("007", "new")]
    d = S.read_dictionary_columns(spark, put("d.tsv", "short_name\tname\nb\tBeta\na\tálpha\n\tnone\n"), key="short_name", display="name")
    assert [(r.value, r.label, r.export_value) for r in d.collect()] == [("a", "álpha", "a"), ("b", "Beta", "b")]
    m = S.read_project_manifest(spark, put("m.csv", "name;iiif\n A ;http://x\nB;\n;y\n"))
    assert sorted((r.name, r.type) for r in m.collect()) == [("A", "iiif"), ("B", "files")]
    t = S.import_table(spark, put("t.csv", "Fulltext Original,field_sequence,Image\nabc,2,5\ndef,2,x\n"), CANTUS)
    assert sorted((r.field_full_text_original, r.field_sequence, r.field_imageref_from_chant) for r in t.collect()) == [("abc", 1, 5.0), ("def", 2, None)]
    e = S.read_eval_pairs(spark, put("e.txt", "Example 1 src\n1. Original OCR\nab\ncd\n1. Fixed by human\nxy\nExample 2\n2. Original OCR\n\n2. Fixed by human\nq\n"))
    assert [(r.n, r.source, r.ocr, r.ref) for r in e.collect()] == [(1, "src", "ab\ncd", "xy")]
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.b.JPG").write_bytes(b"x")
    (tmp_path / "img" / "c.txt").write_bytes(b"x")
    (tmp_path / "img" / "d.png").write_bytes(b"")
    assert [r.name for r in S.scan_page_files(spark, str(tmp_path / "img")).collect()] == ["a.b"]
    S.write_csv(d, str(tmp_path / "out"), bom=True)
    parts = [p.read_bytes() for p in (tmp_path / "out").glob("*.csv")]
    assert parts and all(p.startswith("\ufeffvalue".encode()) for p in parts if p)


def test_conversion_and_validation(spark):
    rows = spark.createDataFrame([(1, "5", "12r", "13v", "text", "f1"), (2, None, "1", None, "", "f2")], "pos long, rism_id string, where_in_ms_from string, where_in_ms_to string, formula_text_from_ms string, function_id string")
    mapping = spark.createDataFrame([("f1", "G1")], "source string, target string")
    got = convert_structure(rows, "content", "usuarium", {"function_id_to_genre.tsv": mapping}).orderBy("_global_sequence").collect()
    assert [(r["SOURCE"], r["PAGE NUMBER (ORIGINAL)"], r["GENRE"], r["ITEM"]) for r in got] == [("RISM:5", "12r - 13v", "G1", "text"), ("", "1", None, "")]
    with pytest.raises(KeyError):
        convert_structure(rows, "content", "cantus")
    bad = spark.createDataFrame([(1, 1, "x", "3r", 1), (1, 2, "a; b", "q", 1), (1, 3, "a", None, None)], "project_id long, k long, TOPICS string, field_folio string, _global_sequence long")
    topics = spark.createDataFrame([("a", "A"), ("b", "B")], "value string, label string")
    errors = sorted((r.k, r.column) for r in validate_table(bad, USUARIUM, {"topic.tsv": topics}, "k").collect())
    assert errors == [(1, "TOPICS"), (1, "_global_sequence"), (2, "_global_sequence"), (3, "_global_sequence")]
    assert [(r.k, r.column) for r in validate_table(bad, CANTUS, {}, "k").collect()] == [(2, "field_folio")]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "dees"), (2, None)], "page_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("page_id long, text string").parquet(str(tmp_path / "in"))
    q = stream_fix(stream, lambda: RULES, str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True)
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("page_id").collect()
    assert [r.text for r in got] == ["deus", None]


def test_columns_with_functions(spark):
    """A structure may bring its own computed values, checks and ways to show a value."""
    own = [
        ColumnSpec("key", "Key", "number"),
        ColumnSpec("word", "Word", check=lambda v: F.when(v.contains("!"), "No shouting")),
        ColumnSpec("size", "Size", "number", compute=lambda: F.length("word"), shown_as=lambda v: F.concat(v.cast("int"), F.lit(" letters"))),
    ]
    df = computed(spark.createDataFrame([(1.0, "abc"), (2.0, "no!")], "key double, word string"), own)
    assert [r.size for r in displayed(df, own).orderBy("key").collect()] == ["3 letters", "3 letters"]
    assert [(r.key, r.message) for r in validate_table(df, own, {}, "key").collect()] == [(2.0, "No shouting")]


def test_latest_progress_of_a_stream(spark, tmp_path):
    """Update mode: a micro-batch hands on only the projects that it changes."""
    rows = [(1, 1, "running", 0.1), (2, 1, "running", 0.2)], [(1, 2, "done", 1.0)]
    for r in rows:
        spark.createDataFrame(r, "project_id long, ts long, status string, progress double").write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("project_id long, ts long, status string, progress double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_progress(stream, lambda batch, n: got.extend(map(tuple, batch.select("project_id", "status").collect())), str(tmp_path / "ck"), available_now=True)
    q.awaitTermination(60)
    assert dict(got) == {1: "done", 2: "running"} and len(got) <= 4


def test_colour_and_regions_in_post_processing(spark):
    point = lambda x, y: {"x": float(x), "y": float(y)}
    line = lambda no, x, y, text: (1, 1000.0, no, 1, text, [point(x, y), point(x + 300, y)], float(x), float(y - 20), float(x + 300), float(y))
    lines = spark.createDataFrame(
        [line(1, 100, 100, "left one"), line(2, 550, 100, "right one"), line(3, 100, 140, "left two"), line(4, 550, 140, "right two")],
        "page_id long, page_w double, line_no int, piece_no int, text string, baseline array<struct<x:double,y:double>>, left double, top double, right double, bottom double",
    )
    regions = spark.createDataFrame([(1, 1, 540.0, 0.0, 900.0, 500.0), (1, 2, 90.0, 0.0, 450.0, 500.0)], "page_id long, region_no int, left double, top double, right double, bottom double")
    signal = spark.range(1000).select(F.lit(1).cast("long").alias("page_id"), F.lit(3).alias("line_no"), F.col("id").alias("x"), F.lit(5.0).alias("redness"))
    got = transcribe_postprocess(lines, regions=regions, signal=signal).first().text
    assert got == "left one <red> left two</red> right one right two⏎"


def test_rows_are_numbered_across_partitions(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("_at", F.monotonically_increasing_id())
    assert [r.n for r in S.numbered(df, "_at", "n").orderBy("id").collect()] == list(range(1, 1001))


def test_error_rate_counts_words(spark):
    local = random.Random(5)
    pairs = [([local.choice("abcd") for _ in range(local.randint(0, 8))], [local.choice("abcd") for _ in range(local.randint(0, 8))]) for _ in range(60)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i + 1]
        for j, y in enumerate(b):
            out.append(min(row[j + 1] + 1, out[j] + 1, row[j] + (x != y)))
        return out

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    for r in df.select("a", "b", X.word_error_rate(F.col("a"), F.col("b")).alias("w")).collect():
        exp = distance(r.a, r.b) / len(r.a) if r.a else float(bool(r.b))
        assert abs(r.w - exp) < 1e-9
