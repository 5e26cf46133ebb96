"""Table functions against the column functions, and tables of several files."""

from pyspark.sql import functions as F

from folioflow.functions import tables
from folioflow.functions import text as X
from folioflow.plans.structures import CONTENT
from folioflow.sources import files as S

MARKED = [
    None, "", " \n", "abc <red>Rubr</red> text⏎<func>F</func>z", "a <red>open rest", "a <b> <c <red>  </red><subrub> s </subrub>⏎⏎x", "<func><red>in</red></func> y",
    "<red>a</func></red>", "﻿<subrub> </subrub>　", "<red></red><redx> é 😀", "<", "</red>", "<red><red>a</red></red>",
]


def test_markup_rows_are_those_of_the_column_function(spark):
    tables.register(spark)
    df = spark.createDataFrame(list(enumerate(MARKED)), "k int, text string")
    exp = df.select("k", F.posexplode(X.parse_markup(F.col("text"))).alias("at", "x")).select("k", F.col("at") + 1, "x.kind", "x.text")
    got = spark.sql("SELECT d.k, m.place, m.kind, m.text FROM {d} AS d, LATERAL markup_rows(d.text) AS m", d=df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))
    assert spark.sql("SELECT count(*) FROM {d} AS d LEFT JOIN LATERAL markup_rows(d.text)", d=df).first()[0] > len(MARKED)


def test_manifest_pages_are_those_of_the_reader(spark):
    tables.register(spark)
    two = """{"sequences": [{"canvases": [{"label": "f1", "images": [{"resource": {"@id": "i1", "service": {"@id": "s1"}}}]},
      {"label": [{"@value": "f1"}], "images": [{"resource": {"@id": "i2", "service": [{"id": "s2"}]}}]}, {"label": "none"}, {"images": [{"resource": {"@id": "i3"}}]}]}]}"""
    three = """{"items": [{"type": "Canvas", "label": {"en": ["A"], "pl": ["B"]}, "items": [{"type": "AnnotationPage", "items": [{"type": "Annotation", "motivation": "painting", "body": {"type": "Image", "id": "i4", "service": [{"@id": "s4"}]}}]}]},
      {"type": "Canvas", "label": {"none": ["B"]}, "items": [{"type": "AnnotationPage", "items": [{"type": "Annotation", "motivation": "tagging", "body": {"type": "Image", "id": "no"}}, {"type": "Annotation", "motivation": "painting", "body": {"type": "Image", "id": "i5"}}]}]},
      {"type": "Range"}, {"type": "Canvas", "label": {"la": ["C"]}}]}"""
    df = spark.createDataFrame([(1, two), (2, three), (3, None), (4, "no json"), (5, "{}")], "manifest_id int, data string")
    got = spark.sql("SELECT m.manifest_id, p.* FROM {m} AS m, LATERAL manifest_pages(m.data) AS p", m=df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, S.flatten_iiif_manifest(df).collect()))
    assert [r.label for r in sorted(got)] == ["f1_1", "f1_2", "page_3", "B_1", "B_2"]


def test_rows_of_several_files_are_numbered_by_file_name(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    sizes = {"a.csv": 3, "b.csv": 300, "c.csv": 1, "d.csv": 40}
    for name, n in sizes.items():
        (folder / name).write_text("formula_text_from_ms\n" + "".join(f"{name[0]}{i}\n" for i in range(n)))
    seq = next(s.name for s in CONTENT if s.type == "sequence")
    got = S.import_table(spark, str(folder), CONTENT).orderBy(seq)
    assert [(r[seq], r.formula_text_from_ms) for r in got.collect()] == list(enumerate((f"{name[0]}{i}" for name, n in sizes.items() for i in range(n)), 1))


def test_the_last_of_several_mappings_wins_by_file_name(spark, tmp_path):
    folder = tmp_path / "maps"
    folder.mkdir()
    (folder / "a.csv").write_text("source,target\nx,first\ny,a\n" + "".join(f"k{i},v\n" for i in range(500)))
    (folder / "b.csv").write_text("source,target\nx,second\n")
    got = {r.source: r.target for r in S.read_mapping(spark, str(folder)).collect()}
    assert (got["x"], got["y"], len(got)) == ("second", "a", 502)
