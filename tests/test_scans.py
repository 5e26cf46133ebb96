"""Scans by ranges against windows over whole groups, one of which holds most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.operators import table as T
from folioflow.operators.islands import greedy_pairs
from folioflow.operators.scans import Scan


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out = [(rng.choice([1] * 8 + [2, 3, None]), n, rng.choice([None, *range(9)]), rng.random() < 0.7, rng.choice(["a¬ ", " b", "c⏎", "", None])) for n in range(900)]
    return spark.createDataFrame(out, "k int, n int, v long, flag boolean, text string").repartition(5).cache()


def same(a, b):
    key = lambda r: tuple((x is not None, x) for x in r)
    cols = sorted(a.columns)
    left, right = (sorted(map(tuple, x.select(*cols).collect()), key=key) for x in (a, b))
    assert left == right and left
    return True


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_running_values(rows, parts):
    w = Window.partitionBy("k").orderBy("n")
    exp = rows.select(
        "k", "n", F.row_number().over(w).cast("long").alias("number"), F.coalesce(F.sum("v").over(w), F.lit(0)).alias("total"), F.lag("v").over(w).alias("previous"),
        F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("latest"),
    )
    scan = Scan(rows, ["k"], ["n"], parts).number("number").total(F.col("v"), "total").previous(F.col("v"), "previous").latest(F.col("v"), "latest")
    assert same(scan.rows().select(*exp.columns), exp)
    last = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n"))) == 1
    flagged = rows.withColumn("flag", F.col("flag") & ~last)
    assert same(Scan(flagged, ["k"], ["n"], parts).leads(F.col("flag"), "_leads").rows(), greedy_pairs(flagged, F.col("flag"), ["k"], ["n"]))


def test_no_range_holds_more_than_its_share(rows):
    sizes = [r["count"] for r in Scan(rows, ["k"], ["n"], 9).df.groupBy("_part").count().collect()]
    assert len(sizes) == 9 and max(sizes) < 2.5 * 900 / 9


def test_operators_by_parts(rows):
    for seq in ("v", "n"):
        for preserve in (False, True):
            args = {"seq": seq, "pos": "n0", "keys": ("k",), "preserve": preserve}
            df = rows.withColumn("n0", F.col("n")).select("k", "n0", F.col(seq).cast("long").alias(seq))
            assert same(T.renumber(df, **args, parts=6), T.renumber(df, **args))
    assert same(T.number_words(rows.select("k", "n", F.repeat(F.coalesce("text", F.lit(" x y ")), 3).alias("text")), "text", "n", ("k",), parts=6), T.number_words(rows.select("k", "n", F.repeat(F.coalesce("text", F.lit(" x y ")), 3).alias("text")), "text", "n", ("k",)))
    assert same(T.dehyphenate(rows.select("k", "n", "text"), ["k"], "n", parts=6), T.dehyphenate(rows.select("k", "n", "text"), ["k"], "n"))
    pages = rows.select("k", "n", (F.col("n") % 50).alias("page"), F.col("text").alias("page_text"), "text", "v")
    assert same(T.stitch_pages(pages, ["k"], "n", "page", "page_text", parts=6), T.stitch_pages(pages, ["k"], "n", "page", "page_text"))
    for least in (1, 3, 50):
        args = (["k"], "n", "v", 4, least)
        got = T.threshold_runs(rows, *args, parts=6)
        assert same(got, T.threshold_runs(rows, *args)) if least < 50 else not got.count()


def test_texts_are_not_shuffled_to_number_their_words(spark, monkeypatch):
    """Ranges hold counts only, and the words of a row come as one row."""
    seen = []
    whole = T.Scan
    monkeypatch.setattr(T, "Scan", lambda df, *a: seen.append(df.columns) or whole(df, *a))
    df = spark.createDataFrame([(1, 3, "c d"), (1, 1, "a  b"), (1, 2, " "), (1, None, "z"), (None, 1, None), (None, 2, "e f")], "k int, n int, text string")
    got = T.numbered_texts(df, 3, key="n", keys=("k",)).collect()
    words = {(r.k, r.n): [tuple(w) for w in r.words] for r in got}
    assert words == {(1, None): [("z", 1)], (1, 1): [("a", 2), ("b", 3)], (1, 3): [("c", 4), ("d", 5)], (None, 2): [("e", 1), ("f", 2)]}
    assert seen == [["k", "n", "_size"]]
    rows = sorted(map(str, T.number_words(df, key="n", keys=("k",), parts=3).collect()))
    assert rows == sorted(map(str, T.number_words(df, key="n", keys=("k",)).collect())) and len(rows) == 7
