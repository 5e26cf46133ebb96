"""Alignments of pairs at once against those of each pair, and runs of byte tokens."""

import random

from pyspark.sql import functions as F

from folioflow.functions import similarity as S
from folioflow.functions.text import decode_byte_tokens


def test_pairs_at_once_are_those_of_each_pair(monkeypatch):
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcé\U0001f600") for _ in range(n))
    pairs = [(some(rng.choice([0, 1, 5, 20, 40])), some(rng.choice([0, 3, 25, 30, 200]))) for _ in range(300)]
    expected = [S.alignment(p, t) for p, t in pairs]
    calls, comb = [], S._comb
    monkeypatch.setattr(S, "_comb", lambda *a: calls.append(1) or comb(*a))
    assert S.paired_alignments(*map(list, zip(*pairs, strict=True))) == expected
    assert len(calls) < 60


def test_running_text_is_one_piece_between_byte_tokens(spark):
    texts = ["", None, "<", "a<b<0xC3><0xA9>c<0x4>d<0xC3><", "x" * 50 + "\n<<0x41>", "é\U0001f600<0xFF>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(decode_byte_tokens(F.col("t")).alias("d"))
    assert [r.d for r in df.collect()] == ["", None, "<", "a<béc<0x4>d<0xC3><", "x" * 50 + "\n<A", "é\U0001f600<0xFF>"]
    assert "|[^<]+|" in df._jdf.queryExecution().optimizedPlan().toString()
