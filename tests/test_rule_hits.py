"""Hits of rules against the pieces of a plain loop, and what is computed for them."""

import random
import re
import time

from pyspark.sql import functions as F

from folioflow.plans import evaluate as E

RULES = [("and", "et", True), ("an", "en", False), ("d.", "de", False), ("é<x", "e", False), ("the", "le", True), ("red", "rubrum", True)]
PATTERN = r"(</?(?:red|func|subrub)>|(?<!\w)and(?!\w)|(?<!\w)red(?!\w)|(?<!\w)the(?!\w)|é<x|an|d\.)|[\s\S]"


def test_same_as_plain_loops(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["and", " ", "an", "d.", "é", "<x", "the", "<red>", "red", "</func>", "a", "😀", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["", None]
    exp = {}
    for t in filter(None, texts):
        for m in re.finditer(PATTERN, t):
            if m[1] and not m[1].startswith("<"):
                around = t[max(0, m.start() - 22) : max(0, m.start() - 22) + len(m[1]) + 44]
                hits, example = exp.get(m[1], (0, around))
                exp[m[1]] = hits + 1, min(example, around, key=str.encode)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = E.rule_hits(df, RULES).collect()
    assert {r.matched: (r.hits, r.example) for r in got} == exp and len(exp) == 6
    assert {r.matched: r.replacement for r in got} == {m: b for m, b, _ in RULES}


def test_long_texts_and_counts_alone(spark):
    """Without an example no places are computed; a text without hits is read once."""
    df = spark.range(1).select(F.concat(F.repeat(F.lit("a the "), 5), F.repeat(F.lit("athe "), 400_000)).alias("text"))
    began = time.time()
    got = E.rule_hits(df, [("the", "le", True)])
    assert [(r.matched, r.hits) for r in got.collect()] == [("the", 5)] and time.time() - began < 60
    assert "EvalPython" in got._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in got.select("matched", "hits", "replacement")._jdf.queryExecution().executedPlan().toString()
