"""Collocations against a plain count of all phrases, whatever the sample proposes."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from folioflow.llm import phrases
from folioflow.llm.common import BODY

SCHEMA = "doc_id long, text string, lang string, phrase string, k int, _n int"
rng = random.Random(11)
WORDS = ["al", "bo", "ci", "dü", "é", "fa\x0bgo", "HI", "the", "the", "of", "\xa0"]


def text(n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n"]) for _ in range(n))


def plain(rows, least, top, cover=80):
    f, n = Counter(), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    out = {}
    frequent = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    for (lang, p), a in frequent.items():
        longer = [b for (o, q), b in frequent.items() if o == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= cover * a for b in longer):
            continue
        cuts = [(2000000 * a // (f[lang, p[:j]] + f[lang, p[j:]]), j) for j in range(1, len(p))]
        score, j = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:j]], f[lang, p[j:]]))
    return {
        (lang, i, p.decode(), -a, left, right, n[lang], -s)
        for lang, found in out.items()
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    }


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text(rng.choice([0, 1, 5, 60])), rng.choice(["en", "de", None, "und"]), "x", 1, 2) for i in range(150)]
    rows += [(None, None, "en", None, None, None), (200, "", "fr", None, None, None), (201, text(20_000), "fr", "y", 0, 0)]
    rows += [(202, "same words again. same words again", "en", "z", 3, 3)] * 25
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.mark.parametrize(("sample", "low", "bits"), [(4, 4, 26), (1, 1, 20), (2, 2, 7), (1_000_000, 1, 20)])
def test_same_as_a_plain_count(docs, sample, low, bits):
    got = {tuple(r) for r in phrases.collocations(docs, least=12, top=40, sample=sample, low=low, filter_bits=bits).collect()}
    want = plain([(r.lang, r.text) for r in docs.collect()], 12, 40)
    assert got == want
    assert len({r[0] for r in want}) == 4


def test_border_failures_start_another_pass(docs):
    rows = phrases.prepared(docs)
    lean, passes = phrases.frequent_phrases(rows, 12, sample=1_000_000, low=1, filter_bits=20)
    assert passes == 2  # nothing was proposed: first the words, then all that they admit
    full, once = phrases.frequent_phrases(rows, 12, sample=1, low=12, filter_bits=20)
    assert once == 1
    assert {tuple(r) for r in lean.collect()} == {tuple(r) for r in full.collect()}


def test_tallies_that_overflow_are_handed_on(docs, monkeypatch):
    rows = docs.select("lang", "text").na.fill("").collect()
    batch = pa.RecordBatch.from_pydict({"lang": [r.lang for r in rows], BODY: [r.text.encode() for r in rows]})

    def summed():
        by = {}
        for b in phrases._count(8, None, None, True)(iter([batch] * 3)):
            for r in b.to_pylist():
                by.setdefault(r["range"], []).append(r)
        done = [phrases._frequent(1)((at,), pa.Table.from_pylist(rs, b.schema)) for at, rs in by.items()]
        return Counter(tuple(r.values()) for t in done for r in t.to_pylist())

    want = summed()
    assert max(want.values()) == 1
    monkeypatch.setattr(phrases, "HELD", 64)
    monkeypatch.setattr(phrases, "BLOCK", 100)
    assert summed() == want


def test_empty(docs):
    assert phrases.collocations(docs.where("false")).collect() == []
    assert phrases.collocations(docs.where("doc_id is null")).collect() == []
