"""Keys of words, bounds by letters and words of texts against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.functions.similarity import lcs_length, ratio, ratios
from folioflow.functions.text import tokenize
from folioflow.operators import match as M

rng = random.Random(3)


def word(low, high, letters="aeinrst"):
    return "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))


def filter_of(keys):
    held = np.zeros(1 << M.FILTER_POWER - 3, np.uint8)
    slots = keys.view(np.uint64) >> np.uint64(64 - M.FILTER_POWER)
    np.bitwise_or.at(held, slots >> np.uint64(3), np.uint8(1) << (slots & np.uint64(7)).astype(np.uint8))
    return held


@pytest.mark.parametrize("cutoff", [80.0, 87.5, 100.0])
def test_words_share_a_key_just_where_they_reach_the_cutoff(cutoff):
    tokens = ["", *{word(1, M.KEYED) for _ in range(150)}]
    vocabulary = ["", *{word(1, 13) for _ in range(150)}, *tokens[:20]]
    own, other = (M.common_keys(w, cutoff, v).to_pylist() for w, v in ((tokens, False), (vocabulary, True)))
    shared = {(a, b) for a, x in zip(tokens, own) for b, y in zip(vocabulary, other) if set(x) & set(y)}
    assert shared == {(a, b) for a in tokens for b in vocabulary if ratio(a, b) >= cutoff}
    assert all(len(set(x)) == len(x) for x in [*own, *other])


def test_only_keys_of_the_vocabulary_meet_it():
    tokens = [word(6, M.KEYED, "bcdfghklmp") for _ in range(2000)]
    vocabulary = [word(6, M.KEYED) for _ in range(300)]
    known = M.common_keys(vocabulary, 80.0, True).values.to_numpy()
    held = filter_of(known)
    assert len(M.common_keys(tokens, 80.0, False).values) > 50_000
    # by chance a key in a thousand, as the filter has 2^26 bits
    assert len(M.common_keys(tokens, 80.0, False, held).values) < 200
    for some, kept in zip(*(M.common_keys(vocabulary, 80.0, False, h).to_pylist() for h in (None, held))):
        assert len(kept) <= len(some) and {*some} & {*known.tolist()} <= {*kept}


def test_ratios_of_pairs():
    a, b = (["", "", "a", "x\x00", "é" * 64, *(word(0, n) for _ in range(500))] for n in (64, 90))
    a, b = a[:-3] + ["", "ae", "a\x00"], b[:-3] + ["ae", "", "a"]
    assert ratios(a, b).tolist() == [ratio(x, y) for x, y in zip(a, b)]
    assert ratios([], []).tolist() == []


def test_letters_bound_what_is_not_common():
    words = ["", "a" * 9, *(word(0, 12, "aeinrstéßz!") for _ in range(300))]
    left = []
    for a in words[:60]:
        for b in words:
            apart = (M.letter_counts(a) ^ M.letter_counts(b)).bit_count()
            assert apart <= len(a) + len(b) - 2 * lcs_length(a, b)
            left.append(apart <= 0.2 * (len(a) + len(b)))
    # repeated letters rule words out, too
    assert (M.letter_counts("aeaeae") ^ M.letter_counts("ae")).bit_count() == 4 and sum(left) < len(left) // 10


def test_words_of_texts(spark):
    spaces = "\t\n\x0b\x0c\r \xa0     　﻿" + "".join(map(chr, range(0x2000, 0x200B)))
    letters = ["a", "be", "\xe9", "\x00", "\x1c", "\x1f", "\x85", "᠎", "​", "\U0001d54f"]
    texts = ["", " ", "\n", None, *("".join(rng.choice(letters) if rng.random() < 0.6 else rng.choice(spaces) for _ in range(40)) for _ in range(200))]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    got = [r.word for r in M.words_of(df.coalesce(1)).collect()]
    assert set(got) == {r.word for r in df.select(F.explode(tokenize(F.col("text"))).alias("word")).collect()}
    # of one batch each word comes once
    assert len(set(got)) == len(got)
    assert M.words_of(df.where("text is null")).count() == 0


def test_wide_and_empty_words_are_matched(spark):
    tokens = spark.createDataFrame([(x,) for x in ("", "😀😀a", "éa", "abcdefghi", "qqqq")], "word string")
    v = spark.createDataFrame([("", 5), ("😀😀ab", 1), ("éa", 2), ("abcdefgh", 3), ("abcdefghij", 4)], "word string, n long")
    got = {r.word: (r.match, r.similarity) for r in M.best_match(tokens, v, order="n", keyed=True).collect()}
    assert got == {"": ("", 100.0), "😀😀a": ("😀😀ab", 600 / 7), "éa": ("éa", 100.0), "abcdefghi": ("abcdefghij", 1800 / 19), "qqqq": (None, 0.0)}
