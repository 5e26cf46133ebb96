"""Bounded alignment and segmentation against plain searches of all windows and phrases."""

import random

import numpy as np
import pytest

from folioflow.functions.similarity import Bounds, adjusted_alignments, alignment, codes_of, may_hold, places, ratio
from folioflow.operators.match import PhrasePack
from folioflow.plans.segment import segment_by_phrases


def plain_best(keys, texts, cutoff, text):
    found = adjusted_alignments(texts, text)
    k = max(range(len(texts)), key=lambda i: found[i][2], default=None)
    return None if k is None or found[k][2] < cutoff else (keys[k], *found[k])


@pytest.mark.parametrize("cutoff", [0.0, 50.0, 70.0, 80.0, 90.0, 100.0])
def test_bounds_lose_no_match(cutoff):
    rng = random.Random(int(cutoff))
    some = lambda n: "".join(rng.choice(rng.choice(["ab", "abcdefgh ", "é\U0001f600"])) for _ in range(n))
    for _ in range(120):
        phrases = [some(rng.randint(1, 40)) for _ in range(rng.randint(1, 12))]
        text = some(rng.choice([0, 3, 30, 400]))
        for _ in range(rng.randint(0, 3)):
            quoted, at = "".join(c for c in rng.choice(phrases) if rng.random() < 0.9), rng.randint(0, len(text))
            text = text[:at] + quoted + text[at:]
        pack = PhrasePack(list(range(len(phrases))), phrases, cutoff, True)
        assert pack.best(text, adjusted_alignments) == plain_best(pack.keys, phrases, cutoff, text)


def test_bounds_are_no_less_than_any_window():
    rng = random.Random(8)
    for _ in range(60):
        phrase, text = ("".join(rng.choice("abcd ") for _ in range(rng.randint(*r))) for r in ((2, 30), (31, 120)))
        m = len(phrase)
        bound, _ = Bounds([phrase]).of(codes_of(text), np.array([0]), 0.0)
        for s in range(len(text)):
            window = text[s : s + m]
            assert bound[0][s // Bounds.STEP] >= ratio(phrase, window) * len(window) / m - 1e-9
        least = rng.choice([50.0, 70.0, 90.0])
        held = may_hold(places(phrase), m, text, [(0, len(text))], least)
        for s in range(len(text) - m + 1):
            assert ratio(phrase, text[s : s + m]) < least or any(a <= s and s + m <= b for a, b in held)


def test_few_cells_are_combed_where_a_phrase_is_quoted():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8)))
    phrases = [" ".join(word() for _ in range(30)) for _ in range(60)]
    pack = PhrasePack(list(range(60)), phrases, 60.0, True)
    for k in range(0, 60, 6):
        text = " ".join(word() for _ in range(90)) + " " + phrases[k][:-9] + " x " + " ".join(word() for _ in range(60))
        assert pack.best(text, adjusted_alignments) == plain_best(pack.keys, phrases, 60.0, text)
        assert alignment(phrases[k], text)[2] > 90
    assert pack.combed < 0.1 * pack.cells


def plain_segments(text, phrases, threshold):
    """(start, end, phrase) of the pieces of a text: the best phrase cut out of each, the rest searched on, halves of what has none."""
    shortest = min(len(t) for _, t in phrases)
    done, todo = [], [(0, text)]
    while todo:
        at, t = todo.pop()
        if not t.strip():
            done += [(at, at + len(t), None)] if t else []
            continue
        found = plain_best([k for k, _ in phrases], [p for _, p in phrases], threshold, t)
        if found:
            k, s, e, _ = found
            done.append((at + s, at + e, k))
            todo += [(at, t[:s]), (at + e, t[e:])]
        elif len(t) <= 2 * shortest:
            done.append((at, at + len(t), None))
        else:
            cut = halved(t)
            todo += [(at, t[:cut]), (at + cut, t[cut:])]
    return sorted(done)


def halved(t):
    """The last space in the first half ends it; without one, or with nothing before it, the middle."""
    half = len(t) // 2
    space = t.rfind(" ", 0, half + 1)
    return space if space > 0 else half


def test_segmentation_is_that_of_plain_loops(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    phrases = [(k, " ".join(word() for _ in range(5))) for k in range(8)]
    rows, texts = [], {}
    for project in range(6):
        words = []
        for _ in range(6):
            words += [word() for _ in range(rng.randint(0, 12))] + rng.choice(phrases)[1].split()
        texts[project] = " ".join(words)
        rows += [(project, i, i // 7, w) for i, w in enumerate(words)]
    content = spark.createDataFrame(rows, "project_id long, row_id long, page_id long, text string")
    got = segment_by_phrases(content, spark.createDataFrame(phrases, "id long, text string"), 80.0).collect()
    for project, text in texts.items():
        own = sorted((r.seg_start, r.seg_end, r.phrase_id) for r in got if r.project_id == project)
        assert "".join(text[a:b] for a, b, _ in own) == text
        assert own == plain_segments(text, phrases, 80.0)
    assert sum(r.found for r in got) >= 30
