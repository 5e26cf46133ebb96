"""Edit distances of many entries at once, and ranks by them, against plain loops."""

import random

from folioflow.functions.similarity import codes_of, edit_distances
from folioflow.operators import match as M

rng = random.Random(5)


def some(n, letters="abc é\U0001f600"):
    return "".join(rng.choice(letters) for _ in range(n))


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distances_are_those_of_the_table():
    for _ in range(150):
        entries = [some(rng.choice([0, 1, 7, 40, 90])) for _ in range(rng.randint(0, 9))]
        text = some(rng.choice([0, 1, 30, 100]))
        assert edit_distances(text, [codes_of(e) for e in entries]).tolist() == [plain(text, e) for e in entries]


def test_ranks_in_packs_and_no_join_of_pairs(spark):
    phrases = [(k, some(rng.randint(3, 40))) for k in range(60)]
    texts = [(i, some(rng.randint(0, 60))) for i in range(40)] + [(98, ""), (99, None)]
    d, q = spark.createDataFrame(phrases, "id long, text string"), spark.createDataFrame(texts, "q long, t string")
    found = M.fuzzy_candidates(q, d, "q", "t")
    one = M.fuzzy_rerank(found, q, d, "q", "t")
    rows, of, text = one.collect(), dict(phrases), dict(texts)
    assert len(rows) == found.count() and {r.q for r in rows} == set(text)
    for k, t in texts:
        own = sorted((r for r in rows if r.q == k), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert [r.distance for r in own] == [None if t is None else plain(t, of[r.id]) for r in own]
        assert own == sorted(own, key=lambda r: (r.distance or 0, r.place))
    many = M.fuzzy_rerank(found, q, d, "q", "t", pack_chars=300)
    assert sorted(map(tuple, many.collect()), key=str) == sorted(map(tuple, rows), key=str)
    # the texts of both sides are not copied for each pair
    assert one._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
