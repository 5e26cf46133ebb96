"""Conversation repair against a plain search over whole audits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from types import SimpleNamespace

import pytest

from folioflow.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, audit string, run int, seq string"
LEGAL = re.compile(r"(s?(ua)+)?\Z")
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def damaged(rows):
    show = lambda x: " " if x is None else str(x)
    out = []
    for conv, turn, role, text in rows:
        role, text = show(role), show(text)
        draw = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        role = "user" if draw == 4 else role
        out += [(conv, turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return out


def plain(rows):
    """Result of one conversation's (turn, role, text), audits as whole strings, all of them by last initial."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [t for t, _, _ in rows if t is not None]
    counts, seen = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set()
    best = {"": (0, "", [])}
    for _, role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        more = 3 if fault == "truncated" else 0
        new = defaultdict(list)
        for last, (cost, audit, lines) in best.items():
            new[last].append((cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            for n in range(3):
                i = role[:1]
                if (last, i) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    new[i].append((cost + more, audit + "K", [*lines, f"{role}:{text}"]))
                last = NEXT[last]
                name = {"u": "user", "a": "assistant"}[last]
                new[last].append((cost + more + 3, audit + "R", [*lines, f"{name}:{text}"]))
                cost, audit, lines = cost + 3, audit + "I", [*lines, f"{name}:"]
        best = {k: min(v) for k, v in new.items()}
    ends = []
    for last, (cost, audit, lines) in best.items():
        while last not in ("", "a"):
            last = NEXT[last]
            cost, audit, lines = cost + 3, audit + "I", [*lines, {"u": "user:", "a": "assistant:"}[last]]
        ends.append((cost, audit, lines))
    cost, audit, lines = min(ends)
    assert LEGAL.match("".join(x[:1] for x in lines))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed, convs, most):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "user", "assistant"], ["Yes.", "No!", "so be it", "é?\n ", " \t", "", None, "Well. then", "a.", "b.", "c."]
    out = [(c, rng.choice([None, *range(3 * most)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(convs)] for _ in range(rng.randrange(most))]
    return out + [(convs + 1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(400)]


def asked(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


def results(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def want(rows):
    by = defaultdict(list)
    for conv, *rest in rows:
        by[conv].append([" " if x is None and i else x for i, x in enumerate(rest)])
    return {conv: plain(rest) for conv, rest in by.items()}


@pytest.mark.parametrize(("chunk", "run", "fan"), [(1024, 64, 8), (3, 2, 1)])
def test_same_as_a_plain_search(spark, chunk, run, fan, monkeypatch):
    rows = conversations(1, 60, 12)
    rows += [(500, 5, "user", "same.")] * 300 + [(500, 6, "tool", " ")] * 80 + [(500, t, "user", "same.") for t in range(7, 90)]
    # workers import the module anew, so sizes travel in the closures of a copy of the map
    monkeypatch.setattr(cv, "FAN", fan)
    monkeypatch.setattr(cv, "_pieces", sized(chunk, run))
    got = results(cv.repair(asked(spark, rows)))
    assert got == want(rows)


def sized(chunk, run):
    inner = cv._pieces

    def make(kind):
        plain_map = inner(kind)

        def mapped(batches):
            from folioflow.llm import conversations as own

            own.CHUNK, own.RUN = chunk, run
            try:
                yield from plain_map(batches)
            finally:
                own.CHUNK, own.RUN = 1024, 64

        return mapped

    return make


def test_damage(spark):
    rows = conversations(2, 200, 8)
    got = cv.damage(asked(spark, rows)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(damaged(rows), key=key)
    assert len({zlib.crc32(f"{c}:{t}".encode()) % 20 for c, t, _, _ in rows}) == 20


def test_query(spark, tmp_path):
    rows = [(c, t, r, x) for c, t, r, x in conversations(3, 80, 6) if c != 81]
    rows.append((next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0), 0, "user", "x"))
    asked(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = results(cv.op13_conversation_repair(spark, str(tmp_path)))
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert got == dict.fromkeys({r[0] for r in rows}, none) | want(damaged(rows))
    assert none in got.values()


def test_ties_are_decided_whatever_the_hashes(monkeypatch):
    rng = random.Random(4)
    for modulus in (cv.Trail.MODULUS, 2, 3):
        monkeypatch.setattr(cv.Trail, "MODULUS", modulus)
        trail = cv.Trail()
        nodes = [0]
        for _ in range(400):
            nodes.append(trail.grow(rng.choice(nodes), rng.choice("DIKR")))
        for _ in range(3000):
            a, b = rng.choice(nodes), rng.choice(nodes)
            assert trail.before(a, b) == (trail.text(a) < trail.text(b))


def test_chunks_join_to_what_one_chunk_gives():
    rng = random.Random(6)
    for _ in range(60):
        rows = [(rng.choice("suat"), rng.random() < 0.3, rng.choice([0, 0, 0, 1, 5])) for _ in range(rng.randrange(1, 30))]
        trail = cv.Trail()
        best = cv.solve(rows, 0, trail)
        order = cv.ranked(best, trail)
        parts, at = [], 0
        while at < len(rows):
            n = rng.randrange(1, 5)
            t = cv.Trail()
            cost, rank, edits = cv._paths({e: (cv.solve(rows[at : at + n], e, t), t) for e in range(4)})
            parts.append(SimpleNamespace(edits=edits, as_row={"costs": cost, "ranks": rank}))
            at += n
        now, back = cv._walk([p.as_row for p in parts], 0)
        assert now == {q: (best[q][0], order[q]) for q in best}
        for q in best:
            text, state = "", q
            for p, before in zip(reversed(parts), reversed(back), strict=True):
                text = p.edits[4 * before[state] + state] + text
                state = before[state]
            assert text == trail.text(best[q][1])


def test_empty(spark):
    assert cv.repair(asked(spark, [(1, 1, "user", "x")]).where("false")).collect() == []
