"""Rendezvous sharding: against plain loops, and what moves when shards change."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioflow.llm import sharding

SCHEMA = "doc_id long, text string, slot string, shard string, _n int"


def plain_shard(key, weights):
    text = "null" if key is None else str(key)
    best = []
    for s, w in weights.items():
        x = int(hashlib.md5(f"{text}:{s}".encode()).hexdigest()[:13], 16)
        best.append((-math.log((x + 0.5) / 2**52) / w, -x, s))
    return min(best)[2]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text é {i % 7}" * (i % 5), "a", "b", 1) for i in range(300)]
    rows += [(None, None, None, None, None), (None, "x", "a", "b", 2), (7, "long " * 20_000, "c", "d", 3), (9, "", "", "", 0)]
    rows += [(1, "same", "p", "q", 9)] * 50
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("run", [1 << 16, 8])
def test_every_row_has_one_place(docs, run, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", run)
    got = sharding.shard_documents(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect()
    )
    now, more = {i: 1.0 for i in range(40)}, {i: 1.0 for i in range(41)}
    slots = defaultdict(list)
    for r in got:
        assert (r.law, r.shard, r.grown_shard) == ("key", plain_shard(r.doc_id, now), plain_shard(r.doc_id, more))
        assert r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_places_do_not_depend_on_partitions(docs):
    places = [sorted(map(tuple, sharding.shard_documents(d).collect()), key=repr) for d in (docs, docs.repartition(1))]
    assert places[0] == places[1]


def test_shares_follow_weights_and_changes_move_only_what_they_must(spark):
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"))
    before = {0: 1.0, 1: 2.0, 2: 1.0}
    placed = keys.select("doc_id", *(
        sharding.shard_of("doc_id", w).alias(n) for n, w in {"a": before, "heavier": before | {2: 2.0}, "fewer": {0: 1.0, 2: 1.0}}.items()
    )).collect()
    share = Counter(r.a for r in placed)
    assert all(abs(share[s] / 20_000 - w / 4) < 0.015 for s, w in before.items())
    assert all(r.heavier == 2 for r in placed if r.heavier != r.a)
    assert all(r.a == 1 for r in placed if r.fewer != r.a)
    assert all(r.a == plain_shard(r.doc_id, before) for r in placed[:500])


def test_files_hold_the_rows_of_their_shard(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), 3, files=2)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == docs.count()
    assert got.where(F.col("shard") != sharding.shard_of("doc_id", 3)).isEmpty()


def test_empty_tables_and_bad_weights(docs):
    assert sharding.shard_documents(docs.where("false")).collect() == []
    for bad in (0, {}, {0: 0.0}, {0: -1.0}):
        with pytest.raises(ValueError, match="shard"):
            sharding.weights_of(bad)
