"""Exact join of near-duplicate texts: Jaccard similarity of five-word shingles of 0.8 or more.

1. Texts become sets of 64-bit shingle hashes. Equal sets are one node; a node keeps its size and a parity bitmap
   (one bit per hash slot, about as many bits as shingles).
2. A first pass compares every node with the least node that shares one of its `BOTTOM` least hashes. Copies of
   one text thereby meet in stars, and the links found join them into components before any tile is formed.
3. Each node's prefix is taken in a global order, rare shingles first: nodes of a link must share a prefix shingle.
   Tiles are (prefix shingle, size band); those whose nodes are one component already are left out. `STARS` times,
   the nodes of a tile are compared with one of them only, and components are joined by the links found.
4. The complete pass pairs nodes of different components within a tile, the members of the tile's largest component
   only with the rest, so a group of copies never meets itself.
5. For every candidate pair the sizes and the differing bits bound the overlap from above, already inside the tile's
   join; what is left is decided by intersecting the sorted arrays. Components of all links are the result.

The order of shingles comes from counts in `BUCKETS` hash buckets over all texts: a fixed-size table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import (
    BODY,
    bit_filter,
    blocks_of,
    components,
    discard,
    materialize,
    mix64,
    passes,
    refuse,
    table,
    with_bytes,
    word_hashes,
)

SHINGLE, BOTTOM, BUCKETS = 5, 3, 1 << 20
#: The counts travel in so many pieces; a group that is summed holds a piece from at most TEAM tasks or teams.
PIECES, TEAM = 64, 64
#: Slots of the parity bitmap that travels with the tiles, and how often tiles are joined as stars before the rest.
SLOTS, STARS = 512, 2
#: Stands for a null doc_id where texts are read again.
NO_ID = -(1 << 63)
#: Unrelated odd factors: multiples of one constant would give equal sums to permuted shingles.
_FACTORS = mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than five words are one shingle, none is no shingle."""
    words, at = word_hashes(column)
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            full += words[k : k + len(full)] * _FACTORS[k]
        full = mix64(full)
        out = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= SHINGLE:
                out.append(np.unique(full[a : b - SHINGLE + 1]))
            elif b > a:
                whole = np.uint64(b - a)
                for k in range(a, b):
                    whole = mix64(np.array([whole ^ words[k]]))[0] * _FACTORS[1]
                out.append(np.array([whole], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def node_of(s: np.ndarray) -> int:
    """A hash of the whole set; 0 for the empty set."""
    return int(mix64(np.array([mix64(s).sum(dtype=np.uint64) + np.uint64(len(s))]))[0].view(np.int64)) if len(s) else 0


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the number of hashes in each of 2**k >= max(64, size) slots."""
    slots = max(64, 1 << int(len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1, bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference: differing parities, the longer bitmap folded onto the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def small_bitmap(s: np.ndarray) -> np.ndarray:
    """The parities in SLOTS slots as 64-bit words."""
    bits = np.bincount((s & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _may_link(a: str, b: str):
    """Whether sizes and differing bits of two sides (columns n and sig with these suffixes) allow a link."""
    n = F.col(f"n{a}") + F.col(f"n{b}")
    apart = sum(F.bit_count(F.col(f"sig{a}")[i].bitwiseXOR(F.col(f"sig{b}")[i])) for i in range(SLOTS // 64))
    sizes = 5 * F.least(f"n{a}", f"n{b}") >= 4 * F.greatest(f"n{a}", f"n{b}")
    return sizes & (9 * (n - apart) >= 8 * n)


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(44)).astype(np.int64)


def _prepare(batches):
    counts = np.zeros(BUCKETS, np.int64)
    names = ["doc_id", "row", "n", "node", "bottom", "bits", "counts"]

    def rows(cols):
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    for batch in batches:
        for lo, hi in blocks_of(batch.column(BODY)):
            sets = shingle_sets(batch.column(BODY).slice(lo, hi - lo))
            for s in sets:
                counts[_bucket(s)] += 1  # buckets met twice by one text count once: an order needs no more
            yield rows(
                [
                    batch.column("doc_id").slice(lo, hi - lo),
                    batch.column("row").slice(lo, hi - lo),
                    [len(s) for s in sets],
                    [node_of(s) for s in sets],
                    [s[:BOTTOM].view(np.int64) for s in sets],
                    [bitmap(s) for s in sets],
                    [None] * len(sets),
                ]
            )
    # one row for each piece of the counts, marked by a negative size; doc_id is the task
    task = TaskContext.get().partitionId()
    sent = [c.tobytes() for c in counts.reshape(PIECES, -1)]
    yield rows([[task] * PIECES, [None] * PIECES, [-1 - k for k in range(PIECES)], *[[None] * PIECES] * 3, sent])


def _sum_counts(key: tuple, rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_py(), np.int64) for c in rows.column("counts"))
    return pa.table({"n": pa.array([key[0].as_py()], pa.int64()), "team": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def _order(sent: DataFrame, tasks: int) -> np.ndarray:
    """How many texts fell into each bucket: the pieces summed team by team."""
    out = np.zeros(BUCKETS, np.int64)
    sums = sent.select("n", F.col("doc_id").alias("team"), "counts")
    while True:
        sums = sums.withColumn("team", F.floor(F.col("team") / TEAM)).groupBy("n", "team").applyInArrow(_sum_counts, "n long, team long, counts binary")
        tasks = -(-tasks // TEAM)
        if tasks <= 1:
            break
    size = BUCKETS // PIECES
    for row in sums.toLocalIterator():  # PIECES rows of a fixed size
        at = (-1 - row["n"]) * size
        out[at : at + size] = np.frombuffer(row["counts"], np.int64)
    return out


def _ordered_prefixes(counts):
    def run(batches):
        order = counts.value
        for batch in batches:
            for lo, hi in blocks_of(batch.column(BODY)):
                sets = shingle_sets(batch.column(BODY).slice(lo, hi - lo))
                keys = []
                for s in sets:
                    n = len(s)
                    first = s[np.argsort(order[_bucket(s)], kind="stable")]
                    keys.append(first[: n - (4 * n + 4) // 5 + 1 if n else 0].view(np.int64))
                flat = np.concatenate([np.zeros(0, np.int64), *keys])
                off = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array([node_of(s) for s in sets], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(off), pa.array(flat)),
                        pa.array([small_bitmap(s) for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "node", "keys", "sig"],
                )

    return run


def _shared_keys(bits):
    def run(batches):
        for batch in batches:
            keys = batch.column("keys")
            flat = keys.flatten().to_numpy(zero_copy_only=False)
            ok = passes(bits.value, flat) if len(flat) else np.zeros(0, bool)
            off = keys.offsets.to_numpy()
            who = np.repeat(np.arange(len(keys)), np.diff(off))[ok]
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[ok]), *(batch.column(n).take(pa.array(who)) for n in ("node", "n", "sig"))],
                ["key", "node", "n", "sig"],
            )

    return run


def _needed_sets(bits):
    def run(batches):
        for batch in batches:
            ok = passes(bits.value, batch.column("h").to_numpy()) if len(batch) else np.zeros(0, bool)
            batch = batch.filter(pa.array(ok))
            for lo, hi in blocks_of(batch.column(BODY)) if len(batch) else ():
                sets = shingle_sets(batch.column(BODY).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array([node_of(s) for s in sets], pa.int64()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    ["doc_id", "node", "hashes"],
                )

    return run


def _bound(batches):
    for batch in batches:
        n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
        apart = [differing(x.as_py(), y.as_py()) for x, y in zip(batch.column("bits_a"), batch.column("bits_b"), strict=True)]
        # overlap <= (n - apart) / 2 and a link needs 9 * overlap >= 4 * n
        ok = 9 * (n - np.array(apart, np.int64)) >= 8 * n
        yield batch.filter(pa.array(ok)).select(["a", "b"])


def _exact(batches):
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(s, t, assume_unique=True))
            ok.append(100 * both >= 80 * (len(s) + len(t) - both))
        yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])


def _id_or_none() -> Column:
    return F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id")


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are links: bit counts first, then exact intersection."""
    spark = docs.sparkSession
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    near = materialize(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_bound, "a long, b long"))
    ends = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    need = materialize(ends.join(nodes.select("node", "at"), "node"))
    # a node's set is read again from a document of its least doc_id
    bits = spark.sparkContext.broadcast(bit_filter(need, F.xxhash64("at"), 22))
    sets = (
        with_bytes(docs, _id_or_none(), F.xxhash64(_id_or_none()).alias("h"))
        .mapInArrow(_needed_sets(bits), "doc_id long, node long, hashes binary")
        .join(need.withColumnRenamed("at", "doc_id"), ["doc_id", "node"])
        .dropDuplicates(["node"])
        .select("node", "hashes")
    )
    sets = materialize(sets)
    one = lambda x: sets.select(F.col("node").alias(x), F.col("hashes").alias(f"set_{x}"))
    out = materialize(near.join(one("a"), "a").join(one("b"), "b").mapInArrow(_exact, "a long, b long"))
    discard(near, need, sets)
    return out


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _labelled(tiles: DataFrame, groups: DataFrame) -> DataFrame:
    """tiles with the component of each node and its number of members; written, as it is joined with itself."""
    sizes = materialize(groups.groupBy("component").agg(F.count("*").alias("members")))
    sized = materialize(groups.join(sizes, "component"))
    out = materialize(
        tiles.join(sized, "node", "left").withColumns({"component": F.coalesce("component", "node"), "members": F.coalesce("members", F.lit(1))})
    )
    discard(sizes, sized)
    return out


def _stars(tiles: DataFrame, turn: int) -> DataFrame:
    """(a, b): each node of a tile with one node of it, another at each turn, where components differ."""
    one = F.struct(F.col("node").alias("node_b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"), F.col("component").alias("component_b"))
    hubs = materialize(tiles.groupBy("key").agg(F.min_by(one, F.xxhash64("key", "node", F.lit(turn))).alias("x")).select("key", "x.*"))
    met = tiles.join(hubs, "key").where((F.col("component") != F.col("component_b")) & _may_link("", "_b"))
    return met.select(F.col("node").alias("a"), F.col("node_b").alias("b"))


def _meetings(tiles: DataFrame) -> DataFrame:
    """(a, b): all pairs of a tile whose components differ and that may be links."""
    # sizes of a link differ by a fifth at most, so its bands are the same or neighbours
    band = F.floor(F.log("n") / F.log(F.lit(1.26))).cast("int")
    mixed = materialize(
        tiles.groupBy("key")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max_by("component", "members").alias("largest"))
        .where("lo < hi")
        .select("key", "largest")
    )
    rows = materialize(tiles.join(mixed, "key").withColumn("band", band))
    rest = rows.where("component <> largest").withColumn("band", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))))
    rest = rest.select("key", "band", *(F.col(c).alias(f"{c}_b") for c in ("node", "n", "sig", "component")))
    # two nodes outside the largest component meet once, from the greater to the less
    met = rows.join(
        rest,
        (rows["key"] == rest["key"])
        & (rows["band"] == rest["band"])
        & (F.col("component") != F.col("component_b"))
        & ((F.col("component") == F.col("largest")) | (F.col("node_b") < F.col("node")))
        & _may_link("", "_b"),
    )
    return met.select(F.col("node").alias("a"), F.col("node_b").alias("b"))


def row_hash() -> Column:
    """Names the rows alike in doc_id and text (by chance 2**-64 two others as well)."""
    return F.xxhash64("doc_id", "text")


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n, node, component, component_id) for each row of docs; row is its `row_hash`.

    component names a group of linked nodes (null without words), component_id is its least doc_id (null if it has none).
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    made = materialize(
        with_bytes(docs, "doc_id", row_hash().alias("row")).mapInArrow(
            _prepare, "doc_id long, row long, n long, node long, bottom array<long>, bits binary, counts binary"
        )
    )
    rows = materialize(made.where("n >= 0").select("doc_id", "row", "n", "node"))
    sent = made.where("n < 0").select("n", "doc_id", "counts")
    order = _order(sent, (sent.agg(F.max("doc_id")).first()[0] or 0) + 1)
    nodes = materialize(
        made.where("n > 0")
        .groupBy("node")
        .agg(F.min("doc_id").alias("least"), F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("at"), F.first("n").alias("n"), F.first("bottom").alias("bottom"), F.first("bits").alias("bits"))
    )
    discard(made)
    # first pass: stars around the least node of each low hash
    low = nodes.select("node", "n", F.explode("bottom").alias("h"))
    hubs = materialize(low.groupBy("h").agg(F.min("node").alias("hub"), F.count("*").alias("c")).where("c > 1").select("h", "hub"))
    near = materialize(_pairs(low.join(hubs, "h").select(F.col("node").alias("a"), F.col("hub").alias("b"))))
    first = _links(near, nodes, docs)
    groups = components(first)
    discard(hubs, near)
    # tiles of prefix shingles that stand in more than one component
    labelled = materialize(
        nodes.select("node", "at", "n")
        .join(groups, "node", "left")
        .select("node", F.col("at").alias("doc_id"), "n", F.coalesce("component", "node").alias("component"))
    )
    prefixes = with_bytes(docs, _id_or_none()).mapInArrow(
        _ordered_prefixes(spark.sparkContext.broadcast(order)), "doc_id long, node long, keys array<long>, sig array<long>"
    )
    joined = prefixes.join(labelled, ["doc_id", "node"]).dropDuplicates(["node"])
    entries = materialize(joined.select("node", "n", "component", "keys", "sig"))
    shared = materialize(
        entries.select(F.explode("keys").alias("key"), "component")
        .groupBy("key")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo < hi")
        .select("key")
    )
    bits = spark.sparkContext.broadcast(bit_filter(shared, F.col("key")))
    tiles = materialize(
        entries.select("node", "n", "keys", "sig")
        .mapInArrow(_shared_keys(bits), "key long, node long, n long, sig array<long>")
        .join(shared, "key")
    )
    discard(labelled, entries, shared)
    links = first

    def more(meet, *how) -> DataFrame:
        own = _labelled(tiles, groups)
        pairs = materialize(_pairs(meet(own, *how)))
        found = _links(pairs, nodes, docs)
        discard(own, pairs)
        return links.union(found)

    for turn in range(STARS):
        links = more(_stars, turn)
        old, groups = groups, components(links)
        discard(old)
    links = more(_meetings)
    discard(tiles, groups)
    final = components(links)
    named = materialize(
        nodes.select("node", "least").join(final, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    )
    least = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")))
    of_node = materialize(named.join(least, "component").select("node", "component", "component_id"))
    discard(nodes, links, final, named, least)
    return rows.join(of_node, "node", "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    component_id is the least doc_id reachable by links, null if all rows reached have none. Texts without words (null,
    empty) have no shingles and stay alone. Every row takes part: rows of a null doc_id link like others, repeated
    rows, and rows of one doc_id with different texts, are each returned. Other columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    return grouped(docs).select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: of its least doc_id (a null one counts as the greatest).

    Decided row by row: where rows of one doc_id have different texts, each goes or stays with its own component. Of rows
    alike in doc_id and text one stays. Texts without words stay, once for each doc_id and text. Other columns are kept
    untouched; the names `_row` and `_touched` are refused; an empty table gives an empty result.
    """
    refuse(docs, "_row", "_touched")
    alone = F.when(F.col("n") == 0, F.col("row"))
    rows = materialize(grouped(docs).groupBy("doc_id", "row", "component", alone.alias("alone")).agg(F.count("*").alias("copies")))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "row", "copies")
    kept = materialize(rows.groupBy("component", "alone").agg(F.min(first).alias("x")).select(F.col("x.row").alias("_row"), F.col("x.copies").alias("_copies")))
    gone = materialize(rows.select(F.col("row").alias("_row")).join(kept, "_row", "left_anti").distinct())
    several = kept.where("_copies > 1").select("_row")
    # a filter of fixed size names the rows that may go or stand several times: only these are shuffled
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(gone.union(several), F.col("_row")))
    discard(rows)

    @F.arrow_udf(T.BooleanType())
    def touched(column: pa.Array) -> pa.Array:
        return pa.array(passes(bits.value, column.to_numpy(zero_copy_only=False)))

    keyed = docs.withColumn("_row", row_hash()).withColumn("_touched", touched("_row"))
    once = keyed.where("not _touched").drop("_row", "_touched")
    rest = keyed.where("_touched").drop("_touched").join(gone, "_row", "left_anti").dropDuplicates(["_row"]).drop("_row")
    return once.unionByName(rest).select(docs.columns)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT r, md5(array_to_string(g, ' ')) AS g FROM (
    SELECT r, w[i:i + 4] AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0))
), sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
pairs AS (
  SELECT a.r AS a, b.r AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r, r AS t FROM words UNION SELECT reach.r, edges.b FROM reach JOIN edges ON reach.t = edges.a)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM words w LEFT JOIN sizes s USING (r) JOIN reach ON reach.r = w.r JOIN words o ON o.r = reach.t
GROUP BY w.r, w.doc_id, s.n
"""
