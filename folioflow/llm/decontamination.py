"""Benchmark decontamination by full-text indexes over shards of the training texts.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lowered. Each shard (a run of texts inside one task) gets an
FM-index of all its words, whatever is searched for: the Burrows-Wheeler transform of its word numbers in a wavelet
matrix, and the suffix positions of every eighth place. All windows of the benchmark are searched backward at once by
ranks, their occurrences are located by walking to the next sampled position, and overlapping occurrences merge into
spans of words to remove.

The benchmark is the stated query set. It is cut into blocks of about `block_words` words, fetched and broadcast one at a
time. A single block is searched as soon as a shard is indexed; several blocks search one written index.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import ALNUM, blocks_of, discard, materialize, refuse, table, text_bytes

WINDOW, SAMPLE, SHARD_BYTES, BLOCK_WORDS = 13, 8, 1_500_000, 2_000_000
END, GAP = 0, 1


def words_of(body: bytes) -> list[bytes]:
    return body.translate(ALNUM).split()


class Phrases:
    """Distinct windows of one block of benchmark items, over the block's own word numbers.

    Windows of items without an id hit words, but name no item.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            ids = [number.setdefault(w, len(number)) for w in words]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).update([] if item is None else [item])
        self.words = list(number)
        by_size: dict[int, list[tuple[int, ...]]] = {}
        for w in found:
            by_size.setdefault(len(w), []).append(w)
        self.windows = {n: np.array(w, np.int64) for n, w in by_size.items()}
        self.items = {n: [sorted(found[x]) for x in w] for n, w in by_size.items()}


class WaveletMatrix:
    """Ranks over a sequence of numbers below 2**depth: one row of bits for each bit, with counts before every 64."""

    def __init__(self, seq: np.ndarray, depth: int):
        self.depth, self.bits, self.before, self.zeros = depth, [], [], []
        for level in range(depth - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.pad(packed, (0, 8 + -len(packed) % 8)).view(np.uint64)
            counts = np.zeros(len(packed), np.int32)
            np.cumsum(np.bitwise_count(packed[:-1]), out=counts[1:])
            self.bits.append(packed)
            self.before.append(counts)
            self.zeros.append(len(seq) - int(bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` bits of row k are set."""
        word, place = at >> 6, (at & 63).astype(np.uint64)
        under = self.bits[k][word] & ((np.uint64(1) << place) - np.uint64(1))
        return self.before[k][word].astype(np.int64) + np.bitwise_count(under)

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where prefix ends `at` of the sequence arrive in the last row when they follow symbol's bits."""
        for k in range(self.depth):
            one = self._ones(k, at)
            at = np.where((symbol >> (self.depth - 1 - k)) & 1, self.zeros[k] + one, at - one)
        return at

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for k in range(self.depth):
            one = self._ones(k, at)
            bit = ((self.bits[k][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            out = out * 2 + bit
            at = np.where(bit, self.zeros[k] + one, at - one)
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes; the text's last number must be its only least.

    Two places are ordered at once, then twice as many in each round, but only suffixes still alike are sorted again.
    """
    n = len(text)
    wide = int(text.max()) + 2
    key = text * wide
    key[:-1] += text[1:] + 1
    order = np.argsort(key)
    ordered = key[order]
    head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    first = np.repeat(head, np.diff(np.append(head, n)))  # where each suffix's group of like ones starts
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = first, -1
    slots, step = np.arange(n), 2
    while True:
        group = rank[order[slots]]
        alike = np.zeros(len(slots), bool)
        same = group[1:] == group[:-1]
        alike[1:] |= same
        alike[:-1] |= same
        slots = slots[alike]
        if not len(slots):
            return order
        at = order[slots]
        key = rank[at] * (n + 2) + rank[np.minimum(at + step, n)] + 1
        sort = np.argsort(key)
        at, key = at[sort], key[sort]
        order[slots] = at
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        rank[at] = slots[np.repeat(head, np.diff(np.append(head, len(key))))]
        step *= 2


class FMIndex:
    """Backward search and location over numbers from 1; 0 is the end mark."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        text = np.append(text.astype(np.int64), END)
        order = suffix_array(text)
        depth = max(1, int(text.max()).bit_length())
        self.tree = WaveletMatrix(text[order - 1], depth)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=(1 << depth) + 1))])[: (1 << depth) + 1]
        self.base = self.tree.down(np.arange(1 << depth), np.zeros(1 << depth, np.int64))
        self.size = len(text)
        sampled = order % sample == 0
        self.ranked = np.concatenate([[0], np.cumsum(sampled)]).astype(np.int32)
        self.positions = order[sampled].astype(np.int32)

    def _rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.tree.down(symbol, at) - self.base[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern numbers, first row, end row) of the patterns of one length that occur."""
        who = np.flatnonzero(((patterns < len(self.base)) & (patterns > GAP)).all(axis=1)) if len(patterns) else np.zeros(0, np.int64)
        lo, hi = np.zeros(len(who), np.int64), np.full(len(who), self.size, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[who, j]
            lo, hi = self._rank(c, lo), self._rank(c, hi)
            live = lo < hi
            who, lo, hi = who[live], lo[live], hi[live]
        return who, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order."""
        out, steps, left = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(left):
            r = rows[left]
            hit = self.ranked[r + 1] > self.ranked[r]
            out[left[hit]] = self.positions[self.ranked[r[hit]]] + steps[left[hit]]
            left = left[~hit]
            r = rows[left]
            rows[left] = self._rank(self.tree.symbol(r), r)
            steps[left] += 1
        return out


class Shard:
    """The index of a run of texts: word numbers of its own, a gap after each text."""

    def __init__(self, bodies: list[bytes]):
        self.number: dict[bytes, int] = {}
        new = self.number.setdefault
        rows = []
        for body in bodies:
            rows += [new(w, len(self.number) + 2) for w in words_of(body)]
            rows.append(GAP)
        text = np.array(rows, np.int64)
        self.ends = np.flatnonzero(text == GAP)  # each text's gap
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else self.ends
        self.index = FMIndex(text) if len(self.number) else None

    def sizes(self) -> list[int]:
        return (self.ends - self.starts).tolist()

    def find(self, phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
        """Per text: merged spans of hit words, and the items that occur."""
        spans: list[list[tuple[int, int]]] = [[] for _ in self.ends]
        items: list[set[str]] = [set() for _ in self.ends]
        if self.index is None:
            return spans, [[] for _ in items]
        own = np.array([self.number.get(w, GAP) for w in phrases.words], np.int64)
        mark = np.zeros(self.index.size + 1, np.int64)
        for size, windows in phrases.windows.items():
            who, lo, hi = self.index.search(own[windows])
            if not len(who):
                continue
            count = hi - lo
            at = self.index.locate(np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()))
            np.add.at(mark, at, 1)
            np.add.at(mark, at + size, -1)
            doc = np.searchsorted(self.ends, at)
            for d, w in np.unique(np.stack([doc, np.repeat(who, count)]), axis=1).T:
                items[d].update(phrases.items[size][w])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(mark) > 0).astype(np.int8), [0]])))
        for a, b in zip(edge[::2], edge[1::2], strict=True):  # no span reaches over a gap
            d = int(np.searchsorted(self.ends, a))
            spans[d].append((int(a - self.starts[d]), int(b - self.starts[d])))
        return spans, [sorted(x) for x in items]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FOUND = "struct<n_words: long, spans: array<struct<first: long, end: long>>, items: array<string>>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _spans(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"first": a, "end": b} for a, b in s] for s in spans], _SPANS)


def _at_once(phrases):
    """A column function: each batch of texts is indexed in shards, which are searched at once and forgotten."""

    @F.arrow_udf(FOUND)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = phrases.value
        for column in batches:
            sizes, spans, items = [], [], []
            for lo, hi in blocks_of(column, SHARD_BYTES):
                shard = Shard(column.slice(lo, hi - lo).to_pylist())
                s, i = shard.find(own)
                sizes += shard.sizes()
                spans += s
                items += i
            yield pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int64()), _spans(spans), pa.array(items, pa.list_(pa.string()))], ["n_words", "spans", "items"]
            )

    return found


def _write_index(batches):
    for batch in batches:
        for lo, hi in blocks_of(batch.column("body"), SHARD_BYTES):
            part = batch.slice(lo, hi - lo)
            shard = Shard(part.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part.column("row").to_pylist()], pa.list_(pa.int64())),
                    pa.array([shard.sizes()], pa.list_(pa.int64())),
                    pa.array([pickle.dumps(shard)], pa.binary()),
                ],
                ["rows", "sizes", "shard"],
            )


def _search_index(phrases):
    def run(batches):
        own = phrases.value
        for batch in batches:
            for rows, shard in zip(batch.column("rows"), batch.column("shard"), strict=True):
                spans, items = pickle.loads(shard.as_py()).find(own)
                hit = [k for k, s in enumerate(spans) if s]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows.as_py(), pa.int64()).take(pa.array(hit, pa.int64())), _spans([spans[k] for k in hit]), pa.array([items[k] for k in hit], pa.list_(pa.string()))],
                    ["row", "spans", "items"],
                )

    return run


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])))
def _merge_spans(column: pa.Array) -> pa.Array:
    return _spans([merge_spans([(x["first"], x["end"]) for x in row]) for row in column.to_pylist()])


def phrase_blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Phrases]:
    """The benchmark's windows, block by block; an item longer than a block is cut so that no window is lost."""
    words = F.expr(r"regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', 0)")
    step = max(1, block_words)
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(step)), lambda i: F.slice(F.col("w"), i + 1, step + window - 1)
    )
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
    items = items.select("item", F.explode(pieces).alias("w"))
    blocks = max(1, -(-(items.agg(F.sum(F.size("w"))).first()[0] or 0) // block_words))
    if blocks > 1:
        items = materialize(items.withColumn("block", F.pmod(F.xxhash64("item", "w"), F.lit(blocks))))
    for k in range(blocks):
        part = (items.where(F.col("block") == k) if blocks > 1 else items).select("item", F.array_join("w", " ").cast("binary").alias("body")).toArrow()
        yield Phrases([(i, words_of(b)) for i, b in zip(part["item"].to_pylist(), part["body"].to_pylist(), strict=True)], window)


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with its columns and `_found`: n_words, spans (word places) and items (ids as text, sorted).

    A document word is hit inside any occurrence of a window of an item; items of fewer words than `window` are one
    window; items and texts without words (null, empty) have none; windows of items with a null id hit but name no item;
    items of the same id count once; repeated documents are each annotated; an empty benchmark hits nothing; an empty
    table gives an empty result. Other columns are kept untouched; the names `_found` and `_row` are refused.
    """
    refuse(docs, "_found", "_row")
    spark = docs.sparkSession
    blocks = phrase_blocks(benchmark, window, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return docs.withColumn("_found", _at_once(spark.sparkContext.broadcast(first))(text_bytes()))
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()))
    index = materialize(
        rows.select(F.col("_row").alias("row"), text_bytes().alias("body")).mapInArrow(_write_index, "rows array<long>, sizes array<long>, shard binary")
    )
    hits = None
    for block in (b for part in ([first, second], blocks) for b in part):
        got = materialize(
            index.select("rows", "shard").mapInArrow(_search_index(spark.sparkContext.broadcast(block)), "row long, spans array<struct<first: long, end: long>>, items array<string>")
        )
        hits = got if hits is None else hits.unionByName(got)
    merged = hits.groupBy("row").agg(_flat("spans").alias("spans"), F.array_sort(F.array_distinct(_flat("items"))).alias("items"))
    merged = materialize(merged.withColumn("spans", _merge_spans("spans")))
    sizes = index.select(F.explode(F.arrays_zip("rows", "sizes")).alias("x")).select(F.col("x.rows").alias("row"), F.col("x.sizes").alias("n_words"))
    found = materialize(sizes.join(merged, "row", "left").select("row", F.struct("n_words", _or_empty("spans", _SPAN), _or_empty("items", "array<string>")).alias("_found")))
    discard(index)
    return rows.join(found.withColumnRenamed("row", "_row"), "_row").select(*docs.columns, "_found")


_SPAN = "array<struct<first: bigint, end: bigint>>"


def _flat(name: str) -> Column:
    return F.flatten(F.collect_list(name))


def _or_empty(name: str, kind: str) -> Column:
    return F.coalesce(name, F.array().cast(kind)).alias(name)


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["first"])


def contaminated(hit: Column, words: Column) -> Column:
    return (hit > 0) & (20 * hit >= words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """One row for each row of docs: what `annotate` finds, counted, and whether a twentieth of the words is hit."""
    found = annotate(docs.select("doc_id", "text"), benchmark, **how).select(
        "doc_id",
        F.col("_found.n_words").alias("n_words"),
        n_hit(F.col("_found.spans")).alias("n_hit"),
        F.size("_found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("_found.items")).cast("binary"), 256).alias("items_sha256"),
        F.col("_found.spans").alias("spans"),
    )
    return found.withColumn("contaminated", contaminated(F.col("n_hit"), F.col("n_words")))


def keep_clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns; null, empty and repeated texts as `annotate` says."""
    found = annotate(docs, benchmark, **how)
    return found.where(~contaminated(n_hit(F.col("_found.spans")), F.col("_found.n_words"))).select(docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


SQL = r"""
WITH words AS (
  SELECT rowid AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT *, row_number() OVER () AS rowid FROM documents)
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, w[i:i + least(len(w), 13) - 1] AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows), grams AS (
  SELECT r, n, i, w[i:i + n - 1] AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)
), found AS (SELECT r, i, n, item_id FROM grams JOIN windows USING (n, g)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
which AS (
  SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT r, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hits USING (r) LEFT JOIN which USING (r)
"""
