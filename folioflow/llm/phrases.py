"""Phrase collocations by Toivonen mining.

A sample of the documents (one of `SAMPLE`, chosen by a hash) proposes phrases: those with `LOW` occurrences or more in it. A
pass over all documents then counts all words, the proposed phrases, and their negative border: those that are not
proposed although both parts one word shorter are. All counts are exact. Where a word or border phrase turns out
frequent, what it admits has not been counted; another pass counts that, with all that this may admit in turn, and so on until
nothing frequent was missed. As a phrase occurs no oftener than its parts, nothing is lost.

Which phrases are proposed is told to the tasks by a bit filter of a fixed size. It never misses a member; what passes it by
chance is merely counted as well, so its size bounds memory and not results. A phrase is a 64-bit hash of those of
its first and last parts, so that counts, cuts and covering are found by joins of numbers (two phrases have one hash by chance
2**-64 a pair). Each task sums its counts up and hands them on as packed runs of hashes, which meet by ranges of the
hash. Only phrases that reach the result are spelled out, in a last pass.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import BODY, bit_filter, blocks_of, byte_view, materialize, mix64, passes, span_hashes, table, with_bytes

LONGEST, LEAST, TOP, COVER = 4, 30, 2000, 80
SAMPLE, LOW, FILTER_BITS = 4, 4, 26
#: Bytes of text whose phrases are hashed at once; hashes that a task holds before it hands them on.
BLOCK, HELD = 2_000_000, 1 << 20
#: Bytes of text for each range of hashes, so that what meets in one stays small; copies of a word that many phrases begin or end with, and of a pair.
RANGE_BYTES, FAN = 4 << 20, (32, 4, 1)

#: Byte -> 0 in words, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[[*b".,;:!?\n\x0b\x0c\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TURN = np.uint64(0xD6E8FEB86659FD93)


class Block:
    """Words of some texts: where they start and end, the piece and the row of each."""

    def __init__(self, texts: pa.Array):
        raw, off = byte_view(texts)
        self.buf = _LOWER[raw]
        kind = _KIND[raw]
        inside = np.zeros(len(kind) + 1, bool)
        inside[:-1] = kind == 0
        edge = np.zeros(len(kind) + 1, bool)
        edge[off] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | edge[1:]
        ends = inside[:-1] & (~inside[1:] | edge[1:])
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.row = np.searchsorted(off, self.starts, "right") - 1
        self.piece = np.cumsum(kind == 2)[self.starts] + self.row if len(kind) else self.starts
        self.counts = np.bincount(self.row, minlength=len(texts))

    def hashes(self, lang: np.ndarray) -> np.ndarray:
        """Hashes of the words, by language."""
        return mix64(span_hashes(self.buf, self.starts, self.ends) + lang[self.row])

    def longer(self, shorter: np.ndarray) -> np.ndarray:
        """Hashes of the phrases of one word more; of those that leave a piece as well."""
        return mix64(shorter[:-1] * _TURN + shorter[1:])

    def whole(self, k: int) -> np.ndarray:
        """Which k words from each on are in one piece."""
        return self.piece[: max(len(self.piece) - k + 1, 0)] == self.piece[k - 1 :]

    def phrase(self, at: int, k: int) -> bytes:
        return b" ".join(self.buf[self.starts[i] : self.ends[i]].tobytes() for i in range(at, at + k))


def _lang_hash(lang: str) -> int:
    return (crc32(lang.encode()) << 32 | crc32(lang.encode()[::-1])) & 0xFFFFFFFFFFFFFFFF


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Block, np.ndarray]]:
    """(hash of each row's language, words, hashes of the words) of blocks of a batch."""
    body, langs = batch.column(BODY), batch.column("lang").to_pylist()
    for lo, hi in blocks_of(body, BLOCK):
        block = Block(body.slice(lo, hi - lo))
        known = {x: _lang_hash(x) for x in set(langs[lo:hi])}
        lang = np.array([known[x] for x in langs[lo:hi]], np.uint64)
        yield lang, block, block.hashes(lang)


def _unique(keys: np.ndarray, c: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Each row of keys once, ordered by the hash in the first column, and its count."""
    order = np.argsort(keys[:, 0], kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:, 0] != keys[:-1, 0]])) if len(keys) else np.zeros(0, np.int64)
    c = np.diff(np.append(first, len(keys))) if c is None else np.add.reduceat(c[order], first) if len(keys) else c
    return keys[first], c.astype(np.int64)


class Tally:
    """Counts of phrases (hash, first part, last part, language) that a task sums up before it hands them on.

    Under no words (k = 0) there are the languages with their numbers of words.
    """

    def __init__(self):
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {k: [] for k in range(LONGEST + 1)}
        self.size = 0

    def add(self, k: int, keys: np.ndarray, c: np.ndarray | None = None) -> None:
        if len(keys):
            self.parts[k].append(_unique(keys, c))
            self.size += len(self.parts[k][-1][0])

    def merge(self) -> None:
        for k, parts in self.parts.items():
            if len(parts) > 1:
                self.parts[k] = [_unique(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
        self.size = sum(len(p[0][0]) for p in self.parts.values() if p)

    def take(self, ranges: int, slim: bool) -> Iterator[pa.RecordBatch]:
        """All counts, a row for each number of words and range of hashes.

        keys: the hashes of both parts, from which the phrase's own follows; of words, and where slim, its own hash.
        """
        self.merge()
        bits = np.uint64(64 - ranges.bit_length() + 1)
        for k, parts in self.parts.items():
            for keys, c in parts:
                at = (keys[:, 0] >> bits).astype(np.int64) if ranges > 1 else np.zeros(len(keys), np.int64)
                edges = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
                langs, lang = np.unique(keys[:, 3], return_inverse=True)
                kept = keys[:, :1] if slim or k < 2 else keys[:, 1:3]
                pairs = list(zip(edges[:-1], edges[1:], strict=True))
                packed = [[kept[a:b].T.tobytes() for a, b in pairs], [_narrow(c[a:b]) for a, b in pairs], [b"" if slim else _narrow(lang[a:b]) for a, b in pairs], [b"" if slim else langs.tobytes()] * len(pairs)]
                yield pa.RecordBatch.from_arrays([pa.array(at[edges[:-1]]), pa.array(np.full(len(pairs), k, np.int32)), *(pa.array(x, pa.binary()) for x in packed)], PACKED)
        self.__init__()


PACKED = ["range", "k", "keys", "counts", "lang", "langs"]


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers from 0 as bytes, each of the width that the greatest needs."""
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64).tobytes()


def _wide(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, f"u{len(packed) // n}").astype(np.int64)


def _keys(k: int, block: Block, shorter: np.ndarray, h: np.ndarray, lang: np.ndarray, take: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(take)
    out = np.empty((len(at), 4), np.uint64)
    out[:, 0] = h[at]
    out[:, 1], out[:, 2] = (0, 0) if k == 1 else (shorter[at], shorter[at + 1])
    out[:, 3] = lang[block.row[at]]
    return out


def _count(ranges: int, now, before, words_too: bool, slim: bool = False):
    """Packed counts of all words and of the phrases that are admitted: both parts one word shorter pass the filter `now`.

    With `before`, a filter whose members `now` has all, only what that did not admit, and what this admits in turn. Without filters everything.
    """

    def run(batches):
        new, old = (x and x.value for x in (now, before))
        tally = Tally()
        for batch in batches:
            for lang, block, h in _blocks(batch):
                if words_too:
                    tally.add(1, _keys(1, block, h, h, lang, np.ones(len(h), bool)))
                    tally.add(0, np.repeat(lang[:, None], 4, axis=1), block.counts)
                own = np.zeros(len(h), bool)  # counted here first, so not known to the filters
                for k in range(2, LONGEST + 1):
                    take, n = block.whole(k), max(len(h) - 1, 0)
                    if new is not None:
                        member = passes(new, h) | own
                        take = take & member[:n] & member[1:]
                    if old is not None:
                        known = passes(old, h)
                        take = take & ~(known[:n] & known[1:])
                        own = take
                    shorter, h = h, block.longer(h)
                    tally.add(k, _keys(k, block, shorter, h, lang, take))
                    if old is None:
                        own = np.zeros(len(h), bool)
                if tally.size > HELD:
                    tally.merge()
                if tally.size > HELD // 2:
                    yield from tally.take(ranges, slim)
        yield from tally.take(ranges, slim)

    return run


FREQUENT = "h long, k int, p long, s long, g long, a long"


def _frequent(least: int, slim: bool = False):
    """Phrases of a range of hashes with `least` occurrences, and all languages; slim: of phrases the hash and count only."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        found = {k: ([], []) for k in range(LONGEST + 1)}
        for k, *packed in zip(*(rows[c].to_pylist() for c in PACKED[1:]), strict=True):
            raw = np.frombuffer(packed[0], np.uint64).reshape(1 if slim or k < 2 else 2, -1)
            full = np.zeros((raw.shape[1], 4), np.uint64)
            full[:, 0] = raw[0] if len(raw) == 1 else mix64(raw[0] * _TURN + raw[1])
            if len(raw) == 2:
                full[:, 1:3] = raw.T
            if not slim:
                full[:, 3] = np.frombuffer(packed[3], np.uint64)[_wide(packed[2], len(full))]
            found[k][0].append(full)
            found[k][1].append(_wide(packed[1], len(full)))
        out = []
        for k, (keys, counts) in found.items():
            if keys:
                once, c = _unique(np.concatenate(keys), np.concatenate(counts))
                often = (c >= least) | (k == 0)
                once, c = once[often].view(np.int64), c[often]
                out.append((once[:, 0], np.full(len(once), k, np.int32), once[:, 1], once[:, 2], once[:, 3], c))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.table([pa.array(np.ascontiguousarray(c)) for c in cols], names=["h", "k", "p", "s", "g", "a"])

    return run


def _spell(wanted):
    """(h, phrase) of the phrases whose hashes pass the filter, and of all languages, once in each batch."""

    def run(batches):
        for batch in batches:
            names: dict[tuple[int, int], bytes] = {(_lang_hash(x) - (1 << 64) * (_lang_hash(x) >> 63), 0): x.encode() for x in set(batch.column("lang").to_pylist())}
            for _, block, h in _blocks(batch):
                for k in range(1, LONGEST + 1):
                    h = block.longer(h) if k > 1 else h
                    at = np.flatnonzero(passes(wanted.value, h) & block.whole(k))
                    for x, i in zip(h[at].view(np.int64).tolist(), at.tolist(), strict=True):
                        if (x, k) not in names:
                            names[x, k] = block.phrase(i, k)
            hashes, sizes = (pa.array(c, t) for c, t in zip(zip(*names, strict=True), (pa.int64(), pa.int32()), strict=True)) if names else (pa.array([], pa.int64()), pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([hashes, sizes, pa.array(list(names.values()), pa.binary()).cast(pa.string())], ["h", "k", "phrase"])

    return run


def _admits(bits):
    @F.arrow_udf("boolean")
    def admits(h: pa.Array) -> pa.Array:
        return pa.array(passes(bits.value, h.to_numpy(zero_copy_only=False)))

    return admits


def prepared(docs: DataFrame) -> DataFrame:
    """Language and whole text as bytes; a null language is `und`, a null text empty."""
    return with_bytes(docs, F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))


def frequent_phrases(rows: DataFrame, least: int = LEAST, sample: int = SAMPLE, low: int = LOW, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, int]:
    """((h, k, p, s, g, a) of all phrases of up to `LONGEST` words with `least` occurrences, passes over all rows).

    rows: from `prepared`. p and s are the hashes of the parts without the last and without the first word, g that of the
    language; k = 0 has each language with its number of words. The
    sample's size and threshold tell how many passes are needed, never which phrases are found.
    """
    size = rows.agg(F.sum(F.octet_length(BODY))).first()[0] or 0
    ranges = 1 << max(5, (size // RANGE_BYTES).bit_length())

    def counts(part: DataFrame, now, before, words_too: bool, most: int, slim: bool = False) -> DataFrame:
        packed = part.mapInArrow(_count(ranges, now, before, words_too, slim), "range long, k int, keys binary, counts binary, lang binary, langs binary")
        return packed.groupBy("range").applyInArrow(_frequent(most, slim), FREQUENT)

    def filter_of(found: DataFrame) -> np.ndarray:
        return bit_filter(found.where(F.col("k").between(1, LONGEST - 1)), F.col("h"), filter_bits)

    broadcast = rows.sparkSession.sparkContext.broadcast
    proposed = counts(rows.where(F.pmod(F.xxhash64("lang", BODY), F.lit(sample)) == 0), None, None, True, low, slim=True)
    bits = filter_of(proposed)
    now = broadcast(bits)
    found = [materialize(counts(rows, now, None, True, least))]
    while True:
        every = reduce(DataFrame.unionByName, found)
        # frequent phrases that the filter does not have: what they admit has not been counted
        failed = found[-1].where(F.col("k").between(1, LONGEST - 1) & ~_admits(now)("h"))
        # after a further pass these are phrases that it counted, with all that they admit
        if len(found) > 1 or failed.isEmpty():
            return every, len(found)
        bits = bits | filter_of(failed)
        before, now = now, broadcast(bits)
        found.append(materialize(counts(rows, now, before, False, least)))


def _with_part(side: DataFrame, shorter: DataFrame, part: str, k: int, **values: str) -> DataFrame:
    """side with values of the phrase whose hash is in column `part`.

    A word may begin or end a great share of the phrases, so short phrases stand `FAN` times in the table, and each row meets one.
    """
    fan = FAN[k - 2]
    copies = F.explode(F.sequence(F.lit(0), F.lit(fan - 1))).alias("_salt")
    table_ = shorter.select(F.col("h").alias(part), *(F.col(c).alias(name) for name, c in values.items()), copies)
    return side.withColumn("_salt", F.pmod(F.xxhash64("h"), F.lit(fan)).cast("int")).join(table_, [part, "_salt"]).drop("_salt")


def scored(phrases: DataFrame) -> DataFrame:
    """(h, g, k, a, l, r, score) of the phrases of two words or more: their cut of the least score, then the first."""
    none = F.array().cast("array<long>")
    level = phrases.where("k = 1").withColumn("firsts", none).withColumn("lasts", none)
    out = None
    for k in range(2, LONGEST + 1):
        own = _with_part(phrases.where(F.col("k") == k), level, "p", k, _pa="a", _firsts="firsts")
        own = _with_part(own, level, "s", k, _sa="a", _lasts="lasts")
        # counts of the first 1, 2, .. words, and of the last ones
        firsts, lasts = F.concat("_firsts", F.array("_pa")), F.concat("_lasts", F.array("_sa"))
        level = materialize(own.select(*phrases.columns, firsts.alias("firsts"), lasts.alias("lasts")))
        out = level if out is None else out.unionByName(level)
    cut = F.struct(F.col("_j").alias("j"), F.element_at("firsts", F.col("_j")).alias("l"), F.element_at("lasts", F.col("k") - F.col("_j")).alias("r"))
    cuts = out.select("h", "g", "k", "a", "firsts", "lasts", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("_j")).select("h", "g", "k", "a", cut.alias("_c"))
    # products may pass 64 bits
    score = F.expr("(cast(a as decimal(20,0)) * 2000000BD) div (cast(_c.l as decimal(20,0)) + _c.r)").cast("long")
    best = cuts.groupBy("h", "g", "k", "a").agg(F.min(F.struct(score.alias("score"), F.col("_c.j"), F.col("_c.l"), F.col("_c.r"))).alias("_b"))
    return best.select("h", "g", "k", "a", "_b.l", "_b.r", "_b.score")


def uncovered(candidates: DataFrame, phrases: DataFrame, cover: int = COVER) -> DataFrame:
    """candidates but those that lie in a longer phrase of at least `cover` percent of their count.

    Of the longer phrases that hold one, those of one word more occur most.
    """
    longer = phrases.where("k > 2")
    most = longer.select(F.col("p").alias("h"), "a").unionByName(longer.select(F.col("s").alias("h"), "a")).groupBy("h").agg(F.max("a").alias("_most"))
    wide = lambda c, by: F.col(c).cast("decimal(20,0)") * by
    return candidates.join(most, "h", "left").where(F.col("_most").isNull() | (wide("_most", 100) < wide("a", cover))).drop("_most")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, cover: int = COVER, sample: int = SAMPLE, low: int = LOW, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` collocations of each language, by score, count, then phrase.

    docs: lang (null: `und`) and text (null: empty); other columns are ignored. Repeated rows count each time, texts are
    counted whole, an empty table gives no rows. Ties end with the phrase, in byte order, so no two rows are alike.
    """
    rows = prepared(docs)
    phrases, _ = frequent_phrases(rows, least, sample, low, filter_bits)
    by = [F.desc("score"), F.desc("a")]
    # those that tie for the last place are spelled out as well
    best = uncovered(scored(phrases), phrases, cover).withColumn("_rank", F.rank().over(Window.partitionBy("g").orderBy(*by)))
    best = materialize(best.where(F.col("_rank") <= top))
    wanted = rows.sparkSession.sparkContext.broadcast(bit_filter(best, F.col("h"), filter_bits))
    names = materialize(rows.mapInArrow(_spell(wanted), "h long, k int, phrase string").groupBy("h", "k").agg(F.min("phrase").alias("phrase")))
    langs = phrases.where("k = 0").select("g", F.col("a").alias("n")).join(names.where("k = 0").select(F.col("h").alias("g"), F.col("phrase").alias("lang")), "g")
    ranked = best.join(names.where("k > 0").select("h", "phrase"), "h").withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*by, "phrase"))).where(F.col("rank") <= top)
    return ranked.join(langs, "g").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 5) ks(k) WHERE len(ws) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, phrase, k, a, string_split(phrase, ' ') AS ws FROM f WHERE a >= 30 AND k >= 2
), cut AS (
  SELECT c.*, j, array_to_string(ws[1:j], ' ') AS le, array_to_string(ws[j + 1:k], ' ') AS ri FROM c, range(1, 4) js(j) WHERE j < k
), s AS (
  SELECT cut.lang, cut.phrase, cut.k, cut.a, fl.a AS l, fr.a AS r, CAST((CAST(cut.a AS HUGEINT) * 2000000) // (fl.a + fr.a) AS BIGINT) AS score
  FROM cut JOIN f fl ON fl.lang = cut.lang AND fl.phrase = cut.le JOIN f fr ON fr.lang = cut.lang AND fr.phrase = cut.ri
  QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY (CAST(cut.a AS HUGEINT) * 2000000) // (fl.a + fr.a), j) = 1
), inside AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM c, range(2, 4) ms(m), range(1, 4) iis(i) WHERE m < k AND i <= k - m + 1 GROUP BY ALL
), kept AS (
  SELECT s.* FROM s LEFT JOIN inside x USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
