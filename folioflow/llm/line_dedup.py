"""Removal of repeated passages by content-defined chunks of lines.

A rolling hash over the hashes of the last two lines chooses where a chunk ends, so inserted lines move no boundary but
the nearest. A line of `long_words` words or more is a chunk of its own, whatever stands around it (passages are often one line;
None turns this off). Chunks of two lines and `MANY_WORDS` words, or of one long line, may be removed. Equal hashes over all texts name the suspects; their bytes
are then compared by grouping, the first occurrence (least doc_id, then place) stays, and all others are cut out.
"""

from __future__ import annotations

import zlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import bit_filter, discard, materialize, passes, refuse, table

LONG_WORDS, MANY_WORDS, MASK, MOST_LINES = 40, 20, 3, 32


def chunks(body: bytes, long_words: int | None = LONG_WORDS) -> list[tuple[int, int, bytes]]:
    """(first line, end line, bytes) of the chunks that may be removed, in order; without long_words of several lines only."""
    lines = body.split(b"\n")
    out: list[tuple[int, int, bytes]] = []
    first, words, before = 0, 0, 0

    def close(end: int) -> None:
        if end - first > 1 and words >= MANY_WORDS:
            out.append((first, end, b"\n".join(lines[first:end])))

    for i, line in enumerate(lines):
        n = len(line.split())
        if long_words is not None and n >= long_words:
            close(i)
            out.append((i, i + 1, line))
            first, words, before = i + 1, 0, 0
            continue
        own = zlib.crc32(line)
        rolling = ((before * 0x9E3779B1 + own) * 0x85EBCA6B & 0xFFFFFFFF) >> 16
        words += n
        before = own
        if rolling & MASK == 0 or i + 1 - first >= MOST_LINES:
            close(i + 1)
            first, words = i + 1, 0
    close(len(lines))
    return out


def chunk_hash(chunk: bytes) -> int:
    return int.from_bytes(blake2b(chunk, digest_size=8).digest(), "little", signed=True)


def _hashes(long_words: int | None):
    def run(batches):
        for batch in batches:
            found = [[chunk_hash(c) for _, _, c in chunks(b.as_py(), long_words)] for b in batch.column("body")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], ["h"])

    return run


def _suspects(bits, long_words: int | None):
    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc, key, body in zip(batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist(), batch.column("body"), strict=True):
                found = chunks(body.as_py(), long_words)
                if not found:
                    continue
                h = np.array([chunk_hash(c) for _, _, c in found], np.int64)
                for k in np.flatnonzero(passes(bits.value, h)):
                    a, b, c = found[k]
                    for col, v in zip(cols, (doc, key, a, b, int(h[k]), c), strict=True):
                        col.append(v)
            types = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "row_key", "first", "end", "h", "chunk"])

    return run


def without_lines(text: str, spans: list[tuple[int, int]]) -> str:
    lines = text.split("\n")
    for a, b in sorted(spans, reverse=True):
        del lines[a:b]
    return "\n".join(lines)


def removals(docs: DataFrame, long_words: int | None = LONG_WORDS) -> DataFrame:
    """(row_key, removed) for each document that loses lines; removed: half-open ranges of line numbers, sorted."""
    rows = docs.select("doc_id", row_key().alias("row_key"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    hashes = rows.select("body").mapInArrow(_hashes(long_words), "h array<long>").select(F.explode("h").alias("h"))
    often = materialize(hashes.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(often, F.col("h")))
    found = materialize(
        rows.mapInArrow(_suspects(bits, long_words), "doc_id long, row_key long, first long, end long, h long, chunk binary").distinct()
    )
    place = F.struct("doc_id", "row_key", "first")
    # grouping by the bytes is the comparison; the bytes are then needed again only where two chunks have one hash
    groups = materialize(found.groupBy("h", "chunk").agg(F.min(place).alias("kept"), F.count("*").alias("c")))
    alike = materialize(groups.groupBy("h").agg(F.count("*").alias("chunks")).where("chunks > 1").select("h"))
    one = groups.where("c > 1").select("h", "kept").join(alike, "h", "left_anti")
    several = groups.where("c > 1").select("h", "chunk", "kept").join(alike, "h", "left_semi")
    one, several = materialize(one), materialize(several)
    again = found.drop("chunk").join(one, "h").unionByName(found.join(several, ["h", "chunk"]).drop("chunk"))
    out = materialize(
        again.where(~place.eqNullSafe(F.col("kept"))).groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct("first", "end"))).alias("removed"))
    )
    discard(often, found, groups, alike, one, several)
    return out


def row_key():
    return F.xxhash64("doc_id", "text")


def dedup_lines(docs: DataFrame, long_words: int | None = LONG_WORDS) -> DataFrame:
    """docs with its columns, repeated chunks cut out of text, n_chars (if there) made to agree, and `_removed`.

    Null and empty texts stay as they are. Rows alike in doc_id and text count as one place and are treated alike (they
    are told apart by a 64-bit hash, by chance 2**-64 a pair alike); a null doc_id comes before all others. Chunks
    repeated inside one text are cut as well. `_removed` is null where nothing was cut. Other columns are kept untouched;
    the names `_row_key` and `_removed` are refused; an empty table gives an empty result.
    """
    refuse(docs, "_row_key", "_removed")
    gone = removals(docs, long_words)
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(gone, F.col("row_key"), 22))

    @F.arrow_udf(T.BooleanType())
    def touched(column: pa.Array) -> pa.Array:
        return pa.array(passes(bits.value, column.to_numpy(zero_copy_only=False)))

    @F.arrow_udf(T.StringType())
    def cut(texts: pa.Array, removed: pa.Array) -> pa.Array:
        pairs = zip(texts, removed.to_pylist(), strict=True)
        return pa.array([t.as_py() if not r else without_lines(t.as_py(), [(x["first"], x["end"]) for x in r]) for t, r in pairs], pa.string())

    keyed = docs.withColumn("_row_key", row_key())
    hit = touched("_row_key")
    # only texts that lose lines are shuffled; with the exchange between them, and `cut` called once, a task needs one Python worker
    ranges = gone.withColumnsRenamed({"row_key": "_row_key", "removed": "_removed"}).hint("merge")
    losing = keyed.where(hit).join(ranges, "_row_key", "left").drop("_row_key")
    losing = losing.withColumn("text", cut.asNondeterministic()("text", "_removed"))
    if "n_chars" in docs.columns:
        fitting = F.length("text").cast(docs.schema["n_chars"].dataType)
        losing = losing.withColumn("n_chars", F.when(F.col("_removed").isNull(), F.col("n_chars")).otherwise(fitting))
    rest = keyed.where(~hit).drop("_row_key")
    return rest.withColumn("_removed", F.lit(None).cast(losing.schema["_removed"].dataType)).unionByName(losing.select(*docs.columns, "_removed"))


def keep_fresh(docs: DataFrame, long_words: int | None = LONG_WORDS) -> DataFrame:
    """docs after `dedup_lines`; a document all of whose words were repeats is left out."""
    out = dedup_lines(docs, long_words)
    return out.where(F.col("_removed").isNull() | (F.trim("text") != "")).select(docs.columns)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id",
        F.coalesce(F.size("_removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.aggregate(F.coalesce("_removed", F.array()), F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["first"]).alias("n_lines_removed"),
        F.array_join(F.transform(F.coalesce("_removed", F.array()), lambda x: F.concat_ws("-", x["first"], x["end"])), ",").alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )
