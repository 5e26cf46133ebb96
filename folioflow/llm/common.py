"""Shared helpers of the training-data operators: checkpoints, byte-level words, hashing."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte -> lower-case byte; words of the "word character" kind keep digits, letters and all of 0x80-0xFF.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only on a single machine without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints")
    return found


def lean(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bound the Arrow batches that go to Python by `most` bytes, if the session leaves Spark's default (64 MB) as it is.

    Texts may be long, and a worker holds a batch, what it makes of it, and the next one.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "67108864b") in ("67108864b", "67108864"):
        spark.conf.set(name, str(most))


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: short lineage that outlives executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/folioflow/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*written: DataFrame) -> None:
    """Remove the files of frames from `materialize` that nothing will read any more."""
    for df in written:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/folioflow/" in folder:
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def refuse(df: DataFrame, *reserved: str) -> None:
    """Raise if df has a column of a name that an operator adds for itself."""
    clash = {c.lower() for c in df.columns} & {r.lower() for r in reserved}
    if clash:
        raise ValueError(f"rename the column(s) {', '.join(sorted(clash))}: the operator adds columns of these names")


def id_crc(col: Column) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


#: Name of the added column of whole texts as bytes; unlikely to clash with a column of the input.
BODY = "_text_as_bytes"


def text_bytes() -> Column:
    """The whole text as bytes (null text: empty)."""
    return F.coalesce(F.col("text"), F.lit("")).cast("binary")


def with_bytes(docs: DataFrame, *keep: str | Column) -> DataFrame:
    """The kept columns and the whole text as bytes."""
    return docs.select(*keep, text_bytes().alias(BODY))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (finaliser of a public splittable generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.ones(size, np.uint64)
            out[1:] = np.uint64(base)
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end] for every span, by polynomial prefix sums."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mix64(raw ^ mix64((ends - starts).astype(np.uint64)))


#: Bytes of text that array operations take at once. They make some hundred bytes for each, and what a worker frees in
#: pieces of several MB stays with it: with blocks of 500 kB a worker held 50 MB more, at no gain in time.
TEXT_BLOCK = 128_000


def blocks_of(column: pa.Array, limit: int = TEXT_BLOCK):
    """Runs (first, last) of rows that hold about `limit` bytes; a longer row stands alone."""
    off = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a binary column without nulls."""
    off = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs without ASCII white space) of rows of bytes; none reaches over a row's end."""
    word = ~_SPACE[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = off[:-1][off[:-1] < off[1:]]
    first[inner] = word[inner]
    last[inner[inner > 0] - 1] = word[inner[inner > 0] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lowered) and where each row's words start."""
    buf, off = byte_view(column)
    starts, ends = word_spans(buf, off)
    return span_hashes(_LOWER[buf], starts, ends), np.searchsorted(starts, off)


def bit_filter(df: DataFrame, hashed: Column, log2_bits: int = 24) -> np.ndarray:
    """A fixed-size membership filter (2**log2_bits bits) of a column of hashes; never misses a member.

    Its size does not depend on the data, so it may be broadcast; what passes is checked exactly by a join.
    """
    at = hashed.bitwiseAND(F.lit((1 << log2_bits) - 1))
    words = (
        df.select(F.shiftright(at, 6).alias("w"), F.expr("1L").alias("one"), at.bitwiseAND(F.lit(63)).cast("int").alias("b"))
        .groupBy("w")
        .agg(F.bit_or(F.expr("shiftleft(one, b)")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (log2_bits - 6), np.int64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def passes(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which of the hashes may be members."""
    at = hashed.view(np.uint64) & np.uint64(len(bits) * 64 - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b); a component is named by its least node.

    Rounds of least-neighbour labels followed by pointer jumping; each round is written to the shared folder.
    """
    both = materialize(edges.union(edges.select("b", "a")).toDF("node", "other").distinct())
    labels = materialize(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        least = (
            both.join(labels.withColumnRenamed("node", "other"), "other")
            .groupBy("node")
            .agg(F.min("component").alias("m"))
        )
        near = materialize(labels.join(least, "node").select("node", F.least("component", "m").alias("c"), F.col("component").alias("old")))
        jump = near.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        new = materialize(near.join(jump, "c").select("node", F.least("c", "cc").alias("component"), (F.col("old") != F.least("c", "cc")).alias("moved")))
        discard(near, labels)
        labels = new.select("node", "component")
        if new.where("moved").isEmpty():
            discard(both)
            return labels
