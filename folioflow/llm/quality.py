"""Quality classifier: supervised subword embeddings.

A text is the mean of the learned vectors of its hashed words, its hashed character n-grams (word ends marked) and one
feature for words that repeat the one before; a softmax over the two labels reads that mean. Vectors and output weights
are fitted by numpy stochastic gradient descent in one Spark task over a bounded sample of labelled rows (`sample_rows`,
the rows of least hash); every text is then scored whole. As the output is linear in the mean, each feature shrinks to
one number before scoring, so only that fixed-size table is broadcast, and a block of texts is scored by array operations
over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import BODY, blocks_of, byte_view, id_crc, span_hashes, table, text_bytes, with_bytes, word_spans

BUCKETS, WIDTH, SAMPLE_ROWS, EPOCHS = 1 << 16, 16, 4000, 4
NGRAMS = (2, 3, 4)
#: Bucket of the words that equal the word before, and so many blank features are added to every mean, so that a
#: text of a few words is judged by little more than the share of the labels.
SAME, BLANK = 0, 60


def _bucket(x: np.ndarray) -> np.ndarray:
    """Buckets from 1 on of 32-bit numbers, by multiplicative hashing."""
    return 1 + (x * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int64) % (BUCKETS - 1)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each feature of each text of a binary column, with repeats."""
    buf, off = byte_view(column)
    starts, ends = word_spans(buf, off)
    n = len(starts)
    row = np.searchsorted(off, starts, "right") - 1
    words = span_hashes(buf, starts, ends)
    same = np.flatnonzero((words[1:] == words[:-1]) & (row[1:] == row[:-1])) + 1
    size = ends - starts
    # all words in one row of bytes, each between two marks
    first = np.cumsum(size + 2) - size - 2
    marked = np.full(int((size + 2).sum()), ord(">"), np.uint32)
    marked[first] = ord("<")
    inside = np.repeat(first + 1 - (np.cumsum(size) - size), size) + np.arange(size.sum())
    marked[inside] = buf[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    room = np.repeat(first + size + 2, size + 2) - np.arange(len(marked))  # bytes from here to the word's end
    of = np.repeat(row, size + 2)
    found, rows = [_bucket((words >> np.uint64(32)).astype(np.uint32)), np.full(len(same), SAME)], [row, row[same]]
    for k in NGRAMS:
        gram = np.zeros(max(0, len(marked) - k + 1), np.uint32)
        for j in range(k):
            gram |= marked[j : j + len(gram)] << np.uint32(8 * j)
        whole = room[: len(gram)] >= k
        found.append(_bucket(gram[whole] ^ np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)))
        rows.append(of[: len(gram)][whole])
    return np.concatenate(found) if n else np.zeros(0, np.int64), np.concatenate(rows) if n else np.zeros(0, np.int64)


def bags(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct buckets and their shares of the mean."""
    out = []
    for t in texts:
        at, count = np.unique(features(pa.array([t], pa.binary()))[0], return_counts=True)
        out.append((at, count / (count.sum() + BLANK)))
    return out


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weight per bucket, bias) of the log odds of label 1; without both labels, the share of label 1 alone."""
    share = (labels.sum() + 1.0) / (len(labels) + 1.5)
    bias = np.array([0.0, float(np.log(share / (1 - share)))])
    if not 0 < labels.sum() < len(labels):
        return np.zeros(BUCKETS), float(bias[1])
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 1.0 / WIDTH, (BUCKETS, WIDTH))
    out = rng.normal(0, 0.1, (WIDTH, 2))
    made = bags(texts)
    total = EPOCHS * len(made)
    step = 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(made)):
            at, w = made[i]
            rate = 1.0 * (1 - step / total) + 0.01
            step += 1
            h = w @ vectors[at]
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= rate * np.outer(h, p)
            bias -= 0.1 * rate * p
            # a feature's step is not divided by the text's length, as in usual mean-of-vectors training
            vectors[at] -= (rate * np.minimum(1.0, w * 50))[:, None] * back
    return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(tuple(r[c] for c in ("doc_id", BODY, "y")) for b in batches for r in b.to_pylist())
    weights, bias = fit([body for _, body, _ in rows], np.array([y for *_, y in rows], np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f8").tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Fit on at most `sample_rows` labelled rows outside the held-out fold (crc32(doc_id) mod 5 = 0).

    Rows with a null id or label teach nothing; of several labels of a document the least counts.
    """
    taught = (
        labels.select("doc_id", F.col("quality").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (F.pmod(id_crc(F.col("doc_id")), F.lit(5)) != 0))
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    # at most sample_rows rows of two numbers: bounded, so it may be broadcast
    rows = (
        with_bytes(docs, "doc_id")
        .join(F.broadcast(taught), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", BODY)
        .limit(sample_rows)
        .coalesce(1)
    )
    got = rows.mapInArrow(_train, "weights binary, bias double").first()
    if got is None:  # nothing to learn from
        return fit([], np.zeros(0, np.int64))
    return np.frombuffer(got["weights"], "<f8"), got["bias"]


def scorer(weights: np.ndarray, bias: float):
    """A column function from a text's bytes to its score: only texts go to Python, one copy of each."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for bodies in batches:
            scores = []
            for lo, hi in blocks_of(bodies):
                at, row = features(bodies.slice(lo, hi - lo))
                total = np.bincount(row, weights[at], minlength=hi - lo)
                mean = total / (np.bincount(row, minlength=hi - lo) + BLANK)
                scores.append(1 / (1 + np.exp(-np.clip(bias + mean, -50, 50))))
            yield pa.array(np.concatenate(scores) if scores else np.zeros(0))

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row (doc_id, held_out, score, predicted) for each row of docs.

    Null and empty texts have no features and get the score of the bias alone; repeated rows are scored alike; other
    columns are ignored, whatever their names; without usable labels, or with one label only, all texts get the
    (smoothed) share of label 1; an empty table gives an empty result.
    """
    score = scorer(*train(docs, labels, sample_rows))
    scored = docs.select("doc_id", (F.pmod(id_crc(F.col("doc_id")), F.lit(5)) == 0).alias("held_out"), score(text_bytes()).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose text is not rejected, with all their columns, whatever their names.

    Null and empty texts are judged by the share of the labels; rows alike are all kept or all left out; an empty table
    gives an empty result.
    """
    score = scorer(*train(docs, labels))
    return docs.where(score(text_bytes()) >= threshold)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
