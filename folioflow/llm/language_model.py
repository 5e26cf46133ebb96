"""Scoring texts with a hashed maximum-entropy language model.

A token's probability is factored three times: its class (one of `CLASSES`), its group within the class (one of `GROUPS`),
and the token within its group. Class and group are drawn from softmaxes whose logits sum one weight row for each active
feature: the word before, the two before (n-gram), and the second and the third before (skips), hashed into rows whose
number grows with the number of distinct words (`rows_for`); for the group the features are joined with the class.
Within a group the only features are the words themselves, for which the maximum-entropy solution is the smoothed
relative frequency over all training texts.

Weights come from distributed gradient updates: in each round (one for each of `RATES`) every task takes all its training texts, sums
the gradient (observed less expected counts) of each row at the same weights, and the sums of all tasks make one step
per row, scaled by the expected counts. At the weights of the start the expected counts are known without reading, so a single round needs no softmax. Sums are of
whole numbers, so scores do not depend on how rows fall into tasks. Texts are numbered once, and the numbers kept for
all rounds and the scoring. Where the rows are too many to broadcast they stay on Spark: each block of tokens gets the
rows it needs by a join. Counts of all words are one distributed aggregation; the most frequent words (fewer than
`HEAD`) are broadcast, all others meet their counts in a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import BODY, discard, id_crc, materialize, mix64, table, with_bytes

HEAD, ROWS, CLASSES, GROUPS, OWN_CLASS, FEATURES = 1 << 18, 1 << 15, 64, 64, 24, 4
#: Number that stands for the places before a text; words beyond the head have those between HEAD and this.
START = (1 << 32) - 1
#: Weight rows more for the square root of the number of distinct words; more than BROADCAST_ROWS are joined to blocks of tokens.
ROOT_ROWS, BROADCAST_ROWS, BLOCK_TOKENS = 16, 1 << 18, 1 << 16
#: Tokens that a task learns from in a round before its sums are sent, if there are tasks enough for all cores.
TASK_TOKENS = 1 << 24
BATCH, SMOOTH, FOLDS = 1 << 11, 0.1, 10
#: Length of the step of each round, expected counts added to each row's own, and units of an expected count.
RATES, PRIOR, UNIT = (0.5,), 1.0, 1 << 16
#: The sums travel in so many pieces; a group that is summed holds a piece from at most TEAM tasks or teams.
PIECES, TEAM = 16, 32
END = b""


def rows_for(words: int) -> int:
    """Number of weight rows of each softmax for a corpus of so many distinct words."""
    return ROWS + ROOT_ROWS * isqrt(words)


def suffix_class(word: bytes) -> int:
    """Class of a word without a class of its own: by its last three bytes."""
    return OWN_CLASS + zlib.crc32(word[-3:]) % (CLASSES - OWN_CLASS)


def leaf_of(word: bytes) -> int:
    """Class and group of a word without a class of its own, as one number."""
    return suffix_class(word) * GROUPS + zlib.crc32(word) % GROUPS


def far_number(word: bytes) -> int:
    """Hashed number of a word beyond the head."""
    return HEAD + zlib.crc32(word) % (START - HEAD)


def _leaf_col(word: Column) -> Column:
    kind = F.lit(OWN_CLASS) + F.pmod(F.crc32(F.substring(word, -3, 3)), F.lit(CLASSES - OWN_CLASS))
    return (kind * GROUPS + F.pmod(F.crc32(word), F.lit(GROUPS))).cast("int")


def tokens(body: bytes) -> list[bytes]:
    return [*body.lower().split(), END]


class Vocabulary:
    """Numbers, leaves and counts of the most frequent words; other words get a hashed number."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        self.number = {w: i for i, w in enumerate(words)}
        self.counts = counts
        self.leaves = np.array([i * GROUPS if i < OWN_CLASS else leaf_of(w) for i, w in enumerate(words)], np.int64)

    def encode(self, body: bytes) -> tuple[np.ndarray, np.ndarray, Counter]:
        """(numbers, leaves, counts of the words beyond the head) of a text's tokens."""
        words = tokens(body)
        x = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        far = np.flatnonzero(x < 0).tolist()
        leaves = self.leaves[x] if len(self.leaves) else np.zeros(len(x), np.int64)
        for i in far:
            x[i] = far_number(words[i])
            leaves[i] = leaf_of(words[i])
        return x, leaves, Counter([words[i] for i in far])


def context_rows(numbers: np.ndarray, sizes: np.ndarray, n_rows: int, leaves: np.ndarray) -> np.ndarray:
    """The weight rows of each token's features, for its class, then for its group; places before a text are one more word."""
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(numbers)) - start

    def back(k: int) -> np.ndarray:
        out = np.full(len(numbers), START, np.int64)
        out[k:] = np.where(place[k:] >= k, numbers[: max(0, len(numbers) - k)], START)
        return out.astype(np.uint64)

    one, two, three = back(1), back(2), back(3)
    keys = (one, two * np.uint64(START + 1) + one, two, three)
    high, n, half = (leaves // GROUPS).astype(np.uint64), np.uint64(n_rows), np.uint64(32)
    out = np.empty((len(numbers), 2 * FEATURES), np.int32)
    for i, k in enumerate(keys):
        k = mix64(k * np.uint64(FEATURES) + np.uint64(i))
        out[:, i] = (k >> half) * n >> half
        k = mix64(k + high + np.uint64(1))
        out[:, FEATURES + i] = ((k >> half) * n >> half) + n
    return out


def logits(weights: np.ndarray, prior: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Prior plus the sum of weight rows, for each token; prior: a row of logits for all tokens or for each.

    A weight is at most a rate times the logarithm of a count, so sums stay far below where exp overflows.
    """
    z = weights.take(rows[:, 0], axis=0)
    for k in range(1, FEATURES):
        z += weights.take(rows[:, k], axis=0)
    z += prior
    return np.minimum(z, 80.0, out=z)


def log_probabilities(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log of the softmax of each row of z at one place; z is used up."""
    chosen = z[np.arange(len(z)), at]
    return chosen - np.log(np.exp(z, out=z).sum(axis=1))


class Model:
    """Prior logits of the classes and of the groups of each class; what the tables of weight rows add to them."""

    def __init__(self, class_prior: np.ndarray, group_prior: np.ndarray):
        self.of_class, self.of_group = class_prior, group_prior

    def log10(self, weights: np.ndarray, rows: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token's class and group."""
        out = np.zeros(len(rows))
        for a in range(0, len(rows), BATCH):
            r, (kind, group) = rows[a : a + BATCH], np.divmod(leaves[a : a + BATCH], GROUPS)
            out[a : a + len(r)] = log_probabilities(logits(weights, self.of_class, r[:, :FEATURES]), kind)
            many = np.flatnonzero(kind >= OWN_CLASS)  # a word with a class of its own is alone in it
            out[a + many] += log_probabilities(logits(weights, self.of_group[kind[many]], r[many, FEATURES:]), group[many])
        return out / np.log(10)

    def expect(self, weights: np.ndarray, sums: np.ndarray, rows: np.ndarray, leaves: np.ndarray) -> None:
        """Add each token's probabilities, in whole units, to the sums of its rows."""
        for a in range(0, len(rows), BATCH):
            r, kind = rows[a : a + BATCH], leaves[a : a + BATCH] // GROUPS
            many = np.flatnonzero(kind >= OWN_CLASS)
            for prior, at in ((self.of_class, r[:, :FEATURES]), (self.of_group[kind[many]], r[many, FEATURES:])):
                if len(at):
                    p = logits(weights, prior, at)
                    np.exp(p, out=p)
                    p *= UNIT / p.sum(axis=1, keepdims=True)
                    units = np.rint(p, out=p).astype(np.int32)
                    flat = at.T.ravel()
                    order = np.argsort(flat, kind="stable")
                    flat = flat[order]
                    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
                    sums[flat[first]] += np.add.reduceat(units[order % len(at)], first, axis=0)


def observe(sums: np.ndarray, rows: np.ndarray, leaves: np.ndarray) -> None:
    """Count each token's class, and its group where there are several, at its rows (first half classes, second groups)."""
    kind, group = np.divmod(leaves, GROUPS)
    many = kind >= OWN_CLASS
    n = len(sums) // 2
    for half, at, where in ((sums[:n], rows[:, :FEATURES], kind), (sums[n:], rows[many, FEATURES:] - n, group[many])):
        cells = at.astype(np.int64) * CLASSES + where[:, None]
        half += np.bincount(cells.ravel(), minlength=n * CLASSES).reshape(n, CLASSES).astype(half.dtype)


def stepped(weights: np.ndarray, observed: np.ndarray, expected: np.ndarray, rate: float) -> np.ndarray:
    """Weights after a step along the gradient, the difference in counts, scaled by the expected counts and damped."""
    gradient = (observed - expected).astype(np.float32)
    step = np.sign(gradient) * np.log1p(np.abs(gradient) / (np.minimum(expected, observed).astype(np.float32) + np.float32(PRIOR)))
    return (weights + np.float32(rate) * step).astype(np.float32)


_TOKENS = "row long, doc_id long, held_out boolean, sizes int, numbers binary, leaves binary, tail array<struct<word: binary, leaf: int, n: long>>"
_TAIL = pa.list_(pa.struct([("word", pa.binary()), ("leaf", pa.int32()), ("n", pa.int64())]))


def _encode(vocabulary):
    """Texts as numbers: kept for every later pass."""

    def run(batches):
        own, next_id = vocabulary.value, TaskContext.get().partitionId() << 36
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for body in batch.column(BODY):
                x, leaves, tail = own.encode(body.as_py())
                for c, v in zip(cols, (len(x), x.astype(np.uint32).tobytes(), leaves.astype(np.uint16).tobytes(), [{"word": w, "leaf": leaf_of(w), "n": n} for w, n in tail.items()]), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(next_id, next_id + len(batch))), batch.column("doc_id"), batch.column("held_out"),
                    pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary()), pa.array(cols[3], _TAIL),
                ],
                ["row", "doc_id", "held_out", "sizes", "numbers", "leaves", "tail"],
            )
            next_id += len(batch)

    return run


def _runs(batches, most: int = 1 << 17):
    """(rows of a batch, numbers, sizes, leaves), about `most` tokens at a time; a longer text stands alone."""
    for batch in batches:
        ends = np.cumsum(batch.column("sizes").to_numpy().astype(np.int64))
        lo = 0
        while lo < len(batch):
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
            part = batch.slice(lo, hi - lo)
            joined = lambda name, kind: np.frombuffer(b"".join(part.column(name).to_pylist()), kind).astype(np.int64)  # noqa: B023, E731
            yield part, joined("numbers", np.uint32), part.column("sizes").to_numpy().astype(np.int64), joined("leaves", np.uint16)
            lo = hi


def _sums(model: Model, weights, n_rows: int):
    """Each task's sums of a round: of observed counts without weights, else of expected ones."""

    def run(batches):
        sums = np.zeros((2 * n_rows, CLASSES), np.int32 if weights is None else np.int64)
        for _, numbers, sizes, leaves in _runs(batches):
            rows = context_rows(numbers, sizes, n_rows, leaves)
            if weights is None:
                observe(sums, rows, leaves)
            else:
                model.expect(weights.value, sums, rows, leaves)
        at = np.flatnonzero(sums.any(axis=1))
        if len(at):
            task, size = TaskContext.get().partitionId(), -(-2 * n_rows // PIECES)
            for piece, part in enumerate(np.split(at, np.searchsorted(at, np.arange(1, PIECES) * size))):
                if not len(part):
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array([piece], pa.int32()), pa.array([task], pa.int64()), pa.array([part.astype(np.int32).tobytes()], pa.binary()), pa.array([sums[part].astype(np.int64).tobytes()], pa.binary())],
                    ["piece", "task", "at", "sums"],
                )

    return run


def _add(size: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((size, CLASSES), np.int64)
        for a, s in zip(pdf["at"], pdf["sums"], strict=True):
            a = np.frombuffer(a, np.int32)
            total[a % size] += np.frombuffer(s, np.int64).reshape(-1, CLASSES)
        at = np.flatnonzero(total.any(axis=1))
        return pd.DataFrame({"piece": [key[0]], "task": [key[1]], "at": [(at + int(key[0]) * size).astype(np.int32).tobytes()], "sums": [total[at].tobytes()]})

    return run


def total_sums(encoded: DataFrame, model: Model, weights, n_rows: int, n_tokens: float):
    """(row numbers, sums), piece by piece: the sums of all tasks, added up team by team."""
    spark = encoded.sparkSession
    schema, size = "piece int, task long, at binary, sums binary", -(-2 * n_rows // PIECES)
    tasks = max(spark.sparkContext.defaultParallelism, -int(-n_tokens // TASK_TOKENS))
    sent = encoded.select("sizes", "numbers", "leaves").coalesce(tasks).mapInArrow(_sums(model, weights, n_rows), schema)
    levels = 1
    while TEAM**levels < tasks:
        levels += 1
    for _ in range(levels):
        sent = sent.withColumn("task", F.floor(F.col("task") / TEAM)).groupBy("piece", "task").applyInPandas(_add(size), schema)
    for row in sent.toLocalIterator():  # PIECES rows, a share of the weight table each
        yield np.frombuffer(row["at"], np.int32), np.frombuffer(row["sums"], np.int64).reshape(-1, CLASSES)


class Start:
    """Expected counts of rows at the start: a row's tokens dealt out by the prior.

    The class of a group's row is not kept with it, so its tokens are dealt out by the mean of all classes' groups.
    """

    def __init__(self, model: Model, n_rows: int, class_counts: np.ndarray):
        groups = (np.exp(model.of_group[OWN_CLASS:]) * class_counts[OWN_CLASS:, None]).sum(axis=0)
        self.n, self.classes = n_rows, np.exp(model.of_class)
        self.groups = groups / groups.sum() if groups.sum() else np.full(GROUPS, 1 / GROUPS)

    def __call__(self, at: np.ndarray, observed: np.ndarray) -> np.ndarray:
        return observed.sum(axis=1, keepdims=True) * np.where(at[:, None] < self.n, self.classes, self.groups)


def train(encoded: DataFrame, model: Model, start: Start, n_tokens: float, rates=RATES) -> np.ndarray:
    """Weights after a round for each of rates over the training rows of encoded."""
    weights = np.zeros((2 * start.n, CLASSES), np.float32)
    counted = {}
    for at, observed in total_sums(encoded, model, None, start.n, n_tokens):
        weights[at] = stepped(weights[at], observed, start(at, observed), rates[0])
        if len(rates) > 1:
            counted[int(at[0]) // -(-2 * start.n // PIECES)] = (at, observed)
    for rate in rates[1:]:
        base, size = encoded.sparkSession.sparkContext.broadcast(weights), -(-2 * start.n // PIECES)
        weights = weights.copy()
        for at, expected in total_sums(encoded, model, base, start.n, n_tokens):
            own, observed = counted[int(at[0]) // size]  # the same rows, as they are met by the same tokens
            seen = np.zeros((len(at), CLASSES), np.int64)
            seen[np.isin(at, own)] = observed[np.isin(own, at)]
            weights[at] = stepped(weights[at], seen, expected / UNIT, rate)
    return weights


_BLOCK = "block long, rows binary, leaves binary, owner binary, need array<long>"


def _blocks(n_rows: int):
    """Blocks of tokens with their weight rows, leaves and texts, and the distinct rows they need."""

    def run(batches):
        next_id = TaskContext.get().partitionId() << 36
        for part, numbers, sizes, leaves in _runs(batches):
            rows, owner = context_rows(numbers, sizes, n_rows, leaves), np.repeat(part.column("row").to_numpy(), sizes)
            for a in range(0, len(rows), BLOCK_TOKENS):
                r = rows[a : a + BLOCK_TOKENS]
                cols = [next_id], [r.tobytes()], [leaves[a : a + len(r)].tobytes()], [owner[a : a + len(r)].tobytes()], [np.unique(r).astype(np.int64)]
                types = pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["block", "rows", "leaves", "owner", "need"])
                next_id += 1

    return run


def _unpacked(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.frombuffer(block["rows"], np.int32).reshape(-1, 2 * FEATURES)
    return rows, np.frombuffer(block["leaves"], np.int64), np.frombuffer(block["owner"], np.int64)


def train_joined(encoded: DataFrame, start: Start, rate: float = RATES[0]) -> DataFrame:
    """(at, w): as the first round of `train`, for more rows than can be broadcast: sums of blocks meet by row."""

    def count(batches):
        for batch in batches:
            for block in batch.to_pylist():
                rows, leaves, _ = _unpacked(block)
                kind, group = np.divmod(leaves, GROUPS)
                many = np.where(kind >= OWN_CLASS, group, -1)
                cells = np.concatenate([rows[:, :FEATURES].astype(np.int64) * CLASSES + kind[:, None], np.where(many[:, None] < 0, -1, rows[:, FEATURES:].astype(np.int64) * CLASSES + many[:, None])])
                cell, n = np.unique(cells[cells >= 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell // CLASSES), pa.array(cell % CLASSES), pa.array(n)], ["at", "k", "n"])

    def step(batches):
        for pdf in batches:
            at = pdf["at"].to_numpy(np.int64)
            observed = np.zeros((len(at), CLASSES), np.int64)
            for i, cells in enumerate(pdf["cells"]):
                for c in cells:
                    observed[i, c["k"]] = c["n"]
            w = stepped(np.zeros(observed.shape, np.float32), observed, start(at, observed), rate)
            yield pd.DataFrame({"at": at, "w": list(w)})

    blocks = encoded.mapInArrow(_blocks(start.n), _BLOCK)
    cells = blocks.mapInArrow(count, "at long, k long, n long").groupBy("at", "k").agg(F.sum("n").alias("n"))
    return materialize(cells.groupBy("at").agg(F.collect_list(F.struct("k", "n")).alias("cells")).mapInPandas(step, "at long, w array<float>"))


def context_scores(encoded: DataFrame, model: Model, weights: DataFrame, n_rows: int) -> DataFrame:
    """(row, context): log10 of the probabilities of classes and groups of each text, blocks joined with their weight rows."""

    def score(tokens: pd.DataFrame, need: pd.DataFrame) -> pd.DataFrame:
        need = need.sort_values("at")
        at, w = need["at"].to_numpy(), np.zeros((len(need), CLASSES), np.float32)
        for i, x in enumerate(need["w"]):
            if x is not None:
                w[i] = x
        rows, leaves, owner = _unpacked(tokens.iloc[0])
        logs = model.log10(w, np.searchsorted(at, rows).astype(np.int32), leaves)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        return pd.DataFrame({"row": owner[first], "context": np.add.reduceat(logs, first)})

    blocks = materialize(encoded.select("row", "sizes", "numbers", "leaves").mapInArrow(_blocks(n_rows), _BLOCK))
    need = blocks.select(F.col("block").alias("of"), F.explode("need").alias("at")).join(weights, "at", "left")
    scored = blocks.drop("need").groupBy("block").cogroup(need.groupBy("of")).applyInPandas(score, "row long, context double")
    out = materialize(scored.groupBy("row").agg(F.sum("context").alias("context")))
    discard(blocks)
    return out


def _counts(batches):
    held: Counter = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

    for batch in batches:
        for body in batch.column(BODY):
            held.update(tokens(body.as_py()))
            if len(held) > 300_000:
                yield rows()
                held.clear()
    yield rows()


def _scores(model: Model, head_counts, weights, n_rows: int, totals: np.ndarray, total: float):
    """Scores of numbered texts by their head words, without weights lacking those of classes and groups."""

    def run(batches):
        (c, leaf), w = head_counts.value, weights.value if weights else None
        inside = np.log10((c + SMOOTH) / totals[leaf]) if len(c) else np.zeros(0)
        alone = np.log10((c + SMOOTH) / total)
        for part, numbers, sizes, leaves in _runs(batches):
            logs = model.log10(w, context_rows(numbers, sizes, n_rows, leaves), leaves) if w is not None else np.zeros(len(numbers))
            head = numbers < HEAD
            logs[head] += inside[numbers[head]]
            base = np.zeros(len(numbers))
            base[head] = alone[numbers[head]]
            first = np.cumsum(sizes) - sizes
            sums = [np.add.reduceat(x, first) for x in (head.astype(np.int64), base, logs)] if len(sizes) else [np.zeros(0)] * 3
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(sizes), *(pa.array(x) for x in sums), part.column("tail")],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail"],
            )

    return run


def head_words(counts: DataFrame, head: int) -> pa.Table:
    """(word, c) of the words more frequent than a threshold, the least one that leaves fewer than `head`; none is cut off by a tie.

    The threshold comes from how many words have each count, so each partition sends its share of the head only.
    """
    spread = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).toLocalIterator()  # a row for each distinct count
    held, least = 0, None
    for r in spread:
        if held + r["n"] >= head:
            break
        held, least = held + r["n"], r["c"]
    return counts.where(F.col("c") >= (1 << 62 if least is None else least)).orderBy(F.desc("c"), "word").toArrow()


def score_texts(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS, rates=RATES, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) for each row of docs.

    The model learns from the rows whose crc32(doc_id as text) mod 10 is not 0. Null and empty texts are the end alone;
    a null doc_id counts as the empty text in that rule; repeated rows count and are scored each on their own; other
    columns are ignored, whatever their names; without training rows all tokens are unknown; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", (F.pmod(id_crc(F.col("doc_id")), F.lit(FOLDS)) == 0).alias("held_out"))
    counts = materialize(with_bytes(docs.where("not held_out")).mapInArrow(_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))
    top = head_words(counts, head)
    own = Vocabulary(top["word"].to_pylist(), top["c"].to_numpy().astype(np.int64))
    shared = spark.sparkContext.broadcast(own)
    leaves = counts.groupBy(_leaf_col(F.col("word")).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).toArrow()
    tokens_in, words_in = np.zeros(CLASSES * GROUPS), np.zeros(CLASSES * GROUPS)
    tokens_in[leaves["k"].to_numpy()], words_in[leaves["k"].to_numpy()] = leaves["c"].to_numpy(), leaves["v"].to_numpy()
    n, v = float(tokens_in.sum()), float(words_in.sum())
    for i, word in enumerate(list(own.number)[:OWN_CLASS]):  # words with a class of their own leave their leaf
        tokens_in[leaf_of(word)] -= own.counts[i]
        words_in[leaf_of(word)] -= 1
        tokens_in[i * GROUPS], words_in[i * GROUPS] = own.counts[i], 1
    totals, total = tokens_in + SMOOTH * (words_in + 1), n + SMOOTH * (v + 1)
    by_class = tokens_in.reshape(CLASSES, GROUPS)
    share = lambda x: np.log((x + SMOOTH) / (x + SMOOTH).sum(axis=-1, keepdims=True)).astype(np.float32)
    model, n_rows = Model(share(by_class.sum(axis=1)), share(by_class)), rows_for(int(v))
    start = Start(model, n_rows, by_class.sum(axis=1))
    encoded = materialize(with_bytes(docs, "doc_id", "held_out").mapInArrow(_encode(shared), _TOKENS))
    taught, weights = encoded.where("not held_out"), None
    if n_rows <= broadcast_rows:
        weights = spark.sparkContext.broadcast(train(taught, model, start, n, rates))
    rows = materialize(
        encoded.mapInArrow(
            _scores(model, spark.sparkContext.broadcast((own.counts, own.leaves)), weights, n_rows, totals, total),
            "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
            "tail array<struct<word: binary, leaf: int, n: long>>",
        )
    )
    if not weights:
        contexts = context_scores(encoded, model, train_joined(taught, start, rates[0]), n_rows)
        rows = rows.join(contexts, "row").withColumn("score", F.col("score") + F.col("context")).drop("context")
    inside = F.element_at(F.lit(totals.tolist()), F.col("leaf") + 1)
    c = F.coalesce("c", F.lit(0))
    rest = materialize(
        rows.select("row", F.explode("tail").alias("x"))
        .select("row", "x.*")
        .join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"),
            F.sum(F.col("n") * F.log10((c + SMOOTH) / total)).alias("more_base"),
            F.sum(F.col("n") * F.log10((c + SMOOTH) / inside)).alias("more_score"),
        )
    )
    added = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return rows.drop("tail").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", added("n_known", "more_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        added("base_score", "more_base"), added("score", "more_score"),
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
