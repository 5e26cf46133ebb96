"""Packing documents into sequences of a fixed number of tokens, by bounded-space online best fit.

A task keeps at most `open_windows` sequences open. A document's whole windows become sequences of their own; its rest
goes into the open sequence that it fills best. When none has room, the fullest is filled up with the head of the
piece and emitted, and the tail is placed again. What is open when the task ends is merged over `merge_tasks` tasks at
a time, so padding is at most one part-filled sequence for each such group.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import materialize, table

WINDOW, OPEN_WINDOWS, MERGE_TASKS = 1024, 16, 64
END = "<|endoftext|>"


@lru_cache(2)
def tokenizer(ranks_path: str):
    """The byte-level vocabulary as ranks; gives the ids of its tokenizer file, that file's special text included."""
    import public_tokenizers
    import tiktoken

    pairs = map(bytes.split, open(ranks_path, "rb"))
    ranks = {base64.b64decode(a): int(b) for a, b in pairs}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END: len(ranks)})


@lru_cache(2)
def slow_tokenizer(tokenizer_path: str):
    """The tokenizer file itself: the same ids, at several times the cost."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path)


def encode(text: str, enc, tokenizer_path: str) -> np.ndarray:
    """A text's ids followed by the end id 0."""
    try:
        ids = np.asarray(enc.encode_to_numpy(text, allowed_special="all"), np.uint32)
    except ValueError:  # its pattern gives up on runs of some hundred thousand blanks or line breaks
        ids = np.asarray(slow_tokenizer(tokenizer_path).encode(text, add_special_tokens=False).ids, np.uint32)
    return np.append(ids, np.uint32(0))


def best_fit(gaps: list[int], size: int) -> int:
    """The place of the least gap that holds size, or -1."""
    best, at = 1 << 60, -1
    for i, g in enumerate(gaps):
        if size <= g < best:
            best, at = g, i
    return at


class Packer:
    """Bounded-space best fit over (document, ids) pieces; emit() gets (sequence, offset, document, start, ids, total)."""

    def __init__(self, emit, window: int, open_windows: int, base: int):
        self.emit, self.window, self.most, self.next = emit, window, open_windows, base
        self.gaps: list[int] = []
        self.held: list[list[tuple]] = []

    def flush(self, at: int) -> None:
        seq, offset = self.next, 0
        self.next += 1
        self.gaps.pop(at)
        for doc, start, ids, total in self.held.pop(at):
            self.emit(seq, offset, doc, start, ids, total)
            offset += len(ids)

    def put(self, at: int, piece: tuple) -> None:
        self.held[at].append(piece)
        self.gaps[at] -= len(piece[2])
        if not self.gaps[at]:
            self.flush(at)

    def add(self, doc, ids: np.ndarray) -> None:
        total = len(ids)
        start = 0
        while total - start >= self.window:
            self.emit(self.next, 0, doc, start, ids[start : start + self.window], total)
            self.next += 1
            start += self.window
        while start < total:
            at = best_fit(self.gaps, total - start)
            if at < 0 and len(self.gaps) < self.most:
                self.gaps.append(self.window)
                self.held.append([])
                at = len(self.gaps) - 1
            if at >= 0:
                self.put(at, (doc, start, ids[start:], total))
                return
            at = min(range(len(self.gaps)), key=self.gaps.__getitem__)
            cut = start + self.gaps[at]
            self.put(at, (doc, start, ids[start:cut], total))
            start = cut


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in PIECE.split(", ")]


class _Rows:
    def __init__(self):
        self.cols = [[] for _ in range(7)]
        self.ids: list[bytes | None] = []

    def emit(self, seq, offset, doc, start, ids, total, keep=False):
        raw = ids.astype("<u4").tobytes()
        for c, v in zip(self.cols, (doc, start, len(ids), zlib.crc32(raw), total, seq, offset), strict=True):
            c.append(v)
        self.ids.append(raw if keep else None)

    def batch(self, task: int) -> pa.RecordBatch:
        n = len(self.ids)
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in self.cols), pa.array(self.ids, pa.binary()), pa.array([task] * n, pa.int64())],
            [*_NAMES, "ids", "task"],
        )


def _pack(ranks_path: str, tokenizer_path: str, window: int, open_windows: int):
    def run(batches):
        enc = tokenizer(ranks_path)
        task = TaskContext.get().partitionId()
        rows = _Rows()
        packer = Packer(lambda *a: rows.emit(*a), window, open_windows, task << 36)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                packer.add(doc, encode(text.as_py(), enc, tokenizer_path))
                if len(rows.ids) >= 4096:
                    yield rows.batch(task)
                    rows = _Rows()
        for held in packer.held:
            for doc, start, ids, total in held:
                rows.emit(-1, 0, doc, start, ids, total, keep=True)
        yield rows.batch(task)

    return run


def _merge(window: int):
    def run(key: tuple, held: pa.Table) -> pa.Table:
        order = lambda r: (r["task"], r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["ids_crc32"])
        rows = _Rows()
        seq, filled = (1 << 62) + (key[0].as_py() << 36), 0
        for r in sorted(held.to_pylist(), key=order):
            ids, at = np.frombuffer(r["ids"], "<u4"), 0
            while at < len(ids):
                part = ids[at : at + window - filled]
                rows.emit(seq, filled, r["doc_id"], r["start"] + at, part, r["doc_tokens"])
                at += len(part)
                filled += len(part)
                if filled == window:
                    seq, filled = seq + 1, 0
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(_NAMES, rows.cols, strict=True)})

    return run


def pack(
    docs: DataFrame,
    ranks_path: str | None = None,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    merge_tasks: int = MERGE_TASKS,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """One row for each piece: its document, place there, digest of its ids, sequence and place in the sequence.

    Null and empty texts are the end id alone; a null doc_id is kept as null; repeated rows are packed each on its
    own; texts longer than a window are cut; other columns are ignored; an empty table gives no pieces. Ids come from the
    rank file, those of texts that its pattern cannot take (very long runs of white space) from the tokenizer file of the same vocabulary.
    """
    if ranks_path is None or tokenizer_path is None:
        import public_tokenizers

        ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        tokenizer_path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed = materialize(rows.mapInArrow(_pack(ranks_path, tokenizer_path, window, open_windows), f"{PIECE}, ids binary, task long"))
    done = placed.where("sequence_id >= 0").select(*_NAMES)
    # a group holds at most merge_tasks * open_windows part-filled sequences
    rest = (
        placed.where("sequence_id < 0")
        .groupBy(F.floor(F.col("task") / merge_tasks).cast("long").alias("team"))
        .applyInArrow(_merge(window), PIECE)
    )
    return done.unionByName(rest)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
