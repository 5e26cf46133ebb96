"""Similarities that need a loop over characters or words, as Arrow-batched functions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WINDOW = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word or big integer for each row of the table."""
    where = places(a)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & where.get(c, 0)
        row = (row + u) | (row - u)
    return (~row & full).bit_count()


def ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b); two empty texts are alike."""
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total if total else 100.0


#: Pairs that `ratios` compares at once.
PAIRS = 1 << 13


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """`ratio` of each pair, many at once; the texts of `a` have up to 64 characters."""
    if len(a) > PAIRS:
        return np.concatenate([ratios(a[i : i + PAIRS], b[i : i + PAIRS]) for i in range(0, len(a), PAIRS)])
    sizes, codes = [], []
    for texts, filling in ((a, -1), (b, -2)):
        size = np.array([len(t) for t in texts], np.int64)
        held = np.arange(size.max(initial=0)) < size[:, None]
        sizes.append(size)
        codes.append(np.full(held.shape, filling, np.int32))
        codes[-1][held] = codes_of("".join(texts))
    row = np.full(len(a), np.uint64((1 << 64) - 1))
    for j in range(codes[1].shape[1]):
        same = np.zeros(len(a), np.uint64)
        for i in range(codes[0].shape[1]):
            same |= (codes[0][:, i] == codes[1][:, j]).astype(np.uint64) << np.uint64(i)
        u = row & same
        row = (row + u) | (row - u)
    total = sizes[0] + sizes[1]
    return np.where(total > 0, 200.0 * np.bitwise_count(~row) / np.maximum(total, 1), 100.0)


#: Cells of a diagonal that are combed at once; phrases of like length share a batch.
CELLS = 1 << 14


def _comb(phrases: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Where the strand that leaves each column of text at the bottom came in, for every phrase.

    phrases: codes (longest, number of phrases), last character first; text: codes, none of them a phrase's filling, of one text or one for each phrase.
    Columns (text, phrases) of numbers: from the longest phrase's length on, the column at the top where the strand came
    in; below, it came in from the left. This is the string-substring part of semi-local comparison by combing (Tiskin):
    strands of row and column cross at most once, and turn where characters agree. A diagonal's cells do not depend on
    each other.
    """
    m, n = len(phrases), len(text)
    kind = np.int16 if m + n < 1 << 15 else np.int32
    rows = np.repeat(np.arange(m, dtype=kind)[:, None], phrases.shape[1], axis=1)
    cols = np.repeat(np.arange(m, m + n, dtype=kind)[:, None], phrases.shape[1], axis=1)
    wide = np.repeat(text[:, None], phrases.shape[1], axis=1) if text.ndim == 1 else text
    for d in range(m + n - 1):
        lo, hi = max(0, d - m + 1), min(n, d + 1)
        at = slice(m - 1 - d + lo, m - 1 - d + hi)
        h, v = rows[at], cols[lo:hi]
        turn = (phrases[at] == wide[lo:hi]) | (h > v)
        change = (h ^ v) & -turn.astype(kind)
        h ^= change
        v ^= change
    return cols


def _best_window(came: np.ndarray, m: int, longest: int, head: bool = True, tail: bool = True) -> tuple[int, int, float]:
    """(start, end, score) of the first best window of length m, or cut at an edge, from a phrase's strands.

    The common subsequence of a window is as long as the window less the strands that come in and leave inside it. Without
    head, or tail, the text goes on there, and no window is cut at that edge.
    """
    n = len(came)
    if not n or not m:
        return 0, 0, 0.0
    inner = came >= longest
    out = np.flatnonzero(inner)
    start_of = came[inner].astype(np.int64) - longest
    if m >= n:
        return 0, n, 200.0 * (n - len(out)) / (m + n)
    # windows start at 1 - m to n - 1; a strand from s to r lies in those that start from r - m + 1 to s
    lost = np.zeros(n + m, np.int64)
    first = out - m + 1
    held = first <= start_of
    np.add.at(lost, first[held] + m - 1, 1)
    np.add.at(lost, start_of[held] + m, -1)
    lost = np.cumsum(lost)[: n + m - 1]
    at = np.arange(1 - m, n)
    size = np.minimum(n, at + m) - np.maximum(0, at)
    score = 200.0 * (size - lost) / (m + size)
    lo, hi = 0 if head else m - 1, n + m - 1 if tail else n
    k = lo + int(score[lo:hi].argmax())
    return max(0, k + 1 - m), min(n, k + 1), float(score[k])


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)


def alignment_within(phrase: np.ndarray, text: np.ndarray, parts: list[tuple[int, int]]) -> tuple[int, int, float]:
    """(start, end, score) of the first best window that lies in one of the parts of the text; only windows at its edges are cut."""
    best = (0, 0, 0.0)
    for a, b in parts:
        came = _comb(phrase[::-1, None], text[a:b])[:, 0]
        s, e, score = _best_window(came, len(phrase), len(phrase), a == 0, b == len(text))
        if score > best[2]:
            best = (a + s, a + e, score)
    return best


class Bits:
    """Some texts (codes) side by side in one big integer, a bit for each character and an empty one after each text.

    The empty bit takes up what an addition carries out of a text.
    """

    def __init__(self, texts: list[np.ndarray]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes + 1)
        self.starts = self.ends - self.sizes - 1
        self.length = int(self.ends[-1]) if len(texts) else 0
        self.codes = np.full(self.length, -1, np.int32)
        held = np.ones(self.length, bool)
        held[self.ends - 1] = False
        self.codes[held] = np.concatenate([np.zeros(0, np.int32), *texts])
        self.full = self.number(held)

    @staticmethod
    def number(bits: np.ndarray) -> int:
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def places(self, chars: Iterable[str]) -> dict[str, int]:
        known = set(np.unique(self.codes).tolist())
        return {c: self.number(self.codes == ord(c)) for c in set(chars) if ord(c) in known}

    def sums(self, up: int, down: int = 0) -> np.ndarray:
        """For each text how many bits of `up` are set, less those of `down`."""
        bits = [np.unpackbits(np.frombuffer(x.to_bytes(-(-self.length // 8), "little"), np.uint8), bitorder="little")[: self.length] for x in (up, down)]
        sums = np.concatenate([[0], np.cumsum(bits[0].astype(np.int64) - bits[1])])
        return sums[self.ends] - sums[self.starts]

    def common(self, text: str, where: dict[str, int]) -> np.ndarray:
        """Length of the longest common subsequence of each text with one other."""
        full = row = self.full
        for c in text:
            if held := where.get(c, 0):
                u = row & held
                row = ((row + u) | (row ^ u)) & full
        return self.sums(full ^ row)


def edit_distances(text: str, entries: list[np.ndarray]) -> np.ndarray:
    """Edit distances of a text to each entry (codes), all at once: a bit of one big integer for each character of them (Myers)."""
    own = Bits(entries)
    full, starts, every = own.full, np.zeros(own.length, bool), (1 << own.length) - 1
    starts[own.starts] = True
    first, where = own.number(starts), own.places(text)
    more, less = full, 0  # where the column of the table goes up, and down, by one
    for c in text:
        same = where.get(c, 0)
        slant = (((same & more) + more) ^ more) | same | less
        up = (less | (every ^ (slant | more))) << 1 | first
        more, less = ((slant & more) << 1 | (every ^ (slant | up))) & full, up & slant
    return len(text) + own.sums(more, less & full)


#: Bits of windows that are compared with a phrase at once; of fewer windows than the second number each is on its own.
WINDOW_BITS, FEW = 1 << 18, 12


def common_with(where: dict[str, int], m: int, text: str) -> int:
    """Length of the longest common subsequence of a text and a phrase of m characters, of which the places are given."""
    full = row = (1 << m) - 1
    for held in map(where.get, text):
        if held:
            u = row & held
            row = (row + u) | (row ^ u)
    return m - (row & full).bit_count()


def common_upto(where: dict[str, int], m: int, text: str, first: int) -> list[int]:
    """`common_with` of the text up to each place from `first` on."""
    full = row = (1 << m) - 1
    for held in map(where.get, text[: first - 1]):
        if held:
            u = row & held
            row = (row + u) | (row ^ u)
    out = []
    for held in map(where.get, text[first - 1 :]):
        if held:
            u = row & held
            row = ((row + u) | (row ^ u)) & full
        out.append(m - (row & full).bit_count())
    return out


def best_window(phrase: str, where: dict[str, int], text: str, s: int, least: float, parts: Callable, edges: tuple[int, int]) -> tuple[int, int, float] | None:
    """`alignment` of a phrase shorter than the text, near whose window at s it is found with a score of `least` or more.

    parts: a function of a score to the parts of the text that hold all whole windows of it; edges: how many grams of four
    characters the phrase holds of the first m - 1 characters of the text, and of the last. Null where that window scores
    less, or too many windows may score as much.
    """
    m, n = len(phrase), len(text)
    known = {s: common_with(where, m, text[s : s + m])}
    score = 100.0 * known[s] / m
    if score < least:
        return None
    least, back = (score - 1e-6) * m / 100, places(phrase[::-1])
    most: dict[int, int] = {}
    for part in parts(score - 1e-6):
        for a, b in [part] if part[1] - part[0] <= 2 * m else may_hold(where, m, text, [part], score - 1e-6, 2.0):
            # a window has no more in common than all that is before its end, or after its start
            before = {i: held for i, held in enumerate(common_upto(where, m, text[a:b], m), a) if held >= least}
            if before:
                a = min(before)
                after = common_upto(back, m, text[a:b][::-1], m)[::-1]
                most |= {i: min(held, after[i - a]) for i, held in before.items()}
    if most:
        i = max(most, key=most.get)
        known[i] = known[i] if i in known else common_with(where, m, text[i : i + m])
        score = max(score, 100.0 * known[i] / m)
        least = (score - 1e-6) * m / 100
    windows = [(i, i + m) for i in sorted(most) if most[i] >= least]
    if len(windows) * (m + 1) > WINDOW_BITS:
        return None
    if len(windows) < FEW:
        common = [known[a] if a in known else common_with(where, m, text[a:b]) for a, b in windows]
    else:
        codes = codes_of(text)
        own = Bits([codes[a:b] for a, b in windows])
        common = own.common(phrase, own.places(phrase)).tolist()
    # a window cut at an edge has no more in common than it has characters, and (see `least_shared`) so many grams
    shortest, c = max(1, int(score * m / (200 - score) - 1e-6)), score / 100
    demanded = (m + shortest) * (3.5 * c - 3) - 3 - 1e-6 if 3.5 * c > 3 else 0.0
    if shortest < m and edges[0] >= demanded:
        windows = [*((0, w) for w in range(shortest, m)), *windows]
        common = common_upto(where, m, text[: m - 1], shortest) + common
    if shortest < m and edges[1] >= demanded:
        windows += [(n - w, n) for w in range(m - 1, shortest - 1, -1)]
        common += common_upto(back, m, text[n - m + 1 :][::-1], shortest)[::-1]
    scores = 200.0 * np.array(common) / (m + np.array([b - a for a, b in windows]))
    k = int(scores.argmax())
    return *windows[k], float(scores[k])


class Bounds:
    """How much any window of a text can be like each of some phrases, from the characters, and pairs of them, that they share.

    Of a phrase of m characters a window of w shares a subsequence of L. L is at most the characters that both have. The
    m + w - 2L that are not in it split it into at most one run more, and each run of r has r - 1 pairs, so both have
    B >= 3L - m - w - 1 pairs. Scores are adjusted, so a window cut at an edge has at most 100 L / m as well.
    """

    STEP = 8

    def __init__(self, phrases: list[str]):
        codes = [codes_of(p).astype(np.int64) for p in phrases]
        self.sizes = np.array([len(c) for c in codes], np.int64)
        self.ones = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]))
        self.counts = np.zeros((len(phrases), len(self.ones)), np.int32)
        for i, c in enumerate(codes):
            np.add.at(self.counts[i], np.searchsorted(self.ones, c), 1)
        pairs = [self._pairs(c) for c in codes]
        self.twos = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))
        self.pairs = [np.unique(np.searchsorted(self.twos, p), return_counts=True) for p in pairs]

    @staticmethod
    def _pairs(codes: np.ndarray) -> np.ndarray:
        return codes[:-1] << 21 | codes[1:]

    def _sums(self, known: np.ndarray, found: np.ndarray, blocks: int) -> np.ndarray:
        """(grams, blocks + 1): how often each known gram stands before each block of STEP places."""
        out = np.zeros((len(known), blocks + 1), np.int32)
        if len(known) and len(found):
            at = np.minimum(np.searchsorted(known, found), len(known) - 1)
            hit = known[at] == found
            flat = at[hit] * blocks + np.flatnonzero(hit) // self.STEP
            out[:, 1:] = np.bincount(flat, minlength=len(known) * blocks).reshape(len(known), blocks)
            np.cumsum(out, axis=1, out=out)
        return out

    def of(self, text: np.ndarray, chosen: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(chosen, blocks): the most that a window that starts in each block of STEP places can score, in percent; and shares of common pairs.

        Where characters alone rule a phrase out, pairs are not looked at.
        """
        codes = text.astype(np.int64)
        blocks = max(1, -(-len(codes) // self.STEP))
        sums = self._sums(self.ones, codes, blocks)
        first = np.arange(blocks)
        sizes = self.sizes[chosen]
        # a window that starts anywhere in a block ends so many blocks later at most
        reach = (sizes + self.STEP - 2) // self.STEP + 1
        out, alike = np.zeros((len(chosen), blocks)), np.zeros(len(chosen))
        for r in np.unique(reach):
            own = np.flatnonzero(reach == r)
            here = sums[:, np.minimum(first + r, blocks)] - sums[:, :blocks]
            used = self.counts[chosen[own]]
            some = np.flatnonzero(used.any(axis=0))
            shared = np.minimum(here[None, some], used[:, some, None]).sum(axis=1)
            out[own] = 100.0 * shared / sizes[own, None]
        near = np.flatnonzero(out.max(axis=1, initial=0) >= least)
        sums = self._sums(self.twos, self._pairs(codes), blocks) if len(near) else sums
        for i in near.tolist():
            grams, counts = self.pairs[chosen[i]]
            own = sums[grams]
            shared = np.minimum(own[:, np.minimum(first + reach[i], blocks)] - own[:, :blocks], counts[:, None]).sum(axis=0)
            m = int(sizes[i])
            alike[i] = shared.max() / m
            out[i] = np.minimum(out[i], 100.0 * ((shared + 2 * m + 1) / 3) / m)
        return out, alike


def places(text: str) -> dict[str, int]:
    """The places of each character, as bits."""
    where: dict[str, int] = {}
    for i, c in enumerate(text):
        where[c] = where.get(c, 0) | 1 << i
    return where


def may_hold(where: dict[str, int], m: int, text: str, parts: list[tuple[int, int]], least: float, most: float = 1.5) -> list[tuple[int, int]]:
    """Of parts of the text, those of `most` times a phrase's length, or less, that may hold a window that scores `least`.

    A window shares no longer a subsequence than what it lies in, so a part is halved only where all of it shares enough.
    """
    out, todo = [], parts[::-1]
    while todo:
        a, b = todo.pop()
        if 100.0 * common_with(where, m, text[a:b]) / m >= least:
            if m < 4 or b - a <= max(most * m, m + 2):
                out.append((a, b))
            else:
                s = (a + b - m) // 2
                todo += [(s + 1, b), (a, s + m)]
    return out


def alignments(phrases: list[str], text: str, least: float = 0.0) -> list[tuple[int, int, float]]:
    """(start, end, score) of the window of text most like each phrase: of its length, or cut at an edge; the first best.

    All windows are compared exactly, those of all phrases at once. A phrase longer than the text is compared with all of
    it. Phrases that cannot reach `least` by the characters they share with the text may get score 0.
    """
    out = [(0, 0, 0.0)] * len(phrases)
    have = Counter(text)
    todo = []
    for i, p in enumerate(phrases):
        common = sum(min(c, have[x]) for x, c in Counter(p).items()) if least > 0 else len(p)
        # of the windows that hold so many, the shortest is most alike
        if p and text and 200.0 * common / (len(p) + common) >= least:
            todo.append(i)
    todo.sort(key=lambda i: len(phrases[i]))
    codes = codes_of(text)
    while todo:
        longest = len(phrases[todo[-1]])
        part, todo = todo[-max(1, CELLS // longest) :], todo[: -max(1, CELLS // longest)]
        grid = np.full((longest, len(part)), -1, np.int32)
        for k, i in enumerate(part):
            grid[longest - len(phrases[i]) :, k] = codes_of(phrases[i])[::-1]
        came = _comb(grid, codes)
        for k, i in enumerate(part):
            out[i] = _best_window(came[:, k], len(phrases[i]), longest)
    return out


def alignment(phrase: str, text: str, least: float = 0.0) -> tuple[int, int, float]:
    """`alignments` of one phrase."""
    return alignments([phrase], text, least)[0]


def adjusted_alignments(phrases: list[str], text: str, least: float = 0.0) -> list[tuple[int, int, float]]:
    """Alignment scores times min(L/m, m/L) for L the phrase's and m the window's length; 0 where 1.5 * text < phrase."""
    fits = [p if 1.5 * len(text) >= len(p) and 100.0 * len(text) >= least * len(p) - 1e-6 else "" for p in phrases]
    return [adjusted(len(p), found) for p, found in zip(phrases, alignments(fits, text, least), strict=True)]


def adjusted(size: int, found: tuple[int, int, float]) -> tuple[int, int, float]:
    """An alignment's score times min(L/m, m/L) for a phrase of `size` characters."""
    s, e, score = found
    m = e - s
    return (s, e, score * min(size / m, m / size)) if m else (0, 0, 0.0)


def adjusted_alignment(phrase: str, text: str, least: float = 0.0) -> tuple[int, int, float]:
    """`adjusted_alignments` of one phrase."""
    return adjusted_alignments([phrase], text, least)[0]


def word_ratio(a, b) -> float:
    return SequenceMatcher(None, list(a), list(b)).ratio()


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def running_sums(lists: pa.Array) -> pa.Array:
    """Each list of whole numbers with every number replaced by the sum up to it."""
    off = lists.offsets.to_numpy()
    sums = np.concatenate([[0], np.cumsum(lists.values.to_numpy(zero_copy_only=False)[: off[-1]], dtype=np.int64)])
    inner = lists.flatten().to_numpy(zero_copy_only=False)
    at = np.arange(off[0], off[0] + len(inner))
    out = (sums[at + 1] - np.repeat(sums[off[:-1]], np.diff(off))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array((off - off[0]).astype(np.int32)), pa.array(out))


#: Characters of texts that are combed at once, each with its own phrase.
PAIRED_CHARS = 1 << 22


def paired_alignments(phrases: list[str], texts: list[str]) -> list[tuple[int, int, float]]:
    """`alignment` of each phrase with its own text; pairs of like length are combed at once."""
    out = [(0, 0, 0.0)] * len(phrases)
    todo = [i for i, (p, t) in enumerate(zip(phrases, texts, strict=True)) if p and t]
    kind = lambda i: len(texts[i]).bit_length()
    todo.sort(key=lambda i: (kind(i), len(phrases[i])))
    while todo:
        longest, last = len(phrases[todo[-1]]), kind(todo[-1])
        most = max(1, min(CELLS // longest, PAIRED_CHARS >> last))
        part = [i for i in todo[-most:] if kind(i) == last]
        todo = todo[: -len(part)]
        grid = np.full((longest, len(part)), -1, np.int32)
        wide = np.full((max(len(texts[i]) for i in part), len(part)), -2, np.int32)
        for k, i in enumerate(part):
            grid[longest - len(phrases[i]) :, k] = codes_of(phrases[i])[::-1]
            wide[: len(texts[i]), k] = codes_of(texts[i])
        came = _comb(grid, wide)
        for k, i in enumerate(part):
            # strands that leave a column depend on the columns before it only
            out[i] = _best_window(came[: len(texts[i]), k], len(phrases[i]), longest)
    return out


@F.pandas_udf(_WINDOW)
def partial_alignment(phrase: pd.Series, text: pd.Series) -> pd.DataFrame:
    rows = paired_alignments(["" if x is None else x for x in phrase], ["" if x is None else x for x in text])
    return pd.DataFrame(rows, columns=["start", "end", "score"])


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Word-level matcher ratio of two arrays of words."""
    return pd.Series([None if x is None or y is None else word_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
