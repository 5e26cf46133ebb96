"""Sanitising personal data by how much terms reveal it.

Fixed patterns find protected values (email, ip, card, phone). Words within `reach` words of a value (or, with no reach,
all words of its text) are its neighbours. Over all texts it is counted in how many texts a word neighbours a value, in
how many the value stands, and in how many the word stands at all. A word discloses a value if it neighbours it in at
least `SUPPORT` texts, if at least `SHARE` of the word's texts are such, and if it gives at least `TOLD` of the
information that tells the value: pointwise mutual information over log2(texts / texts with the value). The latter is a
share, so the rule is the same for tables of any size and for values of any frequency. Such words are reported as
spans beside the values, wherever they neighbour them; `sanitise` removes words that (nearly) always go with one value
and generalises the others.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import ALNUM, bit_filter, materialize, passes, refuse, table, with_bytes, BODY

REACH, SUPPORT, SHARE, TOLD, CERTAIN = 6, 2, 0.5, 0.5, 0.95
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "term")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a failing match is not tried again further right: the digits' first place decides, so later ones are not looked at
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, in time proportional to the text: a match starts where the run before an @ starts."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at) if a < at else None
        if m:
            out.append((a, m.end()))
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of protected values, sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of sorted spans."""
    starts: list[int] = []
    ends: list[int] = []
    for a, _, b in spans:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def neighbours(text: str, spans: list[tuple[int, int, int]], reach: int | None = REACH) -> list[tuple[str, str, int, int]]:
    """(value, word, start, end) of the words of three letters or more around each value, none inside a value.

    One pass over the text's words and a binary search for each value. Without a reach, each distinct value has every
    word of the text.
    """
    lowered = text.translate(_LOWER)  # as long as the text; words are runs of the lowered one
    found = [(m.start(), m.end()) for m in _WORD.finditer(lowered)]
    starts, ends = [a for a, _ in found], [b for _, b in found]
    low, high = _merged(spans)

    def good(i: int) -> bool:
        a, b = found[i]
        k = bisect_left(low, b) - 1  # the last union that starts before the word's end
        return b - a >= 3 and (k < 0 or high[k] <= a) and not lowered[a:b].isdigit()

    out = []
    if reach is None:
        words = [i for i in range(len(found)) if good(i)]
        for value in dict.fromkeys(lowered[s:e] for s, _, e in spans):
            out += [(value, lowered[starts[i] : ends[i]], starts[i], ends[i]) for i in words]
        return out
    for s, _, e in spans:
        # words that end by the value's start, and words that start from its end on
        before, after = bisect_right(ends, s), bisect_left(starts, e)
        for i in (*range(max(0, before - reach), before), *range(after, min(len(found), after + reach))):
            if good(i):
                out.append((lowered[s:e], lowered[starts[i] : ends[i]], starts[i], ends[i]))
    return out


def word_hash(word: bytes) -> int:
    return zlib.crc32(word) | zlib.adler32(word) << 31


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64())]))
_NEAR = pa.list_(pa.struct([("value", pa.string()), ("word", pa.string()), ("h", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(reach: int | None):
    def run(batches):
        for batch in batches:
            spans, near = [], []
            for t in batch.column("text"):
                text = t.as_py()
                found = base_spans(text)
                spans.append([{"start": a, "kind": k, "end": b} for a, k, b in found])
                near.append(
                    [{"value": v, "word": w, "h": word_hash(w.encode()), "start": a, "end": b} for v, w, a, b in neighbours(text, found, reach)]
                    if found
                    else []
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(spans, _SPAN), pa.array(near, _NEAR)],
                ["doc_id", "row_key", "spans", "near"],
            )

    return run


def _frequencies(bits):
    def run(batches):
        known: dict[bytes, bool] = {}
        for batch in batches:
            counts: Counter[bytes] = Counter()
            for body in batch.column(BODY):
                words = set(body.as_py().translate(ALNUM).split())
                new = [w for w in words if w not in known]
                if new:
                    ok = passes(bits.value, np.array([word_hash(w) for w in new], np.int64))
                    known.update(zip(new, ok.tolist(), strict=True))
                counts.update([w for w in words if known[w]])
                if len(known) > 400_000:
                    known = {}
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode("utf-8", "replace") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "c"]
            )

    return run


def pairs_of(scanned: DataFrame) -> DataFrame:
    """(value, word, h, together) of the pairs that may disclose.

    A word stands in no fewer texts than it neighbours values in, so most words that are frequent beside values are ruled
    out before any text is read again for their counts.
    """
    near = scanned.select("row_key", F.explode("near").alias("x")).select("row_key", "x.value", "x.word", "x.h").distinct()
    pairs = near.groupBy("value", "word", "h").agg(F.count("*").alias("together")).where(F.col("together") >= SUPPORT)
    beside = near.select("row_key", F.col("word").alias("_word")).distinct().groupBy("_word").agg(F.count("*").alias("_texts"))
    likely = pairs.join(beside, F.col("word") == F.col("_word")).where(F.col("together") / F.greatest("_texts", "together") >= SHARE)
    return likely.select("value", "word", "h", "together")


def disclosing(scanned: DataFrame, docs: DataFrame) -> DataFrame:
    """(value, word, share, told) of the pairs whose word discloses the value; told is a share of the value's information."""
    pairs = materialize(pairs_of(scanned))
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(pairs, F.col("h"), 22))
    words = materialize(
        with_bytes(docs).mapInArrow(_frequencies(bits), "word string, c long").groupBy("word").agg(F.sum("c").alias("word_texts"))
    )
    near = scanned.select("row_key", F.explode("near").alias("x")).select("row_key", "x.value")
    values = materialize(near.distinct().groupBy("value").agg(F.count("*").alias("value_texts")))
    texts = docs.count()
    share = F.col("together") / F.greatest("word_texts", "together")
    needed = F.log2(F.lit(float(max(texts, 1))) / F.col("value_texts"))
    told = F.when(needed > 0, 1 + F.log2(share) / needed).otherwise(0.0)  # a value that all texts hold is no secret
    return (
        pairs.join(words, "word")
        .join(values, "value")
        .select("value", "word", share.alias("share"), told.alias("told"))
        .where((F.col("share") >= SHARE) & (F.col("told") >= TOLD))
    )


def _report(spans):
    named = F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), (x["kind"] + 1).cast("int")), x["start"], x["end"]))
    return F.array_join(named, ",")


def find_personal(docs: DataFrame, reach: int | None = REACH) -> DataFrame:
    """doc_id, row_key, `spans` (start, kind, end, certain) sorted, for each row of docs.

    Offsets are code points, ends exclusive. Null and empty texts have no spans; rows alike in doc_id and text count as
    one text in what words disclose but are each returned; a null doc_id is kept; other columns are ignored, whatever
    their names; an empty table gives an empty result. Texts are told apart by a 64-bit hash of doc_id and text, by
    chance 2**-64 a pair alike. With reach None terms are sought in whole texts, at the cost of a row for each pair of a
    text's values and words.
    """
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    scanned = materialize(
        rows.mapInArrow(
            _scan(reach),
            "doc_id long, row_key long, spans array<struct<start: long, kind: long, end: long>>, "
            "near array<struct<value: string, word: string, h: long, start: long, end: long>>",
        )
    )
    strong = materialize(disclosing(scanned, docs.select("text")))
    told = (
        scanned.select("row_key", F.explode("near").alias("x"))
        .select("row_key", "x.value", "x.word", "x.start", "x.end")
        .join(strong, ["value", "word"])
        .groupBy("row_key", "start", "end")
        .agg(F.max("share").alias("share"))
        .groupBy("row_key")
        .agg(F.collect_list(F.struct("start", F.lit(4).cast("long").alias("kind"), "end", (F.col("share") >= CERTAIN).alias("certain"))).alias("terms"))
    )
    told = materialize(told)
    spans = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit(True).alias("certain")))
    return scanned.select("doc_id", "row_key", "spans").join(told, "row_key", "left").select(
        "doc_id", "row_key", F.array_sort(F.when(F.col("terms").isNull(), spans).otherwise(F.concat(spans, "terms"))).alias("spans")
    )


def redact(text: str, spans) -> str:
    """text with values replaced by their kind, disclosing words removed if certain and generalised else."""
    out, done = [], 0
    for s in spans:
        if s["start"] >= done:
            word = "" if s["kind"] == 4 and s["certain"] else f"[{KINDS[s['kind']].upper()}]"
            out += [text[done : s["start"]], word]
            done = s["end"]
    return "".join(out) + text[done:]


def sanitise(docs: DataFrame, reach: int | None = REACH) -> DataFrame:
    """docs with its columns, values and disclosing words taken out of text.

    Null texts stay null, empty ones empty; repeated rows are each returned; other columns are kept untouched, but names
    that this operator adds meanwhile (`_row_key`, `_spans`) are refused; an empty table gives an empty result.
    """
    refuse(docs, "_row_key", "_spans")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else redact(t, s) for t, s in zip(text, spans, strict=True)])

    found = materialize(find_personal(docs, reach)).select(F.col("row_key").alias("_row_key"), F.col("spans").alias("_spans")).dropDuplicates(["_row_key"])
    joined = docs.withColumn("_row_key", F.xxhash64("doc_id", "text")).join(found, "_row_key", "left")
    return joined.select(*(cut("text", "_spans").alias("text") if c == "text" else F.col(c) for c in docs.columns))


def op6_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("spans")
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return find_personal(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *(count(k) for k in range(4)),
        F.sha2(_report(F.filter(s, lambda x: x["kind"] < 4)).cast("binary"), 256).alias("base_sha256"),
        _report(s).alias("spans"),
    )
