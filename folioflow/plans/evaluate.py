"""Quality of text repair: word error rate, similarity, echo, rule audits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.similarity import running_sums, seq_ratio
from folioflow.functions.text import Rule, apply_fix_rules, hit_pattern, normalise_words, word_error_rate


def rule_hits(texts: DataFrame, rules: Iterable[Rule], text: str = "text", context: int = 22) -> DataFrame:
    """(matched, replacement, hits, example): how often each rule fires, with one place and its surroundings."""
    hits, firsts, becomes = hit_pattern(rules)
    table = F.create_map(*(F.lit(x) for kv in becomes.items() for x in kv))
    hit = f"(?=[<{firsts}])({hits})"
    # a hit's offset is what stands before it: each hit is matched with that as well, the lengths are summed over a text; where
    # no example is wanted, none of this is computed
    ends = running_sums(F.transform(F.regexp_extract_all("_t", F.lit(f"[\\s\\S]*?(?:{hit}|\\z)"), F.lit(0)), lambda w: F.length(w)))
    rows = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("_t"))
    rows = rows.select("_t", ends.alias("_ends"), F.posexplode(F.regexp_extract_all("_t", F.lit(hit), F.lit(1))).alias("_i", "matched"))
    at = F.get("_ends", F.col("_i")) - F.length("matched") + 1
    found = rows.where(~F.col("matched").startswith("<")).select("_t", at.alias("at"), "matched")
    around = F.substring("_t", F.greatest(F.col("at") - context, F.lit(1)), F.length("matched") + 2 * context)
    return found.groupBy("matched").agg(F.count("*").alias("hits"), F.min(around).alias("example")).withColumn("replacement", table[F.col("matched")])


def false_positive_audit(reference: DataFrame, rules: Iterable[Rule], text: str = "text", ignore: tuple[str, ...] = ("j",)) -> DataFrame:
    """Rules that would corrupt known-good text, most frequent first."""
    return rule_hits(reference, rules, text).where(~F.col("matched").isin(*ignore)).orderBy(F.desc("hits"), "matched")


def similarity(a: Column, b: Column) -> Column:
    return seq_ratio(normalise_words(a), normalise_words(b))


def error_rate(ref: Column, hyp: Column) -> Column:
    return word_error_rate(normalise_words(ref), normalise_words(hyp))


def echo_ratio(source: Column, output: Column, rules: Iterable[Rule] | None = None) -> Column:
    """Share of the input (after the rules, if given) that the output copies."""
    return similarity(apply_fix_rules(source, rules) if rules else source, output)


def evaluate_fixes(pairs: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """pairs (n, ocr, ref) with similarity and word error rate before and after the rules, and how much was echoed."""
    fixed = pairs.withColumn("fixed", apply_fix_rules(F.col("ocr"), rules))
    return fixed.select(
        "n",
        similarity(F.col("ref"), F.col("ocr")).alias("sim_before"),
        similarity(F.col("ref"), F.col("fixed")).alias("sim_after"),
        error_rate(F.col("ref"), F.col("ocr")).alias("wer_before"),
        error_rate(F.col("ref"), F.col("fixed")).alias("wer_after"),
        similarity(F.col("ocr"), F.col("fixed")).alias("echo"),
    )


def before_after(results: DataFrame) -> DataFrame:
    """Each example and a MEAN row, with deltas."""
    names = ["sim_before", "sim_after", "wer_before", "wer_after"]
    r = results.rollup("n").agg(*(F.avg(c).alias(c) for c in names), F.grouping("n").alias("_all"))
    example = F.when(F.col("_all") == 1, "MEAN").otherwise(F.col("n").cast("string"))
    return r.select(example.alias("example"), *names, (F.col("sim_after") - F.col("sim_before")).alias("sim_delta"), (F.col("wer_after") - F.col("wer_before")).alias("wer_delta"))


def eval_summary(results: DataFrame, raw: str = "raw") -> DataFrame:
    """Means per label of (label, similarity, wer, seconds, prompt_tokens, echo) and the gain over the raw label."""
    s = results.groupBy("label").agg(*(F.avg(c).alias(c) for c in ("similarity", "wer", "seconds", "prompt_tokens", "echo")), F.count("*").alias("n"))
    base = s.where(F.col("label") == raw).select(F.col("similarity").alias("_s"), F.col("wer").alias("_w"), F.lit(0).alias("_j"))
    j = s.withColumn("_j", F.lit(0)).join(base, "_j", "left")
    return j.select(*s.columns, (F.col("similarity") - F.col("_s")).alias("sim_delta"), (F.col("wer") - F.col("_w")).alias("wer_delta"))


def eval_pivot(results: DataFrame, labels: list[str], value: str = "similarity") -> DataFrame:
    return results.groupBy("example").pivot("label", labels).agg(F.avg(value))
