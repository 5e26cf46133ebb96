"""A training corpus from raw documents: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm.common import lean, materialize, table
from folioflow.llm.decontamination import keep_clean
from folioflow.llm.jaccard import keep_one
from folioflow.llm.line_dedup import keep_fresh
from folioflow.llm.packing import pack
from folioflow.llm.quality import keep_good


#: Bytes of an Arrow batch: half of what single operators take, as workers of several stages share an executor.
BATCH = 4 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    lean(spark, BATCH)  # holds for the stages after it as well
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages that stand in an earlier document; a document left without words goes."""
    return keep_fresh(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the least doc_id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents a twentieth of whose words stand in benchmark windows."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 1024 tokens."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A trained classifier, learned vectors and online packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
