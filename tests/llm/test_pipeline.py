"""The pipeline on a small table, and the SQL of the queries that have some."""

import pytest

import corpus_pipeline
from folioflow.llm.common import materialize
from folioflow.llm.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, DATA))
        assert docs.columns == columns, name
        assert 0.5 * before < docs.count() <= before
        before = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


@pytest.mark.parametrize("n", range(1, 11))
def test_a_query_for_each_operator(n):
    assert sum(q.startswith(f"op{n}_") for q in QUERIES) == 1
