"""The registered queries over a small copy of the tables, and the pipeline stage by stage."""

import corpus_pipeline
import pytest
from helpers import assert_same

import __spark_entry__
from terrashift.llm import registry


def test_registered_once_each():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, data, duck, name):
    assert_same(registry.queries()[name](spark, data), duck, registry.oracle_sql()[name])


def test_stages_keep_columns_and_only_drop(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        if k == len(corpus_pipeline.STAGES) - 1:
            assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
            break
        assert out.columns == names and out.count() <= before
        before = out.count()
        docs = out
