"""The operators' queries agree with their SQL, and the pipeline's stages keep what they should."""

from __future__ import annotations

import pytest
from framewell.llm.queries import ORACLE_SQL, QUERIES

from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(name, agree):
    agree(QUERIES[name], ORACLE_SQL[name])


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        out = P.stash(stage(spark, docs, DATA))
        assert out.columns == columns and 0 < out.count() <= docs.count(), name
        if name == "pii":
            assert out.filter("text LIKE '%@mail%'").count() == 0 and out.count() == docs.count()
        docs = out
    packed = P.packing(spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 4096").count() == 0
