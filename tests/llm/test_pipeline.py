"""Each stage of the pipeline on nulls, empty and long texts, ties, repeated rows and ids, empty tables and clashing columns."""

from __future__ import annotations

import corpus_pipeline as P
import pytest
from framewell.llm.shared import stash

from tests.conftest import DATA

LINE = " ".join(f"w{i} x{i % 7}" for i in range(60))
NEAR = LINE.replace("w59", "other")
OTHER = " ".join(f"q{i}" for i in range(50))
CLASHING = "doc_id long, text string, lang string, n_chars long, score string, predicted int, held_out string, attention int, n_passages int, d int, t int, spans_ string, spans int, row_id string, row_id_ string, row_hash string, row_spans int, row_number string, text_hash string, first string, label string, component int"


@pytest.fixture(scope="module")
def make(spark):
    def rows(*pairs):
        rest = (None, 5, "s", 3, "h", 4, 6, 1, 2, "x", 7, "a", "b", "c", 8, "n", "th", "f", "l", 9)
        return spark.createDataFrame([(i, t, *rest) for i, t in pairs], CLASHING)

    return rows


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES[:-1]])
def test_columns_and_empty_tables(spark, make, name):
    stage = dict(P.STAGES)[name]
    docs = make((1, LINE), (1, LINE), (None, LINE), (2, None), (3, ""), (4, "a " * 20000), (5, "b" * 50000))
    out = stash(stage(spark, docs, DATA))
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert all(r.row_id_ == "b" and r.text_hash == "th" and r.score == "s" for r in out.collect())
    assert stage(spark, make().limit(0), DATA).count() == 0


def test_near_dedup_keeps_one_of_each_group(spark, make):
    docs = make((3, LINE), (3, OTHER), (None, NEAR), (5, NEAR), (9, NEAR), (9, NEAR), (7, None), (7, None), (8, ""), (None, OTHER), (1, "short"))
    assert left(P.near_dedup(spark, docs, DATA)) == sorted([(3, LINE), (3, OTHER), (7, None), (7, None), (8, ""), (1, "short")], key=str)
    twice = make((4, LINE), (4, LINE), (None, NEAR), (None, OTHER), (None, OTHER))
    assert left(P.near_dedup(spark, twice, DATA)) == sorted([(4, LINE), (None, OTHER)], key=str)


def test_decontamination_judges_each_text(spark, make):
    item = next(r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if r.text and len(r.text.split()) > 20)
    docs = make((3, item), (3, OTHER), (None, item + " more"), (None, None), (4, ""))
    assert left(P.decontamination(spark, docs, DATA)) == sorted([(3, OTHER), (None, None), (4, "")], key=str)


def test_pii_redacts_each_row(spark, make):
    docs = make((3, "mail joe@example.com"), (3, OTHER), (None, "call +1 (212) 555-0100"), (None, None), (4, ""))
    assert left(P.pii(spark, docs, DATA)) == sorted([(3, "mail [EMAIL]"), (3, OTHER), (None, "call [PHONE]"), (None, None), (4, "")], key=str)


def test_quality_judges_equal_texts_alike(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    twins = docs.unionByName(docs.withColumn("doc_id", docs.doc_id * 0 + 10**9 + docs.doc_id))
    kept = {r.doc_id for r in P.quality(spark, twins, DATA).collect()}
    assert {i for i in kept if i < 10**9} == {i - 10**9 for i in kept if i >= 10**9}


def test_packing_takes_all_rows(spark, make):
    docs = make((3, LINE), (3, LINE), (None, None), (4, ""))
    out = P.packing(spark, docs, DATA).collect()
    assert sorted((r.doc_id or 0, r.length > 1) for r in out) == [(0, False), (3, True), (3, True), (4, False)]
    assert P.packing(spark, make().limit(0), DATA).count() == 0
