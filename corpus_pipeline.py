"""A corpus in five stages: quality, near-duplicates, decontamination, personal data, packing.

Each stage takes what its predecessor kept, and all but the last return the columns of ``documents``, whatever further
columns there are and however they are named. A row is known by its doc_id and its text, so rows that share an id keep
their own fate, and rows without an id go through all stages. An empty table gives empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewell.llm.decontaminate import decontaminate
from framewell.llm.near_dedup import near_duplicates
from framewell.llm.packing import Packing, pack_documents
from framewell.llm.pii import redact
from framewell.llm.quality import Quality, apply, learn
from framewell.llm.queries import contaminated
from framewell.llm.shared import free_names, match_rows, stash

#: SQL can't express a learned score or a tokenizer.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null or empty text is scored as one blank passage, so it goes or stays by its score; equal texts share their fate.
    """
    conf = Quality()
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), conf)
    return apply(docs, model, conf).filter("predicted = 1").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id.

    A row without an id stays only where no other of its group has one. Several texts of a group that share the smallest
    id go by the smallest hash of the text; of rows that also agree in the text one stays, the first by a hash of all
    columns. Rows that share an id but are not near-duplicates all stay, as does every null or empty text.
    """
    found = stash(near_duplicates(docs.select("doc_id", "text")))
    out = match_rows(docs, found.filter("NOT first"), "left_anti")
    repeated = found.filter("linked AND first").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        number, whole = free_names(docs, "row_number", "row_whole")
        some = match_rows(out, repeated, "left_semi")
        some = some.withColumn(whole, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
        some = some.withColumn(number, F.row_number().over(Window.partitionBy(F.col("doc_id"), F.xxhash64("text")).orderBy(whole))).filter(F.col(number) == 1)
        out = match_rows(out, repeated, "left_anti").unionByName(some.drop(number, whole))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more stand in the benchmark go.

    It depends on the text alone: null and empty texts stay, and of rows that share an id only the contaminated ones go.
    """
    found = decontaminate(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return match_rows(docs, stash(found.filter(contaminated()).select("doc_id", "text_hash").distinct()), "left_anti")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the text. All rows stay; null and empty texts stay as they are."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences. A null or empty text is its end id; repeated rows are packed like any others."""
    return pack_documents(docs, Packing(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stash(docs)
    return docs
