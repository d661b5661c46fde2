"""Stages from raw documents to a mixed training set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilake.llm import decontaminate, langid, mixing, near_dup, secrets
from vigilake.llm.common import SPACE_CHARS, staged
from vigilake.session import tune

ROW = "row of near_dedup"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go, NULL texts and texts without a
    letter among them; repeated rows and NULL ids are judged like others."""
    tune(spark)
    return langid.accepted(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, once.

    Rows are told apart by two hashes of id and text, not by ``doc_id``: different
    texts under one id, or without an id, are different documents, and copies are
    copies whatever their ids. NULL, empty and blank texts are copies of nothing
    and stay. An empty table stays empty.
    """
    tune(spark)
    row, blank = F.xxhash64("doc_id", "text"), F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACE_CHARS)) == ""
    rows = docs.withColumns({ROW: row, f"{ROW} 2": F.xxhash64("text", "doc_id", F.lit(7)), f"{ROW} 3": F.when(blank, F.monotonically_increasing_id())})
    kept = near_dup.near_groups(rows.select(ROW, "text"), id_col=ROW).where("kept").select(ROW).distinct()
    return rows.join(kept, ROW, "left_semi").dropDuplicates([ROW, f"{ROW} 2", f"{ROW} 3"]).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go; NULL and empty texts
    overlap with nothing, repeated rows and NULL ids are judged like others."""
    return decontaminate.clean(docs, tune(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; all rows stay, NULL texts as they are."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their targets: pieces of documents in blocks."""
    return mixing.mixed(docs)


STAGES = [
    ("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("mix", mix),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
