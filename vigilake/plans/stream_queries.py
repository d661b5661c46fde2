"""Streaming queries, run to the end of their input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilake.operators import changes as ops
from vigilake.operators.skew import shared_folder
from vigilake.plans import label_tables as t
from vigilake.plans.registry import query, table
from vigilake.streaming.changes import SCAN_SCHEMA, read_version, stream_changes as start_stream, watch_folder as start_watch


ARRIVALS = 3


def _arrivals(df: DataFrame, order: str) -> list[DataFrame]:
    """The rows in the order of a column, in as many parts as batches arrive."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    part = F.floor((F.col(order) - F.lit(low or 0)) * F.lit(ARRIVALS) / F.lit((high or 0) - (low or 0) + 1))
    return [df.where(part == i) for i in range(ARRIVALS)]


@query("T2 C2", f"""WITH {t.SQL_BATCH} SELECT drug_id, section, source_record_id, st_orig AS original_text, updated_text FROM eff
QUALIFY row_number() OVER (PARTITION BY drug_id, section, source_record_id ORDER BY seq DESC) = 1""")
def stream_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The crawled rows as they arrive, the stream resumed for each arrival; the
    table equals the batch one."""
    return _streamed(spark, sf, "changes", ops.CHANGES_SCHEMA).select(
        "drug_id", "section", "source_record_id", "original_text", "updated_text")


@query("T2 C2 C4", f"""WITH {t.SQL_BATCH} SELECT drug_id, section, source_record_id, version_number, original_text, updated_text
FROM vers WHERE n > 1""")
def stream_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The archive of the same stream: version numbers go on over its batches."""
    return _streamed(spark, sf, "versions", ops.VERSIONS_SCHEMA).select(
        "drug_id", "section", "source_record_id", "version_number", "original_text", "updated_text")


def _streamed(spark: SparkSession, sf: str, name: str, schema: str) -> DataFrame:
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, sf, "events")
    for arrived in _arrivals(events, "event_id"):
        arrived.write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(events.schema).parquet(f"{root}/in")
        start_stream(t.batch_of(source), f"{root}/tables", f"{root}/progress").awaitTermination()
    return read_version(spark, f"{root}/tables", name, ARRIVALS, schema)


@query("T1 S14", """SELECT 'processed' AS outcome, CAST(sum(coalesce(strlen(text), 0) + 1) AS BIGINT) AS size FROM documents""")
def watch_folder(spark: SparkSession, sf: str) -> DataFrame:
    """Text files that arrive in a folder, each processed once."""
    root = f"{shared_folder(spark)}/watch-{uuid.uuid4().hex}"
    for arrived in _arrivals(table(spark, sf, "documents"), "doc_id"):
        arrived.select("text").write.mode("append").text(f"{root}/in")
        start_watch(spark, f"{root}/in", f"{root}/tables", f"{root}/progress", pattern="*.txt").awaitTermination()
    files = read_version(spark, f"{root}/tables", "files", ARRIVALS, SCAN_SCHEMA)
    return files.groupBy("outcome").agg(F.sum("size").alias("size"))
