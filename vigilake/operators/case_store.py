"""Tables of a listing stored once: what a case holds, bucketed by case.

Rows are stored where the join by case put them, so nothing is shuffled to be
written, and joins and aggregates by case of what is read back need no shuffle
either. What is bucketed is what the ingest left of a case, its distinct events
and products, so a case that repeats over a third of all listing rows is no hot
bucket.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilake.operators.skew import shared_folder


def table_name(spark: SparkSession, kind: str, key: str) -> str:
    """Tables are those of one application: nobody else writes or reads them."""
    return "_".join(("case", kind, key, *re.findall("[A-Za-z0-9]+", spark.sparkContext.applicationId)))


def stored(spark: SparkSession, kind: str, key: str, buckets: int, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of a kind under a key from the session's catalog; made first
    where it is not there, as files in the shared folder. With as many buckets
    as the rows of ``make`` are dealt to by case, a task writes its own ones only."""
    name = table_name(spark, kind, key)
    if not spark.catalog.tableExists(name):
        make().write.format("parquet").mode("overwrite").option("path", f"{shared_folder(spark).rstrip('/')}/{name}").bucketBy(
            buckets, "case_number").sortBy("case_number").saveAsTable(name)
    return spark.table(name)


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A key of the present state of some files: their paths, sizes and times.
    Only the file listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    state = files.select(F.concat_ws("|", "path", "length", F.col("modificationTime").cast("double")).alias("f"))
    # The number of files is that of the paths' directories; order does not count.
    hashes = state.agg(F.count("f").alias("n"), F.sum(F.xxhash64("f").cast("decimal(38,0)")).alias("h")).first()
    return f"{hashes['n']}_{int(hashes['h'] or 0) & ((1 << 64) - 1):016x}"
