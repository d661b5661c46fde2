"""Named queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigilake.operators.skew import spread
from vigilake.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
# Survey rows each query covers, for the table in the README.
COVERS: dict[str, tuple[str, ...]] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        COVERS[name] = tuple(covers.split())
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table whose rows are expensive to work on, over all cores."""
    df = table(spark, sf_dir, name)
    return spread(df.select(*columns) if columns else df)


# Rows of a listing that a task deals with; each is parsed, sorted and counted
# there, which takes some fifty times the bytes it is shuffled with.
ROWS_PER_TASK = 150_000


def deal(spark: SparkSession, rows: int) -> int:
    """As many shuffle partitions as so many rows need, and tasks joined up to a
    size that is sorted in memory. The numbers go by the input, so a task stays
    as long when the input grows. Returns the number of partitions."""
    parts = max(-(-rows // ROWS_PER_TASK), int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")
    # Tables that are dealt by case are joined by dataset and case where they are.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return parts
