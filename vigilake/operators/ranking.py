"""Ranks within each of many requests, none of which has to fit one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilake.operators.skew import cut_lineage


def top(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key with their rank from 1.

    Every task keeps only the best ``k`` rows it has of a key before the shuffle,
    so a request with a third of all rows sends no more than any other.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """All rows with their rank within each key.

    Rows are dealt out by ranges of (key, order), so a key spreads over as many
    tasks as its rows need; what a range holds of a key is added up over the
    ranges before.
    """
    by = [*(F.col(c) for c in keys), *order]
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut_lineage(
        rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()).withColumn("_place", number))
    # One row per range and key that it holds.
    held = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    other = offsets.select(*(F.col(c).alias("_o_" + c) for c in (*keys, "_part")), "_before", "_first")
    same = [F.col(c).eqNullSafe(F.col("_o_" + c)) for c in (*keys, "_part")]
    rank = F.col("_before") + F.col("_place") - F.col("_first") + 1
    return placed.join(other, same).select(*rows.columns, rank.alias(name))
