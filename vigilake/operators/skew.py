"""Building blocks that stay balanced when one key holds much of the data.

* Picks (latest, first, longest) are ``max_by``/``min_by`` aggregates, which
  combine on the map side, instead of a window that sorts a whole key.
* Running values are computed per (key, block of ordinals); only one row per
  block is left to be scanned per key.
* Joins carry no broadcast hint: Spark broadcasts a side only after it has
  measured it, and splits the partitions of hot keys otherwise. Where both sides
  have about as many rows as the input they are merged: before it has measured a
  side, Spark goes by the size of the files, which is a small part of the rows'.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BLOCK = 65_536


def pick(df: DataFrame, keys: Sequence[str], order: Column, largest: bool = True) -> DataFrame:
    """One whole row per key: the one with the largest (smallest) ``order``."""
    choose = F.max_by if largest else F.min_by
    # Keys stay columns of their own, so rows that lie together by key are known to.
    row = F.struct(*(F.col(c) for c in df.columns if c not in keys), F.lit(True).alias("_found"))
    # The order never is NULL as a struct, so a group always yields a row.
    picked = df.groupBy(*keys).agg(choose(row, F.struct(order)).alias("_row"))
    return picked.select(*(F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns))


def rows_at_extreme(df: DataFrame, keys: Sequence[str], value: Column, largest: bool = True) -> DataFrame:
    """All rows of each key that carry the key's largest value."""
    side = df.groupBy(*keys).agg((F.max if largest else F.min)(value).alias("_best"))
    joined = df.join(side.select(*(F.col(k).alias("_k_" + k) for k in keys), "_best"),
                     [df[k].eqNullSafe(F.col("_k_" + k)) for k in keys], "inner")
    return joined.where(value == F.col("_best")).select(*df.columns)


def merge_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join of two sides that both grow with the data; none of them is
    gathered in the driver, however small its files are."""
    return left.join(right.hint("merge"), list(keys), how)


def _blocked(df: DataFrame, ordinal: str, block_size: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(ordinal) / F.lit(block_size)).cast("long"))


def running_sum(
    df: DataFrame, keys: Sequence[str], ordinal: str, value: Column, out: str,
    block_size: int = BLOCK, inclusive: bool = True,
) -> DataFrame:
    """Running total of ``value`` by ``ordinal`` within ``keys``."""
    d = _blocked(df, ordinal, block_size).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_block").orderBy(ordinal)
    frame = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = d.withColumn("_local", F.coalesce(F.sum("_value").over(frame), F.lit(0)))
    totals = d.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("_carry", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    return (
        merge_join(local, carried, [*keys, "_block"])
        .withColumn(out, F.col("_local") + F.col("_carry"))
        .drop("_block", "_value", "_local", "_carry")
    )


def carry_forward(
    df: DataFrame, keys: Sequence[str], ordinal: str, value: Column, out: str, block_size: int = BLOCK,
) -> DataFrame:
    """Last non-NULL ``value`` at or before each row."""
    return carry_all(df, keys, ordinal, {out: value}, block_size=block_size)


def carry_all(
    df: DataFrame, keys: Sequence[str], ordinal: str, values: dict[str, Column], inclusive: bool = True, block_size: int = BLOCK,
) -> DataFrame:
    """Last non-NULL value of each expression at (if ``inclusive``) or before
    each row, by the name of its new column.

    A block of rows is one state: the last value of each expression in it. States
    combine in any grouping, so only one row per block is scanned per key.
    """
    d = _blocked(df, ordinal, block_size).withColumns({f"_v_{out}": v for out, v in values.items()})
    inside = Window.partitionBy(*keys, "_block").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = d.withColumns({f"_l_{out}": F.last(f"_v_{out}", ignorenulls=True).over(inside) for out in values})
    tails = d.groupBy(*keys, "_block").agg(*(
        F.max_by(f"_v_{out}", F.when(F.col(f"_v_{out}").isNotNull(), F.col(ordinal))).alias(f"_t_{out}") for out in values))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*keys, "_block", *(F.last(f"_t_{out}", ignorenulls=True).over(before).alias(f"_c_{out}") for out in values))
    drop = [f"_{x}_{out}" for x in "vlc" for out in values]
    return merge_join(local, carried, [*keys, "_block"], "left").withColumns(
        {out: F.coalesce(f"_l_{out}", f"_c_{out}") for out in values}).drop("_block", *drop)


def neighbour(
    df: DataFrame, keys: Sequence[str], ordinal: str, columns: dict[str, str], offset: int,
) -> DataFrame:
    """Values of the row ``offset`` places on, for dense ordinals.

    An equi-join on (key, ordinal) spreads a long key over all tasks, which
    ``lag``/``lead`` would sort in one.
    """
    other = df.select(
        *keys, (F.col(ordinal) - F.lit(offset)).alias(ordinal), *(F.col(c).alias(o) for c, o in columns.items())
    )
    return merge_join(df, other, [*keys, ordinal], "left")


def links(
    df: DataFrame, keys: Sequence[str], ordinal: str, value: Column, previous: str, index: str,
    block_size: int = BLOCK,
) -> DataFrame:
    """``value`` of the row before and the 1-based place of each row within its
    key, for ordinals with gaps."""
    d = _blocked(df, ordinal, block_size).withColumn("_value", F.struct(value.alias("v")))
    inside = Window.partitionBy(*keys, "_block").orderBy(ordinal)
    local = d.withColumn("_local", F.lag("_value").over(inside)).withColumn("_local_place", F.row_number().over(inside))
    tails = d.groupBy(*keys, "_block").agg(
        F.max_by("_value", ordinal).alias("_tail"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy(*keys).orderBy("_block")
    carried = tails.select(
        *keys, "_block", F.lag("_tail").over(before).alias("_carry"),
        F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"),
    )
    return (
        merge_join(local, carried, [*keys, "_block"])
        .withColumn(previous, F.coalesce("_local", "_carry")["v"])
        .withColumn(index, F.col("_earlier") + F.col("_local_place"))
        .drop("_block", "_value", "_local", "_local_place", "_carry", "_earlier")
    )


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where the input has fewer splits than that.

    Row work that costs far more than moving the row (parsing of cells, texts
    and pages) would otherwise run in as many tasks as a small input has files.
    Inputs with enough splits, as at scale, pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; only a
    local session may fall back to a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written as Parquet to the folder all executors share and read
    back: the plan ends here, columns can still be pruned."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
