"""Helpers shared by the operators: staged tables and expressions on texts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from vigilake.operators.skew import shared_folder

# A word is a longest run of characters other than x20 and x09 to x0D.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the folder that all executors share and
    read back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACES, -1))).cast("long")


def hits(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches of a pattern with their places:
    array of (start, end, hit), code points, end exclusive. ``group`` names the
    group to return as ``hit``; the pattern must not match the empty text.

    The text between the matches comes from ``split``, the matches from
    ``regexp_extract_all``; one pass over both adds up the lengths.
    """
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    wanted = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1)) if group else whole
    empty = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["0"])
        end = start + F.length(part["1"])
        more = F.array(F.struct(start.alias("start"), end.alias("end"), part["2"].alias("hit")))
        return F.struct(
            F.coalesce(end, start).alias("at"),
            F.when(part["1"].isNull(), state["found"]).otherwise(F.concat(state["found"], more)).alias("found"),
        )

    return F.aggregate(
        F.arrays_zip(pieces.alias("0"), whole.alias("1"), wanted.alias("2")),
        F.struct(F.lit(0).alias("at"), empty.alias("found")), step, lambda state: state["found"],
    )


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_of(spans: str, kind: str) -> Column:
    """Number of spans of one kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
