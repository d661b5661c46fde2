"""Substring lookups of many requests at once, by the rarest gram of each.

An index posts (gram, text id) only. Of all grams that a text containing the
request must have, each request takes the one that the fewest texts hold, so its
candidates are no more than those; texts are fetched for the candidates alone and
tested exactly, so no pair is missed and none is wrong.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vigilake.functions.matching import contains_like
from vigilake.operators.skew import cut_lineage

SIZE = 3
_none = "array<string>"


def _runs(c: Column) -> Column:
    """Every run of SIZE characters."""
    size = F.length(c)
    found = F.transform(F.sequence(F.lit(1), F.greatest(size - (SIZE - 1), F.lit(1))), lambda i: F.substr(c, i, F.lit(SIZE)))
    return F.when(size >= SIZE, found).otherwise(F.array().cast(_none))


def grams(c: Column) -> Column:
    """All grams a text is posted under: its distinct runs of three characters,
    its characters, and ''."""
    return F.array_distinct(F.concat(_runs(c), F.filter(F.split(c, ""), lambda g: g != ""), F.array(F.lit(""))))


def needed(c: Column, wildcards: bool = False) -> Column:
    """Grams that every text with ``c`` in it has: runs of three characters, else
    single ones, else ''. With wildcards, ``%`` and ``_`` part the text."""
    parts = F.split(c, "[%_]") if wildcards else F.array(c)
    runs = F.flatten(F.transform(parts, _runs))
    singles = F.filter(F.flatten(F.transform(parts, lambda p: F.split(p, ""))), lambda g: g != "")
    chosen = F.when(F.size(runs) > 0, runs).when(F.size(singles) > 0, singles).otherwise(F.array(F.lit("")))
    return F.array_distinct(chosen)


def candidates(needles: DataFrame, texts: DataFrame, scope: Sequence[str] = (), wildcards: bool = False) -> DataFrame:
    """(scope, needle, text_id) of all pairs that may match. ``needles`` has
    scope and needle, ``texts`` scope, text and text_id, both distinct."""
    asked = needles.select(*scope, "needle", F.explode(needed(F.col("needle"), wildcards)).alias("gram"))
    posted = texts.select(*scope, "text_id", F.explode(grams(F.col("text"))).alias("gram"))
    key = [*scope, "gram"]
    index = cut_lineage(posted.join(asked.select(*key).distinct(), key, "left_semi"))
    held = index.groupBy(*key).agg(F.count(F.lit(1)).alias("texts"))
    # A gram that no text holds is the rarest of all: nothing to look at.
    rarest = asked.join(held, key, "left").groupBy(*scope, "needle").agg(
        F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("rarest")).where("rarest.texts > 0")
    return rarest.select(*scope, "needle", F.col("rarest.gram").alias("gram")).join(index, key).drop("gram")


def substring_join(
    requests: DataFrame, records: DataFrame, needle: Column, haystack: Column, wildcards: bool = False, scope: Sequence[str] = (),
) -> DataFrame:
    """Pairs where the record's text contains the request's text, in any case,
    and both agree in the columns of ``scope``. Rows whose text is NULL meet
    nothing; texts that many rows share are compared once."""
    left = requests.withColumn("_needle", F.lower(needle)).where(F.col("_needle").isNotNull())
    right = records.withColumn("_text", F.lower(haystack)).where(F.col("_text").isNotNull())
    needles = left.select(*scope, F.col("_needle").alias("needle")).distinct()
    # Two texts of one id are both fetched and tested.
    texts = cut_lineage(right.select(*scope, F.col("_text").alias("text")).distinct().withColumn("text_id", F.xxhash64("text")))
    test = contains_like(F.col("text"), F.col("needle")) if wildcards else F.contains(F.col("text"), F.col("needle"))
    pairs = candidates(needles, texts, scope, wildcards).join(texts, [*scope, "text_id"]).where(test).select(
        *scope, F.col("needle").alias("_needle"), F.col("text").alias("_text"))
    return left.join(pairs, [*scope, "_needle"]).join(right, [*scope, "_text"]).drop("_needle", "_text")
