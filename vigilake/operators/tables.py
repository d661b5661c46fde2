"""Tables of documents: captions, continuation over pages, merged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilake.functions.documents import is_organ_class_name
from vigilake.functions.text import strip, text
from vigilake.operators.skew import BLOCK, carry_all, cut_lineage, links, neighbour, running_sum

_TITLE = r"(?:Table|TABLE)\s+\d+[:.]?\s*[^\n]+"


def titled_tables(blocks: DataFrame) -> DataFrame:
    """Table blocks with the title of the text block right before them."""
    d = neighbour(blocks, ["doc"], "ord", {"text": "_before", "block_type": "_before_type"}, -1)
    before = F.when(F.col("_before_type") != "table", strip(text(F.col("_before"))))
    numbered = F.regexp_extract(before, "(?U)" + _TITLE, 0)
    title = (
        F.when(numbered != "", F.replace(strip(numbered), F.lit("\n"), F.lit(" ")))
        .when(F.rlike(before, F.lit("^(Table|TABLE)")), strip(F.split(before, "\n")[0]))
        .otherwise("Adverse Reactions Table")
    )
    fresh = F.coalesce(F.rlike(before, F.lit(r"(?U)(?:Table|TABLE)\s+\d+")), F.lit(False))
    return d.where(F.col("block_type") == "table").withColumn("title", title).withColumn("has_new_title", fresh).drop(
        "_before", "_before_type")


def join_label_tables(tables: DataFrame) -> DataFrame:
    """``table_no``: an untitled table with as many columns on a later page
    goes on the table before it.

    A continued table has its first part's column count, so looking one table
    back is enough.
    """
    dense = running_sum(tables, ["doc"], "ord", F.lit(1), "_n").withColumn("_n", F.col("_n").cast("long"))
    dense = cut_lineage(dense.withColumn("_width", F.size("columns")))
    d = neighbour(dense, ["doc"], "_n", {"_width": "_prev_width", "page_num": "_prev_page"}, -1)
    goes_on = ~F.col("has_new_title") & (F.col("_width") == F.col("_prev_width")) & (F.col("page_num") > F.col("_prev_page"))
    starts = (~F.coalesce(goes_on, F.lit(False))).cast("int")
    numbered = running_sum(cut_lineage(d.withColumn("_starts", starts)), ["doc"], "_n", F.col("_starts"), "table_no")
    return numbered.withColumn("is_continuation", F.col("_starts") == 0).drop("_starts", "_n", "_width", "_prev_width", "_prev_page")


def join_continued_tables(tables: DataFrame, block_size: int = BLOCK) -> DataFrame:
    """Tables that go on over pages, as parts with a common ``table_no``.

    tables: doc, ord, page, caption, columns, rows, original_columns. A part goes
    on from the page before or the same one if it has as many columns as the open
    table, starts with an organ class or says that it is continued. Parts of the
    last two kinds leave the open table's width as it is, any other part sets it,
    so the width is the last one that was set: it is carried down in blocks, as
    are the columns of the part that opened the table. A document of any number
    of parts spreads over many tasks.
    """
    soc = is_organ_class_name(F.get("original_columns", F.lit(0))) & (F.size("original_columns") > 0)
    parts = tables.select(
        "doc", "ord", "page", "columns", F.size("columns").alias("_width"), soc.alias("_soc"),
        (soc | F.contains(F.lower(text(F.col("caption"))), F.lit("continued"))).alias("_forced"))
    linked = links(parts, ["doc"], "ord", F.col("page"), "_page", "_n", block_size)
    near = F.coalesce(F.col("page").isin(F.col("_page"), F.col("_page") + 1), F.lit(False))
    sets = F.when(~(near & F.col("_forced")), F.col("_width"))
    placed = cut_lineage(carry_all(linked.withColumn("_near", near), ["doc"], "_n", {"_open": sets}, inclusive=False, block_size=block_size))
    goes_on = F.col("_near") & (F.col("_forced") | ((F.col("_width") == F.col("_open")) & (F.col("_width") > 0)))
    told = placed.withColumn("is_continuation", F.coalesce(goes_on, F.lit(False)))
    first = F.when(~F.col("is_continuation"), F.struct(F.col("_n").alias("n"), F.col("columns")))
    opened = cut_lineage(carry_all(told, ["doc"], "_n", {"_first": first}, block_size=block_size).select(
        "doc", "ord", "_n", "_soc", "is_continuation", F.col("columns").alias("_own"), F.col("_first.columns").alias("_columns")))
    numbered = running_sum(opened, ["doc"], "_n", (~F.col("is_continuation")).cast("long"), "table_no", block_size).drop("_n")
    joined = tables.select("doc", "ord", "page", "rows", "original_columns").join(numbered, ["doc", "ord"])
    columns, own = F.col("_columns"), F.col("_own")
    organ_class = F.array(F.get("original_columns", F.lit(0)))
    class_row = F.concat(organ_class, F.array_repeat(F.lit(""), F.greatest(F.size(columns) - 1, F.lit(0))))
    with_class = F.when(F.col("_soc") & ~F.coalesce(F.get("rows", F.lit(0)).eqNullSafe(class_row), F.lit(False)),
                        F.concat(F.array(class_row), F.col("rows"))).otherwise(F.col("rows"))
    heading = F.array_join(columns, " ")

    def stays(row: Column) -> Column:
        says_more = F.exists(row, lambda c: (text(c) != "") & ~F.contains(heading, text(c)))
        return ~row.eqNullSafe(columns) & (F.col("_soc") | ~row.eqNullSafe(own)) & says_more

    kept = F.when(F.col("is_continuation"), F.filter(with_class, stays)).otherwise(F.col("rows"))
    return joined.select("doc", "ord", "page", "table_no", "is_continuation", columns.alias("columns"), kept.alias("rows"))


def continued_captions(parts: DataFrame, tables: DataFrame) -> DataFrame:
    """Caption per joined table: the first part's, with the last page it runs to."""
    named = parts.join(tables.select("doc", "ord", "caption"), ["doc", "ord"])
    d = named.groupBy("doc", "table_no").agg(
        F.min_by("caption", "ord").alias("_caption"), F.min("page").alias("page"), F.max_by("page", "ord").alias("_last"),
        F.bool_or("is_continuation").alias("_more"), F.sum(F.size("rows")).alias("n_rows"))
    base = F.split("_caption", r" \(")[0]
    caption = F.when(
        F.col("_more"), F.concat(base, F.lit(" (continued on Page "), F.col("_last").cast("string"), F.lit(")"))
    ).otherwise(F.col("_caption"))
    return d.select("doc", "table_no", "page", caption.alias("caption"), "n_rows")


def markdown_lines(parts: DataFrame) -> DataFrame:
    """Data rows of joined tables, numbered by (ord, row_no)."""
    return parts.select("doc", "table_no", "ord", F.posexplode("rows").alias("row_no", "cells"))
