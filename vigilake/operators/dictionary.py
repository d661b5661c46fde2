"""Term dictionary: grouped code lists, indented outlines, code names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilake.functions.text import strip, text
from vigilake.operators.skew import BLOCK, carry_all, pick

TERM_COLUMNS = (
    "smq_name", "smq_code", "scope", "pt_name", "pt_name_upper", "pt_code", "category",
    "is_active", "reference_version", "load_order",
)


def term_names(term_rows: DataFrame, order: str = "load_order") -> DataFrame:
    """(pt_code → pt_name, pt_category) from term rows; a later row wins, and
    a blank category keeps the last one that was set."""
    rows = term_rows.select(
        strip(F.col("pt_code").cast("string")).alias("pt_code"),
        strip(F.col("pt_name")).alias("pt_name"), strip(F.col("category")).alias("category"), F.col(order),
    ).where(F.col("pt_code").isNotNull() & F.col("pt_name").isNotNull())
    return rows.groupBy("pt_code").agg(
        F.max_by("pt_name", order).alias("pt_name"),
        F.max_by("category", F.when(F.col("category").isNotNull() & (F.col("category") != ""), F.col(order))).alias(
            "pt_category"
        ),
    )


def read_smq_codes(code_rows: DataFrame, term_rows: DataFrame, version: str) -> DataFrame:
    """Dictionary rows from comma lists of codes.

    ``code_rows``: smq_code, smq_name, scope, pt_codes, load_order. Codes
    without a name keep the code as name; (smq, scope, code) is unique and the
    first row wins.
    """
    usable = code_rows.where(
        F.rlike(strip(text(F.col("smq_code"))), F.lit(r"^\d+$"))
        & (text(F.col("smq_name")) != "") & (text(F.col("pt_codes")) != "")
    )
    codes = usable.select(
        strip(F.col("smq_code")).alias("smq_code"), strip(F.col("smq_name")).alias("smq_name"),
        F.when(strip(F.col("scope")) == "Broad+Narrow", "Broad").otherwise(strip(F.col("scope"))).alias("scope"),
        F.col("load_order").alias("_row"), F.posexplode(F.split("pt_codes", ",")).alias("_pos", "_code"),
    ).where(strip(F.col("_code")) != "")
    codes = codes.withColumn("pt_code", F.btrim(strip(F.col("_code")), F.lit("'\""))).drop("_code")
    unique = pick(codes, ["smq_name", "scope", "pt_code"], F.struct("_row", "_pos"), largest=False)
    named = unique.join(term_names(term_rows), "pt_code", "left")
    name = F.coalesce("pt_name", "pt_code")
    return named.select(
        "smq_name", "smq_code", "scope", name.alias("pt_name"), F.upper(name).alias("pt_name_upper"), "pt_code",
        F.col("pt_category").alias("category"), F.lit(True).alias("is_active"),
        F.lit(version).alias("reference_version"), F.struct("_row", "_pos").alias("load_order"),
    )


def outline_terms(rows: DataFrame, block_size: int = BLOCK) -> DataFrame:
    """(sheet_id, row_no, scope, pt_name, pt_code, groups): term lines of an
    indented outline (sheet_id, row_no, cells) with the groups open at each.

    A header opens a group at the column of its cell and closes all groups at
    this and later columns. So the group of a column is its last header, open
    unless a header of an earlier column came after it: what is carried down is
    the last header of each column, in blocks of rows, so one sheet spreads over
    many tasks. The number of columns is that of the widest row with a header.
    """
    is_header = F.transform("cells", lambda c: F.coalesce(F.contains(F.lower(c), F.lit("(smq)")), F.lit(False)))
    level = F.array_position(is_header, True) - 1
    scope_at = F.array_position(F.transform("cells", lambda c: F.coalesce(c.isin("Narrow", "Broad"), F.lit(False))), True) - 1
    d = rows.select(
        "sheet_id", "row_no", "cells", F.when(level >= 0, level).alias("_level"), F.when((level < 0) & (scope_at >= 0), scope_at).alias("_at"))
    header = F.struct("row_no", strip(F.get("cells", F.col("_level").cast("int"))).alias("name"))
    said = d.where(F.col("_level").isNotNull() | F.col("_at").isNotNull()).select(
        "sheet_id", "row_no", "_level", F.when(F.col("_level").isNotNull(), header).alias("_header"),
        *(F.get("cells", (F.col("_at") + i).cast("int")).alias(c) for i, c in ((0, "scope"), (2, "_name"), (3, "_code"))))
    columns = said.agg(F.max("_level")).first()[0]
    if columns is None:
        columns = -1
    levels = [f"_h{i}" for i in range(columns + 1)]
    carried = carry_all(
        said, ["sheet_id"], "row_no", {name: F.when(F.col("_level") == i, F.col("_header")) for i, name in enumerate(levels)}, block_size=block_size)
    terms = carried.where(F.col("_level").isNull() & (text(F.col("_name")) != "") & (text(F.col("_code")) != ""))
    opened, latest = [], F.lit(None).cast("long")
    for name in levels:
        row = F.col(name)["row_no"]
        opened.append(F.when(latest.isNull() | (row > latest), F.col(name)["name"]))
        latest = F.greatest(latest, row)
    groups = F.array_compact(F.array(*opened)) if opened else F.array().cast("array<string>")
    return terms.select("sheet_id", "row_no", "scope", strip(F.col("_name")).alias("pt_name"), strip(F.col("_code")).alias("pt_code"), groups.alias("groups"))


def read_smq_outline(rows: DataFrame, version: str) -> DataFrame:
    """Dictionary rows from an indented outline (sheet_id, row_no, cells).

    Every term goes to each open group as Broad, and as Narrow when marked so.
    """
    grouped = outline_terms(rows)
    scopes = F.when(F.col("scope") == "Narrow", F.array(F.lit("Broad"), F.lit("Narrow"))).otherwise(
        F.array(F.lit("Broad"))
    )
    exploded = grouped.select(
        "sheet_id", "row_no", "pt_name", "pt_code", F.explode("groups").alias("smq_name"), scopes.alias("_scopes")
    ).select("*", F.explode("_scopes").alias("scope")).drop("_scopes")
    unique = pick(exploded, ["smq_name", "scope", "pt_code"], F.struct("sheet_id", "row_no"), largest=False)
    return unique.select(
        "smq_name", F.lit("").alias("smq_code"), "scope", "pt_name", F.upper("pt_name").alias("pt_name_upper"),
        "pt_code", F.lit(None).cast("string").alias("category"), F.lit(True).alias("is_active"),
        F.lit(version).alias("reference_version"), F.struct("sheet_id", "row_no").alias("load_order"),
    )


def reload_terms(current: DataFrame, batch: DataFrame) -> DataFrame:
    """The dictionary after whole versions were loaded again: the terms that a
    version of the batch had before go."""
    again = batch.select("reference_version").distinct()
    return current.join(again, "reference_version", "left_anti").unionByName(batch)


def lookup_terms(terms: DataFrame) -> DataFrame:
    """Active terms, one per (group, scope, upper-case name); the last loaded
    row wins."""
    active = terms.where("is_active")
    return pick(active, ["smq_name", "scope", "pt_name_upper"], F.col("load_order"))
