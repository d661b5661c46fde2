"""Latest-version selection of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilake.functions.text import strip, text
from vigilake.operators.skew import pick

# Where a label URL carries its year and supplement.
URL_YEAR = r"/label/(\d{4})/"
URL_SUPPLEMENT = r"(?i)s(\d{3,4})lbl\.pdf"


def doc_sort_key(date: Column, supplement: Column, url: Column) -> Column:
    """STRUCT<date, supplement, url> that orders label documents."""
    from_url = F.regexp_extract(text(url), URL_YEAR, 1)
    year = F.when(from_url != "", F.make_date(from_url.try_cast("int"), F.lit(1), F.lit(1)))
    day = F.coalesce(F.to_date(date), year, F.to_date(F.lit("1900-01-01")))
    own = F.regexp_extract(text(supplement), r"\d+", 0)
    in_url = F.regexp_extract(text(url), URL_SUPPLEMENT, 1)
    number = F.when(text(supplement) != "", own).otherwise(in_url)
    return F.struct(day.alias("date"), F.coalesce(number.try_cast("int"), F.lit(0)).alias("supplement"), text(url).alias("url"))


def first_per_url(docs: DataFrame, keys: list[str], ordinal: str, url: str = "pdf_url") -> DataFrame:
    """The first row per lower-case URL without fragment; blank URLs go."""
    clean = F.lower(strip(F.split(text(F.col(url)), "#")[0]))
    d = docs.withColumn("_url", clean).where("_url <> ''")
    return pick(d, [*keys, "_url"], F.col(ordinal), largest=False).drop("_url")


def latest_document(docs: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Unique documents with ``is_latest``; the others are the history."""
    d = first_per_url(docs, keys, ordinal).withColumn(
        "_key", doc_sort_key(F.col("document_date"), F.col("supplement_number"), F.col("pdf_url")))
    best = d.groupBy(*keys).agg(F.max("_key").alias("_best"))
    return d.join(best, keys).withColumn("is_latest", F.col("_key") == F.col("_best")).drop("_key", "_best")


def latest_product_information(docs: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Newest by revision date, document or effective date, version, retrieval;
    the first row wins a full tie."""
    floor = F.to_timestamp(F.lit("0001-01-01")).cast("timestamp_ntz")
    order = F.struct(
        F.coalesce("revision_date", floor).alias("a"), F.coalesce("document_date", "effective_date", floor).alias("b"),
        F.coalesce("version_number", F.lit(0.0)).alias("c"), F.coalesce("retrieved_date", floor).alias("d"),
        (-F.col(ordinal)).alias("o"))
    return pick(docs, keys, order)


def latest_check(docs: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """Whether no candidate is newer than the selected document."""
    day = F.coalesce("revision_date", "document_date")
    newest = docs.groupBy(*keys).agg(F.max(day).alias("_newest"))
    d = selected.join(newest, keys)
    return d.withColumn("is_latest", day.isNull() | F.col("_newest").isNull() | (day >= F.col("_newest"))).drop("_newest")


def best_section(sections: DataFrame, keys: list[str], terms: list[str], ordinal: str) -> DataFrame:
    """Section with the most term occurrences; the first one wins a tie."""
    low = F.lower(F.concat_ws(" ", "heading", "text"))
    count = F.lit(0)
    for term in terms:
        count = count + F.regexp_count(low, F.lit(r"\Q" + term.lower() + r"\E"))
    return pick(sections.withColumn("hits", count), keys, F.struct("hits", -F.col(ordinal)))
