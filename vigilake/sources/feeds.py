"""JSON and XML feeds, folders of files and database tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilake.functions.matching import article_match
from vigilake.functions.text import squeeze, strip, text
from vigilake.operators.substring import substring_join
from vigilake.operators.skew import pick


def _joined(df: DataFrame, value: Column, separator: str, out: str) -> DataFrame:
    rows = df.select("drug_code", F.struct("ordinal", value.alias("v")).alias("_s")).where(text(F.col("_s.v")) != "")
    return rows.groupBy("drug_code").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["v"]), separator).alias(out))


def read_product_json(
    products: DataFrame, ingredients: DataFrame, statuses: DataFrame, forms: DataFrame, routes: DataFrame
) -> DataFrame:
    """Products with their ingredients, status, forms and routes; a product
    without a status is marketed. All feeds are keyed by ``drug_code``."""
    strength = squeeze(F.concat_ws(" ", "strength", "strength_unit"))
    dosed = F.when(text(F.col("dosage_unit")) != "", F.concat_ws("/", strength, "dosage_unit")).otherwise(strength)
    named = strip(F.concat_ws(" ", strip(F.col("ingredient_name")), F.nullif(dosed, F.lit(""))))
    status = statuses.groupBy("drug_code").agg(
        F.max_by("status", "history_date").alias("status"), F.max("history_date").alias("status_date"))
    d = (
        products.join(_joined(ingredients, named, "; ", "active_ingredient"), "drug_code", "left")
        .join(_joined(forms, strip(F.col("pharmaceutical_form_name")), ", ", "form"), "drug_code", "left")
        .join(_joined(routes, strip(F.col("route_of_administration_name")), ", ", "route"), "drug_code", "left")
        .join(status, "drug_code", "left")
    )
    return d.select(
        *products.columns, text(F.col("active_ingredient")).alias("active_ingredient"), text(F.col("form")).alias("form"),
        text(F.col("route")).alias("route"), F.coalesce("status", F.lit("Marketed")).alias("status"),
        F.coalesce("status_date", "last_update_date").alias("status_date"))


LABEL_SCHEMA = (
    "openfda STRUCT<brand_name: ARRAY<STRING>, generic_name: ARRAY<STRING>, application_number: ARRAY<STRING>,"
    " manufacturer_name: ARRAY<STRING>>"
)
RECALL_SCHEMA = (
    "recall_number STRING, classification STRING, reason_for_recall STRING, recalling_firm STRING,"
    " recall_initiation_date STRING"
)
EVENT_SCHEMA = (
    "safetyreportid STRING, receiptdate STRING, patient STRUCT<reaction: ARRAY<STRUCT<reactionmeddrapt: STRING>>>"
)


def label_metadata(df: DataFrame, json: str, query: Column) -> DataFrame:
    """First brand, generic, application number and maker of label documents."""
    doc = F.from_json(json, LABEL_SCHEMA)["openfda"]
    first = lambda c: F.try_element_at(c, F.lit(1))
    return df.select(
        *[c for c in df.columns if c != json], F.upper(F.coalesce(first(doc["brand_name"]), query)).alias("brand_name"),
        text(F.upper(first(doc["generic_name"]))).alias("active_ingredient"),
        text(first(doc["application_number"])).alias("application_number"), text(first(doc["manufacturer_name"])).alias("sponsor"))


def recalls(df: DataFrame, json: str) -> DataFrame:
    """Recall notices with the defaults of missing fields."""
    r = F.from_json(json, RECALL_SCHEMA)
    return df.select(
        *[c for c in df.columns if c != json], F.coalesce(r["recall_number"], F.lit("FDA-RECALL")).alias("recall_number"),
        F.coalesce(r["classification"], F.lit("Class II")).alias("classification"),
        F.coalesce(r["reason_for_recall"], F.lit("Safety concern")).alias("reason"),
        F.coalesce(r["recalling_firm"], F.lit("Manufacturer")).alias("firm"), text(r["recall_initiation_date"]).alias("date"))


def adverse_events(df: DataFrame, json: str) -> DataFrame:
    """Event reports with all their named reactions."""
    e = F.from_json(json, EVENT_SCHEMA)
    names = F.filter(F.transform(e["patient"]["reaction"], lambda x: x["reactionmeddrapt"]), lambda n: text(n) != "")
    return df.select(
        *[c for c in df.columns if c != json], text(e["safetyreportid"]).alias("report_id"),
        F.coalesce(names, F.array().cast("array<string>")).alias("reactions"), text(e["receiptdate"]).alias("date"))


RSS_SCHEMA = "channel STRUCT<item: ARRAY<STRUCT<title: STRING, link: STRING, description: STRING, pubDate: STRING>>>"


def rss_items(feeds: DataFrame, xml: str = "xml", portal: str = "") -> DataFrame:
    """Items of RSS documents held in a column (feed_id, xml)."""
    items = F.from_xml(xml, RSS_SCHEMA)["channel"]["item"]
    d = feeds.select("feed_id", F.posexplode(items).alias("ordinal", "i"))
    link = F.coalesce(F.nullif(strip(F.col("i.link")), F.lit("")), F.lit(portal))
    return d.select(
        "feed_id", "ordinal", text(strip(F.col("i.title"))).alias("title"), link.alias("url"),
        text(strip(F.col("i.description"))).alias("summary"), text(strip(F.col("i.pubDate"))).alias("publication_date"))


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files."""
    schema = "title STRING, link STRING, description STRING, pubDate STRING"
    return spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)


def read_feed_items(rss: DataFrame, directory: DataFrame, query: Column, min_title: int | None = None) -> DataFrame:
    """Articles of both lists that name the product, the first per URL.
    Both: ordinal, title, url, summary; RSS comes first. With ``min_title``,
    entries of the directory with shorter titles are left out."""
    common = ["ordinal", "title", "url", "summary"]
    a = rss.select(*common, F.lit(0).alias("list_no"))
    listed = directory if min_title is None else directory.where(F.length(squeeze(F.col("title"))) >= min_title)
    b = listed.select(*common, F.lit(1).alias("list_no"))
    hit = article_match(query, F.concat_ws(" ", "title", "summary")) | ((F.col("list_no") == 1) & article_match(query, F.col("url")))
    return pick(a.unionByName(b).where(hit), ["url"], F.struct("list_no", "ordinal"), largest=False)


def new_articles(curated: DataFrame, live: DataFrame) -> DataFrame:
    """Live articles that no curated change of the drug has by URL or title.

    URLs meet in an equi-join. A title counts when a curated change type of the
    drug contains it, looked up by the title's rarest gram within the drug.
    """
    by_url = live.join(curated.select("drug_id", F.col("source_url").alias("url")).distinct(), ["drug_id", "url"], "left_anti")
    kinds = curated.select("drug_id", "change_type").distinct()
    titles = by_url.where("title <> ''").select("drug_id", "title").distinct()
    held = substring_join(titles, kinds, F.col("title"), F.col("change_type"), scope=["drug_id"]).where(
        F.contains(F.col("change_type"), F.col("title"))).select("drug_id", "title").distinct()
    return by_url.where(F.col("title") != "").join(held, ["drug_id", "title"], "left_anti").select(*live.columns)


def read_table(spark: SparkSession, path: str | None = None, jdbc: dict[str, str] | None = None) -> DataFrame:
    """A relational table from parquet, or from a database with the given JDBC
    options (url, dbtable, and partitionColumn with its bounds for parallel
    reads)."""
    return spark.read.format("jdbc").options(**jdbc).load() if jdbc else spark.read.parquet(path)


# ---------------------------------------------------------------------------
# Folders

def list_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Files below a folder without their bytes; hidden ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("filename"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size")).where(
        ~name.startswith("."))


def changed_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files whose name, time and size are not all known already; only
    metadata is compared, no bytes are read."""
    known = state.select("filename", "mtime", "size")
    return files.dropDuplicates(["path"]).join(known, ["filename", "mtime", "size"], "left_anti")


def scan_outcome(files: DataFrame, contents: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """``outcome`` per file: unmodified, hash_match, errored or processed.

    contents: path, file_hash, and started_at and finished_at where they were
    measured. A file with a new time but the known hash of a finished extraction
    is skipped as well; one without a hash could not be read.
    """
    times = [c for c in ("started_at", "finished_at") if c in contents.columns]
    known = state.select("filename", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"),
                         F.col("file_hash").alias("_hash"), F.col("status").alias("_status"))
    d = files.drop("started_at", "finished_at").dropDuplicates(["path"]).join(contents.select("path", "file_hash", *times), "path", "left").join(known, "filename", "left")
    same = (F.col("mtime") == F.col("_mtime")) & (F.col("size") == F.col("_size"))
    same_hash = (F.col("file_hash") == F.col("_hash")) & F.col("_status").isin("success", "not_found")
    go = F.lit(force)
    outcome = F.when(~go & F.coalesce(same, F.lit(False)), "unmodified").when(
        ~go & F.coalesce(same_hash, F.lit(False)), "hash_match").when(F.col("file_hash").isNull(), "errored").otherwise("processed")
    return d.select("path", "filename", "mtime", "size", "file_hash", outcome.alias("outcome"), *times)


def scan_metrics(outcomes: DataFrame) -> DataFrame:
    errored = F.count_if(F.col("outcome") == "errored")
    none = F.lit(None).cast("double")
    timed = {"started_at", "finished_at"} <= set(outcomes.columns)
    seconds = F.unix_micros(F.max("finished_at")) - F.unix_micros(F.min("started_at")) if timed else none
    return outcomes.agg(
        errored.alias("files_errored"), F.when(errored > 0, "completed_with_errors").otherwise("completed").alias("status"),
        (F.round(seconds / F.lit(1e6), 2) if timed else F.max(none)).alias("duration_seconds"),
        F.count(F.lit(1)).alias("files_scanned"), F.count_if(F.col("outcome") == "processed").alias("files_processed"),
        F.count_if(F.col("outcome").isin("unmodified", "hash_match")).alias("files_skipped"))


def upsert_product_sections(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Section index after a batch, keyed by (filename, target_section); the
    last row of a key (``seq``) replaces what was there."""
    key = ["filename", "target_section"]
    last = pick(batch, key, F.col("seq")).drop("seq")
    return current.join(last.select(*key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def article_record_id(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), F.md5(text(c)))
