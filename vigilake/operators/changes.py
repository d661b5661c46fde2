"""Labelling changes: upserts, versioned change capture, latest-date picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilake.functions.dates import parse_label_date
from vigilake.functions.hashing import content_hash, py_datetime
from vigilake.functions.matching import record_errors
from vigilake.functions.sections import (
    clean_adverse_text, is_whitelisted, normalize_section_name, section_kind, section_sort_key,
)
from vigilake.functions.text import normalize_drug_name, normalize_text, text
from vigilake.operators.skew import cut_lineage, links, pick, rows_at_extreme

DRUG_KEY = ["normalized_name", "source"]
CHANGE_KEY = ["drug_id", "section", "source_record_id"]
# Defaults of a change record.
DEFAULT_SOURCE = "FDA_SRLC"
DEFAULT_URL = "https://www.accessdata.fda.gov/scripts/cder/safetylabelingchanges"
DEFAULT_SECTION = "General Safety"


def upsert_drugs(drugs: DataFrame, batch: DataFrame) -> DataFrame:
    """Drugs after a batch: new keys are added, known ones only get a missing
    ingredient or application number. Earlier rows (``seq``) win."""
    rows = batch.select(
        F.coalesce(F.nullif(F.col("normalized_name"), F.lit("")), normalize_drug_name(F.col("display_name"))).alias(
            "normalized_name"
        ),
        F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit(DEFAULT_SOURCE)).alias("source"),
        "display_name", "active_ingredient", "application_number", "seq",
    )

    def first_set(name: str) -> Column:
        return F.min_by(name, F.when(text(F.col(name)) != "", F.col("seq"))).alias(f"_{name}")

    new = rows.groupBy(*DRUG_KEY).agg(
        F.min_by("display_name", "seq").alias("_display_name"), first_set("active_ingredient"),
        first_set("application_number"),
    )
    merged = drugs.join(new, DRUG_KEY, "full_outer")

    def kept(name: str) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.col(f"_{name}")).alias(name)

    return merged.select(
        *DRUG_KEY, F.coalesce("display_name", "_display_name").alias("display_name"), kept("active_ingredient"),
        kept("application_number"), F.col("_display_name").isNotNull().alias("touched"),
    )


def normalized_record(raw: DataFrame) -> DataFrame:
    """Raw crawled records → the common change columns."""
    def optional(name: str) -> Column:
        return F.col(name) if name in raw.columns else F.lit(None).cast("string")

    return raw.select(
        text(F.col("drug_name")).alias("display_name"), normalize_drug_name(F.col("drug_name")).alias("normalized_name"),
        normalize_drug_name(optional("active_ingredient")).alias("active_ingredient"),
        optional("application_number").alias("application_number"),
        normalize_section_name(F.col("section")).alias("section"), optional("source_date").alias("source_date"),
        *(normalize_text(optional(c)).alias(c) for c in ("original_text", "updated_text", "fda_comment")),
        optional("source_url").alias("source_url"), optional("source_record_id").alias("source_record_id"),
    )


def prepare_changes(batch: DataFrame, whitelist: bool = True) -> DataFrame:
    """Batch rows ready for :func:`apply_changes`, with an ``errors`` array.

    Sections outside the whitelist are dropped on the raw header, before any
    other work; ``whitelist=False`` keeps them for sources with their own
    section names.
    """
    d = batch.where(is_whitelisted(F.col("section"), F.col("updated_text"))) if whitelist else batch
    raw_date = F.col("source_date").cast("string")
    parsed = parse_label_date(raw_date) if dict(batch.dtypes)["source_date"] == "string" else F.col("source_date")
    d = d.withColumn("_date", parsed)
    section = F.coalesce(F.nullif(normalize_section_name(F.col("section")), F.lit("")), F.lit(DEFAULT_SECTION))
    url = F.coalesce(F.nullif(F.col("source_url"), F.lit("")), F.lit(DEFAULT_URL))
    texts = {c: F.col(c) for c in ("original_text", "updated_text", "fda_comment")}
    errors = record_errors(F.col("display_name"), url, texts, {}, {})
    return d.select(
        "drug_id", section.alias("section"), text(F.col("source_record_id")).alias("source_record_id"), "seq",
        "display_name", F.col("_date").alias("source_date"), "original_text", "updated_text", "fda_comment",
        url.alias("source_url"),
        content_hash(
            F.col("display_name"), F.col("active_ingredient"), section, py_datetime(F.col("_date")),
            F.col("original_text"), F.col("updated_text"), F.col("fda_comment"),
        ).alias("content_hash"),
        errors.alias("errors"), "verified_at",
    )


STATE = ("content_hash", "source_date", "original_text", "updated_text", "fda_comment", "source_url")


def classify_changes(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Batch rows with ``action`` NEW / CHANGED / UNCHANGED and ``_replaced``,
    the state each row meets.

    Several rows of one key are taken in ``seq`` order: each is compared with
    the row before, the first one with the current table.
    """
    linked = links(batch, CHANGE_KEY, "seq", F.struct(*STATE), "_before", "_place")
    base = current.select(*CHANGE_KEY, F.struct(*STATE).alias("_base"))
    joined = linked.join(base, CHANGE_KEY, "left").withColumn("_replaced", F.coalesce("_before", "_base"))
    old = F.col("_replaced.content_hash")
    action = F.when(old.isNull(), "NEW").when(old != F.col("content_hash"), "CHANGED").otherwise("UNCHANGED")
    return joined.withColumn("action", action).drop("_before", "_place")


def apply_changes(current: DataFrame, versions: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changes, versions, actions) after a prepared batch.

    An unchanged row only moves ``last_verified_at``; a changed one archives
    what was there under the next version number. Running the same batch again
    adds nothing. The classified batch is written once, because the change
    table, the archive and the counters all read it.
    """
    changes, new_versions, actions = changed_tables(current, versions, batch)
    return changes, versions.unionByName(new_versions), actions


def changed_tables(current: DataFrame, versions: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`apply_changes` with only the new versions, for stores that append."""
    actions = cut_lineage(classify_changes(current, batch.where(F.size("errors") == 0)))
    # Rows between two effective ones repeat the content of the first, so the
    # row before always shows what an effective row replaces. Its original
    # text, when empty, was filled with the text that it replaced itself.
    effective = actions.where(F.col("action") != "UNCHANGED").withColumn(
        "original_text",
        F.when(F.col("action") == "CHANGED",
               F.coalesce(F.nullif(F.col("original_text"), F.lit("")), F.col("_replaced.updated_text")))
        .otherwise(F.col("original_text")),
    )
    chained = links(effective, CHANGE_KEY, "seq", F.col("original_text"), "_old_original", "_place")
    started_new = F.col("_base").isNull()
    counts = versions.groupBy(*CHANGE_KEY).agg(F.max("version_number").alias("_count"))
    new_versions = chained.where(F.col("action") == "CHANGED").join(counts, CHANGE_KEY, "left").select(
        *CHANGE_KEY,
        (F.coalesce("_count", F.lit(0)) + F.col("_place") - started_new.cast("int")).cast("long").alias("version_number"),
        F.col("_replaced.content_hash").alias("content_hash"),
        F.coalesce("_old_original", "_base.original_text").alias("original_text"),
        F.col("_replaced.updated_text").alias("updated_text"),
        F.concat(F.col("section"), F.lit(": "), text(F.col("_replaced.updated_text"))).alias("normalized_content"),
    )
    hit = F.col("action") != "UNCHANGED"
    filled = F.when(
        F.col("action") == "CHANGED",
        F.coalesce(F.nullif(F.col("original_text"), F.lit("")), F.col("_replaced.updated_text")),
    ).otherwise(F.col("original_text"))
    place = F.when(hit, F.col("seq"))

    def last_set(name: str) -> Column:
        return F.max_by(name, F.when(hit & (text(F.col(name).cast("string")) != ""), F.col("seq"))).alias(f"_{name}")

    latest = actions.groupBy(*CHANGE_KEY).agg(
        F.bool_or(hit).alias("_hit"), F.max_by(filled, place).alias("_original_text"),
        *(F.max_by(c, place).alias(f"_{c}") for c in ("content_hash", "updated_text")),
        *(last_set(c) for c in ("source_date", "fda_comment", "source_url")),
        F.max("verified_at").alias("_verified"), F.min("verified_at").alias("_seen"),
    )
    merged = current.join(latest, CHANGE_KEY, "full_outer")

    def replaced(name: str) -> Column:
        return F.when(F.col("_hit"), F.col(f"_{name}")).otherwise(F.col(name)).alias(name)

    changes = merged.select(
        *CHANGE_KEY, *(replaced(c) for c in ("content_hash", "original_text", "updated_text")),
        *(F.coalesce(f"_{c}", c).alias(c) for c in ("source_date", "fda_comment", "source_url")),
        F.coalesce("first_seen_at", "_seen").alias("first_seen_at"),
        F.greatest("last_verified_at", "_verified").alias("last_verified_at"),
    )
    return changes, new_versions, actions.drop("_replaced", "_base")


CHANGES_SCHEMA = (
    "drug_id LONG, section STRING, source_record_id STRING, content_hash STRING, original_text STRING,"
    " updated_text STRING, source_date TIMESTAMP_NTZ, fda_comment STRING, source_url STRING,"
    " first_seen_at TIMESTAMP_NTZ, last_verified_at TIMESTAMP_NTZ"
)
VERSIONS_SCHEMA = (
    "drug_id LONG, section STRING, source_record_id STRING, version_number LONG, content_hash STRING,"
    " original_text STRING, updated_text STRING, normalized_content STRING"
)


def crawl_counters(actions: DataFrame, run: str = "run_id") -> DataFrame:
    """Pages read, and rows found, added, changed and unchanged per run."""
    return actions.groupBy(run).agg(
        F.count_distinct("source_url").alias("pages_crawled"), F.count(F.lit(1)).alias("records_found"), F.count_if(F.col("action") == "NEW").alias("records_added"),
        F.count_if(F.col("action") == "CHANGED").alias("records_changed"),
        F.count_if(F.col("action") == "UNCHANGED").alias("records_unchanged"),
    )


def latest_date_records(changes: DataFrame, key: str = "drug_id", date: str = "source_date",
                        keep_undated: bool = False) -> DataFrame:
    """All rows of each drug's newest day.

    Undated rows are dropped; with ``keep_undated`` a drug without any date
    keeps all its rows.
    """
    day = F.to_date(date)
    dated = rows_at_extreme(changes.where(day.isNotNull()), [key], day)
    if not keep_undated:
        return dated
    with_date = changes.where(day.isNotNull()).select(key).distinct()
    return dated.unionByName(changes.join(with_date, key, "left_anti"))


def longest_per_section(changes: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Longest text per section; the first row wins a tie."""
    section = F.coalesce(F.nullif(F.col("section"), F.lit("")), F.lit("Safety Information"))
    d = changes.withColumn("section", section)
    return pick(d, [*keys, "section"], F.struct(F.length(text(F.col("updated_text"))), -F.col(ordinal)))


def latest_with_section(changes: DataFrame) -> DataFrame:
    """Rows of each drug's newest date on which the adverse-reactions text is
    not empty after cleaning, with the number of dates looked at.

    Texts of one date are cleaned record by record; a record that reaches a
    stop phrase ends the date's text, so later records are left out.
    """
    named = changes.where(
        F.rlike("section", F.lit(r"(?iU)\badverse\s+reactions?\b")) & F.col("source_date").isNotNull()
    )
    cut = F.rlike(text(F.col("updated_text")), F.lit(STOP_HINT))
    d = named.withColumn("_cleaned", clean_adverse_text(F.col("updated_text"))).withColumn("_cut", cut)
    per_date = d.groupBy("drug_id", "source_date").agg(
        F.min(F.when(F.col("_cut"), F.col("id"))).alias("_cut_id"),
        F.min_by("source_record_id", F.when(text(F.col("source_record_id")) != "", F.col("id"))).alias("supplement_id"),
    )
    d = d.join(per_date, ["drug_id", "source_date"]).where(
        (F.col("_cleaned") != "") & (F.col("_cut_id").isNull() | (F.col("id") <= F.col("_cut_id")))
    )
    best = rows_at_extreme(d, ["drug_id"], F.col("source_date"))
    evaluated = named.select("drug_id", "source_date").distinct().groupBy("drug_id").agg(
        F.count(F.lit(1)).alias("dates_evaluated")
    )
    return best.join(evaluated, "drug_id").select(
        "drug_id", "source_date", "id", "supplement_id", F.col("_cleaned").alias("adverse_reactions_text"),
        "dates_evaluated",
    )


STOP_HINT = (
    r"(?iU)(?:^|\n)\s*(?:17\b|17\s+17|PCI/PI/MG|Patient\s+Counseling\s+Information|MEDICATION\s+GUIDE"
    r"|How\s+should\s+I\s+use)"
)
# Fixed value: text of a section that the latest date does not have.
NOT_FOUND = "NOT FOUND IN THE LATEST APPLICABLE FDA LABELING UPDATE"


def supplement_ids(records: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Distinct supplement ids per key in first-seen order, joined."""
    first = records.where(text(F.col("supplement_id")) != "").groupBy(*keys, "supplement_id").agg(
        F.min(ordinal).alias("_first")
    )
    return first.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_first", "supplement_id"))), lambda s: s["supplement_id"]),
            ", ",
        ).alias("supplement_number")
    )


def sections_by_kind(latest: DataFrame, keys: list[str]) -> DataFrame:
    """Presence of each section kind on the latest date, in priority order
    adverse (6), warnings (5), populations (8); never filled from older dates."""
    kind = section_kind(F.col("section"))
    flags = latest.withColumn("_kind", kind).groupBy(*keys).agg(
        *(F.count_if((F.col("_kind") == k) & (text(F.col("updated_text")) != "")).alias(f"n_{k}")
          for k in ("adverse", "warnings", "populations"))
    )

    def status(k: str) -> Column:
        return F.when(F.col(f"n_{k}") > 0, "FOUND").otherwise(NOT_FOUND).alias(k)

    return flags.select(*keys, *(status(k) for k in ("adverse", "warnings", "populations")))


def section_texts(latest: DataFrame, keys: list[str]) -> DataFrame:
    """The texts behind :func:`sections_by_kind` as rows in order of ``id``; a
    kind that the latest date lacks has one row that says so."""
    kinds = latest.withColumn("kind", section_kind(F.col("section")))
    found = kinds.where(F.col("kind").isin("adverse", "warnings", "populations") & (text(F.col("updated_text")) != "")).select(
        *keys, "kind", "id", "updated_text")
    wanted = latest.select(*keys).distinct().withColumn(
        "kind", F.explode(F.array(*(F.lit(k) for k in ("adverse", "warnings", "populations")))))
    absent = wanted.join(found.select(*keys, "kind").distinct(), [*keys, "kind"], "left_anti").select(
        *keys, "kind", F.lit(None).cast("long").alias("id"), F.lit(NOT_FOUND).alias("updated_text"))
    return found.unionByName(absent)


def change_timeline(changes: DataFrame, drugs: DataFrame) -> DataFrame:
    """One row per drug and day, newest first by ``position`` columns: the
    supplement named in the application number, else the highest; first PDF."""
    app = drugs.select(F.col("id").alias("drug_id"), text(F.col("application_number")).alias("_app"))
    day = F.to_date("source_date")
    d = changes.join(app, "drug_id").withColumn("day", day).withColumn("_suppl", text(F.col("source_record_id")))
    named = (F.col("_suppl") != "") & F.contains(F.col("_app"), F.col("_suppl"))
    bodies = d.select("drug_id", "day", section_kind(F.col("section")).alias("kind"), F.sha2(text(F.col("updated_text")), 256).alias("_h"))
    unique = bodies.where("kind IS NOT NULL").distinct().groupBy("drug_id", "day").agg(
        F.count_if(F.col("kind") == "adverse").alias("adverse_bodies"),
        F.count_if(F.col("kind") == "warnings").alias("warning_bodies"),
        F.count_if(F.col("kind") == "populations").alias("population_bodies"),
    )
    groups = d.groupBy("drug_id", "day").agg(
        F.coalesce(
            F.min_by("source_record_id", F.when(named, F.col("id"))), F.max(F.nullif("source_record_id", F.lit("")))
        ).alias("supplement"),
        F.min_by("source_url", F.when(F.lower(text(F.col("source_url"))).contains(".pdf"), F.col("id"))).alias("pdf_url"),
        F.count(F.lit(1)).alias("n_changes"),
    )
    side = unique.withColumnsRenamed({"drug_id": "_drug", "day": "_day"})
    same = (groups.drug_id == F.col("_drug")) & groups.day.eqNullSafe(F.col("_day"))
    return groups.join(side, same, "left").drop("_drug", "_day").fillna(
        0, ["adverse_bodies", "warning_bodies", "population_bodies"]
    )


def duplicate_records(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New rows whose name, section and date are already there."""
    key = ["display_name", "section", "source_date"]
    return new.join(existing.select(*key).distinct(), key, "left_semi")


def fresh_drugs(changes: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Drugs with a change verified within the last days."""
    return changes.where(F.col("last_verified_at") >= now - F.expr(f"INTERVAL {days} DAYS")).select("drug_id").distinct()


def needs_recrawl(candidates: DataFrame, changes: DataFrame) -> DataFrame:
    """Candidates that are new, have no change, or are newer than the latest
    local one."""
    latest = changes.groupBy("drug_id").agg(F.max("source_date").alias("_latest"), F.count(F.lit(1)).alias("_n"))
    d = candidates.join(latest, "drug_id", "left")
    needs = F.col("drug_id").isNull() | F.col("_n").isNull() | F.coalesce(F.col("source_date") > F.col("_latest"), F.lit(False))
    return d.withColumn("needs_crawl", needs).drop("_latest", "_n")


def version_history(versions: DataFrame) -> DataFrame:
    return versions.orderBy(*CHANGE_KEY, F.desc("version_number"))


def newest_first(changes: DataFrame) -> DataFrame:
    return changes.orderBy("drug_id", F.desc_nulls_last("source_date"), F.asc("id"))


def section_order_columns(section: Column) -> list[Column]:
    key = section_sort_key(section)
    return [key["priority"], key["name"]]
