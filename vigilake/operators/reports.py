"""Reports over search matches and assessments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilake.functions.text import clean_xml_hex, normalize_term, text
from vigilake.operators.skew import merge_join

# Report categories in display order.
CATEGORIES = ("Important Identified Risks", "Important Potential Risks", "Missing Information")
CASE = ["dataset_id", "case_number"]
# What a reviewer writes beside the status.
REVIEW = ("reviewer_notes", "exclusion_reason")


def category_of(c: Column) -> Column:
    """One of the three report categories; NULL is left out of the report."""
    low = F.lower(text(c))
    return (
        F.when(low.contains("section 9"), None)
        .when(c.isin(*CATEGORIES), c)
        .when(low.contains("potential"), CATEGORIES[1])
        .when(low.contains("missing"), CATEGORIES[2])
        .when(low.contains("identified"), CATEGORIES[0])
    )


def category_order(c: Column) -> Column:
    order = F.lit(None).cast("int")
    for i, name in enumerate(CATEGORIES):
        order = F.when(c == name, F.lit(i)).otherwise(order)
    return order


def matched_cases(matches: DataFrame, assessments: DataFrame, *more: Column) -> DataFrame:
    """One row per concern, dataset and case with its review status, notes and
    exclusion reason, and ``more`` aggregates of its matches."""
    key = ["concern_id", "dataset_id", "case_number"]
    cases = matches.groupBy(*key).agg(F.count(F.lit(1)).alias("n_matches"), *more)
    joined = cases.join(assessments.select(*key, "status", *_review(assessments)), key, "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("CANDIDATE")))


def _review(assessments: DataFrame) -> list[Column]:
    none = F.lit(None).cast("string")
    return [F.col(c) if c in assessments.columns else none.alias(c) for c in REVIEW]


def status_counts(cases: DataFrame) -> DataFrame:
    """Cases and review states per concern and dataset."""
    return cases.groupBy("concern_id", "dataset_id").agg(
        F.sum("n_matches").alias("total_event_matches"),
        F.count(F.lit(1)).alias("number_of_relevant_cases"),
        F.count_if(F.col("status") == "RELEVANT").alias("confirmed_relevant_count"),
        F.count_if(F.col("status") == "NOT_RELEVANT").alias("excluded_count"),
        F.count_if(F.col("status") == "NEEDS_REVIEW").alias("needs_review_count"),
        F.count_if(~F.col("status").isin("RELEVANT", "NOT_RELEVANT", "NEEDS_REVIEW")).alias("pending_count"),
    )


def section_16_1_table(
    concerns: DataFrame, scope: DataFrame, matches: DataFrame, assessments: DataFrame
) -> DataFrame:
    """Distinct retrieved cases and review states of every reported concern.

    The official count is all retrieved cases, whatever their review state; a
    concern without a match stays with zero.
    """
    counts = status_counts(matched_cases(matches, assessments))
    named = concerns.select(
        F.col("id").alias("concern_id"), "product_name", F.col("name").alias("risk_term"),
        category_of(F.col("category")).alias("category"), "search_method",
    ).where(F.col("category").isNotNull())
    table = named.join(scope, "concern_id").join(counts, ["concern_id", "dataset_id"], "left").drop(
        "total_event_matches"
    )
    measures = [c for c in counts.columns if c.endswith(("_count", "_cases"))]
    return table.select(
        "product_name", "dataset_id", category_order(F.col("category")).alias("category_order"), "category",
        "concern_id", "risk_term", "search_method",
        *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in measures),
    )


def section_16_1_totals(table: DataFrame) -> DataFrame:
    return table.groupBy("product_name", "dataset_id").agg(
        F.sum("number_of_relevant_cases").alias("total_relevant_cases")
    )


def section_16_1_sheet(table: DataFrame) -> DataFrame:
    """Sheet rows: a banner per category, then its risks; no total row."""
    key = ["product_name", "dataset_id", "category_order"]
    none = F.lit(None).cast("long")
    banners = table.select(*key, "category").distinct().select(
        *key, F.lit("").alias("row_key"), F.upper("category").alias("label"), none.alias("cases")
    )
    risks = table.select(
        *key, F.col("concern_id").alias("row_key"), F.col("risk_term").alias("label"),
        F.col("number_of_relevant_cases").alias("cases"),
    )
    return banners.unionByName(risks)


# What a summary says of a case.
SUMMARY_FIELDS = (
    "country", "report_type", "product_name", "age", "sex", "listedness", "initial_receipt_date", "is_serious", "case_outcome")


# What the details of a case say of it, beside its source row.
DETAIL_FIELDS = ("product_name", "country", "case_outcome", "report_type", "age", "sex", "listedness", "initial_receipt_date")


def search_summary_cases(cases: DataFrame, records: DataFrame) -> DataFrame:
    """Case rows of a summary: matched case, its record and review status."""
    fields = [f for f in SUMMARY_FIELDS if f not in ("is_serious", "case_outcome")]
    return cases.join(records.select(*CASE, *fields, "is_serious", "case_outcome"), CASE, "left").select(
        "concern_id", *CASE, *(F.coalesce(c, F.lit("")).alias(c) for c in fields),
        F.coalesce("is_serious", F.lit(False)).alias("is_serious"),
        F.coalesce("case_outcome", F.lit("")).alias("outcome"), "n_matches",
        F.col("status").alias("assessment_status"), *REVIEW,
    )


def search_summary_matches(matches: DataFrame, assessments: DataFrame) -> DataFrame:
    """The matches under each case of a summary, as rows with the review status
    of their case. An assessment is one per concern, dataset and case."""
    key = ["concern_id", *CASE]
    status = assessments.select(*key, F.col("status").alias("assessment_status"))
    return matches.join(status, key, "left").select(
        *key, "position", "matched_field", "matched_term", "pt_code", "reference_source", "evidence", "source_row",
        F.coalesce("assessment_status", F.lit("CANDIDATE")).alias("assessment_status"),
    )


def concern_report_cases(cases: DataFrame, records: DataFrame) -> DataFrame:
    """The relevant, excluded and pending cases of a concern report, with the
    list (``case_list``) each belongs to."""
    case_list = F.when(F.col("assessment_status") == "RELEVANT", "relevant").when(
        F.col("assessment_status") == "NOT_RELEVANT", "excluded").otherwise("pending")
    return search_summary_cases(cases, records).withColumn("case_list", case_list)


def _terms() -> Column:
    """The distinct terms of a matched case, at most as many as its concern names."""
    return F.collect_set(F.struct("matched_term")).alias("_terms")


def _relevant() -> Column:
    return F.count_if(F.col("status") == "RELEVANT")


def _pending() -> Column:
    return F.count_if(~F.col("status").isin("RELEVANT", "NOT_RELEVANT"))


def pt_summary(matches: DataFrame, assessments: DataFrame) -> DataFrame:
    """Distinct cases per term: of the relevant cases, or of the pending ones
    where a concern has no relevant case. The matches are read once; a relevant
    case counts for its terms, so these tell whether there is one."""
    key = ["concern_id", "dataset_id"]
    counted = matched_cases(matches, assessments, _terms()).select(*key, "status", F.explode("_terms").alias("_term")).groupBy(
        *key, F.col("_term.matched_term").alias("preferred_term")).agg(_relevant().alias("_relevant"), _pending().alias("_pending"))
    has_relevant = F.max("_relevant").over(Window.partitionBy(*key)) > 0
    return counted.withColumn("case_count", F.when(has_relevant, F.col("_relevant")).otherwise(F.col("_pending"))).where(
        "case_count > 0").drop("_relevant", "_pending")


def concern_report(
    concerns: DataFrame, matches: DataFrame, assessments: DataFrame, records: DataFrame
) -> DataFrame:
    """Metrics and narrative sentence per concern and dataset.

    A case goes into one aggregate as itself, without a term, and under each of
    its terms, so metrics and terms come from one reading of the matches.
    """
    key = ["concern_id", "dataset_id"]
    relevant = F.col("status") == "RELEVANT"
    fatal = F.lower(text(F.col("case_outcome"))).contains("fatal")
    cases = matched_cases(matches, assessments, _terms()).join(records.select(*CASE, "is_serious", "case_outcome"), CASE, "left")
    counted = cases.select("*", F.explode(F.concat(F.array(F.lit(None)), "_terms")).alias("_term")).groupBy(*key, "_term").agg(
        F.count(F.lit(1)).alias("candidate_case_count"), F.sum("n_matches").alias("total_event_matches"),
        _relevant().alias("relevant_case_count"), F.count_if(F.col("status") == "NOT_RELEVANT").alias("excluded_count"),
        _pending().alias("pending_count"), F.count_if(relevant & F.coalesce("is_serious", F.lit(False))).alias("serious_count"),
        F.count_if(relevant & fatal).alias("fatal_count"),
    )
    of_cases = F.col("_term").isNull()
    measures = [c for c in counted.columns if c.endswith(("_count", "_matches"))]
    # One list per concern: as long as the number of distinct terms, which were
    # counted before they are listed.
    metrics = counted.groupBy(*key).agg(
        *(F.max(F.when(of_cases, F.col(m))).alias(m) for m in measures),
        F.collect_list(F.when(~of_cases, F.struct("relevant_case_count", "pending_count", "_term.matched_term"))).alias("_all"),
    )
    shown = F.transform("_all", lambda t: F.struct(
        (-F.when(F.col("relevant_case_count") > 0, t["relevant_case_count"]).otherwise(t["pending_count"])).alias("n"),
        t["matched_term"].alias("term")))
    listed = F.array_sort(F.filter(shown, lambda t: t["n"] < 0))
    joined = metrics.withColumn("_listed", listed).join(
        concerns.select(F.col("id").alias("concern_id"), "name", "reporting_period", "search_method", "description"), "concern_id")
    n_terms = F.size("_listed").cast("long")
    terms = F.array_join(F.transform("_listed", lambda t: F.format_string("%s (%d)", t["term"], -t["n"])), ", ")
    sentence = F.format_string(
        "During the review period (%s), the MAH retrieved %d candidate case reports pertaining to the safety "
        "concern of '%s' using %s (%s). Following clinical relevance assessment, %d distinct cases were confirmed "
        "to be relevant (%d serious, %d fatal). %d cases were determined to be not relevant following clinical "
        "evaluation. There are currently %d candidate cases awaiting review. The events were categorized across "
        "%d Preferred Terms: %s. Based on the evaluation of these cases, no new safety signals or modifications "
        "to the product benefit-risk profile were established.",
        F.coalesce("reporting_period", F.lit("None")), F.col("candidate_case_count"), F.col("name"),
        F.col("search_method"), text(F.col("description")), F.col("relevant_case_count"), F.col("serious_count"),
        F.col("fatal_count"), F.col("excluded_count"), F.col("pending_count"),
        n_terms, F.when(n_terms > 0, terms).otherwise("None"),
    )
    return joined.select(
        "concern_id", "dataset_id", "candidate_case_count", "total_event_matches", "relevant_case_count",
        "excluded_count", "pending_count", "serious_count", "fatal_count",
        sentence.alias("clinical_narrative_summary"),
    )


def case_detail(
    records: DataFrame, events: DataFrame, products: DataFrame, matches: DataFrame, assessments: DataFrame,
    scoped: bool = True, audit: DataFrame | None = None,
) -> DataFrame:
    """Every part of a case as rows (case, part, ordinal, value), with the audit
    rows of its assessments where they are given.

    Events learn the matched terms of their case in a join by case, so tables
    that are bucketed by case are not shuffled; a case's list is at most as long
    as the concerns name terms.
    ``scoped`` keeps events and products to the case's own dataset; without it
    they are read by case number across datasets.
    """
    def tagged(name: str, df: DataFrame, ordinal: Column, value: Column) -> DataFrame:
        return df.select(*CASE, F.lit(name).alias("part"), ordinal.cast("long").alias("ordinal"), value.alias("value"))

    base = records.select(*CASE)

    def known(df: DataFrame) -> DataFrame:
        return merge_join(df, base, CASE, "left_semi")

    def own(df: DataFrame) -> DataFrame:
        return known(df) if scoped else base.distinct().join(df.drop("dataset_id"), "case_number")

    zero = F.lit(0)
    marks = matches.groupBy(*CASE).agg(F.collect_set(F.upper("matched_term")).alias("_terms"))
    hit = F.coalesce(F.array_contains("_terms", F.col("normalized_term")), F.lit(False))
    marked = merge_join(own(events.select(*CASE, "position", "normalized_term")), marks, CASE, "left")
    rows = (
        tagged("event", marked, F.col("position"), F.concat_ws("|", "normalized_term", hit.cast("string")))
        .unionByName(tagged("product", own(products.select(*CASE, "source_row", "product_name_raw", "role")),
                            F.col("source_row"), F.concat_ws("|", "product_name_raw", "role")))
        .unionByName(known(tagged("match", matches, F.coalesce("position", zero), F.concat_ws("|", "concern_id", "matched_term"))))
        .unionByName(known(tagged("assessment", assessments, zero, F.concat_ws("|", "concern_id", "status"))))
    )
    if audit is not None:
        rows = rows.unionByName(known(tagged("audit", audit, zero, F.concat_ws("|", "concern_id", "user_id", "action"))))
    record = F.concat_ws("|", *DETAIL_FIELDS, "source_row")
    return tagged("record", records, zero, record).unionByName(rows)


def ingestion_status(records: DataFrame, events: DataFrame, datasets: DataFrame) -> DataFrame:
    """One row per dataset with its case and event counts and product."""
    cases = records.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("cases"))
    n_events = events.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("events"))
    return (
        datasets.select(F.col("id").alias("dataset_id"), "product_name", "reporting_period")
        .join(cases, "dataset_id", "left").join(n_events, "dataset_id", "left")
        .fillna(0, ["cases", "events"])
    )


def ingestion_totals(
    records: DataFrame, events: DataFrame, terms: DataFrame, concerns: DataFrame, datasets: DataFrame
) -> DataFrame:
    """(kind, name, n): totals of all tables, cases per product, files."""
    def total(kind: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.lit("").alias("name"), "n")

    def listed(kind: str, df: DataFrame, name: str) -> DataFrame:
        named = df.where(text(F.col(name)) != "")
        return named.groupBy(F.lit(kind).alias("kind"), F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))

    return (
        total("cases", records).unionByName(total("events", events)).unionByName(total("smq_terms", terms))
        .unionByName(total("concerns", concerns)).unionByName(listed("product", records, "product_name"))
        .unionByName(listed("file", datasets, "source_filename"))
    )


def bracket_terms(listing: DataFrame) -> DataFrame:
    """Bracketed terms of every cell, escapes removed first."""
    found = F.regexp_extract_all(clean_xml_hex(F.col("_events")), F.lit(r"\[([^\]]+)\]"), F.lit(1))
    terms = F.filter(F.transform(found, normalize_term), lambda t: t != "")
    return listing.select(*CASE, F.explode(terms).alias("term"))


def line_listing_profile(listing: DataFrame) -> DataFrame:
    """Rows, distinct cases and events per case."""
    per_row = F.size(F.filter(
        F.transform(
            F.regexp_extract_all(clean_xml_hex(F.col("_events")), F.lit(r"\[([^\]]+)\]"), F.lit(1)), normalize_term),
        lambda t: t != ""))
    per_case = listing.select(*CASE, per_row.alias("_n")).groupBy(*CASE).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("_n").alias("_events")
    )
    return per_case.groupBy("dataset_id").agg(
        F.sum("_rows").alias("total_rows"), F.count(F.lit(1)).alias("distinct_cases"),
        F.sum("_events").alias("total_events"), F.max("_events").alias("max_events"),
        F.min("_events").alias("min_events"),
        F.round(F.sum("_events") / F.count(F.lit(1)), 2).alias("avg_events"),
    )


def top_terms(listing: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most common bracketed terms; ties by term."""
    return bracket_terms(listing).groupBy("term").agg(F.count(F.lit(1)).alias("uses")).orderBy(
        F.desc("uses"), "term"
    ).limit(n)


def list_cases(
    records: DataFrame, product: str | None = None, country: str | None = None, serious_only: bool = False,
) -> DataFrame:
    d = records
    if product:
        d = d.where(F.ilike(F.col("product_name"), like_literal(f"%{product}%")))
    if country:
        d = d.where(F.ilike(F.col("country"), like_literal(f"%{country}%")))
    return d.where("is_serious") if serious_only else d


def like_literal(pattern: str) -> Column:
    """A LIKE pattern in which only ``%`` and ``_`` are special."""
    return F.lit(pattern.replace("\\", "\\\\"))


def page(df: DataFrame, order: list[Column], number: int = 1, limit: int = 50) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * limit).limit(limit)


def page_totals(df: DataFrame, limit: int = 50) -> DataFrame:
    """Number of rows and of pages behind :func:`page`."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / F.lit(limit)))


def case_text_filter(matches: DataFrame, records: DataFrame, needle: str) -> DataFrame:
    """Matched cases whose number, country, outcome or a matched term holds the
    text."""
    q = F.lit(needle.lower())
    hit = F.bool_or(F.coalesce(F.lower("matched_term").contains(q), F.lit(False)))
    cases = matches.groupBy("concern_id", *CASE).agg(hit.alias("_hit"))
    joined = cases.join(records.select(*CASE, "country", "case_outcome"), CASE, "left").select(
        "concern_id", *CASE, "_hit", F.coalesce("country", F.lit("")).alias("country"), F.coalesce("case_outcome", F.lit("")).alias("outcome"))
    own = F.lower("case_number").contains(q) | F.lower("country").contains(q) | F.lower("outcome").contains(q)
    return joined.where(own | F.col("_hit")).drop("_hit")


def ingest_quality_flags(events: DataFrame, records: DataFrame, products: DataFrame, start: str, end: str) -> DataFrame:
    """Documented ingest checks, one row per flagged item."""
    def flag(df: DataFrame, name: str, detail: Column) -> DataFrame:
        return df.select(*CASE, F.lit(name).alias("flag"), detail.cast("string").alias("detail"))

    bad_number = records.where(~F.rlike("case_number", F.lit("^[0-9]{4}[A-Z]{2}[0-9]{6}$")))
    received = F.try_to_timestamp("initial_receipt_date", F.lit("yyyy-MM-dd")).cast("date")
    late = records.where(received.isNull() | ~received.between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    hexed = events.where(F.rlike("normalized_term", F.lit("(?i)_x[0-9a-f]{4}_")))
    repeated = events.groupBy(*CASE, "normalized_term").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    roles = products.where(~F.col("role").isin("Suspect", "Concom", "Concomitant"))
    return (
        flag(bad_number, "case_number", F.col("case_number"))
        .unionByName(flag(late, "receipt_date", F.col("initial_receipt_date")))
        .unionByName(flag(hexed, "hex_escape", F.col("normalized_term")))
        .unionByName(flag(repeated, "repeated_term", F.col("normalized_term")))
        .unionByName(flag(roles, "product_role", F.col("role")))
    )


def backfill_case_key(children: DataFrame, records: DataFrame, key: str = "case_id") -> DataFrame:
    """Child rows with the surrogate key of their case; a key that is already
    set stays."""
    keys = records.select(*CASE, F.col(key).alias("_key"))
    return children.join(keys, CASE, "left").withColumn(key, F.coalesce(F.col(key), F.col("_key"))).drop("_key")
