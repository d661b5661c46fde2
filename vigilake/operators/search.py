"""Safety-concern searches: every concern of every dataset in one plan.

One posting table, key → concern, serves dictionary, sub-filtered, listed-term,
interaction and organ-class searches: events are read once and meet it under
their term and organ class, cases under their organ class. Narratives are read
once for the keywords of all concerns. Evidence is written after the matches are
narrowed to the datasets of a concern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilake.functions.text import narrative_snippet, strip, text
from vigilake.operators.dictionary import lookup_terms
from vigilake.operators.keywords import with_keywords
from vigilake.operators.skew import cut_lineage, pick

CONFIG_SCHEMA = (
    "smq_name STRING, scope STRING, soc_name STRING, include_event_level BOOLEAN, pt STRING, pts ARRAY<STRING>,"
    " sub_filter_pts ARRAY<STRING>, initial_pts ARRAY<STRING>, target_substances ARRAY<STRING>,"
    " keywords ARRAY<STRING>"
)
# Substances looked for when a concern names none, and the group
# of a sub-filtered search that names none.
DEFAULT_SUBSTANCES = (
    "fluoxetine", "paroxetine", "bupropion", "quinidine", "duloxetine", "terbinafine", "codeine",
)
DEFAULT_SUBFILTER_GROUP = "Medication errors (SMQ)"

MATCH_COLUMNS = (
    "concern_id", "dataset_id", "case_number", "position", "search_method", "matched_field", "matched_term",
    "pt_code", "smq_name", "smq_scope", "reference_source", "evidence", "source_row",
)


def parse_search_config(concerns: DataFrame) -> DataFrame:
    """Concerns with their JSON parameters and the defaults of each method."""
    cfg = F.from_json(text(F.col("search_config")), CONFIG_SCHEMA)
    method = F.col("search_method")
    scope = F.coalesce(cfg["scope"], F.when(method == "NARROW_SMQ", "Narrow").otherwise("Broad"))
    group = F.coalesce(cfg["smq_name"], F.when(method == "SMQ_SUBFILTER", DEFAULT_SUBFILTER_GROUP))
    default_targets = F.array(*(F.lit(s) for s in DEFAULT_SUBSTANCES))

    def folded(c: Column, fold) -> Column:
        return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: fold(strip(x)))

    return concerns.select(
        *concerns.columns, group.alias("cfg_group"), scope.alias("cfg_scope"),
        cfg["soc_name"].alias("cfg_soc_name"), F.lower(strip(text(cfg["soc_name"]))).alias("cfg_soc"),
        F.coalesce(cfg["include_event_level"], F.lit(False)).alias("cfg_event_level"),
        F.when(method == "SINGLE_PT", F.array(cfg["pt"])).otherwise(
            F.coalesce(cfg["pts"], F.array().cast("array<string>"))
        ).alias("cfg_pts"),
        folded(cfg["sub_filter_pts"], F.upper).alias("cfg_sub_pts"),
        F.coalesce(cfg["initial_pts"], F.array().cast("array<string>")).alias("cfg_initial"),
        folded(F.coalesce(cfg["target_substances"], default_targets), F.lower).alias("cfg_targets"),
        folded(cfg["keywords"], F.lower).alias("cfg_keywords"),
    )


def upsert_concerns(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Concerns by id after a batch: the last row of an id (``seq``) replaces
    what was there, new ids are added."""
    last = pick(batch, ["id"], F.col("seq")).drop("seq")
    return current.join(last.select("id"), "id", "left_anti").unionByName(last)


def list_concerns(concerns: DataFrame, product: str | None = None) -> DataFrame:
    """All concerns, or those whose product name contains a text in any case."""
    return concerns.where(F.lower(text(F.col("product_name"))).contains(product.lower())) if product else concerns


def active_datasets(concerns: DataFrame, datasets: DataFrame) -> DataFrame:
    """concern_id → dataset_id: the newest active dataset of the product whose
    period is the concern's, else the newest of the product."""
    ds = datasets.where(F.col("status") == "ACTIVE").select(
        F.col("id").alias("dataset_id"), "product_name", F.col("reporting_period").alias("_period"), "created_at"
    )
    wanted = F.coalesce(F.col("reporting_period"), F.lit("")).isin("", "Current Period") | (
        F.col("reporting_period") == F.col("_period")
    )
    rank = F.struct(F.coalesce(wanted, F.lit(False)), F.col("created_at"), F.col("dataset_id"))
    return (
        concerns.select(F.col("id").alias("concern_id"), "product_name", "reporting_period")
        .join(ds, "product_name").groupBy("concern_id").agg(F.max_by("dataset_id", rank).alias("dataset_id"))
    )


def all_datasets(concerns: DataFrame, datasets: DataFrame) -> DataFrame:
    """concern_id × every active dataset of its product."""
    ds = datasets.where(F.col("status") == "ACTIVE").select(F.col("id").alias("dataset_id"), "product_name")
    return concerns.select(F.col("id").alias("concern_id"), "product_name").join(ds, "product_name").drop(
        "product_name"
    )


def _listed_terms(concerns: DataFrame, source: str, columns: list[str]) -> DataFrame:
    """Configured terms, one per upper-case spelling; the last spelling wins."""
    exploded = concerns.select(*columns, F.posexplode(source).alias("_i", "_term")).where(
        text(strip(F.col("_term"))) != ""
    )
    term = strip(F.col("_term"))
    return exploded.groupBy(*columns, F.upper(term).alias("normalized_term")).agg(
        F.max_by(term, "_i").alias("matched_term")
    )


def search_terms(concerns: DataFrame, terms: DataFrame) -> DataFrame:
    """(concern, upper-case term) rows of all term-driven methods.

    ``concerns`` comes from :func:`parse_search_config`.
    """
    dictionary = lookup_terms(terms).select(
        F.col("smq_name").alias("cfg_group"), F.col("scope").alias("cfg_scope"),
        F.col("pt_name_upper").alias("normalized_term"), F.col("pt_name").alias("matched_term"), "pt_code",
        "smq_code",
    )
    by_group = concerns.where(F.col("search_method").isin("BROAD_SMQ", "NARROW_SMQ", "SMQ_SUBFILTER"))
    from_dictionary = by_group.join(dictionary, ["cfg_group", "cfg_scope"]).where(
        (F.col("search_method") != "SMQ_SUBFILTER") | F.array_contains("cfg_sub_pts", F.col("normalized_term"))
    ).select(
        F.col("id").alias("concern_id"), "search_method", "normalized_term", "matched_term", "pt_code",
        F.col("cfg_group").alias("smq_name"), F.col("cfg_scope").alias("smq_scope"), "smq_code",
        F.lit(None).cast("int").alias("n_terms"),
    )
    none = F.lit(None).cast("string")

    def listed(method: list[str], source: str) -> DataFrame:
        rows = _listed_terms(concerns.where(F.col("search_method").isin(*method)), source, ["id", "search_method", source])
        n = F.size(F.array_distinct(F.transform(
            F.filter(F.col(source), lambda x: text(strip(x)) != ""), lambda x: F.upper(strip(x)))))
        return rows.select(
            F.col("id").alias("concern_id"), "search_method", "normalized_term", "matched_term",
            none.alias("pt_code"), none.alias("smq_name"), none.alias("smq_scope"), none.alias("smq_code"),
            n.alias("n_terms"),
        )

    return from_dictionary.unionByName(listed(["SINGLE_PT", "MULTIPLE_PTS"], "cfg_pts")).unionByName(
        listed(["CONCOMITANT_INTERACTION"], "cfg_initial")
    )


# What a raw match carries until its evidence is written.
RAW = {
    "concern_id": "string", "dataset_id": "string", "case_number": "string", "position": "bigint", "source_row": "bigint",
    "search_method": "string", "matched_term": "string", "pt_code": "string", "smq_name": "string", "smq_scope": "string",
    "smq_code": "string", "n_terms": "int", "soc_name": "string", "said": "string", "verbatim": "string",
    "drugs": "array<struct<concern_id:string,drug:string>>",
}


def _raw(df: DataFrame) -> DataFrame:
    """A kind of match with all columns of RAW, NULL where it has none."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in RAW.items()))


def _of_terms(term_rows: DataFrame) -> DataFrame:
    return term_rows.select(
        F.concat(F.lit("T|"), "normalized_term").alias("key"), "concern_id", "search_method", "matched_term", "pt_code",
        "smq_name", "smq_scope", "smq_code", "n_terms", F.lit(None).cast("string").alias("soc_name"), F.lit(True).alias("of_events"))


def postings(concerns: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, concern, method, ...) of all methods but narratives; a key is a
    term or an organ class with its kind before it."""
    by_soc = concerns.where(F.col("search_method") == "SOC").select(
        F.concat(F.lit("S|"), "cfg_soc").alias("key"), F.col("id").alias("concern_id"), "search_method",
        F.col("cfg_soc_name").alias("soc_name"), F.col("cfg_event_level").alias("of_events"))
    return _of_terms(search_terms(concerns, terms)).unionByName(by_soc, allowMissingColumns=True)


def scoped(posted: DataFrame, scope: DataFrame) -> DataFrame:
    """Postings by dataset, so that an event meets only the concerns that cover
    its own and none that goes again."""
    return posted.join(scope, "concern_id")


def match_terms(events: DataFrame, scope: DataFrame, term_rows: DataFrame) -> DataFrame:
    """Events whose term belongs to a concern that covers their dataset."""
    return evidenced(match_events(events, scoped(_of_terms(term_rows), scope)))


def with_drugs(events: DataFrame, products: DataFrame, concerns: DataFrame, scope: DataFrame) -> DataFrame:
    """Events with the target substances that their case took, for each
    interaction concern; a join by case of tables bucketed by case."""
    targets = concerns.where(F.col("search_method") == "CONCOMITANT_INTERACTION").select(
        F.col("id").alias("concern_id"), "cfg_targets").join(scope, "concern_id")
    substance, brand = F.lower(text(F.col("active_substance"))), F.lower(text(F.col("brand_name")))
    hit = F.exists("cfg_targets", lambda t: F.contains(substance, t) | F.contains(brand, t))
    drug = F.concat(
        F.coalesce(F.nullif(F.col("brand_name"), F.lit("")), F.col("active_substance")),
        F.lit(" ("), F.col("role"), F.lit(")"),
    )
    # As long as the products of a case are many.
    taken = products.join(targets, "dataset_id").where(hit).groupBy("dataset_id", "case_number").agg(
        F.collect_set(F.struct("concern_id", drug.alias("drug"))).alias("drugs"))
    return events.join(taken, ["dataset_id", "case_number"], "left")


# What a key is looked up by.
_KEY = ["dataset_id", "key"]


def match_events(events: DataFrame, posted: DataFrame) -> DataFrame:
    """Raw matches of events, which are read once: each comes under its term and
    its organ class. ``posted`` comes from :func:`scoped`."""
    soc = F.col("soc") if "soc" in events.columns else F.lit(None).cast("string")
    keys = F.array_compact(F.array(F.concat(F.lit("T|"), "normalized_term"), F.concat(F.lit("S|"), F.lower(soc))))
    drugs = [F.col("drugs")] if "drugs" in events.columns else []
    # Absent where no evidence is to be written.
    verbatim = [F.col("raw_verbatim").alias("verbatim")] if "raw_verbatim" in events.columns else []
    keyed = events.select(
        "dataset_id", "case_number", "position", "source_row", F.coalesce(soc, F.col("normalized_term")).alias("_class"),
        F.col("normalized_term").alias("said"), *verbatim, *drugs, F.explode(keys).alias("key"))
    by_class = F.col("search_method") == "SOC"
    return _raw(keyed.join(posted.where("of_events"), _KEY).withColumn(
        "matched_term", F.when(by_class, F.col("_class")).otherwise(F.col("matched_term"))
    ).withColumn("search_method", F.when(by_class, "SOC_EVENT").otherwise(F.col("search_method"))))


def match_cases(cases: DataFrame, posted: DataFrame) -> DataFrame:
    """Raw matches of cases by organ class; ``posted`` as for events."""
    keyed = cases.select(
        "dataset_id", "case_number", "source_row", F.col("primary_soc").alias("_soc"), F.concat(F.lit("S|"), F.lower("primary_soc")).alias("key"))
    return _raw(keyed.join(posted.where(F.col("search_method") == "SOC"), _KEY).withColumn("matched_term", F.col("_soc")))


def match_narratives(cases: DataFrame, concerns: DataFrame) -> DataFrame:
    """Raw matches of narratives: the first keyword, in configured order, that
    the text holds. Each text is read once for all keywords; a snippet is cut for
    each keyword in it, and only snippets meet the concerns."""
    listed = concerns.where(F.col("search_method") == "NARRATIVE").select(
        F.col("id").alias("concern_id"), F.posexplode("cfg_keywords").alias("_i", "_kw"))
    texts = cases.where(F.col("narrative").isNotNull()).select(
        "dataset_id", "case_number", "source_row", "narrative", F.lower("narrative").alias("_low"))
    found = with_keywords(texts, "_low", listed.select("_kw"), "_kws").select(
        "dataset_id", "case_number", "source_row", "narrative", F.explode("_kws").alias("_kw"))
    said = found.select(
        "dataset_id", "case_number", "source_row", "_kw", narrative_snippet(F.col("narrative"), F.col("_kw")).alias("said"))
    first = said.join(listed, "_kw").groupBy("concern_id", "dataset_id", "case_number", "source_row").agg(
        F.min_by(F.struct("_kw", "said"), "_i").alias("_first"))
    return _raw(first.select(
        "concern_id", "dataset_id", "case_number", "source_row", F.lit("NARRATIVE_SEARCH").alias("search_method"),
        F.col("_first._kw").alias("matched_term"), F.col("_first.said").alias("said")))


def evidenced(raw: DataFrame) -> DataFrame:
    """Matches with their field, reference and evidence written out."""
    method, term, said, verbatim = (F.col(c) for c in ("search_method", "matched_term", "said", "verbatim"))
    of_dictionary = method.isin("BROAD_SMQ", "NARROW_SMQ")

    def by_method(dictionary: Column, sub: Column, inter: Column, soc: Column, soc_event: Column, narrative: Column, listed: Column) -> Column:
        return (
            F.when(of_dictionary, dictionary).when(method == "SMQ_SUBFILTER", sub).when(method == "CONCOMITANT_INTERACTION", inter)
            .when(method == "SOC", soc).when(method == "SOC_EVENT", soc_event).when(method == "NARRATIVE_SEARCH", narrative).otherwise(listed)
        )

    def joined(*parts: str | Column) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    field = by_method(*map(F.lit, (
        "Event Verbatim (Exact PT Lookup)", "SMQ + Sub-filter PT Lookup", "Drug Interaction PT + Concomitant Review",
        "Primary System Organ Class", "Event System Organ Class", "Case Narrative Snippet", "Event Preferred Term (Configured PT List)")))
    code = F.coalesce(F.nullif(F.col("smq_code"), F.lit("")), F.lit("N/A"))
    group, scope = F.col("smq_name"), F.col("smq_scope")
    reference = by_method(
        joined(scope, " SMQ: ", group, " (Code: ", code, ")"), joined("SMQ ", group, " + Sub-filter PT: ", term),
        F.lit("CYP2D6 Multi-Level Interaction Criteria"), joined("MedDRA SOC: ", F.col("soc_name")), joined("Event SOC: ", F.col("soc_name")),
        joined("Narrative keyword criterion: '", term, "'"), joined("Configured PT Criteria (", F.col("n_terms").cast("string"), " terms)"))
    own = F.transform(F.filter("drugs", lambda d: d["concern_id"] == F.col("concern_id")), lambda d: d["drug"])
    drugs = F.nullif(F.array_join(F.array_sort(F.array_distinct(own)), ", "), F.lit(""))
    note = F.coalesce(
        joined(" Concomitant CYP2D6 candidate drugs identified: ", drugs, "."),
        F.lit(" No structured CYP2D6 inhibitor detected; requires clinical narrative review."))
    evidence = by_method(
        joined("Exact match for MedDRA PT '", term, "' [PT Code: ", F.col("pt_code"), "] in event verbatim: ", verbatim),
        joined("Event verbatim ", verbatim, " matched SMQ '", group, "' sub-filtered on PT '", term, "'"),
        joined("Interaction event matched: '", term, "' in verbatim: ", verbatim, ".", note),
        joined("Case primary SOC is '", term, "'"),
        joined("Event '", said, "' mapped to SOC '", term, "' in verbatim: ", verbatim),
        joined("Clinical narrative snippet: '", said, "'"),
        joined("Exact match for configured PT '", term, "' in event verbatim: ", verbatim))
    return raw.withColumns({"matched_field": field, "reference_source": reference, "evidence": evidence}).select(*MATCH_COLUMNS)


def in_scope(raw: DataFrame, scope: DataFrame) -> DataFrame:
    """Raw matches in the datasets of their concern, written out."""
    return evidenced(raw.join(scope, ["concern_id", "dataset_id"]))


def run_searches(
    cases: DataFrame, events: DataFrame, products: DataFrame, terms: DataFrame, concerns: DataFrame,
    scope: DataFrame,
) -> DataFrame:
    """Matches of every concern over every dataset in its scope."""
    parsed = cut_lineage(parse_search_config(concerns))
    return evidenced(raw_matches(cases, with_drugs(events, products, parsed, scope), terms, parsed, scope))


def raw_matches(cases: DataFrame, events: DataFrame, terms: DataFrame, parsed: DataFrame, scope: DataFrame) -> DataFrame:
    """Matches of every concern over every dataset in its scope, before their
    evidence is written. The postings are stored, so events meet them where they
    are and stay dealt by case."""
    posted = cut_lineage(scoped(postings(parsed, terms), scope))
    narratives = match_narratives(cases, parsed).join(scope, ["concern_id", "dataset_id"])
    return match_events(events, posted).unionByName(match_cases(cases, posted)).unionByName(narratives.select(*RAW))


def event_enrichment(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Events with the term and code of their latest match (highest concern id
    where several concerns match)."""
    latest = matches.where(F.col("position").isNotNull() & (F.col("search_method") != "SOC_EVENT")).groupBy(
        "dataset_id", "case_number", "position"
    ).agg(
        F.max_by("matched_term", "concern_id").alias("preferred_term"),
        F.max_by("pt_code", F.when(F.col("pt_code").isNotNull(), F.col("concern_id"))).alias("matched_pt_code"),
    )
    return events.join(latest, ["dataset_id", "case_number", "position"], "left")


def run_metrics(matches: DataFrame) -> DataFrame:
    """Matches and distinct cases per concern and dataset."""
    per_case = matches.groupBy("concern_id", "dataset_id", "case_number").agg(F.count(F.lit(1)).alias("_n"))
    return per_case.groupBy("concern_id", "dataset_id").agg(
        F.sum("_n").alias("candidate_events_count"), F.count(F.lit(1)).alias("distinct_cases_count")
    )


def flag_active_runs(runs: DataFrame) -> DataFrame:
    """``is_active`` recomputed over append-only runs: the newest run of each
    concern and dataset."""
    newest = runs.groupBy("concern_id", "dataset_id").agg(
        F.max(F.struct("execution_time", "id")).alias("_newest")
    )
    return runs.drop("is_active").join(newest, ["concern_id", "dataset_id"]).withColumn(
        "is_active", F.struct("execution_time", "id") == F.col("_newest")
    ).drop("_newest")


def active_run(runs: DataFrame) -> DataFrame:
    """concern_id → the newest active run, else the newest run."""
    rank = F.struct(F.coalesce("is_active", F.lit(False)), "execution_time", "id")
    return runs.groupBy("concern_id").agg(F.max_by("id", rank).alias("search_run_id"))


def _run_id(stamp: str) -> Column:
    return F.concat(F.lit("run_"), F.col("concern_id"), F.lit("_"), F.col("dataset_id"), F.lit("_" + stamp))


def run_rows(metrics: DataFrame, scope: DataFrame, stamp: str, reviewer: str) -> dict[str, DataFrame]:
    """What one search pass adds beside its matches: ``search_runs`` and
    ``audit_logs``, one run per concern and dataset in scope. ``metrics`` comes
    from :func:`run_metrics`."""
    when = F.to_timestamp(F.lit(stamp), "yyyyMMddHHmmss").cast("timestamp_ntz")
    runs = scope.join(metrics, ["concern_id", "dataset_id"], "left").select(
        _run_id(stamp).alias("id"), "concern_id", "dataset_id", when.alias("execution_time"),
        F.lit(reviewer).alias("executed_by"), F.lit(True).alias("is_active"),
        F.coalesce("candidate_events_count", F.lit(0)).cast("long").alias("candidate_events_count"),
        F.coalesce("distinct_cases_count", F.lit(0)).cast("long").alias("distinct_cases_count"),
    )
    audit = runs.select(
        "concern_id", F.lit(reviewer).alias("user_id"), when.alias("at"),
        F.concat(F.lit("Executed deterministic search run '"), F.col("id"), F.lit("': "),
                 F.col("candidate_events_count").cast("string"), F.lit(" candidate events across "),
                 F.col("distinct_cases_count").cast("string"), F.lit(" distinct cases.")).alias("action"),
    )
    return {"search_runs": runs, "audit_logs": audit}


RUN_TABLES = ("search_runs", "search_matches", "audit_logs")


def store_run(
    root: str, matches: DataFrame, scope: DataFrame, stamp: str, reviewer: str, metrics: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Append one search pass to the stored tables below a folder. A pass is a
    part of each table, so one that is run again replaces itself and no earlier
    one is read or written.

    Matches go straight from the search to their part, and the figures are
    counted once from what is stored there, unless ``metrics`` has them already.
    Both are returned for a pass that finds the same again.
    """
    part = f"{root}/search_matches/stamp={stamp}"
    matches.withColumn("search_run_id", _run_id(stamp)).write.mode("overwrite").parquet(part)
    stored = matches.sparkSession.read.schema(matches.schema).parquet(part)
    if metrics is None:
        metrics = cut_lineage(run_metrics(stored))
    for name, df in run_rows(metrics, scope, stamp, reviewer).items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/stamp={stamp}")
    return stored, metrics


def stored_runs(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The stored tables of all passes, with the newest run of each concern and
    dataset active."""
    tables = {name: spark.read.option("mergeSchema", "false").parquet(f"{root}/{name}").drop("stamp") for name in RUN_TABLES}
    return tables | {"search_runs": flag_active_runs(tables["search_runs"])}


def init_assessments(assessments: DataFrame, matches: DataFrame) -> DataFrame:
    """CANDIDATE rows added for matched cases that have no assessment; ids that
    are missing are filled, others stay."""
    key = ["case_number", "concern_id", "dataset_id"]
    new = matches.select(*key).distinct().join(assessments.select(*key), key, "left_anti").select(
        *key, F.lit("CANDIDATE").alias("status")
    )
    made = F.concat_ws("_", F.lit("ass"), "concern_id", "dataset_id", "case_number")
    known = assessments if "id" in assessments.columns else assessments.withColumn("id", F.lit(None).cast("string"))
    return known.unionByName(new, allowMissingColumns=True).withColumn("id", F.coalesce("id", made))


# States a reviewer may set.
STATUSES = ("CANDIDATE", "RELEVANT", "NOT_RELEVANT", "NEEDS_REVIEW")


def reviewed(assessments: DataFrame, updates: DataFrame) -> DataFrame:
    """(key, before, last): the state of each assessment, NULL where there is
    none, and the last update of it (``seq``), NULL where there is none. Both
    tables meet in one aggregate; updates to a status outside the four allowed
    ones are rejected."""
    key = ["case_number", "concern_id", "dataset_id"]
    review = ["status", "reviewer_notes", "exclusion_reason"]
    none = F.lit(None).cast("string")

    def own(df: DataFrame) -> list[Column]:
        return [F.col(c) if c in df.columns else none.alias(c) for c in review]

    old = assessments.select(
        *key, F.struct(*own(assessments)).alias("before"), F.lit(None).cast("long").alias("seq"),
        F.struct(none.alias("reviewer_id"), *(none.alias(c) for c in review)).alias("last"))
    new = updates.where(F.col("status").isin(*STATUSES)).select(
        *key, F.struct(*(none.alias(c) for c in review)).alias("before"), F.col("seq").cast("long").alias("seq"),
        F.struct("reviewer_id", *own(updates)).alias("last"))
    is_old = F.col("seq").isNull()
    return old.unionByName(new).groupBy(*key).agg(
        F.max_by("before", F.when(is_old, F.lit(1))).alias("before"), F.max_by("last", "seq").alias("last"))


def audit_rows(reviews: DataFrame) -> DataFrame:
    """One audit row for each assessment that an update has set."""
    return reviews.where(F.col("last").isNotNull()).select(
        "case_number", "concern_id", "dataset_id", F.coalesce("before.status", F.lit("NEW")).alias("previous_state"),
        F.col("last.status").alias("new_state"), F.col("last.reviewer_id").alias("user_id"),
        F.concat(F.lit("Changed assessment status for case "), F.col("case_number"), F.lit(" to "), F.col("last.status")).alias("action"),
    )


def update_assessments(assessments: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assessments, audit rows) after reviewer updates.

    Several updates of one key are folded to the last one (``seq``), which sets
    status, notes and exclusion reason; a status outside the four allowed ones
    is rejected.
    """
    reviews = reviewed(assessments, updates)
    state = F.coalesce(F.col("last").dropFields("reviewer_id"), F.col("before"))
    current = reviews.select("case_number", "concern_id", "dataset_id", state.alias("_s")).select(
        "case_number", "concern_id", "dataset_id", "_s.status", "_s.reviewer_notes", "_s.exclusion_reason")
    return current, audit_rows(reviews)
