"""Search, ranking and product lookup, for one request or many at once."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from vigilake.functions.dates import in_range, transpose_day_month
from vigilake.functions.matching import contains_like, product_match, source_in_group
from vigilake.functions.text import normalize_drug_name, normalize_product_name, squeeze, strip, strip_drug_salts, text
from vigilake.operators import ranking
from vigilake.operators.skew import cut_lineage, pick
from vigilake.operators.substring import substring_join

SEPARATORS = r"[,;/]+"


def _flag(condition: Column) -> Column:
    """0 where the condition holds, 1 elsewhere (NULL included)."""
    return F.when(condition, 0).otherwise(1)


def search_drugs(drugs: DataFrame, query: str, source: str | None = None) -> DataFrame:
    """Drugs whose name, ingredient or application number contains the query;
    ``%`` and ``_`` of the query act as wildcards."""
    raw, norm = F.lit(query), normalize_drug_name(F.lit(query))
    hit = contains_like(F.col("normalized_name"), norm)
    for name in ("active_ingredient", "display_name", "application_number"):
        hit = hit | contains_like(F.col(name), norm) | contains_like(F.col(name), raw)
    return drugs.where(hit & source_in_group(F.col("source"), source))


def search_order(query: str) -> list[Column]:
    norm, clean = normalize_drug_name(F.lit(query)), F.lit(query.strip().lower())
    ingredient = F.lower(F.trim("active_ingredient"))
    return [
        _flag(F.lower("display_name") == clean), _flag(F.col("normalized_name") == norm),
        _flag(ingredient == clean), _flag(ingredient == norm),
        _flag(~F.col("active_ingredient").contains(";")), F.col("display_name").asc(), F.col("id").asc(),
    ]


def search_drugs_filtered(
    drugs: DataFrame, product: str, generic: str | None = None, ingredients: str | None = None,
    source: str | None = "FDA_SRLC",
) -> DataFrame:
    """Product AND generic AND every listed ingredient."""
    p = squeeze(F.lit(product))
    np = normalize_drug_name(F.lit(product))
    name, ingredient, normalized = F.col("display_name"), F.col("active_ingredient"), F.col("normalized_name")
    hit = (
        contains_like(name, p) | contains_like(normalized, np) | contains_like(name, np)
        | contains_like(ingredient, np) | contains_like(ingredient, p)
    )
    if generic and generic.strip():
        g, ng = F.lit(generic.strip()), normalize_drug_name(F.lit(generic))
        hit = hit & (
            contains_like(ingredient, g) | contains_like(ingredient, ng) | contains_like(name, g)
            | contains_like(normalized, ng)
        )
    if ingredients and ingredients.strip():
        parts = F.filter(F.transform(F.split(F.lit(ingredients), SEPARATORS), strip), lambda x: x != "")
        hit = hit & F.forall(
            parts, lambda x: contains_like(ingredient, x) | contains_like(ingredient, normalize_drug_name(x))
        )
    if source and source != "ALL":
        hit = hit & (F.col("source") == source)
    return drugs.where(hit)


def filtered_order(product: str, generic: str | None = None, ingredients: str | None = None) -> list[Column]:
    clean = " ".join(product.split()).lower()
    targets = [p.strip().lower() for p in re.split(SEPARATORS, ingredients or "") if p.strip()]
    targets += [generic.strip().lower()] if generic and generic.strip() else []
    targets += [clean] if clean else []
    order = [_flag(F.lower("display_name") == clean), _flag(F.col("normalized_name") == clean)]
    if targets:
        order += [
            _flag(F.lower(F.trim("active_ingredient")) == targets[0]),
            _flag(~F.col("active_ingredient").contains(";")),
        ]
    return [*order, F.col("display_name").asc(), F.col("id").asc()]


def autocomplete(products: DataFrame, query: str, limit: int = 20) -> DataFrame:
    name = F.col("product_name")
    return products.where(contains_like(name, F.lit(query))).orderBy(name.asc(), F.col("id").asc()).limit(limit)


# ---------------------------------------------------------------------------
# Many requests at once

def find_product_records(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Best record per request: exact name, normalized name, file name, part of
    the normalized name, part of the file name; the newest of the first stage
    that has a hit.

    requests: request_id, query. records: id, product_name,
    product_normalized, filename, updated_at.
    """
    q = requests.select(
        "request_id", strip(F.col("query")).alias("_clean"), normalize_product_name(strip(F.col("query"))).alias("_norm")
    )
    r = records.select(F.col("id").alias("record_id"), "product_name", "product_normalized", "filename", "updated_at")
    keep = ["request_id", "record_id", "updated_at"]

    def stage(n: int, pairs: DataFrame) -> DataFrame:
        return pairs.select(*keep, F.lit(n).alias("stage"))

    lowered = F.lower(F.col("_clean"))
    by_name = q.withColumn("_key", lowered).join(r.withColumn("_key", F.lower("product_name")), "_key")
    by_norm = q.where("_norm <> ''").withColumn("_key", F.col("_norm")).join(
        r.withColumn("_key", F.col("product_normalized")), "_key")
    names = q.withColumn("_key", F.explode(F.array(lowered, F.concat(lowered, F.lit(".pdf")))))
    by_file = names.join(r.withColumn("_key", F.lower("filename")), "_key")
    exact = cut_lineage(stage(1, by_name).unionByName(stage(2, by_norm)).unionByName(stage(3, by_file)))
    # Requests with an exact hit stay out of the substring joins.
    rest = q.join(exact.select("request_id").distinct(), "request_id", "left_anti")
    in_norm = substring_join(rest.where(F.length("_norm") >= 3), r, F.col("_norm"), F.col("product_normalized"))
    in_file = substring_join(
        rest.where(F.length("_clean") >= 3), r, F.col("_clean"), F.col("filename"), wildcards=True)
    hits = exact.unionByName(stage(4, in_norm)).unionByName(stage(5, in_file))
    best = hits.groupBy("request_id").agg(
        F.min_by(F.struct("record_id", "stage"), F.struct("stage", (-F.col("updated_at")).alias("u"), "record_id")).alias("_b")
    )
    return requests.join(best, "request_id", "left").select("request_id", "query", "_b.record_id", "_b.stage")


def matching_candidates(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates whose name, ingredient or application number fits a request
    as whole words (number: as part).

    The first word of the query must be a word of the candidate, so the join
    is on words; numbers join on grams.
    """
    first = F.regexp_extract(normalize_drug_name(F.col("query")), r"(?U)(\w+)", 1)
    # '' stands for queries without any word character.
    words = F.array_distinct(F.flatten(F.array(F.array(F.lit("")), *(
        F.regexp_extract_all(normalize_drug_name(F.col(c)), F.lit(r"(?U)(\w+)"), F.lit(1))
        for c in ("drug_name", "active_ingredient")
    ))))
    q = requests.select("request_id", "query")
    by_word = q.withColumn("_word", first).join(candidates.withColumn("_word", F.explode(words)), "_word").drop("_word")
    squeezed = lambda c: F.regexp_replace(F.lower(text(c)), r"(?U)[\s\-]", "")
    numbered = q.where(squeezed(F.col("query")) != "")
    by_number = substring_join(
        numbered, candidates.where(text(F.col("application_number")) != ""), squeezed(F.col("query")),
        squeezed(F.col("application_number")))
    pairs = by_word.unionByName(by_number.select(*by_word.columns))
    exact = product_match(F.col("query"), F.col("drug_name"), F.col("active_ingredient"), F.col("application_number"))
    return pairs.where(exact).distinct()


def score_candidates(pairs: DataFrame) -> DataFrame:
    """Candidate rows of dated requests with ``score`` and ``date_matches``.

    pairs: request_id, product, generic, ingredients, start_ts, end_ts and the
    candidate's ordinal, drug_name, active_ingredient, source_date,
    database_updated. Where a request has date matches only those stay.
    """
    terms = F.filter(
        F.transform(
            F.concat(F.split(text(F.col("ingredients")), SEPARATORS), F.array(text(F.col("generic")), text(F.col("product")))),
            strip_drug_salts,
        ), lambda t: t != "")
    parts = F.transform(
        F.filter(F.split(text(F.col("active_ingredient")), SEPARATORS), lambda p: strip(p) != ""), strip_drug_salts)
    d = pairs.withColumn("_terms", terms).withColumn("_parts", parts)
    single = F.size("_parts") == 1

    def term_score(t: Column) -> Column:
        return (
            F.when(single & (F.get("_parts", F.lit(0)) == t), 100).when(F.array_contains("_parts", t), 35)
            .when(F.exists("_parts", lambda p: F.contains(p, t)), 20).otherwise(0)
        )

    ingredient_score = F.coalesce(F.array_max(F.transform("_terms", term_score)), F.lit(0))
    name, product = F.lower(strip(text(F.col("drug_name")))), F.lower(strip(text(F.col("product"))))
    name_score = F.when((text(F.col("product")) != "") & (name == product), 100).when(
        (text(F.col("product")) != "") & F.contains(name, product), 50).otherwise(0)
    start, end = F.col("start_ts"), F.col("end_ts")
    dated = start.isNotNull() | end.isNotNull()

    def within(ts: Column, low: Column, high: Column) -> Column:
        return F.coalesce(ts.isNotNull() & in_range(ts, low, high), F.lit(False))

    alt_start, alt_end = transpose_day_month(start), transpose_day_month(end)
    has_alt = alt_start.isNotNull() | alt_end.isNotNull()
    matches = F.lit(False)
    for c in ("source_date", "database_updated"):
        matches = matches | within(F.col(c), start, end) | (has_alt & within(F.col(c), alt_start, alt_end))
    date_score = F.when(~dated, 0).when(matches, 200).otherwise(-100)
    # Scores cost far more than a table of them: they are written once.
    scored = cut_lineage(d.withColumn("date_matches", ~dated | matches).withColumn(
        "score", (ingredient_score + name_score + date_score).cast("int")
    ).withColumn("_dated", dated).drop("_terms", "_parts"))
    any_match = scored.groupBy("request_id").agg(F.bool_or("date_matches").alias("_any"))
    return scored.join(any_match, "request_id").where(
        ~F.col("_dated") | ~F.col("_any") | F.col("date_matches")
    ).drop("_dated", "_any")


def rank_candidates(candidates: DataFrame, query: str | None = None, top: int | None = None) -> DataFrame:
    """Candidates of each request with their ``rank``, one per application, best
    first; with ``top`` only so many of each request.

    candidates: request_id, query, ordinal and the candidate's columns. With
    ``query`` all rows belong to that one request.
    """
    d = candidates if query is None else candidates.withColumns({"request_id": F.lit(0), "query": F.lit(query)})
    q = F.lower(strip(F.col("query")))
    ingredient, name = F.lower(strip(text(F.col("active_ingredient")))), F.lower(strip(text(F.col("drug_name"))))
    rank = F.struct(
        _flag((name == q) | (ingredient == q)).alias("a"), _flag(ingredient == q).alias("b"),
        _flag(~ingredient.contains(";")).alias("c"), F.col("ordinal"),
    )
    app = F.coalesce(F.nullif("application_number", F.lit("")), F.col("drug_name"))
    unique = pick(d.withColumn("_app", app).withColumn("_rank", rank), ["request_id", "_app"], F.col("_rank"), largest=False)
    return _ranks(unique, [F.col("_rank")], top).drop("_rank", "_app")


def _ranks(rows: DataFrame, order: list[Column], top: int | None) -> DataFrame:
    """Ranks per request of all rows, or of as many as the caller asks for."""
    return ranking.ranked(rows, ["request_id"], order) if top is None else ranking.top(rows, ["request_id"], order, top)


def rank_site_results(results: DataFrame, query: str | None = None, top: int | None = None) -> DataFrame:
    """Results of each request with their ``rank``: title hits first, then the
    newest. results: request_id, query, title, source_date, ordinal; with
    ``query`` all rows belong to that one request."""
    d = results if query is None else results.withColumns({"request_id": F.lit(0), "query": F.lit(query)})
    hit = F.contains(F.lower("title"), F.lower("query")).cast("int")
    order = [F.desc("_hit"), F.desc_nulls_last("source_date"), F.asc("ordinal")]
    return _ranks(d.withColumn("_hit", hit), order, top).drop("_hit")


def first_drug_with_changes(ranked: DataFrame, changes: DataFrame) -> DataFrame:
    """Per request the first ranked drug with a change in range, else the first
    ranked drug. ranked: request_id, drug_id, rank, start_ts, end_ts."""
    in_bounds = ranked.join(changes.select("drug_id", "source_date"), "drug_id").where(
        in_range(F.col("source_date"), F.col("start_ts"), F.col("end_ts"))
    ).groupBy("request_id", "drug_id").agg(F.count(F.lit(1)).alias("n_changes"))
    d = ranked.join(in_bounds, ["request_id", "drug_id"], "left")
    none = F.col("n_changes").isNull().cast("int")
    best = d.groupBy("request_id").agg(
        F.min_by(F.struct("drug_id", F.coalesce("n_changes", F.lit(0)).alias("n_changes")),
                 F.struct(none.alias("none"), F.col("rank"))).alias("_b")
    )
    return best.select("request_id", "_b.drug_id", "_b.n_changes")


def transposed_retry(requests: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes of a request's drug in its range; where there are none, in the
    range with day and month swapped. requests: request_id, drug_id,
    start_ts, end_ts."""
    start, end = F.col("start_ts"), F.col("end_ts")
    alt_start, alt_end = transpose_day_month(start), transpose_day_month(end)
    can_swap = alt_start.isNotNull() | alt_end.isNotNull()
    d = requests.join(changes.select("drug_id", "id", "source_date"), "drug_id").withColumn(
        "attempt",
        F.when(in_range(F.col("source_date"), start, end), 1).when(
            can_swap & in_range(F.col("source_date"), F.coalesce(alt_start, start), F.coalesce(alt_end, end)), 2),
    ).where(F.col("attempt").isNotNull())
    # A row inside both ranges belongs to the second attempt as well, which
    # only counts when the first attempt found nothing.
    first = d.groupBy("request_id").agg(F.min("attempt").alias("_best"))
    return d.join(first, "request_id").where(F.col("attempt") == F.col("_best")).drop("_best")


def drug_summary(drugs: DataFrame, changes: DataFrame) -> DataFrame:
    """Drugs with their change count and the newest change's verification."""
    counts = changes.groupBy("drug_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by("last_verified_at", F.struct(F.col("source_date").isNull().alias("undated"),
                                              (-F.unix_micros(F.col("source_date").cast("timestamp"))).alias("d"), F.col("id"))).alias("_v"),
    )
    d = drugs.join(counts, drugs.id == counts.drug_id, "left")
    return d.select(
        drugs.id.alias("drug_id"), "display_name", F.coalesce("_n", F.lit(0)).alias("safety_change_count"),
        F.coalesce("_v", "updated_at", "created_at").alias("last_verified_at"),
    )


def unified_response(documents: DataFrame, website: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """One row per request from both branches; either may be missing.
    ``requests`` (request_id, request) is echoed beside the answer."""
    d = documents.select("request_id", F.col("payload").alias("document_payload"))
    w = website.select("request_id", F.col("payload").alias("website_payload"))
    joined = d.join(w, "request_id", "full_outer")

    def status(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), "success").otherwise("not_found")

    both_missing = F.col("document_payload").isNull() & F.col("website_payload").isNull()
    answer = joined.select(
        "request_id", status("document_payload").alias("document_status"), "document_payload",
        status("website_payload").alias("website_status"), "website_payload",
        F.when(both_missing, "error").otherwise("success").alias("status"),
    )
    return answer if requests is None else answer.join(requests.select("request_id", "request"), "request_id", "left")
