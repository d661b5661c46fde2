"""Labelling changes, search, lookup and export queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilake.functions.dates import in_range
from vigilake.functions.sections import is_whitelisted
from vigilake.operators import changes as ops, lookup
from vigilake.operators.skew import cut_lineage
from vigilake.plans import label_tables as t
from vigilake.plans.registry import query, table
from vigilake.sources import exports


@query("PR1", """SELECT p_partkey, upper(p_name) AS display_name, p_name AS normalized_name, lower(p_type) AS active_ingredient,
 'Adverse Reactions' AS section, p_name || ' ' || p_type AS updated_text, '' AS original_text, '' AS fda_comment FROM part""")
def normalized_record(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "part").selectExpr(
        "upper(p_name) AS drug_name", "concat(' ', p_type) AS active_ingredient", "'6. adverse events' AS section",
        r"concat(p_name, '\n ', p_type) AS updated_text", "CAST(p_partkey AS STRING) AS source_record_id",
    )
    return ops.normalized_record(raw).select(
        F.col("source_record_id").cast("long").alias("p_partkey"), "display_name", "normalized_name",
        "active_ingredient", "section", "updated_text", "original_text", "fda_comment",
    )


@query("C1", f"""WITH {t.SQL_DRUGS} SELECT normalized_name, source, arg_min(display_name, id) AS display_name,
 arg_min(active_ingredient, id) FILTER (active_ingredient <> '') AS active_ingredient,
 arg_min(application_number, id) FILTER (application_number IS NOT NULL) AS application_number FROM dr GROUP BY ALL""")
def upsert_drugs(spark: SparkSession, sf: str) -> DataFrame:
    """The table loaded twice: keys stay unique, gaps are filled once."""
    batch = t.drugs(spark, sf).withColumnRenamed("id", "seq")
    none = batch.select(
        "normalized_name", "source", "display_name", "active_ingredient", "application_number").limit(0)
    once = ops.upsert_drugs(none, batch).drop("touched")
    return ops.upsert_drugs(once, batch).drop("touched")


def _applied(spark: SparkSession, sf: str):
    batch = ops.prepare_changes(t.batch(spark, sf))
    current = spark.createDataFrame([], ops.CHANGES_SCHEMA)
    versions = spark.createDataFrame([], ops.VERSIONS_SCHEMA)
    early = F.col("verified_at") < F.lit("2024-01-16").cast("timestamp_ntz")
    current, versions, _ = ops.apply_changes(current, versions, batch.where(early))
    # The tables are written between two crawls.
    current, versions = cut_lineage(current), cut_lineage(versions)
    return ops.apply_changes(current, versions, batch.where(~early))


@query("C2 C3 F16", f"""WITH {t.SQL_BATCH} SELECT drug_id, section, source_record_id, st_orig AS original_text, updated_text,
 sha256(display_name || '|None|' || section || '|2024-01-01 00:00:00|' || original_text || '|' || updated_text || '|None') AS content_hash,
 strftime(verified, '%Y-%m-%d %H:%M:%S.%f') AS last_verified_at, strftime(seen, '%Y-%m-%d %H:%M:%S.%f') AS first_seen_at
FROM eff JOIN (SELECT drug_id, section, source_record_id, max(ts) AS verified, min(ts) AS seen FROM b GROUP BY ALL) USING (drug_id, section, source_record_id)
QUALIFY row_number() OVER (PARTITION BY drug_id, section, source_record_id ORDER BY seq DESC) = 1""")
def apply_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches folded into the change table, many rows per key."""
    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return _applied(spark, sf)[0].select(
        "drug_id", "section", "source_record_id", "original_text", "updated_text", "content_hash",
        F.date_format("last_verified_at", stamp).alias("last_verified_at"),
        F.date_format("first_seen_at", stamp).alias("first_seen_at"),
    )


@query("C2 C4 O5", f"""WITH {t.SQL_BATCH} SELECT drug_id, section, source_record_id, version_number, original_text, updated_text,
 section || ': ' || updated_text AS normalized_content FROM vers WHERE n > 1""")
def version_history(spark: SparkSession, sf: str) -> DataFrame:
    """Archived contents, numbered on from the versions that were there."""
    return ops.version_history(_applied(spark, sf)[1]).drop("content_hash")


@query("C3 G14", f"""WITH {t.SQL_BATCH} SELECT strftime(ts, '%Y-%m-%d') AS run_id, count(DISTINCT seq % 13) AS pages_crawled, count(*) AS records_found,
 count(*) FILTER (action = 'NEW') AS records_added, count(*) FILTER (action = 'CHANGED') AS records_changed,
 count(*) FILTER (action = 'UNCHANGED') AS records_unchanged FROM acts GROUP BY ALL""")
def crawl_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Rows found, added, changed and unchanged per day of crawling."""
    batch = ops.prepare_changes(t.batch(spark, sf))
    actions = ops.classify_changes(spark.createDataFrame([], ops.CHANGES_SCHEMA), batch)
    return ops.crawl_counters(actions.withColumn("run_id", F.date_format("verified_at", "yyyy-MM-dd")))


@query("L5", f"""WITH {t.SQL_BATCH} SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS run_id FROM b ORDER BY 1 DESC LIMIT 10""")
def recent_runs(spark: SparkSession, sf: str) -> DataFrame:
    batch = ops.prepare_changes(t.batch(spark, sf))
    return batch.select(F.date_format("verified_at", "yyyy-MM-dd").alias("run_id")).distinct().orderBy(
        F.desc("run_id")).limit(10)


@query("P3 P4 O4", f"""WITH {t.SQL_CHANGES} SELECT drug_id, id, strftime(source_date, '%Y-%m-%d %H:%M:%S') AS at FROM ch
WHERE allowed AND source_date BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 23:59:59.999999'""")
def changes_in_range(spark: SparkSession, sf: str) -> DataFrame:
    start = F.lit("2024-01-05").cast("timestamp_ntz")
    end = F.lit("2024-01-20 23:59:59.999999").cast("timestamp_ntz")
    found = t.changes(spark, sf).where(
        in_range(F.col("source_date"), start, end) & is_whitelisted(F.col("section"), F.col("updated_text")))
    return ops.newest_first(found).select("drug_id", "id", F.date_format("source_date", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("W1", f"""WITH {t.SQL_CHANGES} SELECT drug_id, id FROM ch WHERE source_date IS NOT NULL
QUALIFY CAST(source_date AS DATE) = max(CAST(source_date AS DATE)) OVER (PARTITION BY drug_id)""")
def latest_date_records(spark: SparkSession, sf: str) -> DataFrame:
    return ops.latest_date_records(t.changes(spark, sf)).select("drug_id", "id")


@query("W2 F20", f"""WITH {t.SQL_CHANGES}, ar AS (SELECT * FROM ch WHERE event_type = 'click' AND source_date IS NOT NULL)
SELECT drug_id, id, source_record_id AS supplement_id, strftime(source_date, '%Y-%m-%d %H:%M:%S') AS at,
 'Postmarketing Experience' || chr(10) || chr(10) || repeat('note ', k % 5) || 'k=' || k
  || CASE WHEN bullets THEN chr(10) || chr(10) || '• Skin: rash & <u class="x">itch</u>' || chr(10) || chr(10) || '- second' ELSE '' END AS adverse_reactions_text,
 count(*) OVER (PARTITION BY drug_id) AS dates_evaluated
FROM ar QUALIFY source_date = max(source_date) OVER (PARTITION BY drug_id)""")
def latest_adverse_reactions(spark: SparkSession, sf: str) -> DataFrame:
    return ops.latest_with_section(t.changes(spark, sf)).select(
        "drug_id", "id", "supplement_id", F.date_format("source_date", "yyyy-MM-dd HH:mm:ss").alias("at"),
        "adverse_reactions_text", "dates_evaluated",
    )


@query("W4", f"""WITH {t.SQL_CHANGES} SELECT drug_id, section, id FROM ch
QUALIFY row_number() OVER (PARTITION BY drug_id, section ORDER BY length(updated_text) DESC, id) = 1""")
def longest_per_section(spark: SparkSession, sf: str) -> DataFrame:
    return ops.longest_per_section(t.changes(spark, sf), ["drug_id"], "id").select("drug_id", "section", "id")


@query("W7 G16", f"""WITH {t.SQL_CHANGES}, l AS (SELECT * FROM ch WHERE source_date IS NOT NULL
  QUALIFY CAST(source_date AS DATE) = max(CAST(source_date AS DATE)) OVER (PARTITION BY drug_id))
SELECT drug_id, CASE WHEN bool_or(event_type = 'click') THEN 'FOUND' ELSE n END AS adverse,
 CASE WHEN bool_or(event_type = 'view') THEN 'FOUND' ELSE n END AS warnings,
 CASE WHEN bool_or(event_type = 'signup') THEN 'FOUND' ELSE n END AS populations
FROM l CROSS JOIN (VALUES ('NOT FOUND IN THE LATEST APPLICABLE FDA LABELING UPDATE')) v(n) GROUP BY drug_id, n""")
def date_first_sections(spark: SparkSession, sf: str) -> DataFrame:
    return ops.sections_by_kind(ops.latest_date_records(t.changes(spark, sf)), ["drug_id"])


@query("W7 G16", f"""WITH {t.SQL_CHANGES}, l AS (SELECT * FROM ch WHERE source_date IS NOT NULL
  QUALIFY CAST(source_date AS DATE) = max(CAST(source_date AS DATE)) OVER (PARTITION BY drug_id)),
k AS (SELECT * FROM (VALUES ('click', 'adverse'), ('view', 'warnings'), ('signup', 'populations')) v(event_type, kind))
SELECT drug_id, kind, id, updated_text FROM l JOIN k USING (event_type)
UNION ALL SELECT drug_id, kind, NULL, 'NOT FOUND IN THE LATEST APPLICABLE FDA LABELING UPDATE'
FROM (SELECT DISTINCT drug_id FROM l) CROSS JOIN k
WHERE (drug_id, event_type) NOT IN (SELECT (drug_id, event_type) FROM l)""")
def date_first_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of each section kind on the latest date, in order of ``id``."""
    return ops.section_texts(ops.latest_date_records(t.changes(spark, sf)), ["drug_id"])


@query("G15", f"""WITH {t.SQL_CHANGES}, f AS (SELECT drug_id, source_record_id AS s, min(id) AS i FROM ch GROUP BY ALL)
SELECT drug_id, string_agg(s, ', ' ORDER BY i) AS supplement_number FROM f GROUP BY ALL""")
def supplement_ids(spark: SparkSession, sf: str) -> DataFrame:
    records = t.changes(spark, sf).withColumnRenamed("source_record_id", "supplement_id")
    return ops.supplement_ids(records, ["drug_id"], "id")


@query("W20", f"""WITH {t.SQL_CHANGES}, {t.SQL_DRUGS}, j AS (
  SELECT ch.*, CAST(source_date AS DATE) AS day, coalesce(application_number, '') AS app FROM ch JOIN dr ON dr.id = ch.drug_id)
SELECT drug_id, strftime(day, '%Y-%m-%d') AS day,
 coalesce(arg_min(source_record_id, id) FILTER (contains(app, source_record_id)), max(source_record_id)) AS supplement,
 arg_min(source_url, id) FILTER (contains(source_url, '.pdf')) AS pdf_url, count(*) AS n_changes,
 count(DISTINCT updated_text) FILTER (event_type = 'click') AS adverse_bodies,
 count(DISTINCT updated_text) FILTER (event_type = 'view') AS warning_bodies,
 count(DISTINCT updated_text) FILTER (event_type = 'signup') AS population_bodies FROM j GROUP BY drug_id, j.day""")
def change_timeline(spark: SparkSession, sf: str) -> DataFrame:
    timeline = ops.change_timeline(t.changes(spark, sf), t.drugs(spark, sf))
    return timeline.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("U3", f"""WITH {t.SQL_CHANGES} SELECT id FROM ch WHERE source_date >= TIMESTAMP '2024-01-16' AND EXISTS (
  SELECT 1 FROM ch c WHERE c.source_date < TIMESTAMP '2024-01-16' AND c.drug_id = ch.drug_id AND c.section = ch.section
  AND day(c.source_date) + 15 = day(ch.source_date))""")
def duplicate_records(spark: SparkSession, sf: str) -> DataFrame:
    """Same drug, section and shifted day in both halves of the month."""
    d = t.changes(spark, sf).where("source_date IS NOT NULL")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    late = F.col("source_date") >= cut
    shaped = lambda df, day: df.select("id", F.col("drug_id").alias("display_name"), "section", day.alias("source_date"))
    return ops.duplicate_records(
        shaped(d.where(late), F.dayofmonth("source_date")), shaped(d.where(~late), F.dayofmonth("source_date") + 15)
    ).select("id")


@query("P15 T3", f"""WITH {t.SQL_CHANGES} SELECT DISTINCT drug_id FROM ch WHERE last_verified_at >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 7 DAY""")
def fresh_drugs(spark: SparkSession, sf: str) -> DataFrame:
    return ops.fresh_drugs(t.changes(spark, sf), F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))


@query("P16", f"""WITH {t.SQL_CHANGES}, l AS (SELECT drug_id, max(source_date) AS latest FROM ch GROUP BY ALL)
SELECT o_orderkey, l.drug_id IS NULL OR coalesce(TIMESTAMP '2024-01-01' + to_days(CAST(o_orderkey % 31 AS INTEGER)) > latest, FALSE) AS needs_crawl
FROM orders LEFT JOIN l ON l.drug_id = o_custkey""")
def needs_recrawl(spark: SparkSession, sf: str) -> DataFrame:
    candidates = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_custkey AS drug_id",
        "CAST('2024-01-01' AS TIMESTAMP_NTZ) + make_dt_interval(CAST(o_orderkey % 31 AS INT)) AS source_date")
    return ops.needs_recrawl(candidates, t.changes(spark, sf)).select("o_orderkey", "needs_crawl")


@query("P1 O1", f"""WITH {t.SQL_DRUGS} SELECT id, display_name FROM dr WHERE source IN ('FDA_SRLC', 'FDA') AND
 (normalized_name ILIKE '%red_b%' OR active_ingredient ILIKE '%red_b%' OR display_name ILIKE '%red_b%' OR application_number ILIKE '%red_b%')
ORDER BY CASE WHEN lower(display_name) = 'red_b' THEN 0 ELSE 1 END, CASE WHEN normalized_name = 'red_b' THEN 0 ELSE 1 END,
 CASE WHEN lower(trim(active_ingredient)) = 'red_b' THEN 0 ELSE 1 END, CASE WHEN active_ingredient NOT ILIKE '%;%' THEN 0 ELSE 1 END, display_name, id""")
def search_drugs(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked search; ``_`` of the query is a wildcard."""
    found = lookup.search_drugs(t.drugs(spark, sf), "Red_B", source="FDA")
    return found.orderBy(*lookup.search_order("Red_B")).select("id", "display_name")


@query("P2 O1", f"""WITH {t.SQL_DRUGS} SELECT id FROM dr WHERE source = 'FDA_SRLC' AND (display_name ILIKE '%l%' OR active_ingredient ILIKE '%l%')
 AND (active_ingredient ILIKE '%o%' OR display_name ILIKE '%o%') AND active_ingredient ILIKE '%m%' AND active_ingredient ILIKE '%l%'
ORDER BY CASE WHEN lower(trim(active_ingredient)) = 'm' THEN 0 ELSE 1 END, CASE WHEN active_ingredient NOT LIKE '%;%' THEN 0 ELSE 1 END, display_name, id""")
def search_drugs_filtered(spark: SparkSession, sf: str) -> DataFrame:
    found = lookup.search_drugs_filtered(t.drugs(spark, sf), " l ", "o", "m, l;")
    return found.orderBy(*lookup.filtered_order(" l ", "o", "m, l;")).select("id")


@query("L4", """SELECT p_partkey AS id FROM part WHERE p_name || ' ' || p_type ILIKE '%ring s%'
ORDER BY upper(substr(p_name,1,1)) || split_part(substr(p_name,2), ' ', 1) || ' ' || upper(substr(split_part(p_name,' ',2),1,1)) || substr(split_part(p_name,' ',2),2) || ' ' || substr(p_type,1,1) || lower(substr(p_type,2)), p_partkey LIMIT 20""")
def product_autocomplete(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.autocomplete(t.product_sections(spark, sf), "RING S").select("id")


_REQUESTS = """posexplode(array(concat(p_name, ' ', p_type), concat(replace(p_name, ' ', '-'), '  ', p_type, '!'),
  concat(replace(p_name, ' ', '_'), '_', p_type, '_Brand#7.PDF'), concat(substring(p_name, 3), ' ', substring(p_type, 1, 4)),
  concat(substring_index(p_name, ' ', -1), '%', p_type, '_Brand#1'), concat('zz', p_name)))"""


@query("J11", """WITH base AS (SELECT DISTINCT p_name, p_type FROM part),
r AS (SELECT p_name || '|' || p_type || '|' || i AS request_id, trim(q) AS q, trim(regexp_replace(regexp_replace(lower(q), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS n
  FROM (SELECT p_name, p_type, unnest([0, 1, 2, 3, 4, 5]) AS i, unnest([p_name || ' ' || p_type, replace(p_name, ' ', '-') || '  ' || p_type || '!',
    replace(p_name, ' ', '_') || '_' || p_type || '_Brand#7.PDF', substr(p_name, 3) || ' ' || substr(p_type, 1, 4),
    split_part(p_name, ' ', 2) || '%' || p_type || '_Brand#1', 'zz' || p_name]) AS q FROM base)),
s AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type) AS pn, lower(replace(p_name, ' ', '_') || '_' || p_type || '_' || p_brand || '.pdf') AS fn FROM part),
m AS (SELECT request_id, q, id, CASE WHEN pn = lower(q) THEN 1 WHEN pn = n THEN 2 WHEN fn = lower(q) OR fn = lower(q) || '.pdf' THEN 3
    WHEN length(n) >= 3 AND contains(pn, n) THEN 4 WHEN length(q) >= 3 AND fn ILIKE '%' || q || '%' THEN 5 END AS stage FROM r CROSS JOIN s)
SELECT request_id, CAST(arg_min(id, CAST(stage AS BIGINT) * 1000000000 - id) FILTER (stage IS NOT NULL) AS BIGINT) AS record_id, CAST(min(stage) AS INTEGER) AS stage FROM m GROUP BY ALL""")
def product_lookup_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Six spellings of every product looked up at once."""
    requests = table(spark, sf, "part").select("p_name", "p_type").distinct().selectExpr(
        "p_name", "p_type", f"{_REQUESTS} AS (i, query)"
    ).selectExpr("concat_ws('|', p_name, p_type, i) AS request_id", "query")
    return lookup.find_product_records(requests, t.product_sections(spark, sf)).select("request_id", "record_id", "stage")


@query("P7 U4", f"""WITH {t.SQL_DRUGS}, q(request_id, q) AS (VALUES (1, 'bolt'), (2, 'red bolt'), (3, 'olt'), (4, 'brand#3'), (5, '0001'), (6, 'economy'))
SELECT request_id, id FROM q JOIN dr ON regexp_matches(normalized_name, '\\b' || q || '\\b') OR regexp_matches(lower(active_ingredient), '\\b' || q || '\\b')
 OR contains(regexp_replace(lower(application_number), '[\\s\\-]', '', 'g'), q)""")
def matching_candidates(spark: SparkSession, sf: str) -> DataFrame:
    requests = spark.createDataFrame(
        [(1, "Bolt"), (2, "red  bolt"), (3, "olt"), (4, "Brand#3"), (5, "00-01"), (6, "economy")],
        "request_id INT, query STRING")
    candidates = t.drugs(spark, sf).withColumnRenamed("display_name", "drug_name")
    return lookup.matching_candidates(requests, candidates).select("request_id", "id")


_SCORE_SQL = f"""WITH {t.SQL_DRUGS}, p AS (
  SELECT o_orderkey % 5 AS request_id, o_orderkey, d.display_name, d.active_ingredient, o_orderdate AS sd,
    o_orderkey % 5 <> 4 AS dated, CASE WHEN d.active_ingredient = '' THEN 0 WHEN NOT contains(d.active_ingredient, ';') AND lower(d.active_ingredient) = 'small' THEN 100
      WHEN contains(d.active_ingredient, ';') AND (lower(split_part(d.active_ingredient, '; ', 1)) = 'small' OR lower(split_part(d.active_ingredient, '; ', 2)) = 'red bolt') THEN 35
      WHEN contains(lower(d.active_ingredient), 'small') OR contains(lower(split_part(d.active_ingredient, '; ', 2)), 'red bolt') THEN 20 ELSE 0 END AS ing,
    CASE WHEN lower(d.display_name) = 'red bolt' THEN 100 WHEN contains(lower(d.display_name), 'red bolt') THEN 50 ELSE 0 END AS nm,
    o_orderdate BETWEEN TIMESTAMP '1997-03-04' AND TIMESTAMP '1997-06-07 23:59:59' OR o_orderdate BETWEEN TIMESTAMP '1997-04-03' AND TIMESTAMP '1997-07-06 23:59:59' AS hit
  FROM orders JOIN dr d ON d.id = o_custkey)
SELECT CAST(request_id AS BIGINT) AS request_id, o_orderkey, CAST(ing + nm + CASE WHEN NOT dated THEN 0 WHEN hit THEN 200 ELSE -100 END AS INTEGER) AS score, NOT dated OR hit AS date_matches FROM p
QUALIFY NOT dated OR hit OR NOT bool_or(hit) OVER (PARTITION BY request_id)"""


@query("O3 P6", _SCORE_SQL)
def candidate_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Every order's customer number as a dated candidate row of five requests."""
    drugs = t.drugs(spark, sf).selectExpr("id", "display_name AS drug_name", "active_ingredient")
    pairs = table(spark, sf, "orders").join(drugs, F.col("id") == F.col("o_custkey")).selectExpr(
        "o_orderkey % 5 AS request_id", "o_orderkey", "drug_name", "active_ingredient", "o_orderdate AS source_date",
        "CAST(NULL AS TIMESTAMP_NTZ) AS database_updated", "'Red Bolt' AS product", "CAST(NULL AS STRING) AS generic",
        "'Small Sulfate' AS ingredients",
        "CASE WHEN o_orderkey % 5 <> 4 THEN CAST('1997-03-04' AS TIMESTAMP_NTZ) END AS start_ts",
        "CASE WHEN o_orderkey % 5 <> 4 THEN CAST('1997-06-07 23:59:59' AS TIMESTAMP_NTZ) END AS end_ts",
    )
    return lookup.score_candidates(pairs).select("request_id", "o_orderkey", "score", "date_matches")


@query("O7 L3", f"""WITH {t.SQL_DRUGS}, r AS (SELECT *, coalesce(application_number, display_name) AS app,
  CASE WHEN lower(active_ingredient) = 'promo' OR lower(display_name) = 'promo' THEN 0 ELSE 1 END AS a, CASE WHEN lower(active_ingredient) = 'promo' THEN 0 ELSE 1 END AS b,
  CASE WHEN contains(active_ingredient, ';') THEN 1 ELSE 0 END AS c FROM dr),
u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY app ORDER BY a, b, c, id) = 1)
SELECT id FROM u ORDER BY a, b, c, id""")
def candidate_rank(spark: SparkSession, sf: str) -> DataFrame:
    candidates = t.drugs(spark, sf).withColumnRenamed("display_name", "drug_name").withColumn("ordinal", F.col("id"))
    return lookup.rank_candidates(candidates, "Promo").select("id")


@query("O8", """SELECT o_orderkey FROM orders JOIN part ON p_partkey = o_custkey
ORDER BY CAST(contains(p_name, 'bolt') AS INTEGER) DESC, o_orderdate DESC, o_orderkey""")
def site_result_rank(spark: SparkSession, sf: str) -> DataFrame:
    o, p = table(spark, sf, "orders"), table(spark, sf, "part")
    results = o.join(p, o.o_custkey == p.p_partkey).selectExpr(
        "p_name AS title", "o_orderdate AS source_date", "o_orderkey AS ordinal")
    return lookup.rank_site_results(results, "BOLT").select(F.col("ordinal").alias("o_orderkey"))


@query("O7 L3", f"""WITH {t.SQL_DRUGS}, q AS (SELECT DISTINCT p_name AS request_id FROM part UNION SELECT DISTINCT p_type FROM part),
m AS (SELECT q.request_id, dr.*, coalesce(application_number, display_name) AS app,
  CASE WHEN lower(active_ingredient) = lower(request_id) OR lower(display_name) = lower(request_id) THEN 0 ELSE 1 END AS a,
  CASE WHEN lower(active_ingredient) = lower(request_id) THEN 0 ELSE 1 END AS b, CASE WHEN contains(active_ingredient, ';') THEN 1 ELSE 0 END AS c
  FROM q JOIN dr ON regexp_matches(normalized_name, '\\b' || lower(request_id) || '\\b') OR regexp_matches(lower(active_ingredient), '\\b' || lower(request_id) || '\\b')),
u AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY request_id, app ORDER BY a, b, c, id) = 1)
SELECT request_id, id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY a, b, c, id) AS INTEGER) AS rank FROM u QUALIFY rank <= 10""")
def candidate_rank_per_request(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best candidates of every product name and type asked for."""
    part = table(spark, sf, "part")
    requests = part.select(F.col("p_name").alias("request_id")).union(part.select("p_type")).distinct().withColumn("query", F.col("request_id"))
    candidates = t.drugs(spark, sf).withColumnRenamed("display_name", "drug_name").withColumn("ordinal", F.col("id"))
    return lookup.rank_candidates(lookup.matching_candidates(requests, candidates), top=10).select("request_id", "id", "rank")


_SITE_SQL = """WITH q AS (SELECT p_type AS request_id, min(split_part(p_name, ' ', 2)) AS query FROM part GROUP BY ALL),
r AS (SELECT request_id, o_orderkey, row_number() OVER (PARTITION BY request_id
    ORDER BY CAST(contains(lower(p_name), lower(query)) AS INTEGER) DESC, o_orderdate DESC NULLS LAST, o_orderkey) AS rank
  FROM orders JOIN part ON p_partkey = o_custkey JOIN q ON request_id = p_type)"""


def _site_results(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a search result of the type of its customer's number."""
    o, p = table(spark, sf, "orders"), table(spark, sf, "part")
    requests = p.groupBy(F.col("p_type").alias("request_id")).agg(F.min(F.expr("split_part(p_name, ' ', 2)")).alias("query"))
    results = o.join(p, o.o_custkey == p.p_partkey).selectExpr(
        "p_type AS request_id", "p_name AS title", "o_orderdate AS source_date", "o_orderkey AS ordinal")
    return results.join(requests, "request_id")


@query("O8 L3", f"{_SITE_SQL} SELECT request_id, o_orderkey, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20")
def site_rank_per_request(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty best results of every request."""
    return lookup.rank_site_results(_site_results(spark, sf), top=20).select("request_id", F.col("ordinal").alias("o_orderkey"), "rank")


@query("O8", f"{_SITE_SQL} SELECT * FROM r")
def site_result_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """All results of every request with their ranks."""
    return lookup.rank_site_results(_site_results(spark, sf)).select("request_id", F.col("ordinal").alias("o_orderkey"), "rank")


_RANKED_SQL = f"""{t.SQL_CHANGES}, r AS (
  SELECT o_custkey % 40 AS request_id, o_orderkey % 200 AS drug_id, min(o_orderkey) AS rank FROM orders GROUP BY ALL),
n AS (SELECT r.*, count(ch.id) AS n FROM r LEFT JOIN ch ON ch.drug_id = r.drug_id AND source_date BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-11 23:59:59' GROUP BY ALL)"""


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(
        F.expr("o_custkey % 40").alias("request_id"), F.expr("o_orderkey % 200").alias("drug_id")
    ).agg(F.min("o_orderkey").alias("rank")).select(
        "*", F.lit("2024-01-10").cast("timestamp_ntz").alias("start_ts"),
        F.lit("2024-01-11 23:59:59").cast("timestamp_ntz").alias("end_ts"),
    )


@query("J13", f"""WITH {_RANKED_SQL} SELECT request_id, arg_min(drug_id, (n = 0, rank)) AS drug_id, CAST(arg_min(n, (n = 0, rank)) AS BIGINT) AS n_changes FROM n GROUP BY ALL""")
def first_drug_with_changes(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.first_drug_with_changes(_ranked(spark, sf), t.changes(spark, sf))


@query("P6 P3", f"""WITH {t.SQL_CHANGES}, q AS (SELECT DISTINCT o_custkey AS request_id, o_custkey AS drug_id,
  make_timestamp(2024, 1, CAST(5 + o_custkey % 9 AS INTEGER), 0, 0, 0) AS s, make_timestamp(2024, CAST(1 + (o_custkey % 2) * 4 AS INTEGER), CAST(1 + o_custkey % 9 AS INTEGER), 23, 59, 59) AS e FROM orders),
a AS (SELECT *, make_timestamp(2024, day(s), month(s), 0, 0, 0) AS s2, make_timestamp(2024, day(e), month(e), 23, 59, 59) AS e2 FROM q WHERE day(s) <= 12 OR day(e) <= 12),
x AS (SELECT request_id, id, 1 AS attempt FROM q JOIN ch USING (drug_id) WHERE source_date BETWEEN s AND e
  UNION ALL SELECT request_id, id, 2 FROM (SELECT request_id, drug_id, CASE WHEN day(s) <= 12 THEN s2 ELSE s END AS s3, CASE WHEN day(e) <= 12 THEN e2 ELSE e END AS e3 FROM
     (SELECT q.*, CASE WHEN day(q.s) <= 12 THEN make_timestamp(2024, day(q.s), 1, 0, 0, 0) END AS s2, CASE WHEN day(q.e) <= 12 THEN make_timestamp(2024, day(q.e), month(q.e), 23, 59, 59) END AS e2 FROM q)) JOIN ch USING (drug_id) WHERE source_date BETWEEN s3 AND e3)
SELECT request_id, id, CAST(attempt AS INTEGER) AS attempt FROM x QUALIFY attempt = min(attempt) OVER (PARTITION BY request_id)""")
def transposed_retry(spark: SparkSession, sf: str) -> DataFrame:
    requests = table(spark, sf, "orders").select("o_custkey").distinct().selectExpr(
        "o_custkey AS request_id", "o_custkey AS drug_id",
        "make_timestamp_ntz(2024, 1, CAST(5 + o_custkey % 9 AS INT), 0, 0, 0) AS start_ts",
        "make_timestamp_ntz(2024, CAST(1 + (o_custkey % 2) * 4 AS INT), CAST(1 + o_custkey % 9 AS INT), 23, 59, 59) AS end_ts",
    )
    return lookup.transposed_retry(requests, t.changes(spark, sf)).select("request_id", "id", "attempt")


@query("J12", f"""WITH {t.SQL_CHANGES}, {t.SQL_DRUGS}, c AS (SELECT drug_id, count(*) AS n, arg_min(last_verified_at, (source_date IS NULL, -epoch_us(source_date), id)) AS v FROM ch GROUP BY ALL)
SELECT dr.id AS drug_id, display_name, coalesce(n, 0) AS safety_change_count, strftime(coalesce(v, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M:%S') AS last_verified_at FROM dr LEFT JOIN c ON c.drug_id = dr.id""")
def drug_search_summary(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.drug_summary(t.drugs(spark, sf), t.changes(spark, sf)).withColumn(
        "last_verified_at", F.date_format("last_verified_at", "yyyy-MM-dd HH:mm:ss"))


@query("J17 PR10 X4 X5", f"""WITH {t.SQL_CHANGES}, {t.SQL_DRUGS}, w AS (SELECT drug_id AS request_id, count(*) AS n FROM ch GROUP BY ALL),
d AS (SELECT id AS request_id, normalized_name, source FROM dr WHERE source <> 'TGA')
SELECT request_id, CASE WHEN d.request_id IS NULL THEN 'not_found' ELSE 'success' END AS document_status,
 normalized_name AS document_payload, CASE WHEN w.request_id IS NULL THEN 'not_found' ELSE 'success' END AS website_status,
 '{{"website_Name":"FDA_details","changes":' || n || ',"coverage":"complete"}}' AS website_payload, 'success' AS status,
 '{{"drug_id":' || dr.id || ',"drug_name":"' || display_name || '","source":"' || dr.s || '"}}' AS request
FROM d FULL JOIN w USING (request_id) LEFT JOIN (SELECT id, display_name, source AS s FROM dr) dr ON dr.id = request_id""")
def unified_response(spark: SparkSession, sf: str) -> DataFrame:
    """Both branches of a client request as one row with a JSON payload."""
    from vigilake.functions.classify import coverage, website_name

    documents = t.drugs(spark, sf).where("source <> 'TGA'").selectExpr("id AS request_id", "normalized_name AS payload")
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    item = F.to_json(F.struct(
        website_name(F.lit("FDA_SRLC")).alias("website_Name"), F.col("n").alias("changes"),
        coverage(start, start)["coverage"].alias("coverage")))
    website = t.changes(spark, sf).groupBy(F.col("drug_id").alias("request_id")).agg(F.count(F.lit(1)).alias("n")).select(
        "request_id", item.alias("payload"))
    requests = t.drugs(spark, sf).select(
        F.col("id").alias("request_id"),
        F.to_json(F.struct(F.col("id").alias("drug_id"), F.col("display_name").alias("drug_name"), "source")).alias("request"))
    return lookup.unified_response(documents, website, requests)


_LATEST = f"""{t.SQL_CHANGES}, {t.SQL_DRUGS}, al AS (SELECT * FROM ch WHERE allowed),
lat AS (SELECT * FROM al QUALIFY coalesce(CAST(source_date AS DATE) = max(CAST(source_date AS DATE)) OVER (PARTITION BY drug_id),
   max(CAST(source_date AS DATE)) OVER (PARTITION BY drug_id) IS NULL))"""


@query("K1 O2 W1", f"""WITH {_LATEST} SELECT drug_id, CASE event_type WHEN 'view' THEN 5 WHEN 'click' THEN 6 ELSE 8 END::INTEGER AS section_order, lat.id,
 display_name AS "Drug Name", active_ingredient AS "Active Ingredient", coalesce(application_number, '') AS "Application Number",
 coalesce(strftime(source_date, '%Y-%m-%d'), '') AS "Supplement Date", source_record_id AS "Supplement ID", section AS "Labeling Section", 'Labeling Revision' AS "Change Type",
 updated_text AS "Updated Text", original_text AS "Original Text", source_url AS "FDA Comment / PDF URL", content_hash AS "Content Hash (SHA-256)",
 strftime(last_verified_at, '%Y-%m-%d %H:%M:%S') AS "Last Verified Date" FROM lat JOIN dr ON dr.id = drug_id""")
def export_changes_csv(spark: SparkSession, sf: str) -> DataFrame:
    return exports.changes_csv(t.drugs(spark, sf), t.changes(spark, sf))


_ITEM = """repeat('note ', k % 5) || 'k=' || k || CASE WHEN bullets THEN chr(10) || '• Skin: rash & itch' || chr(10) || '- second' ELSE '' END"""


@query("K2 W4", f"""WITH {_LATEST}, lg AS (SELECT * FROM lat QUALIFY row_number() OVER (PARTITION BY drug_id, section ORDER BY length(updated_text) DESC, id) = 1),
items AS (SELECT drug_id, count(*) AS n, string_agg('{{"id":' || id || ',"section":"' || section || '","source_record_id":"' || source_record_id || '","source_date":' ||
  coalesce('"' || strftime(source_date, '%Y-%m-%d') || '"', 'null') || ',"change_type":"Labeling Revision","updated_text":"' ||
  replace(CASE event_type WHEN 'signup' THEN '8.1 Pregnancy' || chr(10) WHEN 'click' THEN '6.1 Postmarketing Experience' || chr(10) ELSE '' END || {_ITEM}, chr(10), '\\n') ||
  '","original_text":' || CASE WHEN original_text = '' THEN 'null' ELSE '"before"' END || ',"content_hash":"' || content_hash || '"}}', ',' ORDER BY section) AS l FROM lg GROUP BY ALL)
SELECT drug_id, CAST(n AS INTEGER) AS total, '{{"drug":{{"id":' || drug_id || ',"display_name":"' || display_name || '","active_ingredient":"' || active_ingredient || '","application_number":'
 || coalesce('"' || application_number || '"', 'null') || ',"source":"' || source || '"}},"total_safety_changes":' || n || ',"safety_changes":[' || l || ']}}' AS json
FROM items JOIN dr ON dr.id = drug_id""")
def export_changes_json(spark: SparkSession, sf: str) -> DataFrame:
    return exports.changes_json(t.drugs(spark, sf), t.changes(spark, sf))


_BODY = """CASE event_type WHEN 'signup' THEN '<h3>Pregnancy</h3>' || chr(10) WHEN 'click' THEN '<h3>Postmarketing Experience</h3>' || chr(10) ELSE '' END
 || '<p>' || repeat('note ', k % 5) || 'k=' || k || '</p>'
 || CASE WHEN bullets THEN chr(10) || '<ul><li><strong>Skin:</strong> rash &amp; <u>itch</u></li><li>second</li></ul>' ELSE '' END"""
_HTML_SQL = """SELECT drug_id, strftime(day, '%Y-%m-%d') AS day, CASE event_type WHEN 'view' THEN 6 WHEN 'click' THEN 7 ELSE 9 END::INTEGER AS section_order,
 '<{tag}>' || CASE event_type WHEN 'view' THEN 'Warnings and Precautions' WHEN 'click' THEN 'Adverse Reactions' ELSE 'Use in Specific Populations' END || '</{tag}>' || chr(10) || {body} AS fragment FROM lg JOIN dr ON dr.id = drug_id
UNION ALL SELECT DISTINCT drug_id, strftime(day, '%Y-%m-%d'), 0, CASE WHEN day IS NULL THEN '<p>The ' ELSE '<p>On ' || strftime(day, '%d-%b-%Y') || ', the ' END
 || 'United States Food and Drug Administration Center for Drug Evaluation and Research approved the following safety labeling changes for '
 || display_name || CASE WHEN active_ingredient = '' THEN ' (' ELSE ' (' || lower(active_ingredient) || '; ' END || '<em>Additions underlined</em>):</p>' FROM lg JOIN dr ON dr.id = drug_id
UNION ALL SELECT id, NULL, 0, '<p>No data is present on adverse reaction or safety changes.</p>' FROM dr WHERE id NOT IN (SELECT drug_id FROM lg)"""


def _named(drugs: DataFrame) -> DataFrame:
    return drugs.withColumn("display_name", F.concat(F.col("display_name"), F.lit(" x")))


@query("K3 F22 F25", "WITH " + _LATEST.replace("upper(p_name) || ' ' || p_brand AS", "upper(p_name) || ' ' || p_brand || ' x' AS")
       + """, lg AS (SELECT *, CAST(source_date AS DATE) AS day FROM lat
QUALIFY row_number() OVER (PARTITION BY drug_id, CAST(source_date AS DATE), section ORDER BY length(updated_text) DESC, id) = 1) """
       + _HTML_SQL.format(tag="h2", body=_BODY))
def export_changes_html(spark: SparkSession, sf: str) -> DataFrame:
    """Latest date of every drug as HTML fragments."""
    return exports.changes_html(_named(t.drugs(spark, sf)), t.changes(spark, sf)).select(
        "drug_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "section_order", "fragment")


@query("K3", "WITH " + _LATEST.replace("upper(p_name) || ' ' || p_brand AS", "upper(p_name) || ' ' || p_brand || ' x' AS")
       + """, lg AS (SELECT *, CAST(source_date AS DATE) AS day FROM al
QUALIFY row_number() OVER (PARTITION BY drug_id, CAST(source_date AS DATE), section ORDER BY length(updated_text) DESC, id) = 1) """
       + _HTML_SQL.format(tag="h4", body=_BODY))
def export_changes_html_all_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Every date of every drug, newest first."""
    return exports.changes_html(_named(t.drugs(spark, sf)), t.changes(spark, sf), latest_only=False).select(
        "drug_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "section_order", "fragment")
