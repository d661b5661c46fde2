"""Drug and labelling-change tables derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilake.plans.registry import table

# Section header per event type, and the standard name it normalizes to.
HEADERS = {
    "view": "5 Warnings and Precautions", "click": "6 ADVERSE REACTIONS", "signup": "8 Use in Specific Populations",
    "purchase": "17 Patient Counseling Information", "error": "7 Drug Interactions",
}


def _case(subject: str, values: dict[str, str]) -> str:
    return f"CASE {subject} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


SECTION = _case("event_type", HEADERS)
STANDARD = _case("event_type", {
    "view": "Warnings and Precautions", "click": "Adverse Reactions", "signup": "Use in Specific Populations",
    "purchase": "Patient Counseling Information", "error": "Drug Interactions"})


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """One change per event; sections 5, 6, 8, 17 and 7 by event type."""
    return table(spark, sf, "events").selectExpr(
        "event_id AS id", "user_id AS drug_id", f"{SECTION} AS section",
        "concat('SUPPL-', event_id % 7) AS source_record_id", "'Labeling Revision' AS change_type",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS source_date",
        r"""concat(CASE event_type WHEN 'signup' THEN '8.1 Pregnancy\n' WHEN 'click' THEN '6.1 Postmarketing Experience\n'
             ELSE '' END, repeat('note ', CAST(get_json_object(props, '$.k') AS INT) % 5), 'k=', get_json_object(props, '$.k'),
             CASE WHEN event_id % 5 = 0 THEN '\n• Skin: rash & <u class="x">itch</u>\n- second' ELSE '' END) AS updated_text""",
        "CASE WHEN event_id % 2 = 0 THEN '' ELSE 'before' END AS original_text", "CAST(NULL AS STRING) AS fda_comment",
        "CASE WHEN event_id % 3 = 0 THEN concat('https://x/', event_id, '.pdf') ELSE 'https://x/' END AS source_url",
        "sha2(props, 256) AS content_hash", "ts + INTERVAL 1 DAY AS last_verified_at", "'FDA_SRLC' AS source",
    )


SQL_CHANGES = f"""
ch AS (
  SELECT event_id AS id, user_id AS drug_id, event_type, {SECTION} AS section, 'SUPPL-' || (event_id % 7) AS source_record_id,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS source_date, ts,
         CAST(regexp_extract(props, '\\d+') AS INTEGER) AS k, event_id % 5 = 0 AS bullets,
         CASE event_type WHEN 'signup' THEN '8.1 Pregnancy' || chr(10) WHEN 'click' THEN '6.1 Postmarketing Experience' || chr(10) ELSE '' END
           || repeat('note ', CAST(regexp_extract(props, '\\d+') AS INTEGER) % 5) || 'k=' || regexp_extract(props, '\\d+')
           || CASE WHEN event_id % 5 = 0 THEN chr(10) || '• Skin: rash & <u class="x">itch</u>' || chr(10) || '- second' ELSE '' END AS updated_text,
         CASE WHEN event_id % 2 = 0 THEN '' ELSE 'before' END AS original_text,
         CASE WHEN event_id % 3 = 0 THEN 'https://x/' || event_id || '.pdf' ELSE 'https://x/' END AS source_url,
         sha256(props) AS content_hash, ts + INTERVAL 1 DAY AS last_verified_at, event_type IN ('view', 'click', 'signup') AS allowed
  FROM events)"""


def drugs(spark: SparkSession, sf: str) -> DataFrame:
    """One drug per part, several per name and source."""
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS id", "concat(upper(p_name), ' ', p_brand) AS display_name",
        "lower(concat(p_name, ' ', p_brand)) AS normalized_name",
        "CASE p_size % 3 WHEN 0 THEN p_type WHEN 1 THEN concat(p_type, '; ', p_name) ELSE '' END AS active_ingredient",
        "CASE WHEN p_size % 2 = 0 THEN concat('NDA-', lpad(p_partkey, 6, '0'), ' SUPPL-', p_size % 7) END AS application_number",
        "CASE p_size % 5 WHEN 0 THEN 'FDA_SRLC' WHEN 1 THEN 'FDA' WHEN 2 THEN 'UK_MHRA' WHEN 3 THEN 'TGA' ELSE 'HEALTH_CANADA' END AS source",
        "CAST('2024-01-01 00:00:00' AS TIMESTAMP_NTZ) AS created_at", "CAST(NULL AS TIMESTAMP_NTZ) AS updated_at",
    )


SQL_DRUGS = """
dr AS (
  SELECT p_partkey AS id, upper(p_name) || ' ' || p_brand AS display_name, lower(p_name || ' ' || p_brand) AS normalized_name,
         CASE p_size % 3 WHEN 0 THEN p_type WHEN 1 THEN p_type || '; ' || p_name ELSE '' END AS active_ingredient,
         CASE WHEN p_size % 2 = 0 THEN 'NDA-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || ' SUPPL-' || (p_size % 7) END AS application_number,
         CASE p_size % 5 WHEN 0 THEN 'FDA_SRLC' WHEN 1 THEN 'FDA' WHEN 2 THEN 'UK_MHRA' WHEN 3 THEN 'TGA' ELSE 'HEALTH_CANADA' END AS source
  FROM part)"""


def batch(spark: SparkSession, sf: str) -> DataFrame:
    """Crawled change rows, several per key, with repeated contents."""
    return batch_of(table(spark, sf, "events"))


def batch_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "user_id AS drug_id", f"{SECTION} AS section", "concat('SUPPL-', event_id % 3) AS source_record_id",
        "event_id AS seq", "concat('Drug ', user_id) AS display_name", "CAST(NULL AS STRING) AS active_ingredient",
        "CAST('2024-01-01 00:00:00' AS TIMESTAMP_NTZ) AS source_date", "concat('https://x/', event_id % 13) AS source_url",
        "CASE WHEN CAST(get_json_object(props, '$.k') AS INT) % 2 = 0 THEN '' ELSE 'orig' END AS original_text",
        "concat('pregnancy note ', CAST(get_json_object(props, '$.k') AS INT) DIV 34) AS updated_text",
        "CAST(NULL AS STRING) AS fda_comment", "ts AS verified_at", "date_format(ts, 'yyyy-MM-dd') AS run_id",
    )


SQL_BATCH = f"""
b AS (
  SELECT user_id AS drug_id, {STANDARD} AS section, 'SUPPL-' || (event_id % 3) AS source_record_id, event_id AS seq, ts,
         'Drug ' || user_id AS display_name,
         CASE WHEN CAST(regexp_extract(props, '\\d+') AS INTEGER) % 2 = 0 THEN '' ELSE 'orig' END AS original_text,
         'pregnancy note ' || (CAST(regexp_extract(props, '\\d+') AS INTEGER) // 34) AS updated_text
  FROM events WHERE event_type IN ('view', 'click', 'signup')),
acts AS (
  SELECT *, CASE WHEN prev IS NULL THEN 'NEW' WHEN prev <> original_text || '|' || updated_text THEN 'CHANGED' ELSE 'UNCHANGED' END AS action
  FROM (SELECT *, lag(original_text || '|' || updated_text) OVER (PARTITION BY drug_id, section, source_record_id ORDER BY seq) AS prev FROM b)),
eff AS (
  SELECT *, row_number() OVER w AS n, CASE WHEN action = 'CHANGED' AND original_text = '' THEN lag(updated_text) OVER w ELSE original_text END AS st_orig
  FROM acts WHERE action <> 'UNCHANGED' WINDOW w AS (PARTITION BY drug_id, section, source_record_id ORDER BY seq)),
vers AS (
  SELECT drug_id, section, source_record_id, n - 1 AS version_number, lag(st_orig) OVER w AS original_text, lag(updated_text) OVER w AS updated_text, n
  FROM eff WINDOW w AS (PARTITION BY drug_id, section, source_record_id ORDER BY seq))"""


def product_sections(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS id", "initcap(concat(p_name, ' ', p_type)) AS product_name",
        "lower(concat(p_name, ' ', p_type)) AS product_normalized",
        "concat(replace(p_name, ' ', '_'), '_', p_type, '_', p_brand, '.pdf') AS filename", "p_partkey AS updated_at",
    )
