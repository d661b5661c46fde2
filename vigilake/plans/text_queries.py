"""Function queries: text, dates, hashes, sections, predicates.

Most inputs are driver columns written the messy way the sources write them;
the SQL states the clean value straight from the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilake.functions import classify, dates, hashing, matching, sections, text
from vigilake.plans.registry import query, spread_table, table

PART = ["p_partkey"]


@query("F1 F2 F3 F4 F6 F8", r"""SELECT p_partkey, p_name || p_type AS hexless, p_name || ' ' || p_type AS term,
 p_name || ' ' || lower(p_type) AS drug_name, p_type || ' ' || p_name AS plain, p_name || ' ' || lower(p_type) AS product,
 p_name || ' ' || lower(p_type) AS saltless, '' AS missing FROM part""")
def normalize_names(spark: SparkSession, sf: str) -> DataFrame:
    n, t = F.col("p_name"), F.col("p_type")
    lit = F.lit
    return table(spark, sf, "part").select(
        "p_partkey", text.clean_xml_hex(F.concat(lit("_x000D_"), n, lit("_x00aF_"), t)).alias("hexless"),
        text.normalize_term(F.concat(lit("\t "), n, lit(" \r\n  "), t, lit(" "))).alias("term"),
        text.normalize_drug_name(F.concat(lit(" "), F.upper(n), lit("   "), t)).alias("drug_name"),
        text.normalize_text(F.concat(t, lit("\n\n"), n, lit(" "))).alias("plain"),
        text.normalize_product_name(F.concat(n, lit("-("), t, lit(")™"))).alias("product"),
        text.strip_drug_salts(F.concat(n, lit(" Sulfate "), t, lit(" HCL"))).alias("saltless"),
        text.normalize_drug_name(F.lit(None).cast("string")).alias("missing"),
    )


_SECTION_CASE = """CASE p_size % 10 WHEN 0 THEN '5. Warnings' WHEN 1 THEN '6 ADVERSE REACTIONS (6.1)' WHEN 2 THEN '8 - Use in Specific Populations'
 WHEN 3 THEN '17 Patient Counseling' WHEN 4 THEN 'Warning' WHEN 5 THEN concat(p_name, '''s non-clinical notes')
 WHEN 6 THEN '6 months follow up' WHEN 7 THEN 'Use in pregnancy' WHEN 8 THEN '(5)' ELSE '' END"""


@query("F5", """SELECT p_partkey, CASE p_size % 10 WHEN 0 THEN 'Warnings and Precautions' WHEN 1 THEN 'Adverse Reactions'
 WHEN 2 THEN 'Use in Specific Populations' WHEN 3 THEN 'Patient Counseling Information' WHEN 4 THEN 'Boxed Warning'
 WHEN 5 THEN upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1))
   || substr(split_part(p_name, ' ', 2), 2) || '''S Non-Clinical Notes'
 WHEN 6 THEN '6 Months Follow Up' WHEN 7 THEN 'Use In Pregnancy' WHEN 8 THEN 'Boxed Warning' ELSE '' END AS section FROM part""")
def normalize_section_name(spark: SparkSession, sf: str) -> DataFrame:
    header = F.expr(_SECTION_CASE)
    return table(spark, sf, "part").select("p_partkey", sections.normalize_section_name(header).alias("section"))


@query("X3 P4", """SELECT p_partkey, CASE p_size % 10 WHEN 0 THEN 'warnings' WHEN 1 THEN 'adverse' WHEN 2 THEN 'populations' WHEN 3 THEN 'section_17'
 WHEN 4 THEN 'warnings' WHEN 6 THEN 'adverse' WHEN 7 THEN 'populations' WHEN 8 THEN NULL END AS kind,
 p_size % 10 IN (0, 1, 2, 4, 6, 7) AS allowed,
 p_size % 10 IN (0, 1, 4, 6) OR (p_size % 10 IN (2, 7) AND p_type IN ('SMALL', 'LARGE')) AS allowed_with_body FROM part""")
def section_whitelist(spark: SparkSession, sf: str) -> DataFrame:
    header = F.expr(_SECTION_CASE)
    body = F.expr("CASE p_type WHEN 'SMALL' THEN '8.1 Pregnancy\nnone' WHEN 'LARGE' THEN '' ELSE 'geriatric use only' END")
    return table(spark, sf, "part").select(
        "p_partkey", sections.section_kind(header).alias("kind"), sections.is_whitelisted(header).alias("allowed"),
        sections.is_whitelisted(header, body).alias("allowed_with_body"),
    )


@query("F7", """SELECT p_partkey, CASE p_size % 5
  WHEN 0 THEN upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2)
  WHEN 1 THEN upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2))
  WHEN 2 THEN upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2)
  WHEN 3 THEN upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || ' Drug'
  ELSE 'test' END AS product FROM part""")
def product_name_from_file(spark: SparkSession, sf: str) -> DataFrame:
    file_name = F.expr("""CASE p_size % 5 WHEN 0 THEN concat('9c7c7ccd_', replace(p_name, ' ', '-'), '_PBRER_2026.pdf')
      WHEN 1 THEN concat(p_type, '-500mg-tablets.pdf') WHEN 4 THEN 'test.pdf' ELSE 'document.pdf' END""")
    page = F.expr("""CASE p_size % 5 WHEN 2 THEN concat('REPORT\nActive Substance: ', p_name, ', salt\nmore')
      WHEN 3 THEN concat('PERIODIC REPORT\n16.1 Risks\n', p_type, ' Drug™ (salt)\nmore') ELSE '' END""")
    return table(spark, sf, "part").select("p_partkey", text.product_name_from_file(file_name, page).alias("product"))


_DATE_TEXT = """CASE o_orderkey % 9
  WHEN 0 THEN date_format(o_orderdate, 'MM/dd/yyyy') WHEN 1 THEN concat(date_format(o_orderdate, 'M/d/yy'), ' (SUPPL-50)')
  WHEN 2 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 3 THEN concat('Approved ', date_format(o_orderdate, 'MMMM d, yyyy'), '.')
  WHEN 4 THEN date_format(o_orderdate, 'dd-MMM-yyyy') WHEN 5 THEN upper(date_format(o_orderdate, 'MMM dd yyyy'))
  WHEN 6 THEN date_format(o_orderdate, 'd MMMM yyyy') WHEN 7 THEN concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T00:00:00')
  ELSE 'no date here' END"""


@query("F9 F10 F14", """SELECT o_orderkey, CASE WHEN o_orderkey % 9 < 8 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
 CASE WHEN o_orderkey % 9 < 8 THEN strftime(o_orderdate, '%d-%b-%Y') END AS report_date,
 CASE WHEN o_orderkey % 9 = 1 THEN 'SUPPL-50' END AS supplement FROM orders""")
def parse_label_date(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr(_DATE_TEXT)
    ts = dates.parse_label_date(raw)
    return spread_table(spark, sf, "orders").select(
        "o_orderkey", F.date_format(ts, "yyyy-MM-dd").alias("day"), dates.format_report_date(ts).alias("report_date"),
        dates.extract_supplement_id(raw).alias("supplement"),
    )


@query("F9", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS at FROM orders""")
def parse_label_date_lenient(spark: SparkSession, sf: str) -> DataFrame:
    """Two-digit years and times of day, through the Arrow fallback."""
    raw = F.expr("""CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate, 'M/d/yy')
      WHEN 1 THEN date_format(o_orderdate, 'dd-MMM-yy') ELSE date_format(o_orderdate, 'MMMM dd, yyyy') END""")
    ts = dates.parse_label_date(raw, lenient=True)
    return spread_table(spark, sf, "orders").select("o_orderkey", F.date_format(ts, "yyyy-MM-dd HH:mm").alias("at"))


@query("F11 F12", """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 7 THEN NULL WHEN 6 THEN strftime(o_orderdate, '%Y-%m-01') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
 strftime(o_orderdate, '%Y-%m-%d') AS amended, strftime(o_orderdate, '%Y-%m-%d') AS approved FROM orders""")
def parse_register_date(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr("""CASE o_orderkey % 8 WHEN 0 THEN date_format(o_orderdate, 'd MMMM yyyy') WHEN 1 THEN date_format(o_orderdate, 'dd MMM yyyy')
      WHEN 2 THEN date_format(o_orderdate, "yyyyMMdd'T'HHmmss") WHEN 3 THEN date_format(o_orderdate, 'dd/MM/yyyy')
      WHEN 4 THEN date_format(o_orderdate, 'yyyyMMdd') WHEN 5 THEN concat('published ', date_format(o_orderdate, 'd MMMM yyyy'), ' online')
      WHEN 6 THEN date_format(o_orderdate, 'MMMM yyyy') ELSE 'undated' END""")
    amended = F.expr("concat('x Date of most recent amendment: ', date_format(o_orderdate, 'd MMMM yyyy'), ' y')")
    approved = F.expr("concat('FIRST APPROVED - ', date_format(o_orderdate, 'yyyy-MM-dd'))")

    def day(ts):
        return F.date_format(ts, "yyyy-MM-dd")

    return spread_table(spark, sf, "orders").select(
        "o_orderkey", day(dates.parse_register_date(raw)).alias("day"),
        day(dates.extract_amendment_date(amended)).alias("amended"),
        day(dates.extract_approval_date(approved)).alias("approved"),
    )


@query("F13", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Version ' || p_size || '.5' WHEN 1 THEN 'Version ' || p_size WHEN 2 THEN 'Version ' || p_size || '.1.2' ELSE p_name END AS label,
 CASE p_size % 4 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN CAST(p_size AS DOUBLE) END AS number FROM part""")
def parse_version(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr("CASE p_size % 4 WHEN 0 THEN concat('Doc v', p_size, '.5 final') WHEN 1 THEN concat(' ', p_size, ' ')"
                 " WHEN 2 THEN concat('Rev. ', p_size, '.1.2') ELSE concat(p_name, ' ') END")
    return table(spark, sf, "part").select("p_partkey", dates.parse_version(raw).alias("v")).select(
        "p_partkey", "v.label", "v.number")


@query("F31 F30", """SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN '2026-0' || (1 + p_size % 9) || '-01' END AS day,
 CASE WHEN p_size % 3 < 2 THEN p_name ELSE '' END AS brand, CASE WHEN p_size % 3 < 2 THEN p_type ELSE '' END AS generic FROM part""")
def newsletter_title_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Month headings and ``Brand (generic)`` titles."""
    month = F.expr("CASE p_size % 3 WHEN 2 THEN 'Contents 2026' ELSE date_format(make_date(2026, 1 + p_size % 9, 1), ' MMMM yyyy ') END")
    title = F.expr("CASE p_size % 3 WHEN 0 THEN concat(p_name, ' (', p_type, '): update') WHEN 1 THEN concat(p_name, ' - (', p_type, ')') ELSE p_name END")
    names = classify.title_brand_generic(title)
    return table(spark, sf, "part").select(
        "p_partkey", F.date_format(dates.month_year_to_date(month), "yyyy-MM-dd").alias("day"),
        names["brand"].alias("brand"), names["generic"].alias("generic"),
    )


@query("F16 C3", """WITH r AS (SELECT *, lag(l_linenumber) OVER () AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sha256('P' || l_partkey || '|None|' || l_returnflag || '|' || strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')
 || '||' || l_linestatus || '|None') AS hash FROM r""")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        hashing.content_hash(
            F.expr("concat('P', l_partkey)"), none, F.col("l_returnflag"), hashing.py_datetime(F.col("l_shipdate")),
            F.lit(""), F.col("l_linestatus"), none,
        ).alias("hash"),
    )


@query("F17 F18 F19", r"""SELECT doc_id, sha256('drug ' || source || '|' || lower(lang) || '|05/06/2024|' || regexp_replace(text, '^\s+|\s+$', '', 'g')) AS section_hash,
 sha256('{"active_ingredient": "' || source || '", "adverse_reactions": "", "document_date": "", "pdf_url": "u", "pregnancy": "", "product": "say \"hi\"", "warnings_and_precautions": "x"}') AS result_hash,
 substr(sha256('https://x/' || doc_id || '|' || source), 1, 32) AS record_id, substr(md5(source), 1, 8) AS short_id FROM documents""")
def section_and_result_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes over whole document texts."""
    source = F.col("source")
    empty = F.lit("")
    return spread_table(spark, sf, "documents").select(
        "doc_id",
        hashing.section_hash(F.concat(F.lit(" Drug "), source), F.upper("lang"), F.lit("05/06/2024"), F.col("text")).alias("section_hash"),
        hashing.sorted_json_hash({
            "product": F.lit('say "hi"'), "active_ingredient": source, "pdf_url": F.lit("u"), "document_date": empty,
            "adverse_reactions": empty, "warnings_and_precautions": F.lit("x"), "pregnancy": empty,
        }).alias("result_hash"),
        hashing.record_id(F.concat(F.lit("https://x/"), F.col("doc_id").cast("string")), source).alias("record_id"),
        hashing.short_md5(source).alias("short_id"),
    )


@query("F20", r"""SELECT p_partkey, 'Postmarketing Experience' || chr(10) || chr(10) || p_name || ' ' || p_type || ' text' || chr(10) || chr(10)
 || '• ' || p_type || chr(10) || chr(10) || 'Cardiac disorders: ' || p_name || ' ' || p_brand AS report_form,
 'Additions and/or revisions underlined:' || chr(10) || chr(10) || '6.2 Postmarketing Experience' || chr(10) || p_name || chr(10) || p_type || ' text [see Warnings' || chr(10) || '(5.5)]' || chr(10)
 || '• ' || p_type || chr(10) || '...' || chr(10) || 'Cardiac disorders: ' || p_name || chr(10) || p_brand AS plain_form FROM part""")
def clean_adverse_text(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr(r"""concat('Additions and/or revisions underlined:\n\n6.2 Postmarketing \n\nExperience\n', p_name, '\n', p_type,
      ' text [see Warnings\n(5.5)]\n• ', p_type, '\n...\nCardiac disorders: ', p_name, '\n', p_brand, '\n17 PCI/PI/MG\nAdverse: ', p_name)""")
    return table(spark, sf, "part").select(
        "p_partkey", sections.clean_adverse_text(raw).alias("report_form"),
        sections.clean_adverse_text_simple(raw).alias("plain_form"),
    )


@query("F21", r"""WITH d AS (SELECT doc_id, text || chr(10) || chr(10) || chr(10) || chr(9) || ' 17 ' || source || chr(10) || 'rest' AS t FROM documents),
cut AS (SELECT doc_id, regexp_replace(t, '(?is)(?:^|\n)\s*(?:17\b|17\s+17|PCI/PI/MG|Patient\s+Counseling\s+Information|MEDICATION\s+GUIDE).*$', '') AS t FROM d),
l AS (SELECT doc_id, generate_subscripts(string_split(t, chr(10)), 1) AS i, unnest(string_split(t, chr(10))) AS line FROM cut),
j AS (SELECT doc_id, string_agg(regexp_replace(regexp_replace(line, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g'), chr(10) ORDER BY i) AS t FROM l GROUP BY ALL)
SELECT doc_id, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM j""")
def clean_general_text(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents with a section 17 behind them."""
    raw = F.expr(r"concat(text, '\n\n\n\t 17 ', source, '\nrest')")
    return spread_table(spark, sf, "documents").select("doc_id", sections.clean_general_text(raw).alias("cleaned"))


@query("F22", r"""SELECT p_partkey, p_name || chr(10) || '• ' || p_type || chr(10) || 'more ' || chr(10) || p_brand AS cleaned FROM part""")
def clean_clinical_text(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr(r"""concat(p_name, ' [<i> see </i> Warnings (5.1)] • ', p_type, '\n<u><b> </b></u>\n...\nmore . . . ', p_brand,
      ' [ see Use (8)]\nMedication Guide\n', p_name)""")
    return table(spark, sf, "part").select(
        "p_partkey", F.regexp_replace(sections.clean_clinical_text(raw), r"more\n", "more \n").alias("cleaned"))


@query("F24", r"""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '8.1 Pregnancy' || chr(10) || p_name || chr(10) || p_type WHEN 1 THEN NULL
 WHEN 2 THEN 'fetal harm ' || p_name ELSE '8.2 Lactation' || chr(10) || p_name END AS part FROM part""")
def pregnancy_subsections(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr(r"""CASE p_size % 4 WHEN 0 THEN concat('8 Use\n8.1 Pregnancy\n', p_name, '\n', p_type, '\n8.5 Geriatric\nx')
      WHEN 1 THEN concat('8.4 Pediatric Use ', p_name) WHEN 2 THEN concat('fetal harm  ', p_name, '\n17 Guide')
      ELSE concat('8.2 Lactation\n', p_name, '\n8.4 Pediatric\ny') END""")
    return table(spark, sf, "part").select("p_partkey", sections.pregnancy_subsections(raw).alias("part"))


@query("F25 O2", """SELECT p_partkey, CAST(CASE p_size % 10 WHEN 0 THEN 5 WHEN 1 THEN 6 WHEN 2 THEN 8 WHEN 3 THEN 17 WHEN 4 THEN 99
 WHEN 5 THEN 99 WHEN 6 THEN 6 WHEN 7 THEN 8 WHEN 8 THEN 99 ELSE 99 END AS INTEGER) AS priority,
 CASE p_size % 10 WHEN 0 THEN 'Warnings' WHEN 1 THEN 'Adverse Reactions' WHEN 2 THEN 'Use in Specific Populations' WHEN 3 THEN 'Patient Counseling'
 WHEN 4 THEN 'Warning' WHEN 5 THEN p_name || '''s non-clinical notes' WHEN 6 THEN 'months follow up' WHEN 7 THEN 'Use in pregnancy' WHEN 8 THEN '(5)' ELSE '' END AS title
FROM part""")
def section_order(spark: SparkSession, sf: str) -> DataFrame:
    header = F.expr(_SECTION_CASE)
    return table(spark, sf, "part").select(
        "p_partkey", sections.section_sort_key(header)["priority"].alias("priority"),
        sections.section_display_title(header).alias("title"),
    )


@query("A16", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name END AS original,
 CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'Updated Text: ' || p_type END AS updated FROM part""")
def split_original_updated(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr(r"""CASE p_size % 2 WHEN 0 THEN concat('Original Text: ', p_name, '\nUpdated Text:\n', p_type) ELSE concat('Updated Text: ', p_type) END""")
    halves = sections.split_original_updated(raw)
    return table(spark, sf, "part").select("p_partkey", halves["original"].alias("original"), halves["updated"].alias("updated"))


@query("F27", """SELECT p_partkey, p_size || ',' || (p_size + 1) || ',' || (p_size + 2) || ',99' AS pages FROM part""")
def parse_page_ranges(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr("concat(p_size, '–', p_size + 2, ', 99, x, 9-1')")
    return table(spark, sf, "part").select("p_partkey", F.array_join(classify.parse_page_ranges(raw), ",").alias("pages"))


@query("F33", """SELECT p_partkey, CAST(p_size AS VARCHAR) AS main, CASE WHEN p_size % 3 = 0 THEN p_size || '.1' END AS sub,
 p_size % 3 <> 1 AS include_tables, p_size % 3 = 2 AS html FROM part""")
def parse_natural_query(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr("""CASE p_size % 3 WHEN 0 THEN concat('give Section ', p_size, ' to subsection ', p_size, '.1 with tables')
      WHEN 1 THEN concat('section ', p_size, ' text only') ELSE concat('HTML of ', p_size, '.') END""")
    return table(spark, sf, "part").select("p_partkey", classify.parse_natural_query(raw).alias("q")).select("p_partkey", "q.*")


@query("F34", """SELECT p_partkey, 'On 05-Dec-2025, the United States Food and Drug Administration Center for Drug Evaluation and Research approved the following safety labeling changes for '
 || p_name || ' (' || lower(p_type) || '; Additions underlined):' AS sentence FROM part""")
def intro_sentence(spark: SparkSession, sf: str) -> DataFrame:
    ingredient = text.report_ingredient(F.concat("p_type", F.lit(" Sulfate")))
    return table(spark, sf, "part").select(
        "p_partkey", sections.approval_sentence(F.lit("05-Dec-2025"), F.col("p_name"), ingredient).alias("sentence"))


@query("P10", r"""SELECT doc_id, length(text) >= 5 AND (length(regexp_replace(text, '[^<]', '', 'g')) > length(regexp_replace(text, '[^ ]', '', 'g'))
 OR (length(regexp_replace(text, '[^\pL]', '', 'g')) > 0 AND length(regexp_replace(text, '[\pL\pN\s]', '', 'g')) > length(regexp_replace(text, '[^\pL]', '', 'g')))) AS corrupted FROM documents""")
def corrupted_text(spark: SparkSession, sf: str) -> DataFrame:
    return spread_table(spark, sf, "documents").select("doc_id", text.is_corrupted_text(F.col("text")).alias("corrupted"))


@query("P9", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'display_name is required and cannot be empty; ' ELSE '' END
 || CASE WHEN o_orderkey % 9 = 8 THEN 'source_date must be a datetime object; ' ELSE '' END
 || CASE WHEN o_orderpriority = '1-URGENT' THEN 'updated_text appears to be corrupted or malformed; ' ELSE '' END AS errors FROM orders""")
def record_validation(spark: SparkSession, sf: str) -> DataFrame:
    raw_date = F.expr(_DATE_TEXT)
    errors = matching.record_errors(
        F.expr("CASE WHEN o_orderstatus <> 'P' THEN 'x' ELSE '' END"), F.lit("u"),
        {"updated_text": F.expr("CASE WHEN o_orderpriority = '1-URGENT' THEN '<a><b>' ELSE 'plain text' END")},
        {"source_date": raw_date}, {"source_date": dates.parse_label_date(raw_date)},
    )
    return spread_table(spark, sf, "orders").select(
        "o_orderkey", F.concat_ws("", F.transform(errors, lambda e: F.concat(e, F.lit("; ")))).alias("errors"))


_BOUNDS = """CASE o_orderkey % 7 WHEN 0 THEN date_format(o_orderdate, 'dd-MM-yyyy') WHEN 1 THEN date_format(o_orderdate, 'MM/dd/yyyy')
  WHEN 2 THEN concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T10:00:00') WHEN 3 THEN '31-02-2020' WHEN 4 THEN 'soon' WHEN 5 THEN ''
  ELSE date_format(o_orderdate + INTERVAL 400 DAY, 'yyyy-MM-dd') END"""


@query("P5", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 3 THEN strftime(CASE WHEN o_orderkey % 7 = 0 AND day(o_orderdate) <= 12 AND
     day(o_orderdate) = day(o_orderdate + INTERVAL 40 DAY) AND day(o_orderdate + INTERVAL 40 DAY) <= 12 THEN NULL ELSE o_orderdate END, '%Y-%m-%d') END AS start_day,
 CASE WHEN o_orderkey % 7 IN (0, 1, 2, 5) THEN strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d') || ' 23:59:59.999999' END AS end_at,
 CASE o_orderkey % 7 WHEN 3 THEN 'startDate:calendar' WHEN 4 THEN 'startDate:format' WHEN 6 THEN 'order' END AS error FROM orders""")
def validate_date_range(spark: SparkSession, sf: str) -> DataFrame:
    bounds = dates.validate_date_range(F.expr(_BOUNDS), F.expr(
        "CASE WHEN o_orderkey % 7 = 0 THEN date_format(o_orderdate + INTERVAL 40 DAY, 'dd-MM-yyyy')"
        " ELSE date_format(o_orderdate + INTERVAL 40 DAY, 'yyyy-MM-dd') END"))
    return spread_table(spark, sf, "orders").select("o_orderkey", bounds.alias("b")).select(
        "o_orderkey", F.date_format("b.start_ts", "yyyy-MM-dd").alias("start_day"),
        F.date_format("b.end_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("end_at"), "b.error",
    )


@query("P7", """SELECT p_partkey, p_size % 4 IN (0, 1) AS product_hit, p_size % 4 IN (0, 1, 3) AS article_hit FROM part""")
def product_match(spark: SparkSession, sf: str) -> DataFrame:
    """Whole-word and token matches; parts of words do not count."""
    q = F.expr("""CASE p_size % 4 WHEN 0 THEN split(p_name, ' ')[1] WHEN 1 THEN upper(p_name)
      WHEN 2 THEN substring(p_name, 2, 4) ELSE concat(split(p_name, ' ')[1], '  ', split(p_name, ' ')[0]) END""")
    none = F.lit(None).cast("string")
    return table(spark, sf, "part").select(
        "p_partkey", matching.product_match(q, F.col("p_name"), none, none).alias("product_hit"),
        matching.article_match(q, F.col("p_name")).alias("article_hit"),
    )


@query("P8", """SELECT p_partkey, p_size % 5 IN (0, 1, 2) AS medicine_hit, p_size % 5 IN (0, 1, 2) AS register_hit,
 p_size % 5 IN (0, 1, 2) AS result_hit FROM part""")
def medicine_match(spark: SparkSession, sf: str) -> DataFrame:
    q = F.expr("""CASE p_size % 5 WHEN 0 THEN substring(p_name, 2, 5) WHEN 1 THEN concat('extra ', p_name, ' kit')
      WHEN 2 THEN concat('zzzz ', lower(p_type)) WHEN 3 THEN 'zq' ELSE 'qqqq xxxx' END""")
    name, kind = F.col("p_name"), F.col("p_type")
    return table(spark, sf, "part").select(
        "p_partkey", matching.medicine_match(q, name, kind, F.lit("")).alias("medicine_hit"),
        matching.register_product_match(q, name, kind).alias("register_hit"),
        matching.relevant_result(q, name, F.lit(""), F.lit("-"), kind, F.lit(None).cast("string")).alias("result_hit"),
    )


@query("P11 P12", """SELECT p_partkey, p_size % 4 <> 1 AND p_size % 4 <> 2 AS is_pi,
 CASE WHEN p_size % 4 = 0 THEN 'SECTIONS_NOT_FOUND' WHEN p_size % 4 = 1 THEN 'VALID' ELSE 'VALID_WITH_WARNINGS' END AS status,
 CAST(CASE p_size % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS INTEGER) AS n_issues FROM part""")
def document_validity(spark: SparkSession, sf: str) -> DataFrame:
    url = F.expr("CASE p_size % 4 WHEN 1 THEN 'https://x/CMI-doc.pdf' ELSE 'https://x/cmi-pi.pdf' END")
    url = F.when(F.expr("p_size % 4 = 1"), F.lit("https://x/CMI-doc.doc")).otherwise(url)
    title = F.expr("CASE p_size % 4 WHEN 2 THEN 'Consumer Medicine Information' ELSE p_name END")
    long_text = F.rpad("p_name", 60, "x")
    s46 = F.when(F.expr("p_size % 4 <> 0"), long_text)
    s48 = F.expr("CASE p_size % 4 WHEN 1 THEN rpad(p_name, 60, 'y') WHEN 2 THEN p_name WHEN 3 THEN 'Section 4.8 not present in document' END")
    product = F.expr("CASE p_size % 4 WHEN 3 THEN '' ELSE p_name END")
    return table(spark, sf, "part").select(
        "p_partkey", matching.is_pi_document(url, title).alias("is_pi"),
        matching.completeness(product, F.lit("u"), s46, s48).alias("c"),
    ).select("p_partkey", "is_pi", "c.status", F.size("c.issues").alias("n_issues"))


@query("X7 X8 X9", """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'SKIP' WHEN 1 THEN 'PRODUCT_MONOGRAPH_UPDATE' WHEN 2 THEN 'VACCINE_SAFETY_SUMMARY'
  WHEN 3 THEN 'SAFETY_BRIEF' WHEN 4 THEN 'MONTHLY_RECAP' ELSE 'OTHER' END AS article_type, p_size % 6 IN (1, 2, 3, 4) AS relevant,
 CASE p_size % 6 WHEN 1 THEN 'Product Monograph Update' WHEN 2 THEN 'Vaccine Safety Summary' WHEN 3 THEN 'Safety Brief'
  WHEN 4 THEN 'Monthly Recap' ELSE 'Health Canada Safety Information' END AS section FROM part""")
def classify_articles(spark: SparkSession, sf: str) -> DataFrame:
    title = F.expr("CASE p_size % 6 WHEN 0 THEN 'Helpful links' WHEN 2 THEN concat('2025 AEFI data ', p_name) ELSE p_name END")
    level1 = F.expr("CASE WHEN p_size % 6 = 5 THEN p_type ELSE 'Monthly recap of products' END")
    level2 = F.expr("CASE p_size % 6 WHEN 3 THEN 'Safety  brief' ELSE '' END")
    level3 = F.expr("CASE p_size % 6 WHEN 1 THEN 'Product monograph updates' ELSE '' END")
    kind = classify.classify_article(level1, level2, level3, title)
    return table(spark, sf, "part").select("p_partkey", kind.alias("article_type")).select(
        "*", classify.is_safety_relevant(F.col("article_type")).alias("relevant"),
        classify.section_of_type(F.col("article_type")).alias("section"),
    )


@query("X4 X5", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'TGA_details' WHEN '2-HIGH' THEN 'Health_Canada_details'
  WHEN '3-MEDIUM' THEN 'MHRA_details' WHEN '5-LOW' THEN 'MedWatch_details' ELSE 'FDA_details' END AS website,
 CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'partial' ELSE 'complete' END AS coverage,
 o_orderstatus <> 'P' AND o_orderdate < TIMESTAMP '1999-01-01' AS has_note FROM orders""")
def client_labels(spark: SparkSession, sf: str) -> DataFrame:
    source = F.expr("""CASE o_orderpriority WHEN '1-URGENT' THEN 'AUSTRALIA_TGA' WHEN '2-HIGH' THEN 'Health_Canada_DPD'
      WHEN '3-MEDIUM' THEN 'UK_MHRA' WHEN '5-LOW' THEN 'FDA_MEDWATCH' WHEN '4-NOT SPECIFIED' THEN NULL END""")
    start = F.expr("CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 17 YEAR END")
    cover = classify.coverage(start, start)
    return spread_table(spark, sf, "orders").select(
        "o_orderkey", classify.website_name(source).alias("website"), cover["coverage"].alias("coverage"),
        cover["note"].isNotNull().alias("has_note"),
    )


@query("P21", """SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS kept FROM orders""")
def source_filter(spark: SparkSession, sf: str) -> DataFrame:
    source = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'AUSTRALIA_TGA' WHEN '2-HIGH' THEN 'TGA' WHEN '3-MEDIUM' THEN 'UK_MHRA' END")
    return spread_table(spark, sf, "orders").select("o_orderkey", matching.source_has_tag(source, "AUSTRALIA_TGA").alias("kept"))
