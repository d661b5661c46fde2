"""Document, table and version queries.

Blocks are the lines of ``documents``; every second line gets a numbered
heading in front, so the section structure follows from the line number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilake.functions import documents as fn
from vigilake.operators import documents as ops, tables, versions
from vigilake.operators.skew import cut_lineage, pick
from vigilake.plans.registry import query, spread_table, table

NUMBERS = "15", "16", "16.1", "16.1.1", "16.2", "16.2.1", "17", "18"
_ARRAY = "array(" + ", ".join(f"'{n}'" for n in NUMBERS) + ")"


def raw_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return spread_table(spark, sf, "documents", "doc_id", "text").selectExpr(
        "CAST(doc_id AS STRING) AS doc", r"posexplode(split(text, '\n')) AS (pos, line)"
    ).selectExpr(
        "doc", "CAST(pos AS LONG) AS ord", "pos DIV 10 + 1 AS page_num", "'paragraph' AS block_type",
        f"CASE WHEN pos % 2 = 0 THEN concat({_ARRAY}[(pos DIV 2) % 8], ' Part A\n', 'y ', line) ELSE concat('x ', line) END AS text",
        "11.0D AS font_size", "FALSE AS is_bold",
        "array(50.0D, (pos % 10) * 70 + 5.0D, 500.0D, (pos % 10) * 70 + 25.0D) AS bbox",
    ).withColumn("page_num", F.col("page_num").cast("int"))


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return ops.with_dense_order(ops.process_blocks(raw_blocks(spark, sf)))


def sectioned(spark: SparkSession, sf: str) -> DataFrame:
    """The block table with its sections, written once: the boundary and
    report operators read it several times."""
    return cut_lineage(ops.carry_sections(blocks(spark, sf)))


_LIST = "[" + ", ".join(f"'{n}'" for n in NUMBERS) + "]"
SQL = f"""ln AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc, CAST(i - 1 AS BIGINT) AS pos, line, {_LIST}[CAST((i - 1) // 2 % 8 + 1 AS INTEGER)] AS num, (i - 1) // 2 AS h,
         CAST((i - 1) // 10 + 1 AS INTEGER) AS page_num
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
bl AS (
  SELECT doc, pos * 2 AS ord, page_num, 'heading' AS block_type, num || ' Part A' AS text, TRUE AS is_heading, num AS section, h, pos FROM ln WHERE pos % 2 = 0
  UNION ALL SELECT doc, pos * 2 + 1, page_num, 'paragraph', regexp_replace('y ' || line, '\\s+$', ''), FALSE, num, h, pos FROM ln WHERE pos % 2 = 0
  UNION ALL SELECT doc, pos * 2, page_num, 'paragraph', 'x ' || line, FALSE, num, h, pos FROM ln WHERE pos % 2 = 1)"""


@query("X1 F26", """SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN '16.1' WHEN 4 THEN '16' WHEN 6 THEN '16' WHEN 7 THEN '5.1.' || p_size END AS number,
 CASE p_size % 8 WHEN 0 THEN 'Risk of ' || p_name WHEN 4 THEN '2' WHEN 6 THEN 'SAFETY' WHEN 7 THEN 'adverse events' END AS title,
 CAST(CASE p_size % 8 WHEN 0 THEN 2 WHEN 4 THEN 1 WHEN 6 THEN 1 WHEN 7 THEN 3 END AS INTEGER) AS level FROM part""")
def match_heading(spark: SparkSession, sf: str) -> DataFrame:
    # A bare number reads as its first part with the rest as title.
    line = F.expr("""CASE p_size % 8 WHEN 0 THEN concat(' Section 16.01: Risk of ', p_name) WHEN 1 THEN '16.1 adverse events in many patients'
      WHEN 2 THEN '16 Safety ........ 4' WHEN 3 THEN 'See Section 16.1' WHEN 4 THEN '16.2' WHEN 5 THEN '16.1% of subjects'
      WHEN 6 THEN '16. SAFETY' ELSE concat('5.1.0', p_size, ' - adverse events') END""")
    return table(spark, sf, "part").select("p_partkey", fn.match_heading(line).alias("h")).select("p_partkey", "h.*")


@query("X2 S15 O6", f"WITH {SQL} SELECT doc, ord, page_num, block_type, text, is_heading, CASE WHEN pos % 2 = 0 THEN section END AS section_number FROM bl")
def process_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Heading lines split off, in reading order."""
    return ops.reading_order(blocks(spark, sf)).select(
        "doc", "ord", "page_num", "block_type", "text", "is_heading", "section_number")


@query("W13", f"WITH {SQL} SELECT doc, ord, section FROM bl")
def section_carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    return ops.carry_sections(blocks(spark, sf)).select("doc", "ord", "section")


@query("W14", f"WITH {SQL} SELECT doc, ord, section FROM bl WHERE h IN (1, 2, 3)")
def boundary_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Section 16 up to and with 16.1 and what is below it."""
    return ops.extract_within_boundary(sectioned(spark, sf), "16", "16.1").select("doc", "ord", "section")


@query("W14", f"WITH {SQL} SELECT doc, ord, section FROM bl WHERE h BETWEEN 1 AND 5")
def boundary_extract_whole_section(spark: SparkSession, sf: str) -> DataFrame:
    return ops.extract_within_boundary(sectioned(spark, sf), "16").select("doc", "ord", "section")


@query("W14", f"WITH {SQL} SELECT doc, '16.2' AS stop FROM bl GROUP BY ALL HAVING max(h) >= 4")
def find_stop_section(spark: SparkSession, sf: str) -> DataFrame:
    return ops.find_stop_section(sectioned(spark, sf), "16", "16.1")


@query("G10", f"""WITH {SQL} SELECT doc, n.section AS number, min(page_num) AS start_page, max(page_num) AS end_page
FROM (SELECT DISTINCT doc, section FROM bl) n JOIN bl USING (doc) WHERE bl.section = n.section OR starts_with(bl.section, n.section || '.') GROUP BY ALL""")
def section_page_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return ops.section_page_bounds(sectioned(spark, sf))


_CHECK = f"""WITH {SQL}, x AS (SELECT * FROM bl WHERE h IN (1, 2, 3)), d AS (SELECT doc, max(h) AS m FROM bl GROUP BY ALL),
c AS (SELECT doc, coalesce(min(x.page_num), 0) AS start_page, coalesce(max(x.page_num), 0) AS end_page, count(x.doc) AS total_blocks, CAST(0 AS BIGINT) AS tables_included,
  m >= 1 AS main_found, m >= 2 AS target_found, CAST(CASE WHEN m >= 7 THEN 4 WHEN m >= 4 THEN m - 3 ELSE 0 END AS BIGINT) AS n_excluded,
  CASE WHEN m >= 2 THEN 1.0::DOUBLE WHEN m >= 1 THEN 0.65::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
  CASE WHEN m >= 2 THEN 'Extraction completed with high confidence.' WHEN m >= 1 THEN 'Extraction completed with warnings.' ELSE 'Section 16 was not found in the document.' END AS status_message
  FROM d LEFT JOIN x USING (doc) GROUP BY doc, m)"""


def _checklist(spark: SparkSession, sf: str) -> DataFrame:
    b = sectioned(spark, sf)
    return ops.validation_checklist(ops.extract_within_boundary(b, "16", "16.1"), b, "16", "16.1")


@query("G11", f"{_CHECK} SELECT * FROM c")
def validation_checklist(spark: SparkSession, sf: str) -> DataFrame:
    return _checklist(spark, sf)


@query("K5", f"""{_CHECK} SELECT doc, '16' AS section, '16.1' AS subsection, start_page, end_page, CASE WHEN main_found THEN 'success' ELSE 'not_found' END AS status,
 CASE WHEN confidence = 1 THEN '100%' WHEN confidence > 0 THEN '65%' ELSE '0%' END AS confidence, total_blocks AS blocks_extracted, tables_included AS tables_extracted FROM c""")
def export_batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ops.batch_summary(_checklist(spark, sf), "16", "16.1")


@query("G12 G17", f"{_CHECK} SELECT CASE WHEN main_found THEN 'success' ELSE 'not_found' END AS status, count(*) AS documents FROM c GROUP BY ALL")
def batch_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ops.batch_counts(ops.batch_summary(_checklist(spark, sf), "16", "16.1"))


@query("G9", f"""WITH {SQL} SELECT doc, section, section || ' Part A' AS title, count(*) FILTER (NOT is_heading) AS n_parts, CAST(0 AS BIGINT) AS n_tables,
 CAST(coalesce(sum(length(text)) FILTER (NOT is_heading), 0) AS BIGINT) AS text_chars FROM bl WHERE h BETWEEN 2 AND 5 GROUP BY ALL""")
def subsection_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return ops.subsection_rollup(ops.extract_within_boundary(sectioned(spark, sf), "16"), "16")


@query("G9", f"WITH {SQL} SELECT doc, section, ord, text FROM bl WHERE h BETWEEN 1 AND 5 AND NOT is_heading")
def subsection_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The texts behind the roll-up, as parts in reading order."""
    return ops.section_text(ops.extract_within_boundary(sectioned(spark, sf), "16"))


@query("K4 K8", f"""WITH {SQL} SELECT doc, 'elem_' || row_number() OVER (PARTITION BY doc ORDER BY ord) AS id, page_num AS page, section,
 block_type AS type, replace(text, chr(10), ' ') AS text_or_caption FROM bl WHERE h BETWEEN 1 AND 5""")
def export_block_trace(spark: SparkSession, sf: str) -> DataFrame:
    return ops.block_trace(ops.extract_within_boundary(sectioned(spark, sf), "16"))


def _bands(spark: SparkSession, sf: str) -> DataFrame:
    return raw_blocks(spark, sf).withColumn("_p", F.col("ord") % 10).withColumn(
        "text", F.expr("CASE _p WHEN 0 THEN CASE WHEN CAST(doc AS INT) % 3 = 0 THEN concat('Report ', page_num, ' of set') ELSE concat('Head ', doc, chr(65 + page_num % 26), page_num) END"
                       " WHEN 9 THEN concat('Page ', page_num, ' of 99') ELSE concat('line ', ord) END")
    ).withColumn("bbox", F.expr("array(50.0D, CASE WHEN _p = 9 THEN 750.0D ELSE _p * 70 + 5.0D END, 500.0D, CASE WHEN _p = 9 THEN 780.0D ELSE _p * 70 + 25.0D END)")).drop("_p")


@query("G8", f"""WITH {SQL}, m AS (SELECT doc, max(page_num) AS pages FROM ln GROUP BY ALL)
SELECT doc, pos AS ord, CASE WHEN pos % 10 = 9 THEN 'footer' WHEN pos % 10 = 1 AND pages > 1 AND (pages - 1) * 10 + 1 <= last THEN 'header' WHEN pos % 10 = 1 AND pages > 2 THEN 'header'
  WHEN pos % 10 = 0 AND CAST(doc AS INTEGER) % 3 = 0 AND pages > 1 THEN 'header'
  WHEN pos % 10 = 0 AND CAST(doc AS INTEGER) % 3 <> 0 AND pages > 26 AND (page_num > 26 OR page_num + 26 <= pages) THEN 'header' ELSE 'paragraph' END AS block_type
FROM ln JOIN m USING (doc) JOIN (SELECT doc, max(pos) AS last FROM ln GROUP BY ALL) USING (doc)""")
def header_footer_repeat(spark: SparkSession, sf: str) -> DataFrame:
    """Templates that repeat on two pages in the top or bottom band."""
    return ops.tag_headers_footers(_bands(spark, sf)).select("doc", "ord", "block_type")


@query("G18 S15", """SELECT doc, arg_max(s, (c, -s)) AS body_font_size FROM (SELECT CAST(doc_id AS VARCHAR) AS doc, (8 + i % 3)::DOUBLE AS s, sum(length(line)) AS c
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) GROUP BY ALL) GROUP BY ALL""")
def body_font_mode(spark: SparkSession, sf: str) -> DataFrame:
    spans = table(spark, sf, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS doc", r"posexplode(split(text, '\n')) AS (pos, text)"
    ).withColumn("font_size", (F.lit(8) + F.col("pos") % 3).cast("double"))
    return ops.body_font_size(spans)


def _page_tables(spark: SparkSession, sf: str) -> DataFrame:
    pages = raw_blocks(spark, sf).where("page_num % 3 = 0").select("doc", "page_num").distinct()
    return pages.select(
        "doc", F.lit(-1).cast("long").alias("ord"), "page_num", F.lit("table").alias("block_type"),
        F.lit("| a |").alias("text"), F.expr("array(60.0D, 100.0D, 480.0D, 300.0D)").alias("bbox"),
        F.lit(False).alias("is_heading"))


@query("J14", f"""WITH {SQL} SELECT doc, ord, block_type FROM bl WHERE is_heading OR page_num % 3 <> 0 OR pos % 10 NOT IN (2, 3, 4)
UNION ALL SELECT doc, -1, 'table' FROM (SELECT DISTINCT doc, page_num FROM bl WHERE page_num % 3 = 0)""")
def tables_in_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Text inside a table's box leaves, headings stay."""
    return ops.drop_text_in_tables(blocks(spark, sf), _page_tables(spark, sf)).select("doc", "ord", "block_type")


@query("P17", f"""WITH {SQL} SELECT doc, avg_chars < 40 AS is_scanned FROM (SELECT doc, sum(length(regexp_replace(line, '^\\s+|\\s+$', '', 'g'))) / count(*) AS avg_chars FROM ln GROUP BY ALL)""")
def needs_scan(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS doc", r"posexplode(split(text, '\n')) AS (pos, text)"
    ).withColumn("page_num", F.expr("pos DIV 10 + 1"))
    return ops.needs_scan(lines).select("doc", "is_scanned")


@query("P18", f"""WITH {SQL} SELECT doc, bool_or(contains(lower(line), 'tion') OR contains(lower(line), 'schung')) AS is_product FROM ln GROUP BY ALL""")
def in_document_product(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS doc", r"posexplode(split(text, '\n')) AS (pos, text)"
    ).withColumn("page_num", F.expr("pos DIV 10 + 1"))
    return ops.in_document_product(lines, F.lit(" Tion"), F.lit("SCHUNG"))


@query("W21", f"WITH {SQL} SELECT doc, ord FROM bl WHERE pos BETWEEN 2 AND 11")
def label_section_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return ops.label_section_bounds(blocks(spark, sf), "16", ["17"], ["NOWHERE"], ["Part Z"]).select("doc", "ord")


def _label_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Seven blocks of an adverse-reactions section per part."""
    return table(spark, sf, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS doc", "p_name", "p_type",
        """posexplode(array(
          named_struct('t', '6', 'h', TRUE, 'p', 3, 'k', 'heading'), named_struct('t', 'ADVERSE REACTIONS', 'h', FALSE, 'p', 3, 'k', 'paragraph'),
          named_struct('t', concat('intro ', p_name), 'h', FALSE, 'p', 3, 'k', 'paragraph'), named_struct('t', '6.1', 'h', TRUE, 'p', 4, 'k', 'heading'),
          named_struct('t', p_type, 'h', FALSE, 'p', 4, 'k', 'paragraph'), named_struct('t', concat('| ', p_name, ' |'), 'h', FALSE, 'p', 4, 'k', 'table'),
          named_struct('t', 'Postmarketing Experience', 'h', FALSE, 'p', 5, 'k', 'paragraph'))) AS (ord, b)""",
    ).selectExpr("doc", "CAST(ord AS LONG) AS ord", "b.t AS text", "b.h AS is_heading", "b.p AS page_num", "b.k AS block_type")


@query("G19", """SELECT CAST(p_partkey AS VARCHAR) AS doc, CAST(ord AS BIGINT) AS ord, CAST(part AS INTEGER) AS part, CASE k WHEN 'n' THEN p_name WHEN 't' THEN chr(10) || '| ' || p_name || ' |' || chr(10)
  WHEN 'i' THEN 'intro ' || p_name WHEN 'y' THEN chr(10) || '### 6.1 ' || p_type || chr(10) WHEN 'h' THEN chr(10) || '### 6. ADVERSE REACTIONS' || chr(10) ELSE k END AS piece
FROM part CROSS JOIN (VALUES (0, 0, '[Page 3]'), (0, 1, 'h'), (2, 0, 'i'), (3, 0, '[Page 4]'), (3, 1, 'y'), (5, 0, 't'), (6, 0, '[Page 5]'), (6, 1, 'Postmarketing Experience')) v(ord, part, k)""")
def blocks_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return ops.blocks_to_text(_label_blocks(spark, sf)).select("doc", "ord", "part", "piece")


@query("W17 J15", """SELECT CAST(p_partkey AS VARCHAR) AS doc, CAST(ord AS BIGINT) AS ord, CAST(n AS BIGINT) AS sub_no, CASE WHEN ord = 3 THEN '6.1 ' || p_type WHEN ord = 6 THEN 'Postmarketing Experience' END AS sub_name, ord IN (3, 4, 6) AS is_title
FROM part CROSS JOIN (VALUES (0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 2)) v(ord, n)""")
def subsection_split(spark: SparkSession, sf: str) -> DataFrame:
    return ops.split_subsections(_label_blocks(spark, sf)).select("doc", "ord", "sub_no", "sub_name", "is_title")


@query("J15", """SELECT CAST(p_partkey AS VARCHAR) AS doc, CAST(n AS BIGINT) AS sub_no, t AS table_id FROM part CROSS JOIN (VALUES (0, 'a'), (1, 'a'), (1, 'b')) v(n, t)""")
def subsection_tables(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS doc", "inline(array(struct('a' AS table_id, array(3, 4) AS pages), struct('b' AS table_id, array(4) AS pages)))")
    return ops.subsection_tables(ops.split_subsections(_label_blocks(spark, sf)), found)


@query("G20 X10", """SELECT CAST(p_partkey AS VARCHAR) AS doc, CAST(item AS BIGINT) AS item_no, CAST(ord AS BIGINT) AS ord, CAST(ln AS INTEGER) AS line_no, kind, replace(replace(t, '<n>', p_name), '<t>', p_type) AS line FROM part CROSS JOIN
 (VALUES (1, 0, 0, 'heading', '### Pregnancy'), (2, 0, 1, 'text', 'the <n> was'), (2, 1, 0, 'text', 'given to <t>.'), (3, 2, 0, 'pipe', '| a | <n> |'), (4, 3, 0, 'text', 'end of <n>,'), (4, 3, 1, 'text', 'really.'), (5, 4, 0, 'table', '| x |'), (6, 5, 0, 'heading', '### 4.8 effects')) v(item, ord, ln, kind, t)""")
def paragraph_reflow(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS doc",
        r"""posexplode(array(concat('Pregnancy\nthe ', p_name, ' was'), concat('[Page 2] given to ', p_type, '.'), concat('| a | ', p_name, ' |'),
          concat('end of ', p_name, ',\n really.'), '| x |', '4.8 effects')) AS (ord, text)""",
    ).selectExpr("doc", "CAST(ord AS LONG) AS ord", "text", "CASE ord WHEN 4 THEN 'table' ELSE 'paragraph' END AS block_type")
    return ops.paragraph_reflow(b)


@query("W18", r"""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || chr(10) || p_type ELSE p_name || chr(10) || 'the overdose of ' || p_type || ' ' || repeat('long ', 20) || chr(10) || 'x' END AS kept FROM part""")
def truncate_at_stop(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr(r"""CASE WHEN p_size % 2 = 0 THEN concat(p_name, '\n', p_type, '\n### 4.9 Overdose\nrest')
      ELSE concat(p_name, '\nthe overdose of ', p_type, ' ', repeat('long ', 20), '\nx\nPharmacological properties\ny') END""")
    return table(spark, sf, "part").select("p_partkey", fn.truncate_at_stop(raw).alias("kept"))


@query("F28 PR9", r"""SELECT p_partkey, p_name || chr(10) || chr(10) || p_type AS plain, p_name || chr(10) || chr(10) || chr(10) || 'after' AS no_tables, 'a' || p_type || 'b' AS no_html FROM part""")
def strip_tables_and_headings(spark: SparkSession, sf: str) -> DataFrame:
    headed = F.expr(r"concat('16.1 Summary of Safety Concerns\n[Page 3] PBRER x\n', p_name, '\n\n\n\nSection 16\n', p_type, '\n')")
    md = F.expr(r"concat(p_name, '\n[Page 3 Table]\n| a |\n| b |\n\nafter\n| c | d |')")
    html = F.expr("concat('a<TABLE x>', p_name, '\n</table> ', p_type, '<div class=\"table-responsive\">z</div> b')")
    return table(spark, sf, "part").select(
        "p_partkey", fn.strip_text_headings(headed).alias("plain"), fn.strip_md_tables(md).alias("no_tables"),
        fn.strip_html_tables(html).alias("no_html"))


@query("F28 PR9", r"""SELECT p_partkey AS id, 'Risks' AS title, '<style></style><title>Extracted Document</title><p class="x">' || chr(10) || '        ' || p_name || ' was seen<br>' || chr(10) || '        <b>' || p_type
  || '</b>' || chr(10) || '    </p>tail' || CASE WHEN p_size % 2 = 0 THEN '<table><tr><td>1</td></tr></table>' ELSE '' END AS text FROM part""")
def html_section_response(spark: SparkSession, sf: str) -> DataFrame:
    """Exported pages without headings: header elements, a badge, title lines
    inside paragraphs, and the paragraph and wrappers that are then empty."""
    page = r"""concat('<style>.med-badge { color: red }</style><title>Drug - Section 16</title><header class="med-main-header"><div class="med-brand-tag">B</div><h2>Section 16</h2></header>
      <article class="a"><div class="med-sub-body"> </div></article><div class="med-root-content"><span class="med-badge">16.1</span> </div>',
      '<p class="x">Section 16.1<br>', p_name, ' was seen<br/>\n16.1 Summary of Safety Concerns\n  <b>', p_type, '</b></p><h3 class="med-subsection-title">T</h3>\n<p>PBRER x</p>tail',
      CASE WHEN p_size % 2 = 0 THEN '<table><tr><td>1</td></tr></table>' ELSE '' END)"""
    sections = table(spark, sf, "part").selectExpr(
        "p_partkey AS id", "'Risks' AS section_title", f"{page} AS text",
        "CAST(NULL AS ARRAY<STRUCT<number: STRING, title: STRING, text: STRING>>) AS subsections")
    return ops.section_response(sections, None, True, fn.strip_html_tables, fn.strip_html_headings)


@query("PR9", """SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'Sub ' || p_type ELSE p_brand END AS title, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'all ' || p_name END AS text FROM part""")
def section_response(spark: SparkSession, sf: str) -> DataFrame:
    """Subsection 16.1 where it is indexed, else the whole section."""
    indexed = table(spark, sf, "part").selectExpr(
        "p_partkey AS id", "p_brand AS section_title", r"concat('16 Risks here\nall ', p_name) AS text",
        r"""CASE WHEN p_size % 2 = 0 THEN array(struct('16.1' AS number, concat('Sub ', p_type) AS title, concat('16.1 Risks\n', p_name, '\n| a | b |') AS text))
            ELSE array(struct('16.2' AS number, 'x' AS title, 'y' AS text)) END AS subsections""")
    return ops.section_response(indexed, "16.1", False, fn.strip_md_tables, fn.strip_text_headings)


_ROWS = "array(array('Term', p_type, ''), array('Cardiac disorders', '', ''), array(p_name, '1', ''), array('* Note about x', '', ''))"


@query("A14 F29 A8 A9", r"""SELECT p_partkey, 'Term,' || p_type || ',Column_3,Term_4' AS columns, '| Term | ' || p_type || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| **Cardiac disorders** |  |' || chr(10)
 || '| ' || p_name || ' | 1 |' || chr(10) || '| * Note about x |  |' AS report, '| Term | ' || p_type || ' |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| Cardiac disorders |  |  |' || chr(10)
 || '| ' || p_name || ' | 1 |  |' || chr(10) || '| * Note about x |  |  |' AS markdown, '* Note about x' AS notes, FALSE AS first_is_class, TRUE AS second_is_class FROM part""")
def table_rendering(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.expr(_ROWS)
    cut = F.transform(F.slice(rows, 2, 3), lambda r: F.slice(r, 1, 2))
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(fn.unique_columns(F.expr("array(' Term ', p_type, '', 'Term')")), ",").alias("columns"),
        fn.markdown_report_table(F.expr("array('Term', p_type)"), cut).alias("report"),
        fn.markdown_table(rows).alias("markdown"), F.array_join(fn.table_footnotes(rows), ";").alias("notes"),
        fn.is_organ_class_row(rows[0]).alias("first_is_class"), fn.is_organ_class_row(rows[1]).alias("second_is_class"))


@query("A7", """SELECT p_partkey, 'Term,' || p_type || ' n=' || p_size AS columns, p_name || ',1;' || p_brand || ',2' AS data FROM part""")
def clean_table(spark: SparkSession, sf: str) -> DataFrame:
    """An empty column dropped, a second header row merged."""
    rows = F.expr("array(array('Term', '', p_type), array('', NULL, concat('n=', p_size)), array(p_name, '', '1'), array(p_brand, ' ', '2'))")
    return table(spark, sf, "part").select("p_partkey", fn.clean_table(rows).alias("t")).select(
        "p_partkey", F.array_join("t.columns", ",").alias("columns"),
        F.array_join(F.transform("t.data", lambda r: F.array_join(r, ",")), ";").alias("data"))


@query("A10 A11", """SELECT p_partkey, 'Term,N' AS headers, p_name || '=' || p_size AS cell, 'First|' || p_type AS names, '3,4' AS pages FROM part""")
def markdown_to_rows(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr(r"""concat('intro\n### First\n[Page 4] a [Page 3]\n| Term | N |\n| --- | --- |\n| ', p_name, ' | ', p_size, ' |\n### ', p_type, '\nbody')""")
    tables_, subs = fn.markdown_to_rows(raw), fn.text_to_subsections(raw)
    first = tables_[0]
    row = first["rows"][0]
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(first["headers"], ",").alias("headers"), F.concat_ws("=", row["Term"], row["N"]).alias("cell"),
        F.array_join(F.transform(subs, lambda s: s["name"]), "|").alias("names"), F.array_join(subs[0]["pages"], ",").alias("pages"))


@query("A12", r"""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || chr(10) || chr(10) || '| M |' || chr(10) || chr(10) || p_type
 ELSE p_name || chr(10) || '| M |' || repeat('narrative ', 9) || p_type END AS text FROM part""")
def replace_inline_tables(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr(r"""CASE WHEN p_size % 2 = 0 THEN concat(p_name, '\n[Page 3 Table]\n| a | 1 |\n\n[Page 4 Table]\n| b | 2 |\n', p_type)
      ELSE concat(p_name, '\n| a | 1 |\n', repeat('narrative ', 9), '| b | 2 |\n', p_type) END""")
    return table(spark, sf, "part").select("p_partkey", fn.replace_inline_tables(raw, F.lit("| M |")).alias("text"))


@query("A15", r"""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'bullet_list' WHEN 1 THEN 'numbered_list' ELSE 'paragraph' END AS block_type,
 CASE p_size % 3 WHEN 0 THEN 'lead;' || p_name || ' more;' || p_type WHEN 1 THEN p_name || ';' || p_type END AS items FROM part""")
def list_items(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr(r"""CASE p_size % 3 WHEN 0 THEN concat('lead\n• ', p_name, '\nmore\n- ', p_type) WHEN 1 THEN concat('1. ', p_name, '\n(2) ', p_type) ELSE p_name END""")
    items = fn.list_items(raw)
    return table(spark, sf, "part").select("p_partkey", items["block_type"].alias("block_type"), F.array_join(items["items"], ";").alias("items"))


_TABLE_PARTS = """o_custkey AS doc, o_orderkey AS ord, CAST(floor(o_totalprice / 100000) AS INT) AS page"""


@query("W15 A8", """WITH RECURSIVE p AS (SELECT o_custkey AS doc, o_orderkey AS ord, CAST(floor(o_totalprice / 100000) AS INTEGER) AS page, o_orderstatus AS st,
  o_orderpriority = '5-LOW' AS low, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
j AS (SELECT doc, k, ord, page, st, low, st AS head, 1 AS table_no, FALSE AS more FROM p WHERE k = 1
  UNION ALL SELECT doc, k, ord, page, st, low, CASE WHEN more THEN head ELSE st END, table_no + CASE WHEN more THEN 0 ELSE 1 END, more
  FROM (SELECT p.*, j.head, j.table_no, p.page IN (j.page, j.page + 1) AND (p.st = j.head OR p.st = 'P' OR p.low) AS more
    FROM j JOIN p ON p.doc = j.doc AND p.k = j.k + 1)),
g AS (SELECT doc, table_no, min(page) AS page, arg_min('Table ' || ord || CASE WHEN low THEN ' (continued)' ELSE '' END, ord) AS caption,
  arg_max(page, ord) AS last, bool_or(more) AS more, sum(CASE WHEN NOT more THEN 3 WHEN head = 'P' THEN CASE st WHEN 'F' THEN 2 ELSE 3 END WHEN st = 'P' THEN 2 ELSE 1 END) AS n_rows
  FROM j GROUP BY ALL)
SELECT CAST(doc AS VARCHAR) AS doc, CAST(table_no AS BIGINT) AS table_no, page,
  CASE WHEN more THEN replace(caption, ' (continued)', '') || ' (continued on Page ' || last || ')' ELSE caption END AS caption, CAST(n_rows AS BIGINT) AS n_rows FROM g""")
def continuation_tables(spark: SparkSession, sf: str) -> DataFrame:
    """One table part per order; parts of a customer follow one another."""
    parts = table(spark, sf, "orders").selectExpr(
        "CAST(o_custkey AS STRING) AS doc", "o_orderkey AS ord", "CAST(floor(o_totalprice / 100000) AS INT) AS page",
        "concat('Table ', o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN ' (continued)' ELSE '' END) AS caption",
        "CASE o_orderstatus WHEN 'F' THEN array('Term', 'N') WHEN 'O' THEN array('Term', 'N', 'P') ELSE array('Cardiac disorders') END AS columns",
        "array(array(o_orderpriority, 'x'), array('Term', 'N'), array('', 'N')) AS rows",
        "CASE o_orderstatus WHEN 'P' THEN array('Cardiac disorders') ELSE array('Term', 'N') END AS original_columns")
    joined = tables.join_continued_tables(parts)
    return tables.continued_captions(joined, parts)


@query("W15 W16", """WITH t AS (SELECT CAST(o_custkey AS VARCHAR) AS doc, o_orderkey AS ord, CAST(floor(o_totalprice / 50000) AS INTEGER) AS page, CASE o_orderstatus WHEN 'F' THEN 2 ELSE 3 END AS w,
  o_orderpriority = '1-URGENT' AS fresh, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Table ' || o_orderkey || ': Events' ELSE 'Adverse Reactions Table' END AS title FROM orders),
f AS (SELECT *, CASE WHEN NOT fresh AND w = lag(w) OVER o AND page > lag(page) OVER o THEN 0 ELSE 1 END AS s FROM t WINDOW o AS (PARTITION BY doc ORDER BY ord))
SELECT doc, ord, title, CAST(sum(s) OVER (PARTITION BY doc ORDER BY ord) AS BIGINT) AS table_no, s = 0 AS is_continuation FROM f""")
def label_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Captions from the block before, continuation by width and page."""
    b = table(spark, sf, "orders").selectExpr(
        "CAST(o_custkey AS STRING) AS doc", "CAST(floor(o_totalprice / 50000) AS INT) AS page_num",
        "CASE o_orderstatus WHEN 'F' THEN array('a', 'b') ELSE array('a', 'b', 'c') END AS columns",
        "inline(array(struct(o_orderkey * 2 AS ord, 'paragraph' AS block_type, CASE o_orderpriority WHEN '1-URGENT' THEN concat('see Table ', o_orderkey, ': Events') ELSE 'text' END AS text),"
        " struct(o_orderkey * 2 + 1 AS ord, 'table' AS block_type, '' AS text)))")
    joined = tables.join_label_tables(tables.titled_tables(b))
    return joined.select("doc", ((F.col("ord") - 1) / 2).cast("long").alias("ord"), "title", "table_no", "is_continuation")


_DOCS = """d AS (SELECT source AS doc, doc_id AS id, 'https://x/label/' || (2000 + doc_id % 23) || '/' || (doc_id % 50) || 's' || lpad(CAST(doc_id % 7 AS VARCHAR), 3, '0') || 'lbl.pdf' AS url,
  CASE WHEN doc_id % 4 = 0 THEN make_date(2020, CAST(1 + doc_id % 12 AS INTEGER), 1) END AS dt, CASE WHEN doc_id % 5 = 0 THEN 'S-0' || (doc_id % 9) END AS sup FROM documents),
u AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY doc, url ORDER BY id) = 1),
k AS (SELECT *, coalesce(dt, make_date(CAST(regexp_extract(url, '/label/(\\d{4})/', 1) AS INTEGER), 1, 1)) AS day,
  CASE WHEN sup IS NOT NULL THEN CAST(regexp_extract(sup, '\\d+') AS INTEGER) ELSE CAST(regexp_extract(url, 's(\\d{3})lbl', 1) AS INTEGER) END AS s FROM u)"""


def _label_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(
        "source AS doc", "doc_id AS id",
        "concat('https://x/label/', 2000 + doc_id % 23, '/', doc_id % 50, 's', lpad(doc_id % 7, 3, '0'), 'lbl.pdf') AS pdf_url",
        "CASE WHEN doc_id % 4 = 0 THEN make_date(2020, CAST(1 + doc_id % 12 AS INT), 1) END AS document_date",
        "CASE WHEN doc_id % 5 = 0 THEN concat('S-0', doc_id % 9) END AS supplement_number")


@query("W3 F15 U2", f"""WITH {_DOCS} SELECT doc, id, row_number() OVER (PARTITION BY doc ORDER BY day DESC, s DESC, url DESC) = 1 AS is_latest FROM k""")
def latest_document(spark: SparkSession, sf: str) -> DataFrame:
    return versions.latest_document(_label_documents(spark, sf), ["doc"], "id").select("doc", "id", "is_latest")


_PI = """SELECT o_custkey AS doc, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS rev, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS dt, CAST(o_orderkey % 4 AS DOUBLE) AS v FROM orders"""


def _pi_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_custkey AS doc", "o_orderkey AS id", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS revision_date",
        "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS document_date", "CAST(NULL AS TIMESTAMP_NTZ) AS effective_date",
        "CAST(o_orderkey % 4 AS DOUBLE) AS version_number", "CAST(NULL AS TIMESTAMP_NTZ) AS retrieved_date")


@query("W5", f"WITH d AS ({_PI}) SELECT doc, id FROM d QUALIFY row_number() OVER (PARTITION BY doc ORDER BY rev DESC NULLS LAST, dt DESC NULLS LAST, v DESC, id) = 1")
def latest_product_information(spark: SparkSession, sf: str) -> DataFrame:
    return versions.latest_product_information(_pi_documents(spark, sf), ["doc"], "id").select("doc", "id")


@query("W6", f"""WITH d AS ({_PI}), s AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY doc ORDER BY id) = 1), m AS (SELECT doc, max(coalesce(rev, dt)) AS newest FROM d GROUP BY ALL)
SELECT doc, coalesce(coalesce(rev, dt) >= newest, TRUE) AS is_latest FROM s JOIN m USING (doc)""")
def latest_check(spark: SparkSession, sf: str) -> DataFrame:
    docs = _pi_documents(spark, sf)
    first = pick(docs, ["doc"], F.col("id"), largest=False)
    return versions.latest_check(docs, first, ["doc"]).select("doc", "is_latest")


@query("W19", """WITH s AS (SELECT source, doc_id, (length(lower(text)) - length(replace(lower(text), 'tion', ''))) // 4 + (length(lower(text)) - length(replace(lower(text), 'ung', ''))) // 3 AS hits FROM documents)
SELECT source, doc_id, CAST(hits AS INTEGER) AS hits FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY hits DESC, doc_id) = 1""")
def best_section(spark: SparkSession, sf: str) -> DataFrame:
    """Text with the most occurrences of the terms per source."""
    sections = table(spark, sf, "documents").selectExpr("source", "doc_id", "'' AS heading", "text")
    return versions.best_section(sections, ["source"], ["TION", "ung"], "doc_id").select(
        "source", "doc_id", F.col("hits").cast("int").alias("hits"))


@query("U6", """WITH p AS (SELECT split_part(url, '#', 1) AS page_url, page_id FROM pages) SELECT page_url, min(page_id) AS page_id FROM p GROUP BY ALL""")
def first_of_page(spark: SparkSession, sf: str) -> DataFrame:
    """First entry per page address, fragments ignored."""
    return table(spark, sf, "pages").groupBy(F.split("url", "#")[0].alias("page_url")).agg(F.min("page_id").alias("page_id"))
