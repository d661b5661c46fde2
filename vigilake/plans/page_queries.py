"""Crawled-page, feed, projection and folder queries.

Pages of the regulators are written from driver rows as HTML, JSON or XML, so
the parsers have to give the rows back; ``pages`` itself is parsed as well.
"""

from __future__ import annotations

from html import unescape
from html.entities import html5

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilake.operators import projections as pr
from vigilake.plans.registry import query, spread_table, table
from vigilake.sources import feeds, html, pages as src


def _page(spark: SparkSession, sf: str, body: str, url: str = "'https://www.fda.gov/x/list?q=1'") -> DataFrame:
    return spread_table(spark, sf, "part").selectExpr("p_partkey AS page_id", f"{url} AS url", f"concat('<html><body>', {body}, '</body></html>') AS html")


def _sql_unescaped(text: str) -> str:
    """SQL for a text whose character references are read as HTML reads them:
    names with or without their semicolon, the longest that fits, and numbers."""
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    names = sorted(html5, key=lambda n: (-len(n), n))
    named = f"MAP([{', '.join(quoted('&' + n) for n in names)}], [{', '.join(quoted(html5[n]) for n in names)}])"
    odd = {n: unescape(f"&#{n};") for n in range(160) if unescape(f"&#{n};") != chr(n)}
    numbered = f"MAP([{', '.join(map(str, odd))}], [{', '.join(map(quoted, odd.values()))}])"
    digits = "CASE WHEN lower(r) LIKE '&#x%' THEN try_cast('0x' || substr(rtrim(r, ';'), 4) AS BIGINT) ELSE try_cast(substr(rtrim(r, ';'), 3) AS BIGINT) END"
    number = f"""list_transform([{digits}], lambda n: CASE WHEN n IS NULL OR n > 1114111 OR n BETWEEN 55296 AND 57343 THEN chr(65533)
      WHEN n BETWEEN 64976 AND 65007 OR n & 65534 = 65534 THEN '' ELSE coalesce({numbered}[n], chr(CAST(n AS INTEGER))) END)[1]"""
    part = f"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&(?:{'|'.join(names)})|[^&]+|&"
    return f"""array_to_string(list_transform(regexp_extract_all({text}, {quoted(part)}),
      lambda r: CASE WHEN regexp_matches(r, '^&#[0-9xX]') THEN {number} WHEN r LIKE '&_%' THEN {named}[r] ELSE r END), '')"""


@query("F23", rf"""SELECT page_id, trim(regexp_replace({_sql_unescaped("regexp_extract(html, '<h1>(.*?)</h1>', 1)")}, '[\s\x0b\x1c-\x1f\x{{85}}\pZ]+', ' ', 'g')) AS title,
 CAST(len(regexp_extract_all(html, '<li>')) AS INTEGER) AS n_items, CAST(len(regexp_extract_all(html, '<a ')) AS INTEGER) AS n_links,
 CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS n_paragraphs FROM pages""")
def html_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Every page of the driver's crawl tokenized."""
    d = html.html_elements(spread_table(spark, sf, "pages"))
    n = lambda t: F.size(html.elements_of(t))
    return d.select("page_id", html.first_text("h1").alias("title"), n("li").alias("n_items"), n("a").alias("n_links"), n("p").alias("n_paragraphs"))


def _sql_cut(value: str) -> str:
    """SQL for what comes before the first heading or paragraph in which section
    17 starts. An end tag is marked, so that a search stays inside its element;
    all cuts are prefixes of one text, so the least is the shortest."""
    word, space = r"\pL\pM\p{Nd}\p{Pc}", r"[\s\x0b\x{85}\pZ]+"
    stop = rf"(?:17(?:[^{word}]|$)|PCI/PI/MG|Patient{space}Counseling|MEDICATION{space}GUIDE|How{space}should{space}I{space}use)"
    return "least(" + ", ".join(
        rf"""replace(regexp_replace(regexp_replace({value}, '(?i)(</{t}[\s\x0b\x{{85}}\pZ]*>)', chr(57344) || '\1', 'g'),
        '(?is)<{t}(?:[^{word}>][^>]*)?>(?:[^\x{{E000}}]*?[^\x{{E000}}{word}])??{stop}.*$', ''), chr(57344), '')"""
        for t in ("h4", "h5", "h6", "p", "strong", "b")) + ")"


@query("F23", rf"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_sql_cut("html")},
  '(?i)</?(html|body|nav|div|article|footer|h1)\b[^>]*>', '', 'g'), '(?i)<(p|b|ul|li|br)\s[^>]*>', '<\1>', 'g'), '<a href="([^"]*)"[^>]*>', '<a href="\1" target="_blank" rel="noopener noreferrer">', 'g'), '<p>\s*</p>', '', 'g')) AS html FROM
 (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<head>.*?</head>', ''), '(?is)<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>|<title\b.*?</title>|<!--.*?-->|<!doctype[^>]*>', '', 'g') AS html FROM pages)""")
def sanitize_html(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", html.sanitize_html(F.col("html")).alias("html"))


@query("S9", r"""WITH a AS (SELECT page_id, regexp_extract(url, '^https?://[^/]*', 0) AS host, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, host || href AS url FROM a WHERE NOT (starts_with(href, '#')) AND href <> '' GROUP BY ALL""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Absolute links of every crawled page, unique per page."""
    return src._anchors(spread_table(spark, sf, "pages")).select("page_id", "url").distinct()


@query("S9", """SELECT p_partkey AS page_id, v.url, CAST(v.rank AS INTEGER) AS rank, v.t AS discovery_type FROM part CROSS JOIN LATERAL (VALUES
 ('https://www.fda.gov/x/' || p_partkey || 'lbl.pdf', 0, 'path_b_direct'), ('https://accessdata.fda.gov/cder/daf/' || p_partkey, 1, 'path_a_intermediate'),
 ('https://www.fda.gov/more', 1, 'path_a_intermediate')) v(url, rank, t)""")
def discover_links(spark: SparkSession, sf: str) -> DataFrame:
    body = """'<a href="/more">Full <b>Prescribing</b> Information</a><a href="#x">label</a><a href="', p_partkey, 'lbl.pdf">', p_name, '</a><a href="', p_partkey, 'lbl.pdf">again</a>
      <a href="https://accessdata.fda.gov/cder/daf/', p_partkey, '">go</a><a href="https://evil.com/lbl.pdf">label</a><a href="mailto:a@b.c">label</a><a href="/other">other</a>'"""
    return src.discover_links(_page(spark, sf, body)).select("page_id", "url", "rank", "discovery_type")


@query("S10", """SELECT p_partkey AS page_id, v.* FROM part CROSS JOIN LATERAL (VALUES
 ('https://www.fda.gov/label/20' || (10 + p_size % 10) || '/0211s007lbl.pdf', '01/02/2024', 's007', '20' || (10 + p_size % 10) || '-s007', p_name),
 ('https://www.fda.gov/label/2012/0300s001lbl.pdf', '01/02/2024', 's001', '2012-s001', p_type || ' label'),
 ('https://www.fda.gov/x/two.pdf', NULL, NULL, NULL, 'the Label')) v(pdf_url, document_date, supplement_number, version, document_title)""")
def discover_documents(spark: SparkSession, sf: str) -> DataFrame:
    body = """'<table><tr><td>01/02/2024</td><td><a href="/label/20', 10 + p_size % 10, '/0211s007lbl.pdf">', p_name, '</a> <a href="/label/2012/0300s001lbl.pdf">', p_type, ' label</a></td></tr></table><p><a href="two.pdf">the  Label</a> <a href="three.pdf">x</a></p>'"""
    return src.discover_documents(_page(spark, sf, body)).drop("ordinal")


@query("S4", """SELECT p_partkey AS page_id, CAST(v.o AS INTEGER) AS ordinal, v.n AS drug_name, v.i AS active_ingredient, v.a AS application_number, v.d AS source_date, v.u AS detail_url, v.s AS source
FROM part CROSS JOIN LATERAL (VALUES (0, p_name, p_type, 'NDA-' || p_partkey, '01/02/2024', 'https://www.fda.gov/x/detail?id=' || p_partkey, 'FDA_SRLC', 0), (1, p_brand, p_type, 'BLA7', '03/04/2024', 'http://d/' || p_size, 'FDA_SRLC', 0),
 (0, p_name, NULL, NULL, NULL, NULL, 'autocomplete', 1)) v(o, n, i, a, d, u, s, k) WHERE v.k = CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END""")
def parse_search_results(spark: SparkSession, sf: str) -> DataFrame:
    rows = """'<table id="example"><tr><th>Drug Name</th><th>Active Ingredient</th><th>App</th></tr><tr><td><a href="detail?id=', p_partkey, '">', p_name, '</a></td><td>', p_type, '</td><td>', p_partkey,
      '</td><td>NDA</td><td>01/02/2024</td><td>x</td></tr><tr><td>', p_brand, '<td>', p_type, '<td>BLA7<td>BLA<td>03/04/2024<td>x<td>http://d/', p_size, '</tr><tr><td>No data available in table</td><td></td><td></td></tr></table>'"""
    options = """'<datalist><option value="Drug Name: ', p_name, '"></option><option>Active Ingredient: x</option></datalist>'"""
    body = f"CASE WHEN p_size % 3 = 0 THEN concat({options}) ELSE concat({rows}) END"
    return src.parse_search_results(_page(spark, sf, body)).select(
        "page_id", "ordinal", "drug_name", "active_ingredient", "application_number", "source_date", "detail_url", "source")


@query("S5 F14 F24 A16", """SELECT p_partkey AS page_id, p_name AS drug_name, 'NDA-' || p_partkey AS application_number, p_type AS active_ingredient, v.* FROM part CROSS JOIN LATERAL (VALUES
 ('Warnings and Precautions', 'SUPPL-' || p_size, '2024-01-02', NULL, '<u>' || p_type || '</u> risk' || chr(10) || chr(10) || '• one' || chr(10) || chr(10) || '• two', 'https://x/a.pdf'),
 ('Adverse Reactions', 'SUPPL-' || p_size, '2024-01-02', 'old ' || p_name, 'new ' || p_type, 'https://x/a.pdf'),
 ('Use in Specific Populations', p_name || '-12/31/2023', '2023-12-31', NULL, '8.1 Pregnancy' || chr(10) || p_name, 'https://www.fda.gov/x/list?q=1')) v(section, source_record_id, day, original_text, updated_text, source_url)""")
def parse_detail_page(spark: SparkSession, sf: str) -> DataFrame:
    body = """'<h2>', p_name, ' (NDA-', p_partkey, ')</h2><h4>(', p_type, ')</h4><div id="accordion"><h3>01/02/2024 (SUPPL-', p_size, ')</h3><div><a href="https://x/a.pdf">Label</a>
      <h4>5 Warnings and Precautions</h4><p><u>', p_type, '</u> risk</p><ul><li>one</li><li>two</ul><h4>6 Adverse Reactions</h4><p>Original Text: old ', p_name, '</p><p>Updated Text: new ', p_type, '</p><p>17 dropped</p>
      <h4>17 PCI/PI/MG</h4><p>gone</p><h4>7 Drug Interactions</h4><p>gone</p></div><h3>December 31, 2023</h3><div><h4>8 Use in Specific Populations</h4><p>8.1 Pregnancy</p><p>', p_name, '</p></div><h3>no date</h3><div><h4>6 Adverse Reactions</h4><p>x</p></div></div>'"""
    d = src.parse_detail_page(_page(spark, sf, body))
    return d.select("page_id", "drug_name", "application_number", "active_ingredient", "section", "source_record_id",
                    F.date_format("source_date", "yyyy-MM-dd").alias("day"), "original_text", "updated_text", "source_url")


@query("S6 X7 F30 F31", """SELECT p_partkey AS page_id, v.* FROM part CROSS JOIN LATERAL (VALUES
 ('Announcement of ' || p_name, 'https://www.fda.gov/a1', '2026-08-01', 'Announcement of ' || p_name, '', '', 'ANNOUNCEMENT'),
 (p_name || ' (' || p_type || ')', 'https://www.fda.gov/a2#x', '2026-08-01', 'Monthly recap', '', '', 'MONTHLY_RECAP'),
 (p_brand, 'https://www.fda.gov/a3', '2026-08-01', 'New things', 'Safety brief', '', 'SAFETY_BRIEF'),
 ('deep', 'https://www.fda.gov/a4', '2026-07-01', 'One', 'Two', 'Product monograph updates', 'PRODUCT_MONOGRAPH_UPDATE')) v(article_title, article_url, day, category_level1, category_level2, category_level3, article_type)""")
def parse_newsletter_index(spark: SparkSession, sf: str) -> DataFrame:
    body = """'<main><h2 id="a1">Health Product InfoWatch</h2><h3>August 2026</h3><ul><li><a href="/a1">Announcement of ', p_name, '</a></li><li><a href="/r">Monthly recap</a><ul><li><a href="/a2#x">', p_name, ' (', p_type, ')</a></li><li><a href="/s">Scope</a></li></ul></li>
      <li>New things<ul><li><a href="/b">Safety brief</a><ul><li><a href="/a3">', p_brand, '</a></li></ul></li></ul></li></ul><h3>July 2026</h3><ul><li><a href="/1">One</a><ul><li><a href="/2">Two</a><ul><li><a href="/3">Product monograph updates</a><ul><li><a href="/a4">deep</a></li></ul></li></ul></li></ul></li></ul></main>'"""
    d = src.parse_newsletter_index(_page(spark, sf, body))
    return d.select("page_id", "article_title", "article_url", F.date_format("publication_date", "yyyy-MM-dd").alias("day"),
                    "category_level1", "category_level2", "category_level3", "article_type").withColumn(
        "category_level1", F.when(F.col("category_level1").startswith("New things"), "New things").otherwise(F.col("category_level1")))


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    body = """'<h1>', p_name, ' update</h1><p>Published: August 3, 2026 by the newsletter team</p><h2>Scope</h2><p>Hidden (never a product) mention in a structural section</p><h2>New data</h2><p>Brand', p_partkey, ' (', lower(p_type),
      ' acid) was linked with harm in reports.</p><p>short</p><p>All ', p_name, '-containing products are under review now.</p><a href="/files/', p_partkey, '.pdf">pdf</a><table><tr><td>a</td><td>b</td></tr></table>'"""
    return src.parse_article(_page(spark, sf, body))


@query("S7", """SELECT p_partkey AS page_id, p_name || ' update' AS title, '2026-08-03' AS day, 'https://www.fda.gov/files/' || p_partkey || '.pdf' AS pdfs, p_name || ' update|Scope|New data' AS headings,
 'Brand' || p_partkey || ' (' || lower(p_type) || ' acid) was linked with harm in reports.' || chr(10) || 'short' || chr(10) || 'All ' || p_name || '-containing products are under review now.' AS last_text FROM part""")
def parse_article(spark: SparkSession, sf: str) -> DataFrame:
    return _articles(spark, sf).select(
        "page_id", "title", F.date_format("publication_date", "yyyy-MM-dd").alias("day"), F.array_join("pdf_urls", ",").alias("pdfs"),
        F.array_join(F.transform("sections", lambda s: s["heading"]), "|").alias("headings"), F.element_at("sections", -1)["text"].alias("last_text"))


@query("A6 U2", """SELECT p_partkey AS page_id, v.* FROM part CROSS JOIN LATERAL (VALUES (p_brand, 'seed', ''), ('New data' || chr(10) || 'Brand' || p_partkey, lower(p_type) || ' acid', 'New data'), ('', 'short' || chr(10) || 'All ' || p_name, 'New data')) v(product_name, generic_name, section_heading)""")
def product_mentions(spark: SparkSession, sf: str) -> DataFrame:
    seeds = table(spark, sf, "part").selectExpr("p_partkey AS page_id", "p_brand AS product_name", "'seed' AS generic_name")
    return src.product_mentions(_articles(spark, sf).join(seeds, "page_id")).select("page_id", "product_name", "generic_name", "section_heading")


@query("S8", """SELECT p_partkey AS page_id, v.* FROM part CROSS JOIN LATERAL (VALUES (p_name || ' (' || lower(p_type) || ')', 'https://www.fda.gov/p1', 'Sponsor AUST R 1234' || (p_partkey % 10), '2026-02-18', 'AUST R 1234' || (p_partkey % 10), p_type),
 (p_brand || ' (PI)', 'https://www.fda.gov/x/p2', '', NULL, NULL, NULL)) v(title, url, snippet, day, artg_number, active_ingredient)""")
def parse_site_search(spark: SparkSession, sf: str) -> DataFrame:
    body = """'<main><article><h3><a href="/p1">', p_name, ' (', lower(p_type), ')</a></h3><p class="snippet">Sponsor AUST R 1234', p_partkey % 10, '</p><time class="date">18 February 2026</time></article>
      <div class="views-row"><a href="p2">', p_brand, ' (PI)</a></div><div class="other"><a href="p3">no</a></div></main>'"""
    return src.parse_site_search(_page(spark, sf, body)).select(
        "page_id", "title", "url", "snippet", F.date_format("source_date", "yyyy-MM-dd").alias("day"), "artg_number", "active_ingredient")


@query("S11", """SELECT p_partkey AS drug_code, p_name AS brand_name, p_type || ' ' || p_size || ' mg/ml; ' || p_brand AS active_ingredient, CASE WHEN p_size % 2 = 0 THEN 'Tablet, Kit' ELSE '' END AS form,
 'Oral' AS route, CASE WHEN p_size % 3 = 0 THEN 'Approved' ELSE 'Marketed' END AS status, CASE WHEN p_size % 3 = 0 THEN '2024-02-02' ELSE '2020-01-01' END AS status_date FROM part""")
def read_product_json(spark: SparkSession, sf: str) -> DataFrame:
    """JSON documents of five feeds joined on the drug code."""
    part = table(spark, sf, "part")
    docs = part.select(F.to_json(F.struct(F.col("p_partkey").alias("drug_code"), F.col("p_name").alias("brand_name"))).alias("j"))
    products = docs.select(F.from_json("j", "drug_code LONG, brand_name STRING").alias("r")).select("r.*").withColumn("last_update_date", F.lit("2020-01-01"))
    ingredients = part.selectExpr("p_partkey AS drug_code", "inline(array(named_struct('ordinal', 0, 'ingredient_name', concat(' ', p_type), 'strength', CAST(p_size AS STRING), 'strength_unit', 'mg', 'dosage_unit', 'ml'),"
                                  " named_struct('ordinal', 1, 'ingredient_name', p_brand, 'strength', '', 'strength_unit', '', 'dosage_unit', '')))")
    statuses = part.where("p_size % 3 = 0").selectExpr("p_partkey AS drug_code", "inline(array(struct('Dormant' AS status, '2021-01-01' AS history_date), struct('Approved' AS status, '2024-02-02' AS history_date)))")
    forms = part.where("p_size % 2 = 0").selectExpr("p_partkey AS drug_code", "posexplode(array('Tablet ', 'Kit')) AS (ordinal, pharmaceutical_form_name)")
    routes = part.selectExpr("p_partkey AS drug_code", "0 AS ordinal", "'Oral' AS route_of_administration_name")
    return feeds.read_product_json(products, ingredients, statuses, forms, routes).drop("last_update_date")


@query("S12", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE 'Q' END AS brand_name, '' AS active_ingredient, CASE WHEN event_id % 2 = 0 THEN 'NDA' || event_id ELSE '' END AS application_number, '' AS sponsor FROM events""")
def label_metadata(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "events").selectExpr("event_id", "CASE WHEN event_id % 2 = 0 THEN concat('{\"openfda\": {\"brand_name\": [\"', event_type, '\", \"x\"], \"generic_name\": [], \"application_number\": [\"NDA', event_id, '\"]}}') ELSE '{}' END AS json")
    return feeds.label_metadata(docs, "json", F.lit("q"))


@query("S12", """SELECT event_id, 'FDA-RECALL' AS recall_number, event_type AS classification, 'k' || regexp_extract(props, '\\d+') AS reason, 'Manufacturer' AS firm, '' AS date FROM events""")
def recalls(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "events").selectExpr("event_id", "to_json(named_struct('classification', event_type, 'reason_for_recall', concat('k', get_json_object(props, '$.k')))) AS json")
    return feeds.recalls(docs, "json")


@query("S12", """SELECT event_id, CAST(event_id AS VARCHAR) AS report_id, 'a,' || event_type || ',c,d,e' AS reactions FROM events""")
def adverse_events(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "events").selectExpr(
        "event_id", "concat('{\"safetyreportid\": \"', event_id, '\", \"patient\": {\"reaction\": [{\"reactionmeddrapt\": \"a\"}, {\"reactionmeddrapt\": \"\"}, {\"reactionmeddrapt\": \"', event_type, '\"}, {\"reactionmeddrapt\": \"c\"}, {\"reactionmeddrapt\": \"d\"}, {\"reactionmeddrapt\": \"e\"}]}}') AS json")
    return feeds.adverse_events(docs, "json").select("event_id", "report_id", F.array_join("reactions", ",").alias("reactions"))


@query("S13", """SELECT p_partkey AS feed_id, v.* FROM part CROSS JOIN LATERAL (VALUES (0, p_name, 'https://x/' || p_partkey, 'about ' || p_type), (1, 'second', 'portal', '')) v(ordinal, title, url, summary)""")
def rss_items(spark: SparkSession, sf: str) -> DataFrame:
    xml = table(spark, sf, "part").selectExpr(
        "p_partkey AS feed_id", "concat('<rss><channel><item><title> ', p_name, '</title><link>https://x/', p_partkey, '</link><description>about ', p_type, '</description></item><item><title>second</title></item></channel></rss>') AS xml")
    return feeds.rss_items(xml, portal="portal").select("feed_id", "ordinal", "title", "url", "summary")


@query("S13 U2", """WITH a AS (SELECT p_partkey AS o, 'https://x/' || p_size AS url, 0 AS l FROM part WHERE split_part(p_name, ' ', 2) = 'ring' OR p_type = 'RING' UNION ALL
  SELECT p_partkey, 'https://x/' || (p_size + 25), 1 FROM part WHERE split_part(p_name, ' ', 2) = 'ring') SELECT url, CAST(arg_min(o, l * 1000000000000 + o) AS BIGINT) AS ordinal FROM a GROUP BY ALL""")
def read_feed_items(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    rss = part.selectExpr("p_partkey AS ordinal", "concat('News on ', p_name) AS title", "concat('https://x/', p_size) AS url", "p_type AS summary")
    listed = part.selectExpr("p_partkey AS ordinal", "concat('Communication ', p_name) AS title", "concat('https://x/', p_size + 25) AS url", "'' AS summary")
    return feeds.read_feed_items(rss, listed, F.lit("Ring")).select("url", "ordinal")


@query("J16", """WITH c AS (SELECT p_size AS drug_id, 'u' || p_partkey AS source_url, 'News: ' || p_name AS change_type FROM part), l AS (SELECT p_size % 25 AS drug_id, 'u' || (p_partkey + 1) AS url, p_name AS title FROM part)
SELECT drug_id, url, title FROM l WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.drug_id = l.drug_id AND (c.source_url = l.url OR contains(c.change_type, l.title)))""")
def new_articles(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    curated = part.selectExpr("p_size AS drug_id", "concat('u', p_partkey) AS source_url", "concat('News: ', p_name) AS change_type")
    live = part.selectExpr("p_size % 25 AS drug_id", "concat('u', p_partkey + 1) AS url", "p_name AS title")
    return feeds.new_articles(curated, live)


@query("U4", """SELECT p_partkey AS id, 1 AS n FROM part UNION ALL SELECT p_partkey, 2 FROM part""")
def union_of_sources(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    a = part.selectExpr("p_partkey AS id", "p_name AS title", "1 AS n")
    b = part.selectExpr("2 AS n", "p_partkey AS id")
    return a.unionByName(b, allowMissingColumns=True).select("id", "n")


# ---------------------------------------------------------------------------
# Projections

@query("PR2", """SELECT drug_name, section, source_date, source_record_id, updated_text, fda_comment FROM (
 SELECT 'd' || p_partkey AS drug_name, v.* FROM part CROSS JOIN LATERAL (VALUES ('Warnings and Precautions', '01/02/2024', 'S1', p_name, 'Approved Label PDF: u', 0), ('Adverse Reactions', '01/02/2024', 'S1', p_type, 'Approved Label PDF: u', p_size % 2),
  ('Adverse Reactions', '12/31/2023', 'd' || p_partkey || '-12/31/2023', 'old ' || p_name, NULL, 0)) v(section, source_date, source_record_id, updated_text, fda_comment, skip) WHERE skip = 0)""")
def srlc_changes(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    latest = part.selectExpr("concat('d', p_partkey) AS drug_name", "'u0' AS detail_url", "'01/02/2024' AS date_str", "'S1' AS supplement_number", "'u' AS document_url",
                             "p_name AS warnings", "CASE WHEN p_size % 2 = 0 THEN p_type END AS adverse", "CAST(NULL AS STRING) AS populations")
    older = part.selectExpr("concat('d', p_partkey) AS drug_name", "'u0' AS detail_url", "'' AS document_url", "CAST(NULL AS STRING) AS supplement_id",
                            "inline(array(struct('12/31/2023' AS date_str, '6 Adverse Reactions' AS raw_section, concat('old ', p_name) AS text), struct('12/31/2023' AS date_str, '17 Guide' AS raw_section, 'x' AS text), struct('01/02/2024' AS date_str, '6 Adverse Reactions' AS raw_section, 'y' AS text)))")
    return pr.srlc_changes(latest, older).select("drug_name", "section", "source_date", "source_record_id", "updated_text", "fda_comment")


@query("PR3 X9 F19", """SELECT p_partkey AS page_id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS display_name, 'Safety Brief' AS section, substr(sha256('https://a/' || p_partkey || '|' || CASE WHEN p_size % 2 = 0 THEN p_name ELSE lower(p_brand) END), 1, 32) AS source_record_id,
 CASE WHEN p_size % 2 = 0 THEN 'ctx ' || p_type || chr(10) || chr(10) || '[PDF content]' || chr(10) || repeat('p', 5000) ELSE repeat(p_name || ' ', 400) || chr(10) || chr(10) || '[PDF content]' || chr(10) || repeat('p', 5000) END AS updated_text,
 'Health Canada InfoWatch — August 2026' AS fda_comment FROM part""")
def newsletter_changes(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    articles = part.selectExpr("p_partkey AS page_id", "concat('https://a/', p_partkey) AS article_url", "'SAFETY_BRIEF' AS article_type", "DATE'2026-08-01' AS publication_date", "'August' AS month", "2026 AS year", "'InfoWatch' AS newsletter_type",
                               "p_brand AS product_name", "p_type AS generic_name", "repeat(concat(p_name, ' '), 400) AS full_text", "repeat('p', 5000) AS pdf_text")
    mentions = part.where("p_size % 2 = 0").selectExpr("p_partkey AS page_id", "p_name AS product_name", "p_type AS generic_name", "concat('ctx ', p_type) AS context_text")
    return pr.newsletter_changes(mentions, articles, "https://index").select("page_id", "display_name", "section", "source_record_id", "updated_text", "fda_comment")


@query("PR4", """SELECT p_partkey || p_name AS product_name, v.* FROM part CROSS JOIN LATERAL (VALUES ('Use in Specific Populations', 'TGA-PI-4.6-' || upper(sha256(p_partkey || p_name || '|4.6|' || p_type)), p_type, 'T46' || chr(10) || 'Pages: N/A' || chr(10) || 'Document Date: 2026-01-02' || chr(10) || chr(10) || p_type),
 ('Adverse Reactions', 'TGA-PI-4.8-' || upper((sha256(p_partkey || p_name || '|4.8|' || p_brand || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || '### Cap (Page 3)' || chr(10) || '| m |' ELSE ' | m | x' END))),
  p_brand || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || '### Cap (Page 3)' || chr(10) || '| m |' ELSE ' | m | x' END,
  'T48' || chr(10) || 'Pages: 18–20' || chr(10) || 'Document Date: 2026-01-02' || chr(10) || chr(10) || p_brand || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || '### Cap (Page 3)' || chr(10) || '| m |' ELSE ' | m | x' END)) v(section, source_record_id, original_text, updated_text)""")
def tga_changes(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "part").selectExpr(
        "concat(p_partkey, p_name) AS product_name", "'u' AS pdf_url", "'2026-01-02T00:00:00' AS doc_date", "CAST(NULL AS STRING) AS rev_date", "'T46' AS title_46", "p_type AS text_46", "'' AS pages_46", "'T48' AS title_48",
        "CASE WHEN p_size % 2 = 0 THEN p_brand ELSE concat(p_brand, ' | m | x') END AS text_48", "'18–20' AS pages_48", "array(struct('Cap' AS caption, 3 AS page, '| m |' AS markdown)) AS tables")
    return pr.tga_changes(docs).select("product_name", "section", "source_record_id", "original_text", "updated_text")


@query("PR5", """SELECT p_name AS display_name, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'QUERY' END AS active_ingredient, CASE p_size % 3 WHEN 0 THEN 'AUST R' WHEN 1 THEN 'AUST R 123' ELSE 'AUST L 9' END AS application_number,
 'TGA-' || upper(sha256('u' || p_partkey)) AS source_record_id, p_name || chr(10) || chr(10) || p_brand AS updated_text FROM part""")
def tga_metadata_rows(spark: SparkSession, sf: str) -> DataFrame:
    results = table(spark, sf, "part").selectExpr("p_name AS title", "concat('u', p_partkey) AS url", "p_brand AS snippet", "CAST(NULL AS TIMESTAMP_NTZ) AS source_date",
                                                  "CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN '123' ELSE 'AUST L 9' END AS artg_number", "CASE WHEN p_size % 2 = 0 THEN p_type END AS active_ingredient")
    now = F.lit("2026-01-01").cast("timestamp_ntz")
    return pr.tga_metadata_rows(results, F.lit("query"), now).select("display_name", "active_ingredient", "application_number", "source_record_id", "updated_text")


@query("PR6", """SELECT p_partkey AS article_id, v.section, v.t AS change_type, v.r AS source_record_id, v.c AS fda_comment FROM part CROSS JOIN LATERAL (VALUES
 ('Adverse Reactions', 'Official Prescribing Information (Section 6)', 'MW-LBL-' || p_name || '-SEC6', 'Official FDA Prescribing Information PDF: d (Pages: 4-9 | Subsections: 2 | Tables: 1)', p_size % 3 = 0),
 ('Adverse Reactions', 'Official Prescribing Information (Section 6 Not Found)', 'MW-LBL-' || p_name || '-SEC6-NF', 'Official FDA Prescribing Information PDF: d (Status: ADVERSE_REACTIONS_SECTION_NOT_FOUND)', p_size % 3 = 1),
 ('Adverse Reactions', 'Official Prescribing Information (Extraction Failed)', 'MW-LBL-' || p_name || '-PDF-FAIL', 'Official FDA Prescribing Information PDF: d (Status: PDF_EXTRACTION_FAILED)', p_size % 3 = 2),
 ('Warnings and Precautions', 'Official Prescribing Information (Section 5)', 'MW-LBL-' || p_name || '-SEC5', 'Official FDA Prescribing Information PDF: d (Page: 3)', p_size % 3 = 0),
 ('MedWatch Safety Communication', 'FDA MedWatch Alert: ' || repeat(p_brand || ' ', 20), 'MW-ART-' || md5('u' || p_partkey), 'Official FDA MedWatch Safety Communication.', TRUE),
 ('FDA Recall Notice (Class I)', 'FDA Recall: R-' || p_type, 'MW-RECALL-R-' || p_type, 'FDA Enforcement Notice for ' || p_name || '.', p_name = 'red ring')) v(section, t, r, c, ok)
 JOIN (VALUES (0)) z(z) ON ok WHERE v.section <> 'FDA Recall Notice (Class I)'
UNION ALL SELECT a.p_partkey, 'FDA Recall Notice (Class I)', 'FDA Recall: R-' || r.p_partkey, 'MW-RECALL-R-' || r.p_partkey, 'FDA Enforcement Notice for ' || a.p_name || '.' FROM part a JOIN (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY ALL) r ON a.p_name = r.p_name""")
def medwatch_changes(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    articles = part.selectExpr(
        "p_partkey AS article_id", "p_name AS product", "repeat(concat(p_brand, ' '), 20) AS title", "'' AS summary", "concat('u', p_partkey) AS url", "'2026-01-01' AS publication_date", "'d' AS pdf_url", "'2025-01-01' AS document_date",
        "CASE WHEN p_size % 3 = 0 THEN p_type END AS adverse", "CASE p_size % 3 WHEN 1 THEN 'ADVERSE_REACTIONS_SECTION_NOT_FOUND' WHEN 2 THEN 'PDF_EXTRACTION_FAILED' ELSE 'OK' END AS adverse_status",
        "CASE WHEN p_size % 3 = 0 THEN 'w' END AS warnings", "'' AS pregnancy", "'4-9' AS pages_6", "'3' AS pages_5", "'' AS pages_8", "2 AS n_subsections", "1 AS n_tables")
    notices = part.groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey")).selectExpr("p_name AS product", "concat('R-', p_partkey) AS recall_number", "'Class I' AS classification", "'x' AS reason", "'y' AS firm")
    return pr.medwatch_changes(articles, notices).select("article_id", "section", "change_type", "source_record_id", "fda_comment")


@query("PR7", """SELECT p_name AS brand_name, 'Product Monograph Update' AS section, substr(sha256(p_partkey || '|' || p_name || '|monograph'), 1, 32) AS source_record_id, 'Health Canada Product Monograph for ' || p_name || '.' || chr(10) || chr(10) || 'Drug Identification Number (DIN): ' || p_partkey || chr(10) || chr(10) || 'Manufacturer / Sponsor: co' || chr(10) || chr(10)
 || 'Active Ingredient(s): ' || p_type || chr(10) || chr(10) || 'Dosage Form: ' || chr(10) || chr(10) || 'Route of Administration: ' || chr(10) || chr(10) || 'Regulatory Status: Marketed (as of 2020)' || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || 'Official Product Monograph Document: https://m/' || p_partkey || '.PDF' ELSE '' END AS updated_text FROM part
UNION ALL SELECT coalesce(f.n, 'Q ' || (p_size + 25)), 'Adverse Reaction Information', substr(sha256('r' || p_partkey || '|' || p_brand), 1, 32), p_brand || chr(10) || chr(10) || p_brand FROM part LEFT JOIN (SELECT p_size AS q, arg_min(p_name, p_partkey) AS n FROM part GROUP BY ALL) f ON q = p_size + 25""")
def monograph_rows(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    products = part.selectExpr("concat('q ', p_size) AS request", "p_partkey AS rank", "p_name AS brand_name", "CAST(p_partkey AS STRING) AS din", "'co' AS company", "p_type AS active_ingredient", "'' AS form", "'' AS route", "'Marketed' AS status", "'2020' AS status_date",
                               "CASE WHEN p_size % 2 = 0 THEN concat('https://m/', p_partkey, '.PDF') END AS monograph_url", "'https://p' AS page_url")
    alerts = part.selectExpr("concat('q ', p_size + 25) AS request", "p_brand AS title", "concat('r', p_partkey) AS url", "'2024' AS date", "'' AS description")
    return pr.monograph_rows(products, alerts).select("brand_name", "section", "source_record_id", "updated_text")


@query("PR8", """SELECT p_name || repeat('x', 150) AS change_type, 'MHRA-DSU-' || md5(p_name || repeat('x', 150)) AS source_record_id, p_name || repeat('x', 150) || '. ' || p_type || '. Guidance issued by the UK MHRA and the Commission on Human Medicines.' AS updated_text FROM part""")
def bulletin_rows(spark: SparkSession, sf: str) -> DataFrame:
    articles = table(spark, sf, "part").selectExpr("concat(p_name, repeat('x', 150)) AS title", "'u' AS url", "'May' AS date", "p_type AS description")
    return pr.bulletin_rows(articles).select("change_type", "source_record_id", "updated_text")


# ---------------------------------------------------------------------------
# Folders of files, held as rows

def _files(spark: SparkSession, sf: str, shift: int) -> DataFrame:
    """Documents as files; a third each unchanged, touched and rewritten."""
    return table(spark, sf, "documents").selectExpr(
        "doc_id", "concat('/in/', doc_id, '.pdf') AS path", "concat(doc_id, '.pdf') AS filename",
        f"doc_id + CASE WHEN doc_id % 3 = 0 THEN 0 ELSE {shift} END AS mtime", "length(text) AS size",
        f"sha2(concat(text, CASE WHEN doc_id % 3 = 2 THEN '{shift}' ELSE '' END), 256) AS file_hash", "'success' AS status")


def _read(files: DataFrame) -> DataFrame:
    """Some of the rewritten files cannot be read and have no hash."""
    return files.withColumn("file_hash", F.expr("CASE WHEN doc_id % 3 = 2 AND doc_id % 7 = 3 THEN NULL ELSE file_hash END"))


@query("S14 G13", """SELECT doc_id || '.pdf' AS filename, CASE doc_id % 3 WHEN 0 THEN 'unmodified' WHEN 1 THEN 'hash_match' ELSE CASE WHEN doc_id % 7 = 3 THEN 'errored' ELSE 'processed' END END AS outcome FROM documents""")
def scan_folder(spark: SparkSession, sf: str) -> DataFrame:
    new = _read(_files(spark, sf, 5))
    return feeds.scan_outcome(new.drop("file_hash", "status"), new, _files(spark, sf, 0)).select("filename", "outcome")


@query("G13", """SELECT count(*) FILTER (doc_id % 3 = 2 AND doc_id % 7 = 3) AS files_errored, 'completed_with_errors' AS status,
 CAST(max(doc_id) + 2 - min(doc_id) AS DOUBLE) AS duration_seconds, count(*) AS files_scanned, count(*) FILTER (doc_id % 3 = 2 AND doc_id % 7 <> 3) AS files_processed, count(*) FILTER (doc_id % 3 <> 2) AS files_skipped FROM documents""")
def scan_metrics(spark: SparkSession, sf: str) -> DataFrame:
    new = _read(_files(spark, sf, 5)).selectExpr("*", "timestamp_seconds(mtime - 5 * CAST(doc_id % 3 <> 0 AS INT)) AS started_at",
                                                 "timestamp_seconds(doc_id + 2) AS finished_at")
    return feeds.scan_metrics(feeds.scan_outcome(new.drop("file_hash", "status"), new, _files(spark, sf, 0)))


@query("S14 T1", """SELECT doc_id || '.pdf' AS filename FROM documents WHERE doc_id % 3 <> 0""")
def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.changed_files(_files(spark, sf, 5), _files(spark, sf, 0)).select("filename")


@query("C10", """WITH b AS (SELECT p_brand || CASE WHEN p_size < 20 THEN '' ELSE ' new' END AS filename, max(p_partkey) AS k FROM part GROUP BY ALL), c AS (SELECT p_brand AS filename, min(p_partkey) AS k FROM part GROUP BY ALL)
SELECT filename, coalesce(b.k, c.k) AS version FROM c FULL JOIN b USING (filename)""")
def upsert_product_section(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    current = part.groupBy(F.col("p_brand").alias("filename")).agg(F.min("p_partkey").alias("version")).withColumn("target_section", F.lit("16"))
    batch = part.selectExpr("concat(p_brand, CASE WHEN p_size < 20 THEN '' ELSE ' new' END) AS filename", "'16' AS target_section", "p_partkey AS version", "p_partkey AS seq")
    return feeds.upsert_product_sections(current, batch).select("filename", "version")
