"""Crawled pages → result rows, dated sections, index entries, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilake.functions.classify import classify_article, title_brand_generic
from vigilake.functions.dates import month_year_to_date, parse_label_date, parse_register_date
from vigilake.functions.sections import (
    clean_adverse_text, clean_general_text, is_whitelisted, pregnancy_subsections, section_kind, split_original_updated,
)
from vigilake.functions.text import normalize_drug_name, record, squeeze, strip, text
from vigilake.operators.skew import pick
from vigilake.sources.html import around, cells_of, elements_of, host_of, html_elements, resolve_url, rich_of, text_of, with_text

STOP_PARAGRAPH = r"(?iU)\b(?:17\b|PCI/PI/MG|Patient\s+Counseling|MEDICATION\s+GUIDE|How\s+should\s+I\s+use)"


def parse_search_results(pages: DataFrame) -> DataFrame:
    """Candidate rows of result tables; where a page has none, the drug names
    of its option list. pages: page_id, url, html."""
    d = html_elements(pages)
    heads = F.transform(F.flatten(F.transform(elements_of("tr"), cells_of)), F.lower)
    is_result = F.exists(heads, lambda h: h.contains("drug name")) & F.exists(
        heads, lambda h: h.contains("active ingredient") | h.contains("application"))
    rows = F.transform(F.filter(elements_of("tr"), lambda e: (F.size(e["cells"]) >= 3)), lambda e: record(cells=cells_of(e), links=e["links"]))

    def cell(e: Column, i: int) -> Column:
        return F.get(e["cells"], F.lit(i))

    def candidate(e: Column) -> Column:
        number, kind = cell(e, 2), cell(e, 3)
        typed = (text(kind) != "") & (text(number) != "") & ~F.startswith(number, kind)
        link = F.coalesce(F.get(e["links"], F.lit(0)), F.when(F.startswith(cell(e, 6), F.lit("http")), cell(e, 6)))
        return record(
            drug_name=cell(e, 0), active_ingredient=cell(e, 1),
            application_number=F.when(typed, F.concat_ws("-", kind, number)).otherwise(number),
            source_date=cell(e, 4), database_updated=cell(e, 5), href=link, source=F.lit("FDA_SRLC"))

    noise = ("drug name", "no data available in table", "")
    table_rows = F.filter(F.transform(rows, candidate), lambda r: ~F.lower(r["drug_name"]).isin(*noise))
    none = F.lit(None).cast("string")
    options = F.transform(
        F.filter(
            F.transform(elements_of("option"), lambda e: F.coalesce(F.nullif(strip(e["href"]), F.lit("")), text_of(e))),
            lambda v: F.lower(strip(F.split(v, ":")[0])) == "drug name"),
        lambda v: record(
            drug_name=strip(F.substring_index(v, ":", -1)), active_ingredient=none, application_number=none,
            source_date=none, database_updated=none, href=none, source=F.lit("autocomplete")))
    chosen = F.when(is_result & (F.size(table_rows) > 0), table_rows).otherwise(options)
    d = d.select("page_id", "url", F.posexplode(chosen).alias("ordinal", "r")).select("page_id", "url", "ordinal", "r.*")
    return d.withColumn("detail_url", F.when(F.col("href").isNotNull(), resolve_url(F.col("url"), F.col("href")))).drop("href")


def parse_detail_page(pages: DataFrame) -> DataFrame:
    """One row per supplement and whitelisted section of drug detail pages."""
    d = html_elements(pages)
    name_pattern = r"(?U)^([^(]+?)\s*\(\s*([A-Za-z]+[\s\-]?\d+)\s*\)"
    heads = F.transform(elements_of(("h2", "h3")), text_of)
    titled = F.get(F.filter(heads, lambda h: F.rlike(h, F.lit(name_pattern))), F.lit(0))
    any_title = F.get(F.transform(elements_of(("h1", "h2", "h3")), text_of), F.lit(0))
    name = F.coalesce(F.nullif(F.regexp_extract(titled, name_pattern, 1), F.lit("")), any_title)
    ingredient = F.get(F.filter(
        F.transform(elements_of(("h4", "h5")), text_of), lambda h: h.startswith("(") & h.endswith(")")), F.lit(0))

    def sections(panel: Column) -> Column:
        own = lambda e: e["h3"] == panel["pos"]
        heads_ = F.filter(with_text(F.filter("elements", lambda e: (e["tag"] == "h4") & own(e))), lambda e: is_whitelisted(e["text"]))

        def body(h: Column) -> Column:
            content = F.filter("elements", lambda e: (
                (e["h4"] == h["pos"])
                & e["tag"].isin("li", "p", "h5", "h6", "blockquote") & ~e["in_item"]
                & ((e["tag"] == "li") | ~F.rlike(text_of(e), F.lit(STOP_PARAGRAPH)))))
            lines = F.transform(content, lambda e: F.concat(F.when(e["tag"] == "li", "• ").otherwise(""), rich_of(e)))
            return F.array_join(F.filter(lines, lambda x: x != ""), "\n\n")

        return F.transform(heads_, lambda h: record(raw_section=h["text"], body=strip(body(h))))

    def panel_of(p: Column) -> Column:
        links = F.filter("elements", lambda e: (e["tag"] == "a") & (e["h3"] == p["pos"]) & F.rlike(text(e["href"]), F.lit(r"(?i)\.pdf")))
        return record(header=text_of(p), pdf_url=strip(F.get(links, F.lit(0))["href"]), sections=sections(p))

    named = lambda e: F.concat_ws("#", e["tag"], e["id"], e["cls"]).contains("accordion")
    panels = F.transform(
        F.filter(elements_of("h3"), lambda e: named(e) | (F.size(around(e, F.filter("elements", named))) > 0)), panel_of)
    d = d.select(
        "page_id", "url", name.alias("drug_name"), F.nullif(F.regexp_extract(titled, name_pattern, 2), F.lit("")).alias("application_number"),
        F.btrim(ingredient, F.lit("() \t\n\r")).alias("active_ingredient"), F.posexplode(panels).alias("panel_no", "p"))
    dated = d.withColumn("source_date", parse_label_date(F.col("p.header"))).where(F.col("source_date").isNotNull())
    supplement = F.nullif(F.regexp_extract("p.header", r"(?i)\((SUPPL-[^)]+)\)", 1), F.lit(""))
    rows = dated.select(
        "page_id", "url", "drug_name", "application_number", "active_ingredient", "panel_no", "source_date",
        F.coalesce(supplement, F.concat_ws("-", "drug_name", F.date_format("source_date", "MM/dd/yyyy"))).alias("source_record_id"),
        F.col("p.pdf_url").alias("pdf_url"), F.posexplode("p.sections").alias("section_no", "s"))
    halves = split_original_updated(F.col("s.body"))
    kind = section_kind(F.col("s.raw_section"))
    rows = rows.withColumn("kind", kind).withColumn("_h", halves)
    updated = (
        F.when(F.col("kind") == "adverse", clean_adverse_text(F.col("_h.updated")))
        .when(F.col("kind") == "warnings", clean_general_text(F.col("_h.updated")))
        .otherwise(pregnancy_subsections(F.col("_h.updated")))
    )
    name_of = F.when(F.col("kind") == "adverse", "Adverse Reactions").when(
        F.col("kind") == "warnings", "Warnings and Precautions").otherwise("Use in Specific Populations")
    out = rows.select(
        "page_id", "url", "drug_name", "application_number", "active_ingredient", "panel_no", "section_no",
        name_of.alias("section"), "source_record_id", "source_date", F.lit("Labeling Revision").alias("change_type"),
        F.col("_h.original").alias("original_text"), updated.alias("updated_text"),
        F.when(F.col("pdf_url").isNotNull(), F.concat(F.lit("Approved Drug Label: "), F.col("pdf_url"))).alias("fda_comment"),
        F.coalesce("pdf_url", "url").alias("source_url"))
    return out.where(text(strip(F.col("updated_text"))) != "")


# Index titles that are page structure.
SKIP_TITLES = ("scope", "reporting adverse reactions", "helpful links", "contact us", "on this page")


def parse_newsletter_index(pages: DataFrame) -> DataFrame:
    """Leaf links of the month lists with their categories and class."""
    d = html_elements(pages)

    def at(pos: Column) -> Column:
        # An element's place is its index.
        return F.get("elements", pos)

    def label(li: Column) -> Column:
        return F.coalesce(text_of(at(li["child_link"])), text_of(li))

    def entry(li: Column) -> Column:
        return record(
            title=strip(label(li)), href=at(li["child_link"])["href"], names=F.transform(around(li, elements_of("li")), label),
            month=text_of(at(li["h3"])))

    leaves = F.filter("elements", lambda e: (e["tag"] == "li") & (e["child_lists"] == 0))
    d = d.select("page_id", "url", F.posexplode(F.transform(leaves, entry)).alias("ordinal", "e"))
    first = F.coalesce(F.get("e.names", F.lit(0)), F.col("e.title"))
    deep = F.size("e.names") >= 2
    d = d.select(
        "page_id", "ordinal", F.col("e.title").alias("article_title"), resolve_url(F.col("url"), F.col("e.href")).alias("article_url"),
        month_year_to_date(F.col("e.month")).alias("publication_date"), first.alias("category_level1"),
        F.when(deep, F.get("e.names", F.lit(1))).otherwise("").alias("category_level2"),
        F.coalesce(F.get("e.names", F.lit(2)), F.lit("")).alias("category_level3"), F.col("e.href").alias("_href"))
    names = title_brand_generic(F.col("article_title"))
    kind = classify_article(F.col("category_level1"), F.col("category_level2"), F.col("category_level3"), F.col("article_title"))
    return d.where(
        F.col("publication_date").isNotNull() & (F.col("article_title") != "") & (text(F.col("_href")) != "")
        & ~F.lower("article_title").isin(*SKIP_TITLES)
    ).withColumn("product_name", names["brand"]).withColumn("generic_name", names["generic"]).withColumn(
        "article_type", kind).where(F.col("article_type") != "SKIP").drop("_href")


# Where an article page states its date.
ARTICLE_DATES = (
    r"(?iU)(?:posted|published|updated|date[d]?)[:\s]+(\w+ \d{1,2},?\s*\d{4})",
    r"(?iU)\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s*\d{4})\b",
    r"\b(\d{4}-\d{2}-\d{2})\b",
)


def parse_article(pages: DataFrame, min_paragraph: int = 1) -> DataFrame:
    """Title, first date, PDF links and heading-grouped sections of articles;
    paragraphs and lists of fewer characters than ``min_paragraph`` are left out."""
    d = html_elements(pages)
    whole = F.array_join(F.transform(F.filter("elements", lambda e: (e["parent"] == -1) & (e["tag"] != "title")), text_of), " ")
    date = F.coalesce(*(parse_label_date(F.nullif(F.regexp_extract(whole, p, 1), F.lit(""))) for p in ARTICLE_DATES))
    pdfs = F.array_distinct(F.transform(
        F.filter(elements_of("a"), lambda e: F.lower(text(e["href"])).contains("pdf")), lambda e: resolve_url(F.col("url"), e["href"])))
    heads = F.filter("elements", lambda e: F.rlike(e["tag"], F.lit("^h[1-6]$")))
    starts = F.concat(F.array(record(pos=F.lit(-1), title=F.lit(""))), F.transform(heads, lambda e: record(pos=e["pos"], title=text_of(e))))

    def section(s: Column, i: Column) -> Column:
        until = F.coalesce(F.get(starts, i + 1)["pos"], F.lit(2_000_000_000))
        content = F.filter(F.transform(F.filter("elements", lambda e: (
            (e["pos"] > s["pos"]) & (e["pos"] < until) & ~e["in_item"] & e["tag"].isin("p", "ul", "ol"))), text_of),
            lambda t: F.length(t) >= min_paragraph)
        rows = F.filter("elements", lambda e: (e["pos"] > s["pos"]) & (e["pos"] < until) & (e["tag"] == "tr"))
        return record(heading=s["title"], text=F.array_join(content, "\n"),
                      n_rows=F.size(rows))

    sections = F.filter(F.transform(starts, section), lambda s: (s["heading"] != "") | (s["text"] != "") | (s["n_rows"] > 0))
    title = text_of(F.get(elements_of("h1"), F.lit(0)))
    return d.select("page_id", "url", title.alias("title"), date.alias("publication_date"), pdfs.alias("pdf_urls"), sections.alias("sections"))


# How products are mentioned, and headings that are structure.
BRAND_GENERIC = r"(?U)\b([A-Z][A-Za-z0-9\-\s]{1,40}?)\s*\(([^)]{3,80})\)"
CONTAINING = r"(?iU)\b([a-z][a-z\-\s]{3,50}?)\s*[\-–]\s*containing\b"
STRUCTURE = (
    "scope", "reporting adverse reactions", "helpful links", "contact us", "on this page", "table of contents",
    "references", "footnotes",
)


def product_mentions(articles: DataFrame) -> DataFrame:
    """Products named by articles, one row per normalized name; the first
    mention wins. articles: page_id, sections, product_name, generic_name.

    What an article is listed under is its section 0, so pages are parsed once."""
    kind = articles.schema["sections"].dataType.elementType
    sections = F.concat(F.array(F.lit(None).cast(kind)), F.coalesce("sections", F.array().cast(articles.schema["sections"].dataType)))
    listed = F.col("section_no") == 0
    exploded = articles.select("page_id", "product_name", "generic_name", F.posexplode(sections).alias("section_no", "s")).where(
        listed | ~F.lower(strip(F.col("s.heading"))).isin(*STRUCTURE))
    combined = F.concat_ws("\n", "s.heading", "s.text")
    brands = F.regexp_extract_all(combined, F.lit(BRAND_GENERIC), F.lit(1))
    generics = F.regexp_extract_all(combined, F.lit(BRAND_GENERIC), F.lit(2))
    alone = F.regexp_extract_all(combined, F.lit(CONTAINING), F.lit(1))
    found = F.concat(
        F.filter(F.zip_with(brands, generics, lambda b, g: record(brand=strip(b), generic=strip(g))), lambda m: F.length(m["brand"]) >= 3),
        F.filter(F.transform(alone, lambda g: record(brand=F.lit(""), generic=strip(g))), lambda m: F.length(m["generic"]) >= 4))
    product, generic = text(F.col("product_name")), text(F.col("generic_name"))
    seed = F.filter(F.array(record(brand=product, generic=generic)), lambda m: (m["brand"] != "") | (m["generic"] != ""))
    mentions = exploded.select(
        "page_id", "section_no", F.when(listed, "").otherwise(F.col("s.heading")).alias("section_heading"),
        F.when(listed, "").otherwise(F.col("s.text")).alias("context_text"), F.posexplode(F.when(listed, seed).otherwise(found)).alias("place", "m"))
    named = mentions.select(
        "page_id", "section_no", "section_heading", "context_text", "place", F.col("m.brand").alias("product_name"),
        F.col("m.generic").alias("generic_name"),
        normalize_drug_name(F.coalesce(F.nullif("m.brand", F.lit("")), F.col("m.generic"))).alias("normalized"))
    return pick(named.where("normalized <> ''"), ["page_id", "normalized"], F.struct("section_no", "place"), largest=False)


# Words in parentheses that are no ingredient.
NO_INGREDIENT = ("PI", "CMI", "TGA", "TABLETS", "CAPSULES")


def parse_site_search(pages: DataFrame) -> DataFrame:
    """Result nodes of a site search: title, link, snippet, date, licence id
    and ingredient."""
    d = html_elements(pages)
    nodes = F.filter("elements", lambda e: (e["tag"] == "article") | F.rlike(text(e["cls"]), F.lit(
        r"(^|\s)(views-row|search-result|field--name-node-title|search-item)(\s|$)")))
    # A node reaches up to the next node.
    d = d.withColumn("nodes", nodes)
    d = d.withColumn("nodes", F.transform("nodes", lambda n, i: record(
        pos=n["pos"], last=n["last"], until=F.coalesce(F.get("nodes", i + 1)["pos"], F.lit(2_000_000_000)))))

    def inside(n: Column, test) -> Column:
        return F.filter("elements", lambda e: (
            (e["pos"] > n["pos"]) & (e["pos"] < n["until"]) & (e["pos"] <= n["last"]) & test(e)))

    def first(n: Column, test) -> Column:
        return F.get(inside(n, test), F.lit(0))

    def result(n: Column) -> Column:
        link = first(n, lambda e: e["tag"] == "a")
        has_class = lambda e, p: F.rlike(text(e["cls"]), F.lit(f"(?i){p}"))
        return record(
            title=text_of(link), href=link["href"],
            snippet=text(text_of(first(n, lambda e: e["tag"].isin("p", "div") & has_class(e, "snippet|summary|description|body")))),
            date_str=text_of(first(n, lambda e: e["tag"].isin("time", "span") & has_class(e, "date|published|time"))))

    d = d.select("page_id", "url", F.posexplode(F.transform("nodes", result)).alias("ordinal", "r")).select(
        "page_id", "url", "ordinal", "r.*").where(F.length("title") >= 3)
    licence = F.regexp_extract(F.concat_ws(" ", "title", "snippet"), r"(?iU)\b(AUST\s*[RL]\s*\d{5,7})\b", 1)
    inner = F.upper(strip(F.regexp_extract("title", r"\(([^)]+)\)", 1)))
    return d.select(
        "page_id", "ordinal", "title", resolve_url(F.col("url"), F.col("href")).alias("url"), "snippet",
        parse_register_date(F.col("date_str")).alias("source_date"), F.upper(F.nullif(licence, F.lit(""))).alias("artg_number"),
        F.when((inner != "") & ~inner.isin(*NO_INGREDIENT), inner).alias("active_ingredient"))


# Official hosts, direct label PDFs and label pages.
OFFICIAL_HOSTS = ("www.fda.gov", "fda.gov", "accessdata.fda.gov", "api.fda.gov", "search.usa.gov")
OFFICIAL_SUFFIXES = (".fda.gov", ".fda.hhs.gov")
DIRECT_PDF = (
    r"(?i)accessdata\.fda\.gov/drugsatfda_docs/label/\d{4}/[A-Za-z0-9]+lbl\.pdf"
    r"|accessdata\.fda\.gov/drugsatfda_docs/label/.*\.pdf|fda\.gov/.*lbl\.pdf"
)
PAGE_PARTS = ("cder/daf", "drugsatfda", "product-information", "prescribing-information")
LABEL_TEXT = (
    r"(?iU)\bproduct\s+information\b|\bprescribing\s+information\b|\bfull\s+prescribing\s+information\b"
    r"|\bview\s+full\s+prescribing\s+information\b|\bfda-?approved\s+labeling\b|\bapproved\s+labeling\b"
    r"|\bpackage\s+insert\b|\blabel(?:ing)?\b|\bfull\s+label\b"
)


def _anchors(pages: DataFrame) -> DataFrame:
    d = html_elements(pages)
    usable = F.filter(elements_of("a"), lambda e: (strip(text(e["href"])) != "") & ~F.rlike(strip(text(e["href"])), F.lit("^(#|javascript:|mailto:)")))
    # An element's place is its index, so the table row of a link is one lookup
    # and the page itself is not carried along with every link.
    linked = F.transform(usable, lambda e: F.struct(e["href"].alias("href"), text_of(e).alias("text"), cells_of(F.get("elements", e["row"])).alias("cells")))
    d = d.select("page_id", F.col("url").alias("page_url"), F.posexplode(linked).alias("ordinal", "a"))
    return d.select(
        "page_id", "page_url", "ordinal", F.col("a.text").alias("link_text"),
        resolve_url(F.col("page_url"), F.col("a.href")).alias("url"), F.array_join("a.cells", " ").alias("row_text"))


def discover_links(
    pages: DataFrame, hosts: tuple[str, ...] = OFFICIAL_HOSTS, suffixes: tuple[str, ...] = OFFICIAL_SUFFIXES,
    page_parts: tuple[str, ...] = PAGE_PARTS,
) -> DataFrame:
    """Official links of pages, unique per page: direct PDFs (rank 0) and
    intermediate label pages (rank 1)."""
    d = _anchors(pages)
    host = host_of(F.col("url"))
    official = host.isin(*hosts)
    for suffix in suffixes:
        official = official | host.endswith(suffix)
    bare = F.lower(F.split(F.split("url", r"\?")[0], "#")[0])
    direct = bare.endswith(".pdf") & (
        F.rlike("url", F.lit(DIRECT_PDF)) | bare.endswith("lbl.pdf")
        | (F.col("url").contains("accessdata.fda.gov") & F.col("url").contains("/label/")))
    low = F.lower("url")
    page = F.rlike("link_text", F.lit(LABEL_TEXT))
    for part in page_parts:
        page = page | low.contains(part)
    kind = F.when(direct, "path_b_direct").when(page, "path_a_intermediate")
    kept = d.where(official).withColumn("discovery_type", kind).where(F.col("discovery_type").isNotNull())
    unique = pick(kept, ["page_id", "url"], F.col("ordinal"), largest=False)
    return unique.select("page_id", "url", "link_text", "ordinal", "discovery_type",
                         F.when(F.col("discovery_type") == "path_b_direct", 0).otherwise(1).alias("rank"))


def discover_documents(pages: DataFrame) -> DataFrame:
    """Label PDFs with year and supplement from the URL; a date in the table
    row overrides the year."""
    d = _anchors(pages)
    bare = F.lower(F.split(F.split("url", r"\?")[0], "#")[0])
    worded = F.rlike(F.lower("link_text"), F.lit("label|prescribing|package insert"))
    pdf = bare.endswith(".pdf") & (bare.endswith("lbl.pdf") | F.rlike("url", F.lit(DIRECT_PDF)) | worded)
    d = pick(d.where(pdf), ["page_id", "url"], F.col("ordinal"), largest=False)
    year = F.nullif(F.regexp_extract("url", r"/label/(\d{4})/", 1), F.lit(""))
    number = F.nullif(F.regexp_extract("url", r"(?i)s(\d{3,4})lbl\.pdf", 1), F.lit(""))
    supplement = F.concat(F.lit("s"), number)
    row_date = F.nullif(F.regexp_extract("row_text", r"\b(\d{1,2}/\d{1,2}/\d{4})\b", 1), F.lit(""))
    return d.select(
        "page_id", F.col("url").alias("pdf_url"), "ordinal", F.coalesce(F.nullif(squeeze(F.col("link_text")), F.lit("")),
        F.lit("FDA Approved Prescribing Information")).alias("document_title"),
        F.coalesce(row_date, F.concat(year, F.lit("-01-01"))).alias("document_date"), supplement.alias("supplement_number"),
        F.nullif(F.concat_ws("-", year, supplement), F.lit("")).alias("version"))
