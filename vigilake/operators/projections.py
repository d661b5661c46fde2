"""Regulator records → rows of the common change columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilake.functions.classify import section_of_type
from vigilake.functions.hashing import record_id
from vigilake.functions.sections import section_kind
from vigilake.functions.text import normalize_drug_name, record, strip, text

FIELDS = (
    "section", "change_type", "source_date", "source_record_id", "source_url", "original_text", "updated_text", "fda_comment",
)
ROW = "STRUCT<" + ", ".join(f"{f}: STRING" for f in FIELDS) + ">"


def change_row(**fields: Column | str | None) -> Column:
    """One change as a struct with all common columns."""
    values = {f: fields.get(f) for f in FIELDS}
    columns = {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}
    return record(**columns).cast(ROW)


def explode_rows(df: DataFrame, keys: list[str], rows: list[Column]) -> DataFrame:
    """The rows whose condition held, in order (``row_no``)."""
    return df.select(*keys, F.posexplode(F.array_compact(F.array(*rows))).alias("row_no", "r")).select(*keys, "row_no", "r.*")


def _named(c: Column) -> Column:
    return F.nullif(text(c), F.lit(""))


def srlc_changes(latest: DataFrame, older: DataFrame) -> DataFrame:
    """Latest sections 5, 6 and 8 where found, and every whitelisted section of
    older supplements.

    latest: drug_name, detail_url, date_str, supplement_number, document_url,
    warnings, adverse, populations (NULL when not found). older: drug_name,
    detail_url, date_str, supplement_id, document_url, raw_section, text.
    """
    def comment() -> Column:
        return F.when(_named(F.col("document_url")).isNotNull(), F.concat(F.lit("Approved Label PDF: "), F.col("document_url")))

    def own_id(c: str) -> Column:
        return F.coalesce(_named(F.col(c)), F.concat_ws("-", "drug_name", "date_str"))

    def found(c: str, section: str) -> Column:
        return F.when(_named(F.col(c)).isNotNull(), change_row(
            section=section, change_type="Labeling Revision", source_date=F.col("date_str"),
            source_record_id=own_id("supplement_number"), source_url=F.col("detail_url"), updated_text=F.col(c), fda_comment=comment()))

    new = explode_rows(latest, ["drug_name"], [
        found("warnings", "Warnings and Precautions"), found("adverse", "Adverse Reactions"),
        found("populations", "Use in Specific Populations")])
    kind = section_kind(F.col("raw_section"))
    name = F.when(kind == "adverse", "Adverse Reactions").when(kind == "warnings", "Warnings and Precautions").when(
        kind == "populations", "Use in Specific Populations")
    current = latest.select("drug_name", F.col("date_str").alias("_latest"))
    past = older.join(current, "drug_name").where(F.col("date_str") != F.col("_latest"))
    row = F.when(name.isNotNull(), change_row(
        section=name, change_type="Labeling Revision", source_date=F.col("date_str"),
        source_record_id=own_id("supplement_id"), source_url=F.col("detail_url"), updated_text=F.col("text"), fda_comment=comment()))
    return new.unionByName(explode_rows(past, ["drug_name"], [row]))


def newsletter_changes(mentions: DataFrame, articles: DataFrame, index_url: str) -> DataFrame:
    """Mentions as changes; an article without a mention but with a product in
    its index entry gives one row from its whole text.

    articles: page_id, article_url, article_type, publication_date, month,
    year, newsletter_type, product_name, generic_name, full_text, pdf_text.
    """
    caught = articles.where(text(F.col("product_name")) != "").join(mentions.select("page_id").distinct(), "page_id", "left_anti").select(
        "page_id", "product_name", "generic_name", F.col("full_text").alias("context_text"))
    all_mentions = mentions.select("page_id", "product_name", "generic_name", "context_text").unionByName(caught)
    info = articles.drop("product_name", "generic_name", "full_text")
    d = all_mentions.join(info, "page_id")
    with_pdf = F.when(
        _named(F.col("pdf_text")).isNotNull(),
        F.concat(F.col("context_text"), F.lit("\n\n[PDF content]\n"), F.col("pdf_text"))).otherwise(F.col("context_text"))
    name = F.coalesce(_named(F.col("product_name")), F.col("generic_name"))
    row = change_row(
        section=section_of_type(F.col("article_type")), change_type=F.col("article_type"),
        source_date=F.date_format("publication_date", "yyyy-MM-dd"),
        source_record_id=record_id(F.col("article_url"), normalize_drug_name(name)), source_url=index_url,
        original_text=_named(F.col("context_text")), updated_text=_named(with_pdf),
        fda_comment=F.concat(F.lit("Health Canada "), F.col("newsletter_type"), F.lit(" — "), F.col("month"), F.lit(" "), F.col("year").cast("string")))
    return d.where(text(name) != "").select(
        "page_id", name.alias("display_name"), normalize_drug_name(name).alias("normalized_name"),
        F.col("generic_name").alias("active_ingredient"), row.alias("r")).select(
        "page_id", "display_name", "normalized_name", "active_ingredient", "r.*")


def tga_changes(documents: DataFrame) -> DataFrame:
    """Two rows per document, sections 4.6 and 4.8; table text is added to 4.8
    unless it is part of it already.

    documents: product_name, pdf_url, doc_date, rev_date, title_46, text_46,
    pages_46, title_48, text_48, pages_48, tables (caption, page, markdown).
    """
    embedded = F.exists("tables", lambda t: (text(t["markdown"]) != "") & F.contains(F.col("text_48"), t["markdown"]))
    listed = F.array_join(F.transform("tables", lambda t: F.concat(
        F.lit("### "), t["caption"], F.lit(" (Page "), t["page"].cast("string"), F.lit(")\n"), t["markdown"])), "\n\n")
    summary = F.when((F.size("tables") > 0) & ~embedded, F.concat(F.lit("\n\n"), listed)).otherwise("")
    d = documents.withColumn("full_48", strip(F.concat(F.col("text_48"), summary)))
    day = F.substring("doc_date", 1, 10)

    def section(number: str, canonical: str, body: str, note: Column) -> Column:
        n = number.replace(".", "")
        digest = F.sha2(F.concat_ws("|", "product_name", F.lit(number), body), 256)
        pages = F.coalesce(_named(F.col(f"pages_{n}")), F.lit("N/A"))
        return change_row(
            section=canonical, change_type=f"Product Information - Section {number}",
            source_date=F.coalesce(_named(F.col("rev_date")), F.col("doc_date")),
            source_record_id=F.concat(F.lit(f"TGA-PI-{number}-"), F.upper(digest)),
            source_url=F.col("pdf_url"), original_text=F.col(body),
            updated_text=F.concat(F.col(f"title_{n}"), F.lit("\nPages: "), pages, F.lit("\nDocument Date: "), day, F.lit("\n\n"), F.col(body)),
            fda_comment=F.concat(F.lit(f"Australian TGA Product Information Section {number} (Pages: "), pages, note, F.col("pdf_url")))

    rows = [
        section("4.6", "Use in Specific Populations", "text_46", F.lit("). PDF: ")),
        section("4.8", "Adverse Reactions", "full_48", F.concat(
            F.lit(", Tables extracted: "), F.size("tables").cast("string"), F.lit("). PDF: "))),
    ]
    return explode_rows(d, ["product_name"], rows)


def tga_metadata_rows(results: DataFrame, query: Column, now: Column) -> DataFrame:
    """Search results as single change rows; a bare licence number gets its
    prefix."""
    licence = F.coalesce(_named(F.col("artg_number")), F.lit("AUST R"))
    number = F.when(F.upper(licence).startswith("AUST"), licence).otherwise(F.concat(F.lit("AUST R "), licence))
    row = change_row(
        section="Product Information (PI)", change_type="TGA Registered Medicine",
        source_date=F.date_format(F.coalesce("source_date", now), "yyyy-MM-dd'T'HH:mm:ss"),
        source_record_id=F.concat(F.lit("TGA-"), F.upper(F.sha2("url", 256))), source_url=F.col("url"),
        original_text=F.col("title"), updated_text=strip(F.concat_ws("\n\n", "title", "snippet")),
        fda_comment=F.concat(F.lit("Sourced from Australian TGA eBS: "), F.col("url")))
    return results.select(
        F.col("title").alias("display_name"), normalize_drug_name(F.col("title")).alias("normalized_name"),
        F.coalesce(_named(F.col("active_ingredient")), F.upper(query)).alias("active_ingredient"),
        number.alias("application_number"), row.alias("r")).select(
        "display_name", "normalized_name", "active_ingredient", "application_number", "r.*")


# Texts of documents without a usable section.
SECTION_MISSING = (
    "ADVERSE_REACTIONS_SECTION_NOT_FOUND: The official product labeling document was retrieved and analyzed, but the "
    "Section 6 Adverse Reactions section could not be identified."
)
EXTRACTION_FAILED = (
    "PDF_EXTRACTION_FAILED: The official product labeling PDF was discovered, but could not be parsed or downloaded."
)
UNDATED = "2024-01-01T00:00:00"


def medwatch_changes(articles: DataFrame, recalls: DataFrame) -> DataFrame:
    """Label sections or a status row, the article itself, then its recalls.

    articles: article_id, product, title, summary, url, publication_date,
    pdf_url, document_date, adverse, adverse_status, warnings, pregnancy,
    pages_6, pages_5, pages_8, n_subsections, n_tables. recalls: product,
    recall_number, classification, reason, firm.
    """
    has_doc = _named(F.col("pdf_url")).isNotNull()
    date = F.when(has_doc, F.col("document_date")).otherwise(F.col("publication_date"))
    link = F.coalesce(_named(F.col("pdf_url")), F.col("url"))
    pdf = F.concat(F.lit("Official FDA Prescribing Information PDF: "), F.col("pdf_url"))
    kind = lambda s: f"Official Prescribing Information ({s})"
    rid = lambda s: F.concat(F.lit("MW-LBL-"), F.col("product"), F.lit(f"-{s}"))
    adverse = _named(F.col("adverse")).isNotNull()
    counts = F.concat(
        F.lit(" (Pages: "), text(F.col("pages_6")), F.lit(" | Subsections: "), F.col("n_subsections").cast("string"),
        F.lit(" | Tables: "), F.col("n_tables").cast("string"), F.lit(")"))
    missing = has_doc & (F.col("adverse_status") == "ADVERSE_REACTIONS_SECTION_NOT_FOUND")
    failed = has_doc & (F.col("adverse_status") == "PDF_EXTRACTION_FAILED")

    def section(c: str, name: str, label: str, suffix: str, pages: str) -> Column:
        note = F.when(has_doc, F.concat(pdf, F.lit(" (Page: "), text(F.col(pages)), F.lit(")")))
        return F.when(_named(F.col(c)).isNotNull(), change_row(
            section=name, change_type=kind(label), source_date=date, updated_text=F.col(c), source_url=link, fda_comment=note,
            source_record_id=rid(suffix)))

    first = (
        F.when(adverse, change_row(
            section="Adverse Reactions", change_type=kind("Section 6"), source_date=date, updated_text=F.col("adverse"),
            source_url=link, fda_comment=F.when(has_doc, F.concat(pdf, counts)), source_record_id=rid("SEC6")))
        .when(missing, change_row(
            section="Adverse Reactions", change_type=kind("Section 6 Not Found"), source_date=date,
            updated_text=SECTION_MISSING, source_url=F.col("pdf_url"), source_record_id=rid("SEC6-NF"),
            fda_comment=F.concat(pdf, F.lit(" (Status: ADVERSE_REACTIONS_SECTION_NOT_FOUND)"))))
        .when(failed, change_row(
            section="Adverse Reactions", change_type=kind("Extraction Failed"), source_date=date,
            updated_text=EXTRACTION_FAILED, source_url=F.col("pdf_url"), source_record_id=rid("PDF-FAIL"),
            fda_comment=F.concat(pdf, F.lit(" (Status: PDF_EXTRACTION_FAILED)"))))
    )
    article = change_row(
        section="MedWatch Safety Communication",
        change_type=F.concat(F.lit("FDA MedWatch Alert: "), F.col("title")),
        source_date=F.coalesce(_named(F.col("publication_date")), F.lit(UNDATED)),
        updated_text=F.coalesce(_named(F.col("summary")), F.col("title")), source_url=F.col("url"),
        fda_comment="Official FDA MedWatch Safety Communication.",
        source_record_id=F.concat(F.lit("MW-ART-"), F.md5(text(F.col("url")))))
    own = explode_rows(articles, ["article_id"], [
        first, section("warnings", "Warnings and Precautions", "Section 5", "SEC5", "pages_5"),
        section("pregnancy", "Use in Specific Populations", "Pregnancy 8.1", "SEC8", "pages_8"), article])
    recall = change_row(
        section=F.concat(F.lit("FDA Recall Notice ("), F.col("classification"), F.lit(")")),
        change_type=F.concat(F.lit("FDA Recall: "), F.col("recall_number")), source_date=UNDATED,
        source_record_id=F.concat(F.lit("MW-RECALL-"), F.col("recall_number")), source_url=F.col("url"),
        updated_text=F.concat(F.lit("Recall Reason: "), F.col("reason"), F.lit(". Firm: "), F.col("firm"), F.lit(".")),
        fda_comment=F.concat(F.lit("FDA Enforcement Notice for "), F.col("product"), F.lit(".")))
    noted = explode_rows(articles.select("article_id", "product", "url").join(recalls, "product"), ["article_id"], [recall])
    return own.unionByName(noted.withColumn("row_no", F.lit(9)))


def monograph_rows(products: DataFrame, recalls: DataFrame) -> DataFrame:
    """Product facts as text rows; recalls go to the first product of their
    request, or to the request's own name where it found no product.

    products: request, rank, drug_code, brand_name, din, company, active_ingredient,
    form, route, status, status_date, monograph_url, page_url. recalls:
    request, title, url, date, description.
    """
    pm = F.coalesce(_named(F.col("monograph_url")), F.col("page_url"))
    facts = [
        F.concat(F.lit("Health Canada Product Monograph for "), F.col("brand_name"), F.lit(".")),
        F.concat(F.lit("Drug Identification Number (DIN): "), F.col("din")),
        F.concat(F.lit("Manufacturer / Sponsor: "), F.col("company")),
        F.concat(F.lit("Active Ingredient(s): "), F.col("active_ingredient")),
        F.concat(F.lit("Dosage Form: "), F.col("form")), F.concat(F.lit("Route of Administration: "), F.col("route")),
        F.concat(F.lit("Regulatory Status: "), F.col("status"), F.lit(" (as of "), F.col("status_date"), F.lit(")")),
        F.when(pm.endswith(".PDF"), F.concat(F.lit("Official Product Monograph Document: "), pm)),
    ]
    digest = F.substring(F.sha2(F.concat_ws("|", "din", "brand_name", F.lit("monograph")), 256), 1, 32)
    row = change_row(
        section="Product Monograph Update", change_type="Health Canada Authorized Monograph", source_date=F.col("status_date"),
        source_record_id=digest, source_url=pm, original_text=F.concat(F.lit("DIN "), F.col("din"), F.lit(" - "), F.col("company")),
        updated_text=F.concat_ws("\n\n", *facts),
        fda_comment=F.concat(F.lit("Health Canada DPD — DIN "), F.col("din"), F.lit(" ("), F.col("status"), F.lit(")")))
    own = products.select("brand_name", row.alias("r"))
    title = F.coalesce(_named(F.col("title")), F.concat(F.lit("Health Canada Safety Alert: "), F.col("request")))
    note = change_row(
        section="Adverse Reaction Information", change_type="Health Canada Safety Alert / Recall", source_date=F.col("date"),
        source_record_id=F.substring(F.sha2(F.concat_ws("|", F.col("url"), title), 256), 1, 32), source_url=F.col("url"),
        original_text=title, updated_text=F.concat_ws("\n\n", title, F.coalesce(_named(F.col("description")), title)),
        fda_comment=F.concat(F.lit("Health Canada MedEffect Alert — "), title))
    first = products.groupBy("request").agg(F.min_by("brand_name", "rank").alias("_first"))
    noted = recalls.select("request", note.alias("r")).join(first, "request", "left").select(
        F.coalesce("_first", F.initcap("request")).alias("brand_name"), "r")
    return own.unionByName(noted).select("brand_name", "r.*")


def bulletin_rows(articles: DataFrame, live: bool = False) -> DataFrame:
    """Bulletin articles as change rows. articles: title, url, date,
    description."""
    prefix = "MHRA-DSU-LIVE-" if live else "MHRA-DSU-"
    tail = ("Published by the UK MHRA and Commission on Human Medicines (CHM)." if live
            else "Guidance issued by the UK MHRA and the Commission on Human Medicines.")
    date = F.coalesce(F.col("date"), F.lit("Recent"))
    note = (F.concat(F.lit("Published in MHRA Drug Safety Update ("), date, F.lit(").")) if live
            else F.concat(F.lit("UK MHRA Drug Safety Update notice ("), date, F.lit(").")))
    row = change_row(
        section="MHRA Drug Safety Update Article", change_type=F.col("title"), source_date=UNDATED,
        source_record_id=F.concat(F.lit(prefix), F.md5(text(F.col("title")))), source_url=F.col("url"),
        original_text=F.col("title"),
        updated_text=F.concat(F.col("title"), F.lit(". "), text(F.col("description")), F.lit(". "), F.lit(tail)), fda_comment=note)
    return articles.where(text(F.col("title")) != "").select(row.alias("r")).select("r.*")
