"""Article types, client labels and request parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vigilake.functions.text import record, squeeze, strip, strip_chars, text

# Titles that are page structure, not articles.
SKIP = (
    r"(?iU)\bscope\b|\breporting adverse reactions\b|\bhelpful links\b|\bcontact us\b|\bon this page\b"
    r"|\bcontents?\b$|\bannual reports?\b"
)
# Category wording → article type, first that fits.
CATEGORY_RULES = (
    (r"product\s+monograph\s+updat", "PRODUCT_MONOGRAPH_UPDATE"),
    (r"safety\s+brief", "SAFETY_BRIEF"),
    (r"vaccine\s+safety\s+summar", "VACCINE_SAFETY_SUMMARY"),
    (r"health\s+product\s+safety\s+summar", "SAFETY_SUMMARY"),
    (r"medication\s+error\s+alert", "MEDICATION_ERROR_ALERT"),
    (r"notice\s+of\s+market\s+authoriz", "MARKET_AUTHORIZATION_WITH_CONDITIONS"),
    (r"authoriz\w+\s+with\s+conditions?", "MARKET_AUTHORIZATION_WITH_CONDITIONS"),
    (r"monthly\s+recap", "MONTHLY_RECAP"),
    (r"announcement", "ANNOUNCEMENT"),
    (r"aefi\s+data|adverse\s+event.*following\s+immuniz", "VACCINE_SAFETY_SUMMARY"),
    (r"adverse\s+reaction", "ADVERSE_REACTION_INFORMATION"),
    (r"new\s+health\s+product\s+safety\s+information", "SAFETY_SUMMARY"),
)
TITLE_RULES = (
    (r"authoriz\w+\s+with\s+conditions?", "MARKET_AUTHORIZATION_WITH_CONDITIONS"),
    (r"aefi\s+data", "VACCINE_SAFETY_SUMMARY"),
    (r"\d{4}\s+aefi\b", "VACCINE_SAFETY_SUMMARY"),
    (r"\d{4}\s+ar\s+data\b", "ADVERSE_REACTION_INFORMATION"),
)
# Article types that are fetched and read.
SAFETY_RELEVANT = (
    "MONTHLY_RECAP", "PRODUCT_MONOGRAPH_UPDATE", "SAFETY_BRIEF", "SAFETY_SUMMARY", "VACCINE_SAFETY_SUMMARY",
    "MEDICATION_ERROR_ALERT", "MARKET_AUTHORIZATION_WITH_CONDITIONS", "ADVERSE_REACTION_INFORMATION",
    "REVIEW_ARTICLE",
)
# Section name of an article type.
TYPE_SECTIONS = {
    "PRODUCT_MONOGRAPH_UPDATE": "Product Monograph Update",
    "SAFETY_BRIEF": "Safety Brief",
    "SAFETY_SUMMARY": "Safety Summary",
    "VACCINE_SAFETY_SUMMARY": "Vaccine Safety Summary",
    "MEDICATION_ERROR_ALERT": "Medication Error Alert",
    "MARKET_AUTHORIZATION_WITH_CONDITIONS": "Market Authorization With Conditions",
    "MONTHLY_RECAP": "Monthly Recap",
    "ANNOUNCEMENT": "Announcement",
    "ADVERSE_REACTION_INFORMATION": "Adverse Reaction Information",
}
DEFAULT_TYPE_SECTION = "Health Canada Safety Information"


def _first_rule(c: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    return F.coalesce(*(F.when(F.rlike(text(c), F.lit("(?iU)" + p)), name) for p, name in rules))


def classify_article(level1: Column, level2: Column, level3: Column, title: Column) -> Column:
    """Article type: innermost category, then title, then outer categories."""
    return F.when(F.rlike(strip(text(title)), F.lit(SKIP)), "SKIP").otherwise(
        F.coalesce(
            _first_rule(level3, CATEGORY_RULES), _first_rule(title, TITLE_RULES),
            _first_rule(level2, CATEGORY_RULES), _first_rule(level1, CATEGORY_RULES), F.lit("OTHER"),
        )
    )


def is_safety_relevant(article_type: Column) -> Column:
    return article_type.isin(*SAFETY_RELEVANT)


def section_of_type(article_type: Column) -> Column:
    mapped = F.create_map(*(F.lit(v) for pair in TYPE_SECTIONS.items() for v in pair))
    return F.coalesce(F.try_element_at(mapped, article_type), F.lit(DEFAULT_TYPE_SECTION))


def website_name(source: Column) -> Column:
    """Client-facing label of a source."""
    s = F.upper(F.coalesce(F.nullif(source, F.lit("")), F.lit("FDA_SRLC")))
    return (
        F.when(s.contains("TGA"), "TGA_details")
        .when(s.contains("CANADA") | s.contains("HC"), "Health_Canada_details")
        .when(s.contains("MHRA"), "MHRA_details").when(s.contains("MEDWATCH"), "MedWatch_details")
        .otherwise("FDA_details")
    )


# First day of coverage and the note for earlier requests.
COVERAGE_START = "2016-01-01"
COVERAGE_NOTE = (
    "US FDA SrLC records begin from 01-01-2016. Safety labeling changes prior to 2016 "
    "are not indexed in this database and may reside in the FDA MedWatch archive."
)


def coverage(start: Column, end: Column) -> Column:
    """STRUCT<coverage, note>: partial when the request starts too early,
    complete when dated, NULL when undated."""
    early = F.coalesce(start < F.to_date(F.lit(COVERAGE_START)), F.lit(False))
    return record(
        coverage=F.when(early, "partial").when(start.isNotNull() | end.isNotNull(), "complete"),
        note=F.when(early, COVERAGE_NOTE),
    )


def title_brand_generic(c: Column) -> Column:
    """STRUCT<brand, generic> of ``Brand (generic)``."""
    value = text(c)
    pattern = r"(?U)^([^(]+?)\s*\(([^)]+)\)"
    brand = strip(F.regexp_replace(strip(F.regexp_extract(value, pattern, 1)), r"(?U)[:\-]\s*$", ""))
    return record(brand=brand, generic=strip(F.regexp_extract(value, pattern, 2)))


# How a request names sections and what it says about tables.
NATURAL_SECTIONS = (
    r"(?iU)(?:section\s+)?(\d+(?:\.\d+)*)\s*(?:(?:to|and|->|→|\+|,)\s*(?:subsection\s+|section\s+)?(\d+(?:\.\d+)*))?"
)
NO_TABLES = (
    r"(?iU)\b(?:neglect(?:ing)?\s+(?:the\s+)?tables?|no\s+tables?|without\s+tables?|text\s+only|only\s+text"
    r"|strip\s+tables?|exclude\s+tables?|skip\s+tables?|omit\s+tables?|don'?t\s+want\s+tables?)\b"
)
ADD_TABLES = r"(?iU)\b(?:add(?:ing)?\s+(?:the\s+)?tables?|include\s+tables?|with\s+tables?|keep\s+tables?)\b"


def parse_natural_query(
    query: Column, main: Column | None = None, sub: Column | None = None, include_tables: Column | None = None
) -> Column:
    """STRUCT<main, sub, include_tables, html> of a free-text section request;
    section 16 when none is named."""
    none = F.lit(None).cast("string")
    main, sub = (none if main is None else main), (none if sub is None else sub)
    wanted = F.lit(True) if include_tables is None else include_tables
    both = (text(main) != "") & (text(sub) != "")
    q = F.when(both, "").otherwise(text(query))
    found_main = F.nullif(F.regexp_extract(q, NATURAL_SECTIONS, 1), F.lit(""))
    found_sub = F.nullif(F.regexp_extract(q, NATURAL_SECTIONS, 2), F.lit(""))
    chosen = F.coalesce(found_main, F.nullif(text(main), F.lit("")), F.lit("16"))
    return record(
        main=strip_chars(strip(chosen), ".:-"),
        sub=strip_chars(strip(F.coalesce(found_sub, F.nullif(text(sub), F.lit("")))), ".:-"),
        include_tables=F.when(F.rlike(text(query), F.lit(NO_TABLES)), False)
        .when(F.rlike(text(query), F.lit(ADD_TABLES)), True).otherwise(wanted),
        html=F.rlike(text(query), F.lit(r"(?iU)\b(?:html|htaml)\b")),
    )


def parse_page_ranges(c: Column) -> Column:
    """``3-5, 9`` → [3, 4, 5, 9]; parts that are no page are left out."""
    parts = F.transform(F.split(F.regexp_replace(text(c), "[–—]", "-"), ","), strip)

    def pages(x: Column) -> Column:
        low = F.regexp_extract(x, r"(?U)^(\d+)\s*-\s*(\d+)", 1).try_cast("int")
        high = F.regexp_extract(x, r"(?U)^(\d+)\s*-\s*(\d+)", 2).try_cast("int")
        single = F.regexp_extract(x, r"^(\d+)$", 1).try_cast("int")
        empty = F.array().cast("array<int>")
        return (
            F.when(single.isNotNull(), F.array(single))
            .when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(empty)
        )

    return F.flatten(F.transform(parts, pages))


def clean_title(c: Column) -> Column:
    return squeeze(c)
