"""Product and document predicates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vigilake.functions.text import is_corrupted_text, normalize_drug_name, strip, text

# Regulators and the source tags that belong to each.
SOURCE_GROUPS = (
    ("HEALTH_CANADA_INFOWATCH", "HEALTH_CANADA", "HEALTH_CANADA_DPD"),
    ("FDA_SRLC", "FDA"),
    ("AUSTRALIA_TGA", "TGA"),
    ("FDA_MEDWATCH", "MEDWATCH"),
    ("UK_MHRA", "MHRA"),
)
# Text a change's source must contain, per chosen regulator.
SOURCE_TAGS = {
    "HEALTH_CANADA_INFOWATCH": "HEALTH_CANADA", "HEALTH_CANADA": "HEALTH_CANADA",
    "FDA_SRLC": "FDA_SRLC", "FDA": "FDA_SRLC", "AUSTRALIA_TGA": "TGA", "TGA": "TGA",
    "FDA_MEDWATCH": "MEDWATCH", "MEDWATCH": "MEDWATCH", "UK_MHRA": "MHRA", "MHRA": "MHRA",
}


def quote(c: Column) -> Column:
    """Regular-expression literal for the text of a column."""
    return F.regexp_replace(c, r"([\\.\[\]{}()*+\-?^$|#&~ ])", r"\\$1")


def like_pattern(c: Column) -> Column:
    """``%c%`` with ``%`` and ``_`` of the text as wildcards, nothing escaped."""
    return F.concat(F.lit("%"), F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("%"))


def contains_like(value: Column, needle: Column) -> Column:
    return F.coalesce(F.ilike(value, like_pattern(needle)), F.lit(False))


def source_in_group(source: Column, wanted: str | None) -> Column:
    """Source equals the wanted one or another tag of the same regulator."""
    if not wanted or wanted == "ALL":
        return F.lit(True)
    group = next((g for g in SOURCE_GROUPS if wanted in g), (wanted,))
    return source.isin(*group)


def source_has_tag(source: Column, wanted: str) -> Column:
    tag = SOURCE_TAGS.get(wanted)
    return F.lit(True) if tag is None else text(source).contains(tag)


def _bounded(needle: Column, value: Column) -> Column:
    return F.rlike(value, F.concat(F.lit(r"(?U)\b"), quote(needle), F.lit(r"\b")))


def product_match(query: Column, name: Column, ingredient: Column, application: Column) -> Column:
    """Equal, a whole-word part of name or ingredient, or part of the
    application number."""
    q, n, i = normalize_drug_name(query), normalize_drug_name(name), normalize_drug_name(ingredient)
    squeezed_q = F.regexp_replace(F.lower(text(query)), r"(?U)[\s\-]", "")
    squeezed_app = F.regexp_replace(F.lower(text(application)), r"(?U)[\s\-]", "")
    by_number = (squeezed_q != "") & (squeezed_app != "") & F.contains(squeezed_app, squeezed_q)
    return (text(query) == "") | (q == n) | (q == i) | _bounded(q, n) | _bounded(q, i) | by_number


def article_match(query: Column, value: Column) -> Column:
    """Whole-word match, or all words of the query among the words of the text."""
    q, v = normalize_drug_name(query), normalize_drug_name(value)
    words = F.filter(F.split(q, " "), lambda w: w != "")
    subset = (F.size(words) > 0) & (F.size(F.array_except(words, F.split(v, " "))) == 0)
    return (F.length(q) >= 2) & (text(value) != "") & (_bounded(q, v) | subset)


def medicine_match(query: Column, product: Column, generic: Column, title: Column) -> Column:
    """Either text contains the other, or a word of four letters or more hits."""
    q = normalize_drug_name(query)
    words = F.filter(F.split(q, " "), lambda w: F.length(w) >= 4)

    def hits(target: Column) -> Column:
        t = normalize_drug_name(target)
        return (t != "") & (F.contains(t, q) | F.contains(q, t) | F.exists(words, lambda w: F.contains(t, w)))

    long_enough = F.length(strip(F.lower(text(query)))) >= 3
    return (text(query) == "") | (long_enough & (hits(product) | hits(generic) | hits(title)))


def register_product_match(query: Column, product: Column, ingredient: Column) -> Column:
    """As :func:`medicine_match`, but an empty name counts as contained."""
    q, p, i = normalize_drug_name(query), normalize_drug_name(product), normalize_drug_name(ingredient)
    words = F.filter(F.split(q, " "), lambda w: F.length(w) >= 4)
    loose = F.contains(p, q) | F.contains(q, p) | F.contains(i, q) | F.contains(q, i)
    return (text(query) != "") & (loose | F.exists(words, lambda w: F.contains(p, w) | F.contains(i, w)))


def relevant_result(
    query: Column, title: Column, snippet: Column, url: Column, ingredient: Column, licence: Column
) -> Column:
    """Search result that concerns the query, by text or licence number."""
    q = F.lower(strip(text(query)))
    q_norm = normalize_drug_name(q)
    words = F.filter(F.split(q, r"(?U)\s+"), lambda w: F.length(w) >= 3)

    def hits(target: Column) -> Column:
        return (target != "") & (
            F.contains(target, q) | F.contains(target, q_norm) | F.contains(q_norm, target)
            | F.exists(words, lambda w: F.contains(target, w))
        )

    targets = [F.lower(text(c)) for c in (title, snippet, url, ingredient)] + [normalize_drug_name(title)]
    found = F.lit(False)
    for target in targets:
        found = found | hits(target)
    digits = F.regexp_replace(q, r"\D", "")
    number = text(licence)
    by_number = (number != "") & (
        F.contains(F.lower(number), q) | ((F.length(digits) >= 4) & F.contains(number, digits))
    )
    return (q != "") & (found | by_number)


def record_errors(
    display_name: Column, source_url: Column, texts: dict[str, Column], raw_dates: dict[str, Column],
    parsed_dates: dict[str, Column],
) -> Column:
    """ARRAY of problems of a change record; empty when it is valid."""
    checks = [
        F.when(text(display_name) == "", "display_name is required and cannot be empty"),
        F.when(text(source_url) == "", "source_url is required"),
    ]
    for name, raw in raw_dates.items():
        bad = (text(raw) != "") & parsed_dates[name].isNull()
        checks.append(F.when(bad, f"{name} must be a datetime object"))
    for name, value in texts.items():
        checks.append(F.when(is_corrupted_text(value), f"{name} appears to be corrupted or malformed"))
    return F.array_compact(F.array(*checks))


def is_pi_document(url: Column, title: Column) -> Column:
    """A product-information document, not a consumer leaflet."""
    u, t = F.lower(text(url)), F.lower(text(title))
    return (u != "") & ~(u.contains("cmi") & ~u.contains("pi")) & ~t.contains("consumer medicine")


# Texts stored for a section the document lacks.
MISSING_SECTION = {"4.6": "Section 4.6 not present in document", "4.8": "Section 4.8 not present in document"}


def completeness(product: Column, url: Column, text_46: Column, text_48: Column) -> Column:
    """STRUCT<status, issues> of one product-information record; a NULL
    section text means that the section is absent."""
    def section_issue(number: str, body: Column) -> Column:
        return F.when(body.isNull() | (body == MISSING_SECTION[number]), MISSING_SECTION[number]).when(
            F.length(strip(body)) < 50, f"Section {number} text is unusually short"
        )

    issues = F.array_compact(F.array(
        F.when(text(product) == "", "Missing product name"), F.when(text(url) == "", "Missing PDF URL"),
        section_issue("4.6", text_46), section_issue("4.8", text_48),
    ))
    status = (
        F.when(text_46.isNull() & text_48.isNull(), "SECTIONS_NOT_FOUND")
        .when(F.size(issues) == 0, "VALID").otherwise("VALID_WITH_WARNINGS")
    )
    return F.struct(status.alias("status"), issues.alias("issues"))
