"""Text normalization as Column expressions.

``\\s``, ``\\b`` and ``\\w`` are Unicode-aware here (``(?U)``), and trimming
removes every Unicode white-space character, not only blanks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Starts with one class, so a text without a break is read once: \v is
# [\n\x0B\f\r\x85  ].
LINE_BREAK = r"[\v\x1c-\x1e](?:(?<=\r)\n)?"

# Fixed value: the characters with Unicode's White_Space property, as in (?U)\s.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def record(**fields: Column) -> Column:
    """STRUCT with the given field names, also inside lambdas."""
    parts = []
    for name, value in fields.items():
        parts += [F.lit(name), value]
    return F.named_struct(*parts)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once.

    A long expression that is used many times would be copied into the plan
    each time, until the generated code no longer compiles.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text(c: Column) -> Column:
    """NULL reads as the empty string."""
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def squeeze(c: Column) -> Column:
    """White space collapsed to single blanks, ends trimmed, NULL → ''."""
    return F.trim(collapse(text(c)))


def strip_chars(c: Column, chars: str) -> Column:
    """Both ends freed of any of ``chars``."""
    return F.btrim(c, F.lit(chars))


def lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


def clean_xml_hex(c: Column) -> Column:
    """Spreadsheet escapes such as ``_x000D_`` removed."""
    value = text(c)
    return F.when(F.contains(value, F.lit("_x")), F.regexp_replace(value, "_x[0-9a-fA-F]{4}_", "")).otherwise(value)


def normalize_term(c: Column) -> Column:
    return squeeze(c)


def normalize_drug_name(c: Column) -> Column:
    return F.lower(squeeze(c))


def normalize_text(c: Column) -> Column:
    return squeeze(c)


def normalize_product_name(c: Column) -> Column:
    return F.lower(squeeze(F.regexp_replace(text(c), r"(?U)[^a-zA-Z0-9\s]", " ")))


def title_case(c: Column) -> Column:
    """Every run of letters starts upper-case and goes on lower-case.

    ``initcap`` only looks at blanks; here apostrophes, hyphens and digits
    also start a new word.
    """
    words = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), ""
    )


# Salt words ignored when ingredients are compared.
SALTS = (
    "sulfate", "hydrochloride", "sodium", "potassium", "calcium", "acetate",
    "mesylate", "fumarate", "tartrate", "hcl", "maleate", "citrate",
)
# Salt words left out of a report's ingredient label.
REPORT_SALTS = ("sulfate", "hydrochloride", "sodium", "potassium", "acetate")


def strip_drug_salts(c: Column) -> Column:
    words = "|".join(SALTS)
    return F.lower(squeeze(F.regexp_replace(text(c), rf"(?iU)\b({words})\b", "")))


def report_ingredient(c: Column) -> Column:
    lowered = F.lower(text(c))
    words = "|".join(REPORT_SALTS)
    cleaned = strip(F.regexp_replace(lowered, rf"(?iU)\b({words})\b", ""))
    return F.coalesce(
        F.nullif(cleaned, F.lit("")), F.nullif(lowered, F.lit("")), F.lit("active ingredient")
    )


def is_corrupted_text(c: Column) -> Column:
    """More ``<`` than blanks, or more special characters than letters."""
    value = text(c)
    tags = F.length(F.regexp_replace(value, "[^<]", ""))
    blanks = F.length(F.regexp_replace(value, "[^ ]", ""))
    letters = F.length(F.regexp_replace(value, r"[^\p{L}]", ""))
    specials = F.length(F.regexp_replace(value, r"(?U)[\p{L}\p{N}\s]", ""))
    return (F.length(value) >= 5) & ((tags > blanks) | ((letters > 0) & (specials > letters)))


def narrative_snippet(narrative: Column, keyword: Column, margin: int = 80) -> Column:
    """Up to ``margin`` characters on either side of the first hit."""
    hit = F.position(keyword, F.lower(narrative))
    start = F.greatest(hit - 1 - margin, F.lit(0))
    end = F.least(F.length(narrative), hit - 1 + F.length(keyword) + margin)
    cut = F.substr(narrative, start + 1, end - start)
    return F.concat(F.lit("..."), strip(F.replace(cut, F.lit("\n"), F.lit(" "))), F.lit("..."))


# File-name endings that are not part of a product name, in the
# order in which they are removed.
FILE_SUFFIXES = (
    r"[\s_\-]+(can\s+pbrer|can[_\-]pbrer|pbrer|psur|dsur|pi|cmi|label|lbl|monograph|fda|package[_\-]insert)[\s_\-0-9].*$",
    r"[\s_\-]+(can\s+pbrer|can[_\-]pbrer|pbrer|psur|dsur|pi|cmi|label|lbl|monograph|fda|package[_\-]insert)$",
    r"[\s_\-]+can[\s_\-]+pbrer.*$",
    r"[\s_\-]+(\d+mg|\d+ml|\d+mcg)[\s_\-].*$",
    r"[\s_\-]+(\d+mg|\d+ml|\d+mcg)$",
    r"[\s_\-]+(tablets?|capsules?|solution|injection)[\s_\-].*$",
    r"[\s_\-]+(tablets?|capsules?|solution|injection)$",
    r"[\s_\-]+(\d{8}|\d{4}[_\-]\d{2}[_\-]\d{2}).*$",
    r"[\s_\-]+(sample|test\d*)$",
)
GENERIC_FILE_NAMES = (
    "test", "sample", "document", "doc", "pdf", "file", "output", "input", "data",
)
# Substance and invented names that are placeholders.
NOT_A_SUBSTANCE = ("CONFIDENTIAL", "UNKNOWN", "SEE")
NOT_AN_INVENTED_NAME = ("CONFIDENTIAL", "UNKNOWN", "THE", "OF")
# First words that mark a first-page line as boilerplate.
FIRST_LINE_NOISE = (
    "CONFIDENTIAL", "PERIODIC", "BENEFIT", "RISK", "EVALUATION",
    "REPORT", "SAFETY", "UPDATE", "TABLE", "CONTENTS", "HIGHLIGHTS",
    "PRESCRIBING", "INFORMATION", "PACKAGE", "INSERT", "VERSION",
    "INC", "PHARMA", "FOR", "CANADIAN", "SECTION",
)


def _capitalize_words(c: Column) -> Column:
    words = F.filter(F.split(squeeze(c), " "), lambda w: w != "")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " "
    )


def product_name_from_file(
    file_name: Column, first_page: Column | None = None, sponsors: tuple[str, ...] = (), first_lines: int | None = None
) -> Column:
    """Product name from a file name, else from the text of the first page.

    ``sponsors`` are company names; a first-page line that opens with one of
    them is a running header, not a product. ``first_lines`` is how many lines
    with text are looked at, by default all.
    """
    noise = FIRST_LINE_NOISE + tuple(s.upper() for s in sponsors)
    stem_raw = F.regexp_replace(file_name, r"(?<=.)\.[^./]*$", "")
    stem = F.regexp_replace(stem_raw, r"(?iU)^[0-9a-f]{8,32}[_\-\s]+", "")
    for pattern in FILE_SUFFIXES:
        stem = strip(F.regexp_replace(stem, "(?iU)" + pattern, ""))
    cleaned = strip(F.regexp_replace(stem, "[_-]", " "))
    cleaned = strip(F.regexp_replace(cleaned, r"(?iU)\s+can$", ""))
    from_file = bind(
        cleaned,
        lambda c: F.when((c != "") & ~F.lower(c).isin(*GENERIC_FILE_NAMES), _capitalize_words(c)),
    )
    if first_page is None:
        return F.coalesce(from_file, stem_raw)
    page = text(first_page)
    substance = F.regexp_extract(page, r"(?iU)ACTIVE\s+SUBSTANCE\s*:\s*([A-Za-z0-9\s\-]+)", 1)
    substance = strip(F.split(substance, "\n")[0])
    invented = F.regexp_extract(page, r"(?iU)Invented\s+Name[^\n]*\n+([A-Za-z0-9\s\-'™®]+)", 1)
    invented = strip(F.split(F.regexp_replace(strip(invented), "[™®]", ""), r"[,;/()\n]")[0])

    def plausible(c: Column, placeholders: tuple[str, ...]) -> Column:
        return bind(c, lambda x: F.when((F.length(x) >= 3) & ~F.upper(x).isin(*placeholders), title_case(x)))

    candidates = F.filter(F.transform(F.split(page, "\n"), strip), lambda x: x != "")
    if first_lines is not None:
        candidates = F.slice(candidates, 1, first_lines)
    candidates = F.transform(candidates, lambda x: strip(F.regexp_replace(x, "[™®]", "")))
    candidates = F.filter(candidates, lambda x: ~F.rlike(x, F.lit(r"(?iU)^(section\s+)?\d+(\.\d+)*\b")))
    candidates = F.transform(candidates, lambda x: strip(F.split(x, r"[(\[{]")[0]))

    def informative(x: Column) -> Column:
        first = F.get(F.filter(F.split(x, "[^A-Za-z0-9]"), lambda w: w != ""), F.lit(0))
        return (
            first.isNotNull() & ~F.upper(first).isin(*noise)
            & (F.length(x) >= 3) & ~F.rlike(x, F.lit(r"^\d+$"))
        )

    first_line = title_case(F.get(F.filter(candidates, informative), F.lit(0)))
    return F.coalesce(
        from_file, plausible(substance, NOT_A_SUBSTANCE), plausible(invented, NOT_AN_INVENTED_NAME),
        first_line, stem_raw,
    )
