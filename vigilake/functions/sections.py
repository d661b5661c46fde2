"""Labelling sections: names, kinds, whitelist, order and text cleanup."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vigilake.functions.text import record, strip, text, title_case

# Standard section names, tried in this order.
SECTION_NAMES = (
    ("boxed warning", "Boxed Warning"),
    ("contraindications", "Contraindications"),
    ("warnings", "Warnings and Precautions"),
    ("warnings and precautions", "Warnings and Precautions"),
    ("adverse reactions", "Adverse Reactions"),
    ("adverse events", "Adverse Reactions"),
    ("drug interactions", "Drug Interactions"),
    ("use in specific populations", "Use in Specific Populations"),
    ("patient counseling", "Patient Counseling Information"),
    ("patient counseling information", "Patient Counseling Information"),
    ("patient information", "Patient Information"),
    ("medication guide", "Medication Guide"),
    ("pci/pi/mg", "Patient Counseling Information"),
)
# Display order of sections without a number.
SECTION_ORDER = (
    ("boxed warning", 0), ("box warning", 0), ("black box warning", 0),
    ("contraindications", 4),
    ("warnings and precautions", 5), ("warnings & precautions", 5), ("warnings", 5), ("precautions", 5),
    ("adverse reactions", 6), ("side effects", 6),
    ("drug interactions", 7), ("interactions", 7),
    ("use in specific populations", 8), ("pregnancy", 8), ("lactation", 8),
    ("pediatric use", 8), ("geriatric use", 8),
    ("overdosage", 10),
    ("dosage and administration", 2), ("dosage", 2),
    ("indications and usage", 1), ("indications", 1),
)
# Display titles.
SECTION_TITLES = (
    "Warnings and Precautions", "Adverse Reactions", "Use in Specific Populations",
    "Contraindications", "Drug Interactions",
)
# Where section 17 starts and every section text ends.
STOP_SECTION_17 = r"17\b|17\s+17|PCI/PI/MG|Patient\s+Counseling\s+Information|MEDICATION\s+GUIDE"
STOP_WITH_HOW_TO = STOP_SECTION_17 + r"|How\s+should\s+I\s+use"
STOP_EXPORT = r"17\b|PCI/PI/MG|Patient\s+Counseling|MEDICATION\s+GUIDE"
STOP_LINE = r"17\b|17\s+17|PCI/PI/MG|Patient\s+Counseling|MEDICATION\s+GUIDE|How\s+should\s+I\s+use"
PREGNANCY_HINT = (
    r"(?iU)(\b8\.1\b|\b8\.2\b|\b8\.3\b|\bpregnancy\b|\blactation\b|\breproductive\s+potential\b"
    r"|\bnursing\s+mothers\b|\bteratogen|\bfetal\b|\bneonat)"
)
PREGNANCY_PART = (
    r"(?isU)(?:^|\n)\s*(8\.[123]\b[^\n]*|pregnancy\b[^\n]*|lactation\b[^\n]*"
    r"|females\s+and\s+males\s+of\s+reproductive\s+potential\b[^\n]*)(.*?)"
    r"(?=(?:(?:^|\n)\s*8\.[456789]\b)|$)"
)


def _bare_name(c: Column) -> Column:
    unnumbered = F.lower(strip(F.regexp_replace(text(c), r"(?U)^\d+[\s.\-]+", "")))
    return strip(F.regexp_replace(unnumbered, r"\(.*?\)", ""))


def normalize_section_name(c: Column) -> Column:
    """Standard section name; either text may contain the other."""
    bare = _bare_name(c)
    mapped = F.lit(None).cast("string")
    for key, standard in reversed(SECTION_NAMES):
        hit = F.contains(bare, F.lit(key)) | F.contains(F.lit(key), bare)
        mapped = F.when(hit, standard).otherwise(mapped)
    return F.when(text(c) == "", "").otherwise(F.coalesce(mapped, title_case(strip(c))))


def _header(c: Column) -> Column:
    return F.lower(strip(F.regexp_replace(text(c), r"[\r\n\t]+", " ")))


def is_adverse_reactions(c: Column) -> Column:
    h = _header(c)
    return F.rlike(h, F.lit(r"(?U)\b6\b|\badverse\s+reactions?\b|\badverse\s+events?\b")) & (
        h.contains("adverse") | h.contains("reaction") | h.startswith("6")
    )


def is_warnings(c: Column) -> Column:
    h = _header(c)
    return F.rlike(h, F.lit(r"(?U)\b5\b|\bwarnings?\b|\bprecautions?\b")) & (
        h.contains("warning") | h.contains("precaution") | h.startswith("5")
    )


def is_specific_populations(c: Column) -> Column:
    h = _header(c)
    return F.rlike(h, F.lit(r"(?U)\b8\b|\bspecific\s+populations?\b|\bpregnancy\b|\blactation\b")) & (
        h.contains("specific population") | h.contains("use in") | h.startswith("8") | h.contains("pregnancy")
    )


def is_section_17(c: Column) -> Column:
    h = _header(c)
    pattern = (
        r"(?U)\b(?:17\b|17\s+17|pci/pi/mg|patient\s+counseling|medication\s+guide|patient\s+information"
        r"|how\s+should\s+i\s+use)\b"
    )
    return (
        F.rlike(h, F.lit(pattern)) | h.contains("patient counseling")
        | h.contains("medication guide") | h.contains("patient information")
    )


def section_kind(c: Column) -> Column:
    """adverse / warnings / populations / section_17 / NULL, first that fits."""
    return (
        F.when(is_section_17(c), "section_17")
        .when(is_adverse_reactions(c), "adverse")
        .when(is_warnings(c), "warnings")
        .when(is_specific_populations(c), "populations")
    )


def is_whitelisted(header: Column, body: Column | None = None) -> Column:
    """Sections 5, 6 and 8.1–8.3; section 8 with a body must mention pregnancy."""
    kind = section_kind(header)
    allowed = kind.isin("adverse", "warnings")
    populations = kind == "populations"
    if body is not None:
        populations = populations & ((text(body) == "") | pregnancy_subsections(body).isNotNull())
    return (text(header) != "") & F.coalesce(allowed | populations, F.lit(False))


def cut_at(c: Column, stop: str) -> Column:
    """Text before the first line that opens with a stop phrase."""
    return F.regexp_replace(text(c), rf"(?isU)(?:^|\n)\s*(?:{stop}).*$", "")


def squeeze_blank_lines(c: Column) -> Column:
    """Runs of blanks and tabs collapsed, lines trimmed, at most one blank
    line in a row."""
    flat = F.transform(F.split(c, "\n"), lambda x: strip(F.regexp_replace(x, "[ \t]+", " ")))
    return strip(F.regexp_replace(F.array_join(flat, "\n"), "\n{3,}", "\n\n"))


def clean_general_text(c: Column) -> Column:
    return squeeze_blank_lines(cut_at(c, STOP_SECTION_17))


def _mend_headings(c: Column) -> Column:
    mended = F.regexp_replace(c, r"(?iU)\bPostmarketing\s*\n+\s*Experience\b", "Postmarketing Experience")
    return F.regexp_replace(
        mended, r"(?iU)\bClinical\s*\n+\s*Trials?\s*\n+\s*Experience\b", "Clinical Trials Experience"
    )


def clean_adverse_text_simple(c: Column) -> Column:
    return squeeze_blank_lines(_mend_headings(cut_at(c, STOP_WITH_HOW_TO)))


def _dots_only(x: Column) -> Column:
    return F.rlike(x, F.lit(r"(?U)^[.\s…]+$"))


def _reflow(block: Column) -> Column:
    """Lines of one block joined into paragraphs; bullets, short headings and
    ``Class:`` openers start their own."""
    raw = F.filter(F.transform(F.split(block, "\n"), strip), lambda x: x != "")
    # Lines from the first stop phrase on are dropped.
    stop_at = F.array_position(
        F.transform(raw, lambda x: F.rlike(x, F.lit(rf"(?iU)^({STOP_LINE})"))), F.lit(True)
    )
    kept = F.when(stop_at > 0, F.slice(raw, F.lit(1), F.greatest(stop_at.cast("int") - 1, F.lit(0)))).otherwise(raw)
    editorial = r"(?iU)^(additions\s+and/or\s+revisions\s+underlined|newly\s+added)"
    kept = F.filter(kept, lambda x: ~_dots_only(x) & ~F.rlike(x, F.lit(editorial)))

    def unnumber(x: Column) -> Column:
        x = F.regexp_replace(x, r"(?U)^\s*\d+(?:\.\d+)+[.\s:-]*\s*", "")
        x = F.regexp_replace(x, r"(?iU)^\s*\d+\s+(?=(?:Warnings|Adverse|Use|Contraindications|Drug))", "")
        x = F.regexp_replace(x, r"(?iU)^\s*6\s+Adverse\s+Reactions", "Adverse Reactions")
        return F.regexp_replace(x, r"(?iU)\s*\[\s*see\s+[^\]]+\]", "")

    kept = F.transform(kept, unnumber)

    # State: finished paragraphs and the open one ('' when none is open).
    def step(state: Column, line: Column) -> Column:
        done, open_text = state["done"], state["open"]
        alone = F.rlike(line, F.lit(r"^[•\-*]")) | (
            (F.length(line) < 60) & F.rlike(line, F.lit("Experience|Reactions|Trials"))
        )
        opener = F.rlike(line, F.lit(r"(?U)^[A-Z][a-zA-Z\s,/]+:\s*"))
        flushed = F.when(open_text != "", F.concat(done, F.array(open_text))).otherwise(done)
        joined = F.when(open_text != "", F.concat_ws(" ", open_text, line)).otherwise(line)
        return record(
            done=F.when(alone, F.concat(flushed, F.array(line))).when(opener, flushed).otherwise(done),
            open=F.when(alone, "").when(opener, line).otherwise(joined),
        )

    start = record(done=F.expr("CAST(array() AS ARRAY<STRING>)"), open=F.lit(""))
    paragraphs = F.aggregate(
        kept, start, step,
        lambda s: F.when(s["open"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]),
    )
    return F.when(F.size(kept) > 0, F.array_join(paragraphs, "\n\n"))


def clean_adverse_text(c: Column) -> Column:
    """Report form of an adverse-reactions text."""
    value = cut_at(c, STOP_WITH_HOW_TO)
    value = F.regexp_replace(value, r"(?iU)\s*\[\s*see\s+[^\]]+\]", "")
    value = _mend_headings(value)
    blocks = F.filter(F.transform(F.split(value, "\n\n"), strip), lambda b: b != "")
    skip = r"(?iU)^(additions\s+and/or\s+revisions\s+underlined|newly\s+added|approved\s+drug\s+label)"
    blocks = F.filter(blocks, lambda b: ~_dots_only(b) & ~F.rlike(b, F.lit(skip)))
    return strip(F.array_join(F.array_compact(F.transform(blocks, _reflow)), "\n\n"))


def clean_clinical_text(c: Column) -> Column:
    """Export form: references, ellipses and empty tags removed, one bullet
    per line."""
    value = cut_at(c, STOP_EXPORT)
    value = F.regexp_replace(value, r"(?iU)\[\s*(?:<[^>]+>\s*)*see(?:\s*<[^>]+>)*\s*[^\]]+\]", "")
    value = F.regexp_replace(value, r"(?iU)\[\s*see\s+[^\]]+\]", "")
    value = F.regexp_replace(value, r"(?U)(?:\.\s*){3,}", "\n")
    value = F.regexp_replace(value, "…", "\n")
    for _ in range(3):
        value = F.regexp_replace(value, r"(?iU)<([a-z0-9]+)[^>]*>\s*</\1>", "")
    value = F.regexp_replace(value, r"(?U)\s*•\s*", "\n• ")
    kept = F.filter(
        F.transform(F.split(value, "\n"), strip), lambda x: (x != "") & ~_dots_only(x)
    )
    return F.array_join(kept, "\n")


def pregnancy_subsections(c: Column) -> Column:
    """Parts 8.1–8.3 of a section-8 text, the whole text when it only hints at
    them, NULL when it does not."""
    value = text(c)
    heads = F.regexp_extract_all(value, F.lit(PREGNANCY_PART), F.lit(1))
    bodies = F.regexp_extract_all(value, F.lit(PREGNANCY_PART), F.lit(2))
    parts = F.zip_with(heads, bodies, lambda h, b: F.concat(strip(h), F.lit("\n"), strip(b)))
    picked = F.when(F.size(heads) > 0, strip(F.array_join(parts, "\n\n"))).otherwise(value)
    return F.when(F.rlike(value, F.lit(PREGNANCY_HINT)), clean_general_text(picked))


def section_sort_key(c: Column) -> Column:
    """STRUCT<priority, name>: leading number, else keyword, else 99."""
    name = F.lower(strip(text(c)))
    number = F.nullif(F.regexp_extract(name, r"(?U)^(\d+)(?:\.\d+)?\b", 1), F.lit("")).try_cast("int")
    keyword = F.lit(None).cast("int")
    for key, order in reversed(SECTION_ORDER):
        keyword = F.when(name.contains(key), F.lit(order)).otherwise(keyword)
    return record(priority=F.coalesce(number, keyword, F.lit(99)), name=name)


def section_display_title(c: Column) -> Column:
    whole = strip(text(c))
    bare = strip(F.regexp_replace(whole, r"(?U)^\d+(?:\.\d+)*[.\s:-]*", ""))
    title = F.coalesce(F.nullif(bare, F.lit("")), whole)
    for known in reversed(SECTION_TITLES):
        title = F.when(F.lower(bare).contains(known.lower()), known).otherwise(title)
    return title


def split_original_updated(c: Column) -> Column:
    """STRUCT<original, updated> around ``Original Text:`` / ``Updated Text:``."""
    value = text(c)
    both = value.contains("Original Text:") & value.contains("Updated Text:")
    halves = F.split(value, "Updated Text:", 2)
    original = strip(F.replace(halves[0], F.lit("Original Text:"), F.lit("")))
    return record(original=F.when(both, original), updated=F.when(both, strip(halves[1])).otherwise(value))


def approval_sentence(date: Column, drug: Column, ingredient: Column) -> Column:
    return F.format_string(
        "On %s, the United States Food and Drug Administration Center for Drug Evaluation and Research "
        "approved the following safety labeling changes for %s (%s; Additions underlined):",
        date, drug, ingredient,
    )
