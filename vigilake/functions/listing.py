"""Cells of a case listing: events, outcomes, onsets and products."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vigilake.functions.text import bind, clean_xml_hex, lines, normalize_term, record, strip, text

# A bracketed term with its trailing flags, and a flag line.
EVENT_PATTERN = r"(?U)\[([^\]]+)\](?:\s*([YyNn\s/]+))?"
FLAG_LINE = r"(?U)^[YyNn\s/]+$"
# Dosage forms, first one found wins.
FORMS = ("Oral use", "Tablet", "Capsule", "Injection", "Intravenous")

EVENT_TYPE = (
    "ARRAY<STRUCT<normalized_term: STRING, raw_verbatim: STRING, seriousness: STRING,"
    " listedness: STRING, causality: STRING>>"
)


def _event(term: Column, raw: Column, flags: Column | None) -> Column:
    none = F.lit(None).cast("string")
    flag = [none] * 3 if flags is None else [F.get(flags, F.lit(i)) for i in range(3)]
    return record(
        normalized_term=F.upper(term), raw_verbatim=raw, seriousness=flag[0], listedness=flag[1], causality=flag[2]
    )


def parse_event_verbatim(c: Column, clean_first: bool = False) -> Column:
    """ARRAY of events in one cell.

    Bracketed terms carry up to three flags; a cell without brackets holds one
    term per line, flag lines aside. Escapes are removed after the brackets
    were found, so an escape right behind a bracket hides the flags;
    ``clean_first`` removes them before.
    """
    raw = clean_xml_hex(c) if clean_first else text(c)
    flags = F.regexp_extract_all(raw, F.lit(EVENT_PATTERN), F.lit(2))

    def bracketed(term: Column, flag_text: Column) -> Column:
        parts = F.filter(
            F.transform(F.split(normalize_term(clean_xml_hex(flag_text)), "/"), strip), lambda x: x != ""
        )
        name = normalize_term(clean_xml_hex(term))
        return bind(parts, lambda own: _event(name, F.concat(F.lit("["), term, F.lit("]")), own))

    def from_brackets(terms: Column) -> Column:
        return F.filter(F.zip_with(terms, flags, bracketed), lambda e: e["normalized_term"] != "").cast(EVENT_TYPE)

    plain = F.filter(
        F.transform(lines(clean_xml_hex(raw)), normalize_term),
        lambda x: (x != "") & ~F.rlike(x, F.lit(FLAG_LINE)),
    )
    without = F.transform(plain, lambda x: _event(x, x, None)).cast(EVENT_TYPE)
    return bind(
        F.regexp_extract_all(raw, F.lit(EVENT_PATTERN), F.lit(1)),
        lambda terms: F.when(F.size(terms) > 0, from_brackets(terms)).otherwise(without))


def parse_outcomes(c: Column) -> Column:
    """MAP<term, outcome> from ``Term - Outcome`` lines; a later line wins."""
    rows = F.filter(F.transform(lines(clean_xml_hex(c)), normalize_term), lambda x: x.contains(" - "))
    entries = F.transform(rows, lambda x: bind(
        F.split(x, " - ", 2), lambda parts: record(k=F.upper(strip(parts[0])), v=strip(parts[1]))))

    def last(all_: Column) -> Column:
        return F.filter(
            all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda later: later["k"] == e["k"]))

    return F.map_from_entries(bind(entries, last))


def parse_event_onsets(c: Column) -> Column:
    return F.filter(F.transform(lines(clean_xml_hex(c)), normalize_term), lambda x: x != "")


def onset_for(onsets: Column, index: Column) -> Column:
    """STRUCT<onset, status> of the event with a 0-based ``index``."""
    n = F.size(onsets)
    onset = F.when(n == 1, F.get(onsets, F.lit(0))).otherwise(
        F.coalesce(F.get(onsets, index.cast("int")), F.get(onsets, F.lit(0)))
    )
    status = F.when(n > 1, "UNCERTAIN_MAPPED_BY_POSITION").otherwise("CONFIRMED")
    return record(onset=onset, status=status)


def outcome_for(outcomes: Column, term: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(outcomes, term), default)


def parse_products(
    cell: Column, product: Column, dose: Column, form: Column, duration: Column, indication: Column
) -> Column:
    """ARRAY of products: the primary suspect, then one per line of the cell."""
    none = F.lit(None).cast("string")

    def cleaned(c: Column) -> Column:
        return F.when(text(c) != "", normalize_term(clean_xml_hex(c)))

    def brand_of(primary_dose: Column) -> Column:
        return F.when(primary_dose.contains(" / "), strip(F.split(primary_dose, " / ")[0])).otherwise(product)

    def item(raw, brand_, substance, role, dose_, form_, duration_, indication_):
        return record(
            product_name_raw=raw, brand_name=brand_, active_substance=substance, role=role, daily_dose=dose_,
            form=form_, duration=duration_, indication_pt=indication_,
        )

    def primary(primary_dose: Column) -> Column:
        return bind(brand_of(primary_dose), lambda brand: item(
            F.concat(brand, F.lit(" (Primary Suspect)")), brand, F.upper(product), F.lit("Suspect"),
            primary_dose, cleaned(form), cleaned(duration), cleaned(indication),
        ))

    # What is used more than once is bound: it would be worked out each time.
    def from_line(x: Column) -> Column:
        return bind(F.struct(
            F.lower(x).alias("low"), F.rlike(x, F.lit(r"\(([^)]+)\)")).alias("parens"),
            F.regexp_extract(x, r"(?iU)daily dose:\s*([^,]+)", 1).alias("dose"),
        ), lambda seen: bind(
            F.when(seen["parens"], strip(F.split(x, r"\(")[0])).otherwise(F.split(x, " ")[0]),
            lambda line_brand: from_parts(x, seen, line_brand)))

    def from_parts(x: Column, seen: Column, line_brand: Column) -> Column:
        lowered = seen["low"]
        in_parens = F.when(seen["parens"], F.nullif(strip(F.regexp_extract(x, r"\(([^)]+)\)", 1)), F.lit("")))
        role = (
            F.when(lowered.contains("suspect"), "Suspect").when(lowered.contains("concom"), "Concom")
            .otherwise("Concomitant")
        )
        # A dose that is found has at least one character.
        line_dose = F.when(seen["dose"] != "", strip(seen["dose"]))
        line_form = F.coalesce(*(F.when(lowered.contains(f.lower()), f) for f in FORMS))
        return item(x, line_brand, F.coalesce(in_parens, line_brand), role, line_dose, line_form, none, none)

    rows = F.filter(F.transform(lines(clean_xml_hex(cell)), normalize_term), lambda x: x != "")
    return F.concat(F.array(bind(cleaned(dose), primary)), F.transform(rows, from_line))
