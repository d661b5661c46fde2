"""Headings, section numbers, lines and tables of documents as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vigilake.functions.text import bind, record, strip, strip_chars, text

# How a section heading is written.
HEADING = r"(?iU)^(?:Section\s+|Chapter\s+)?(\d+(?:\.\d+)*)(?:[.:\s\-]+)(.*)$"
NUMBER_ONLY = r"(?iU)^(?:Section\s+)?(\d+(?:\.\d+)*)\.?$"
# Openings of lines that mention a section without being one.
CITATIONS = (
    "see section", "in section", "refer to", "according to", "as in", "table", "figure", "fig.", "appendix",
)
CONTENTS_LEADER = r"(?U)(\.{3,}|…|\s{5,}\d+$)"
CONTENTS_PAGE = r"(?U)[A-Za-z)]\s{3,}\d{1,4}$"
MAX_HEADING_LENGTH = 150


def canonical_section_number(c: Column) -> Column:
    """``16.01.`` → ``16.1``."""
    value = strip_chars(strip(text(c)), ".:-")
    parts = F.filter(F.split(value, r"\."), lambda p: F.rlike(p, F.lit(r"^\d+$")))
    plain = F.array_join(F.transform(parts, lambda p: F.coalesce(F.nullif(F.ltrim(p, F.lit("0")), F.lit("")), F.lit("0"))), ".")
    return F.when(F.size(parts) > 0, plain).otherwise(value)


def section_level(number: Column) -> Column:
    return F.size(F.split(number, r"\."))


def section_parent(number: Column) -> Column:
    """Number without its last part; NULL for a top-level section."""
    return F.nullif(F.regexp_extract(number, r"^(.*)\.[^.]*$", 1), F.lit(""))


def section_prefixes(number: Column) -> Column:
    parts = F.split(number, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def _word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def match_heading(line: Column) -> Column:
    """STRUCT<number, title, level> of a heading line, NULL otherwise.

    Contents lines, citations, sentences and percentages are no headings.
    """
    def test(clean: Column) -> Column:
        lowered = F.lower(clean)
        contents = F.rlike(clean, F.lit(CONTENTS_LEADER)) | F.rlike(clean, F.lit(CONTENTS_PAGE))
        citation = F.lit(False)
        for opening in CITATIONS:
            citation = citation | lowered.startswith(opening)
        sentence = (_word_count(clean) > 5) & F.rlike(clean, F.lit(r"[.;!]$"))
        other = (
            citation | sentence | (F.length(clean) > MAX_HEADING_LENGTH)
            | F.rlike(clean, F.lit(r"(?U)^\d+(?:\.\d+)*%"))
        )
        title = strip(F.regexp_extract(clean, HEADING, 2))
        lower_start = F.rlike(title, F.lit(r"^\p{Ll}")) & (_word_count(title) > 3)
        numbered = F.rlike(clean, F.lit(HEADING))
        number = canonical_section_number(
            F.when(numbered, F.regexp_extract(clean, HEADING, 1)).otherwise(F.regexp_extract(clean, NUMBER_ONLY, 1)))
        found = F.when(numbered, ~lower_start).otherwise(F.rlike(clean, F.lit(NUMBER_ONLY)))
        return F.when(
            (clean != "") & ~contents & ~other & found,
            record(number=number, title=F.when(numbered, title).otherwise(""), level=section_level(number)),
        )

    return bind(strip(text(line)), test)


# Page numbering of headers and footers, list markers.
PAGE_NUMBER = r"(?iU)^(page\s+\d+(\s+(of|/)\s+\d+)?|\d+\s*/\s*\d+|-\s*\d+\s*-|\d+)$"
BULLET = r"(?U)^[\s•●○▪▫\-*]+(?:\s+|$)"
NUMBERED = r"(?U)^\s*(?:\(\d+\)|\d+\.|\d+\))\s+"


def header_template(c: Column) -> Column:
    return F.regexp_replace(strip(text(c)), r"(?U)\d+", "#")


def list_items(c: Column) -> Column:
    """STRUCT<block_type, items>: bullet lines with their continuation lines,
    or numbered lines; a paragraph has no items."""
    rows = F.filter(F.split(text(c), "\n"), lambda x: strip(x) != "")
    is_bullet = lambda x: F.rlike(x, F.lit(BULLET))
    is_numbered = lambda x: F.rlike(x, F.lit(NUMBERED))

    def step(items: Column, line: Column) -> Column:
        body = strip(F.regexp_replace(line, BULLET, ""))
        open_item = F.element_at(items, -1)
        joined = F.when(open_item == "", strip(line)).otherwise(F.concat_ws(" ", open_item, strip(line)))
        kept = F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0)))
        return F.when(is_bullet(line), F.concat(items, F.array(body))).otherwise(
            F.when(F.size(items) == 0, F.array(strip(line))).otherwise(F.concat(kept, F.array(joined)))
        )

    bullets = F.filter(F.aggregate(rows, F.array().cast("array<string>"), step), lambda x: strip(x) != "")
    numbers = F.transform(rows, lambda x: strip(F.regexp_replace(x, NUMBERED, "")))
    kind = F.when(F.exists(rows, is_bullet), "bullet_list").when(F.exists(rows, is_numbered), "numbered_list").otherwise(
        "paragraph")
    return bind(kind, lambda k: record(
        block_type=k, items=F.when(k == "bullet_list", bullets).when(k == "numbered_list", numbers)))


# ---------------------------------------------------------------------------
# Sub-topic headings and stop lines

# Sub-topic headings of product information.
SUBHEADINGS = (
    r"^effects?\s+on\s+fertility\b", r"^fertility\s*$", r"^use\s+in\s+pregnancy\b", r"^pregnancy\s*$",
    r"^category\s+[A-X0-9]+(?:\s*\(.*?\))?\s*$", r"^use\s+in\s+lactation\b", r"^lactation\s*$",
    r"^breastfeeding\s*$", r"^use\s+in\s+breastfeeding\b",
    r"^females?\s+and\s+males?\s+of\s+reproductive\s+potential\b", r"^contraception\s*$",
    r"^summary\s+of\s+(?:the\s+)?safety\s+profile\b", r"^tabulated\s+list\s+of\s+adverse\s+reactions\b",
    r"^description\s+of\s+selected\s+adverse\s+reactions\b",
    r"^reporting\s+(?:of\s+)?suspected\s+adverse\s+effects\b", r"^post-?marketing\s+experience\b",
    r"^clinical\s+trials?\s+experience\b", r"^paediatric\s+use\b", r"^use\s+in\s+the\s+elderly\b",
    r"^prevention\s+of\s+vte\b", r"^treatment\s+of\s+dvt\b", r"^prevention\s+of\s+stroke\b",
)
SENTENCE_WORDS = (
    "and", "or", "to", "in", "is", "was", "were", "the", "for", "with", "from", "by", "at",
)
STOP_48 = (r"\b4\.9\b", r"\boverdose\b", r"\b5\.0?\b", r"pharmacological\s+properties")
STOP_WORDS = ("4.7", "4.9", "5.", "overdose", "pharmacological")


def is_subheading(c: Column) -> Column:
    """Known sub-topic, or a short line in title case without end mark."""
    def test(clean: Column) -> Column:
        known = F.rlike(clean, F.lit("(?iU)" + "|".join(f"(?:{p})" for p in SUBHEADINGS)))
        words = F.filter(F.split(clean, r"(?U)\s+"), lambda w: w != "")
        capitals = F.size(F.filter(words, lambda w: F.rlike(w, F.lit(r"^\p{Lu}"))))
        short = (
            ~F.rlike(clean, F.lit(r"[.,;!?]$")) & (F.length(clean) < 55) & F.size(words).between(1, 7)
            & ~F.lower(F.get(words, F.lit(0))).isin(*SENTENCE_WORDS) & (capitals / F.size(words) >= 0.6)
        )
        return (clean != "") & (F.length(clean) <= 80) & (known | F.coalesce(short, F.lit(False)))

    return bind(strip(F.regexp_replace(strip(text(c)), r"(?U)^###\s*", "")), lambda x: test(x))


def is_stop_line(c: Column, stops: tuple[str, ...] = STOP_48) -> Column:
    """A line that opens the next section."""
    line = strip(text(c))
    opener = F.rlike(line, F.lit(r"(?iU)^(?:###\s*)?(\[Page\s+\d+\]\s+)?(4\.7|4\.9|5(\.0)?)\b"))
    mentions = F.rlike(line, F.lit("(?iU)" + "|".join(f"(?:{p})" for p in stops)))
    named = F.lit(False)
    for word in STOP_WORDS:
        named = named | F.lower(line).contains(word)
    return opener | (mentions & (F.length(line) < 80) & named)


def truncate_at_stop(c: Column, stops: tuple[str, ...] = STOP_48) -> Column:
    """Lines before the first stop line."""
    def cut(rows: Column) -> Column:
        at = F.array_position(F.transform(rows, lambda x: is_stop_line(x, stops)), F.lit(True)).cast("int")
        return F.array_join(F.when(at > 0, F.slice(rows, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(rows), "\n")

    return bind(F.split(text(c), "\n"), cut)


# Running headers and section titles removed from answers.
HEADER_LINES = (
    r"\[page\s+\d+(?:\s+table)?\]",
    r"(?:section\s+)?\d+(?:\.\d+)*\s*[:\-\.]?\s*(?:signal\s+(?:and|&)\s+risk\s+evaluation|summary\s+of\s+safety\s+concerns?|evaluation\s+of\s+(?:signals?|risks?)|signal\s+evaluation|characterization\s+of\s+risks?|effectiveness\s+of\s+risk\s+minimization|benefit-risk\s+balance|summary\s+of\s+safety\s+issues?).*",
    r"signal\s+(?:and|&)\s+risk\s+evaluation",
    r"summary\s+of\s+safety\s+concerns?",
    r"evaluation\s+of\s+(?:signals?|risks?)(?:\s+and\s+new\s+information)?",
    r"signal\s+evaluation",
    r"characterization\s+of\s+risks?",
    r"effectiveness\s+of\s+risk\s+minimization(?:\s+activities)?",
    r"summary\s+of\s+safety\s+issues?",
    r"benefit-risk\s+balance",
    r"periodic\s+(?:benefit-risk|safety\s+update)\s+(?:evaluation\s+)?report.*",
    r"pbrer.*",
    r"psur.*",
    r".*-\s*section\s+\d+.*",
    r"section\s+\d+(?:\.\d+)*",
    r"(?:section\s+)?\d+(?:\.\d+)*\s+[A-Za-z].*",
    r"(?:section\s+)?\d+(?:\.\d+)*$",
)


def header_line_pattern(sponsors: tuple[str, ...] = ()) -> str:
    """Pattern of running-header lines; ``sponsors`` adds company names."""
    extra = tuple(rf"{s}(?:\s+inc\.?)?.*" for s in sponsors)
    return "(?iU)^(?:" + "|".join(HEADER_LINES + extra) + ")$"


def strip_text_headings(c: Column, sponsors: tuple[str, ...] = ()) -> Column:
    """Body lines only: section titles, running headers and page marks go."""
    pattern = header_line_pattern(sponsors)

    def keep(line: Column) -> Column:
        s = strip(line)
        unpaged = strip(F.regexp_replace(s, r"(?iU)^\[page\s+\d+(?:\s+table)?\]\s*", ""))
        return (s == "") | ((unpaged != "") & ~F.rlike(s, F.lit(pattern)) & ~F.rlike(unpaged, F.lit(pattern)))

    kept = F.filter(F.split(text(c), "\n"), keep)
    blanked = F.transform(kept, lambda x: F.when(strip(x) == "", "").otherwise(x))
    return F.regexp_replace(strip(F.array_join(blanked, "\n")), "\n{3,}", "\n\n")


def strip_md_tables(c: Column) -> Column:
    """``[Page n Table]`` captions with what follows, and pipe-table lines."""
    value = F.regexp_replace(text(c), r"(?sU)\[Page\s+\d+\s+Table\].*?(?=\n\n|\z)", "")
    kept = F.filter(F.split(value, "\n"), lambda x: ~(strip(x).startswith("|") & strip(x).endswith("|")))
    return strip(F.array_join(kept, "\n"))


def strip_html_tables(c: Column) -> Column:
    value = F.regexp_replace(text(c), r'(?isU)<div class="table-responsive".*?</div>\s*', "")
    return F.regexp_replace(value, r"(?isU)<table.*?</table>\s*", "")


# Elements of an exported page that hold nothing but a heading.
HEADING_ELEMENTS = (
    ("header", "med-main-header"), ("div", "med-brand-tag"), ("header", "med-sub-header"), ("span", "med-badge"),
)
HEADING_STYLES = ("main-header", "brand-tag", "section-main-title", "sub-header", "badge", "subsection-title", "subheading")


def strip_html_headings(c: Column, sponsors: tuple[str, ...] = ()) -> Column:
    """Exported HTML with its body alone: heading elements and badges go, and of
    each paragraph the lines that are titles or running headers; a paragraph or
    wrapper that is left empty goes as well."""
    whole = "|".join(rf'<{tag} class="{cls}".*?</{tag}>' for tag, cls in HEADING_ELEMENTS) + "|<h[1-4][^>]*>.*?</h[1-4]>"
    value = F.regexp_replace(text(c), rf"(?isU)(?:{whole})\s*", "")
    value = F.regexp_replace(value, r"(?iU)\.med-(?:" + "|".join(HEADING_STYLES) + r")\s*\{[^}]*\}\s*", "")
    value = F.regexp_replace(value, r"(?iU)<title>[^<]*?(?:Section|\d+\.\d+)[^<]*?</title>", "<title>Extracted Document</title>")
    pattern, block = header_line_pattern(sponsors), r'(?is)(<p(?:\s+class="[^"]*")?>)(.*?)</p>'

    def body(line: Column) -> Column:
        plain = strip(F.regexp_replace(line, "<[^>]+>", ""))
        return (plain != "") & ~F.rlike(plain, F.lit(pattern))

    def paragraph(opening: Column, inner: Column) -> Column:
        kept = F.transform(F.filter(F.split(inner, r"<br\s*/?>|\n"), body), strip)
        lines = F.concat(opening, F.lit("\n        "), F.array_join(kept, "<br>\n        "), F.lit("\n    </p>"))
        return F.when(F.size(kept) > 0, lines).otherwise("")

    def paragraphs(v: Column) -> Column:
        found = F.zip_with(F.regexp_extract_all(v, F.lit(block), F.lit(1)), F.regexp_extract_all(v, F.lit(block), F.lit(2)), paragraph)
        # The text around the paragraphs is one piece more.
        return F.array_join(F.flatten(F.zip_with(F.split(v, block, -1), found, lambda around, p: F.array(around, p))), "")

    value = bind(value, paragraphs)
    value = F.regexp_replace(value, r'(?iU)<div class="med-root-content">\s*</div>\s*', "")
    return F.regexp_replace(value, r'(?iU)<article[^>]*>\s*<div class="med-sub-body">\s*</div>\s*</article>\s*', "")


# ---------------------------------------------------------------------------
# Tables

# System organ classes of adverse-reaction tables.
ORGAN_CLASSES = (
    "blood and lymphatic system disorders", "cardiac disorders", "congenital, familial and genetic disorders",
    "ear and labyrinth disorders", "endocrine disorders", "eye disorders", "gastrointestinal disorders",
    "general disorders and administration site conditions", "hepatobiliary disorders",
    "immune system disorders", "infections and infestations",
    "injury, poisoning and procedural complications", "investigations", "metabolism and nutrition disorders",
    "musculoskeletal and connective tissue disorders", "neoplasms benign, malignant and unspecified",
    "nervous system disorders", "pregnancy, puerperium and perinatal conditions", "product issues",
    "psychiatric disorders", "renal and urinary disorders", "reproductive system and breast disorders",
    "respiratory, thoracic and mediastinal disorders", "skin and subcutaneous tissue disorders",
    "social circumstances", "surgical and medical procedures", "vascular disorders",
)
ORGAN_CLASS_WORDS = ("disorders", "infections", "infestations", "complications", "investigations")


def is_organ_class_name(c: Column) -> Column:
    name = strip(F.regexp_replace(F.lower(strip(text(c))), r"^\*+|\*+$", ""))
    hit = F.lit(False)
    for word in (*ORGAN_CLASSES, *ORGAN_CLASS_WORDS):
        hit = hit | name.contains(word)
    return hit


def is_organ_class_row(row: Column) -> Column:
    """First cell names an organ class, all other cells are empty."""
    rest = F.slice(row, F.lit(2), F.greatest(F.size(row) - 1, F.lit(0)))
    return (F.size(row) > 0) & F.forall(rest, lambda x: strip(text(x)) == "") & is_organ_class_name(F.get(row, F.lit(0)))


def unique_columns(header: Column) -> Column:
    """Blank headers become ``Column_n``; a repeat gets its place appended."""
    named = F.transform(header, lambda h, i: F.when(
        strip(text(h)) != "", strip(text(h))).otherwise(F.concat(F.lit("Column_"), (i + 1).cast("string"))))

    def unique(names: Column) -> Column:
        return F.transform(names, lambda h, i: F.when(
            F.array_contains(F.slice(names, F.lit(1), F.greatest(i, F.lit(0))), h) & (i > 0),
            F.concat(h, F.lit("_"), (i + 1).cast("string"))).otherwise(h))

    return bind(named, unique)


def align_rows(rows: Column) -> Column:
    """All rows padded with blanks to the widest, cells cleaned."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    clean = lambda x: strip(F.replace(text(x), F.lit("\n"), F.lit(" ")))
    return F.transform(rows, lambda r: F.concat(F.transform(r, clean), F.array_repeat(F.lit(""), width - F.size(r))))


def rows_to_maps(columns: Column, rows: Column) -> Column:
    return F.transform(rows, lambda r: F.map_from_arrays(columns, r))


def markdown_table(rows: Column) -> Column:
    """Pipe table; the first row is the header, short rows are padded."""
    def render(aligned: Column) -> Column:
        def line(r: Column) -> Column:
            return F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))

        head = F.get(aligned, F.lit(0))
        rule = line(F.array_repeat(F.lit("---"), F.size(head)))
        body = F.transform(F.slice(aligned, F.lit(2), F.greatest(F.size(aligned) - 1, F.lit(0))), line)
        return F.array_join(F.concat(F.array(line(head), rule), body), "\n")

    return F.when(F.size(rows) > 0, bind(align_rows(rows), render)).otherwise("")


def markdown_report_table(columns: Column, rows: Column) -> Column:
    """Pipe table with bold organ-class rows; rows are cut or padded to the
    header, a repeated header row is dropped."""
    def render(c: Column) -> Column:
        cols, data = c["cols"], c["rows"]
        width = F.size(cols)
        flat = lambda x: strip(F.replace(text(x), F.lit("\n"), F.lit(" ")))

        def line(r: Column) -> Column:
            cells = F.slice(F.concat(F.transform(r, flat), F.array_repeat(F.lit(""), width)), F.lit(1), width)
            bold = bind(cells, lambda x: F.when(
                is_organ_class_row(x),
                F.concat(F.array(F.concat(F.lit("**"), F.get(x, F.lit(0)), F.lit("**"))),
                         F.slice(x, F.lit(2), F.greatest(width - 1, F.lit(0)))),
            ).otherwise(x))
            return F.concat(F.lit("| "), F.array_join(bold, " | "), F.lit(" |"))

        head = F.concat(F.lit("| "), F.array_join(F.transform(cols, flat), " | "), F.lit(" |"))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        return F.array_join(F.concat(F.array(head, rule), F.transform(data, line)), "\n")

    no_header = F.size(columns) == 0
    head = F.when(no_header, F.get(rows, F.lit(0))).otherwise(columns)
    skip_first = no_header | (F.get(rows, F.lit(0)) == columns)
    data = F.when(skip_first, F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)
    return F.when((F.size(columns) == 0) & (F.size(rows) == 0), "").otherwise(
        bind(record(cols=head, rows=data), render))


def clean_table(rows: Column) -> Column:
    """STRUCT<columns, data>: empty columns dropped, up to two header rows
    below the first merged into it."""
    empty_rows = F.array().cast("array<array<string>>")

    def pruned(grid: Column) -> Column:
        width = F.size(F.get(grid, F.lit(0)))
        filled = F.filter(
            F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))),
            lambda c: F.exists(grid, lambda r: F.get(r, c) != ""))
        in_column = lambda c: F.size(F.filter(grid, lambda r: F.get(r, F.lit(c)) != ""))
        top = F.get(grid, F.lit(0))
        shifted = (
            F.array_contains(filled, 0) & F.array_contains(filled, 1) & (in_column(0) == 1)
            & (F.get(top, F.lit(0)) != "") & (F.get(top, F.lit(1)) == "") & (in_column(1) > 1)
        )
        moved = F.transform(grid, lambda r, i: F.when(
            shifted & (i == 0),
            F.concat(F.array(F.get(r, F.lit(0)), F.get(r, F.lit(0))), F.slice(r, F.lit(3), F.greatest(F.size(r) - 2, F.lit(0)))),
        ).otherwise(r))
        kept = F.when(shifted, F.filter(filled, lambda c: c != 0)).otherwise(filled)
        return F.transform(moved, lambda r: F.transform(kept, lambda c: F.get(r, c)))

    def split(grid: Column) -> Column:
        def sub_header(i: int) -> Column:
            r = F.get(grid, F.lit(i))
            rest = F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0)))
            return F.coalesce((F.get(r, F.lit(0)) == "") & F.exists(rest, lambda x: x != ""), F.lit(False))

        n_head = F.when(sub_header(1), F.when(sub_header(2), 3).otherwise(2)).otherwise(1)
        heads = F.slice(grid, F.lit(1), n_head)
        places = F.sequence(F.lit(0), F.greatest(F.size(F.get(grid, F.lit(0))) - 1, F.lit(0)))
        columns = F.transform(places, lambda c: F.array_join(F.array_distinct(F.filter(
            F.transform(heads, lambda h: F.get(h, c)), lambda x: x != "")), " "))
        return record(
            columns=columns, data=F.slice(grid, n_head + 1, F.greatest(F.size(grid) - n_head, F.lit(0))))

    no_table = record(columns=F.array().cast("array<string>"), data=empty_rows)
    any_cell = F.exists(rows, lambda r: F.exists(r, lambda x: strip(text(x)) != ""))
    return F.when(any_cell, bind(bind(align_rows(rows), pruned), split)).otherwise(no_table)


def table_footnotes(rows: Column) -> Column:
    cells = F.transform(F.flatten(rows), lambda x: strip(text(x)))
    return F.filter(cells, lambda x: F.rlike(x, F.lit(r"(?U)^[*†‡§1-9]\s+[A-Za-z]")) | F.lower(x).startswith("note:"))


def markdown_to_rows(c: Column) -> Column:
    """ARRAY<STRUCT<headers, rows>> of the pipe tables in a text."""
    blocks = F.regexp_extract_all(text(c), F.lit(r"((?:\|[^\n]+\|\n?)+)"), F.lit(1))

    def cells(line: Column) -> Column:
        parts = F.split(line, r"\|")
        return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), strip)

    def parsed(block: Column) -> Column:
        rows = F.filter(F.transform(F.split(strip(block), "\n"), strip), lambda x: x.startswith("|"))
        header = cells(F.get(rows, F.lit(0)))
        body = F.transform(F.slice(rows, F.lit(3), F.greatest(F.size(rows) - 2, F.lit(0))), cells)
        n = lambda r: F.least(F.size(header), F.size(r))
        return F.when(F.size(rows) >= 3, record(
            headers=header,
            rows=F.transform(body, lambda r: F.map_from_arrays(F.slice(header, F.lit(1), n(r)), F.slice(r, F.lit(1), n(r)))),
        ))

    return F.array_compact(F.transform(blocks, parsed))


def text_to_subsections(c: Column) -> Column:
    """ARRAY<STRUCT<name, pages, content>> of ``### title`` blocks."""
    pattern = F.lit(r"(?sU)###\s+([^\n]+)\n(.*?)(?=(?:###\s+[^\n]+\n)|\z)")
    value = text(c)
    names, bodies = F.regexp_extract_all(value, pattern, F.lit(1)), F.regexp_extract_all(value, pattern, F.lit(2))

    def item(name: Column, body: Column) -> Column:
        pages = F.regexp_extract_all(body, F.lit(r"\[Page\s+(\d+)\]"), F.lit(1))
        return record(
            name=strip(name), pages=F.array_sort(F.array_distinct(F.transform(pages, lambda p: p.cast("int")))),
            content=strip(body))

    return F.zip_with(names, bodies, item)


def replace_inline_tables(content: Column, merged: Column) -> Column:
    """Pipe-table fragments replaced by the merged tables: the whole span when
    little text lies between them, else the first fragment."""
    fragment = r"(?U)(?:(?:\[Page\s+\d+\s+Table\]\s*\n)?\|[^\n]+\|\n?)+"
    span = r"(?sU)^(.*?)(" + fragment[4:] + r"(?:.*" + fragment[4:] + r")?)((?:(?!\|[^\n]+\|).)*)$"

    def replaced(value: Column) -> Column:
        middle = F.regexp_extract(value, span, 2)
        between = F.regexp_replace(middle, r"(?U)(?:\[Page\s+\d+(?:\s+Table)?\]|\|[^\n]+\||\s+)", "")
        before = F.regexp_replace(F.regexp_extract(value, span, 1), r"(?U)\s+$", "")
        after = F.regexp_replace(F.regexp_extract(value, span, 3), r"(?U)^\s+", "")
        whole = strip(F.concat(before, F.lit("\n\n"), merged, F.lit("\n\n"), after))
        head = F.regexp_extract(value, span, 1)
        tail = F.substr(value, F.length(head) + 1)
        rest = F.regexp_replace(tail, fragment, "")
        return F.when(F.length(between) < 60, whole).otherwise(strip(F.concat(head, merged, rest)))

    value = text(content)
    return F.when(F.rlike(value, F.lit(fragment)) & (text(merged) != ""), bind(value, replaced)).otherwise(value)
