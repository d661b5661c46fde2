"""Documents: headings, section boundaries, roll-ups and text rendering.

A block table has doc, ord (dense reading order), page_num, block_type, text,
font_size, is_bold and bbox. Nothing is collected per document: results stay
rows in reading order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilake.functions.documents import (
    PAGE_NUMBER, header_template, is_subheading, match_heading, section_level, section_parent, section_prefixes,
)
from vigilake.functions.text import squeeze, strip, text
from vigilake.operators.skew import carry_forward, merge_join, neighbour, running_sum

# Header and footer bands, default page height.
HEADER_BAND, FOOTER_BAND, PAGE_HEIGHT = 0.12, 0.10, 792.0


def body_font_size(spans: DataFrame) -> DataFrame:
    """Font size with the most characters per document; the smaller on a tie."""
    sizes = spans.groupBy("doc", "font_size").agg(F.sum(F.length("text")).alias("_chars"))
    return sizes.groupBy("doc").agg(
        F.max_by("font_size", F.struct("_chars", (-F.col("font_size")).alias("s"))).alias("body_font_size"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Sorted by page, then top, then left edge, each rounded to a tenth."""
    return blocks.orderBy("doc", "page_num", F.round(F.col("bbox")[1], 1), F.round(F.col("bbox")[0], 1))


def tag_headers_footers(blocks: DataFrame) -> DataFrame:
    """``block_type`` header / footer for page numbers and templates that
    repeat on two pages or more. Optional ``page_height`` column."""
    height = F.col("page_height") if "page_height" in blocks.columns else F.lit(PAGE_HEIGHT)
    top = F.col("bbox")[3] <= height * HEADER_BAND + 10
    bottom = F.col("bbox")[1] >= height * (1.0 - FOOTER_BAND) - 10
    d = blocks.withColumn("_template", header_template(F.col("text"))).withColumn("_top", top).withColumn("_bottom", bottom)
    zones = d.where(F.col("_template") != "").select(
        "doc", "page_num", "_template",
        F.explode(F.array_compact(F.array(F.when(top, "top"), F.when(bottom, "bottom")))).alias("_zone"))
    # Two distinct pages exist exactly when the first is not the last.
    repeated = zones.groupBy("doc", "_zone", "_template").agg(
        F.min("page_num").alias("_first"), F.max("page_num").alias("_last")
    ).where("_first <> _last").select("doc", "_zone", "_template", F.lit(True).alias("_repeated"))
    d = d.withColumn("_zone", F.when(F.col("_top"), "top").when(F.col("_bottom"), "bottom"))
    d = d.join(repeated, ["doc", "_zone", "_template"], "left")
    hit = (F.col("_template") != "") & (
        F.coalesce("_repeated", F.lit(False)) | F.rlike(strip(F.col("text")), F.lit(PAGE_NUMBER)))
    kind = F.when(hit & (F.col("_zone") == "top"), "header").when(hit & (F.col("_zone") == "bottom"), "footer")
    return d.withColumn("block_type", F.coalesce(kind, "block_type")).select(*blocks.columns)


def process_blocks(blocks: DataFrame, body_size: Column | float = 11.0, bookmarks: DataFrame | None = None) -> DataFrame:
    """Blocks whose first line is a prominent heading are split into a heading
    and a body block.

    Prominent: at least half a point below body size, bold, or named by a
    bookmark (doc, number). ``part`` is 0 for headings and whole blocks, 1 for
    bodies; (ord, part) is the reading order.
    """
    rows = F.filter(F.split(text(F.col("text")), "\n"), lambda x: strip(x) != "")
    d = blocks.withColumn("_lines", rows).withColumn("_fixed", F.col("block_type").isin("header", "footer", "table"))
    d = d.where(F.col("_fixed") | (F.size("_lines") > 0))
    d = d.withColumn("_h", F.when(~F.col("_fixed"), match_heading(F.get("_lines", F.lit(0)))))
    size = body_size if isinstance(body_size, Column) else F.lit(body_size)
    prominent = (F.col("font_size") >= size - 0.5) | F.col("is_bold")
    if bookmarks is not None:
        marks = bookmarks.select("doc", F.explode(section_prefixes(F.col("number"))).alias("_mark")).distinct()
        marked = marks.withColumn("_marked", F.lit(True))
        d = d.join(marked, (d.doc == marked.doc) & (F.col("_h.number") == F.col("_mark")), "left").drop(marked.doc)
        prominent = prominent | F.coalesce("_marked", F.lit(False))
    d = d.withColumn("_valid", F.coalesce(F.col("_h").isNotNull() & prominent, F.lit(False)))
    number, title = F.col("_h.number"), F.col("_h.title")
    head_text = F.when(title != "", strip(F.concat_ws(" ", number, title))).otherwise(strip(F.get("_lines", F.lit(0))))
    rest = strip(F.array_join(F.slice("_lines", F.lit(2), F.greatest(F.size("_lines") - 1, F.lit(0))), "\n"))
    none = F.lit(None)

    def part(i: int, kind: Column, body: Column, num: Column, heading: Column, level: Column) -> Column:
        return F.named_struct(
            F.lit("part"), F.lit(i), F.lit("block_type"), kind, F.lit("text"), body,
            F.lit("section_number"), num.cast("string"), F.lit("is_heading"), heading,
            F.lit("heading_level"), level.cast("int"))

    whole = part(0, F.col("block_type"), F.col("text"), none, F.lit(False), none)
    head = part(0, F.lit("heading"), head_text, number, F.lit(True), F.col("_h.level"))
    body = part(1, F.lit("paragraph"), rest, number, F.lit(False), none)
    pieces = F.when(~F.col("_valid"), F.array(whole)).when(rest == "", F.array(head)).otherwise(F.array(head, body))
    keep = [c for c in blocks.columns if c not in ("text", "block_type", "section_number", "is_heading", "heading_level")]
    return d.select(*keep, F.inline(pieces))


def with_dense_order(blocks: DataFrame) -> DataFrame:
    """``ord`` from (ord, part): bodies follow their headings."""
    return blocks.withColumn("ord", (F.col("ord") * 2 + F.col("part")).cast("long")).drop("part")


def drop_text_in_tables(blocks: DataFrame, tables: DataFrame, include_tables: bool = True) -> DataFrame:
    """Text blocks inside a table's box (centre within 5 points, or more than
    35 % of the block's area) go; headings stay; tables join the list."""
    box = lambda c, i: F.col(c)[i]
    b, t = "bbox", "_tbox"
    boxes = tables.select(F.col("doc").alias("_tdoc"), F.col("page_num").alias("_tpage"), F.col("bbox").alias(t))
    cx, cy = (box(b, 0) + box(b, 2)) / 2, (box(b, 1) + box(b, 3)) / 2
    inside = cx.between(box(t, 0) - 5, box(t, 2) + 5) & cy.between(box(t, 1) - 5, box(t, 3) + 5)
    width = F.least(box(b, 2), box(t, 2)) - F.greatest(box(b, 0), box(t, 0))
    height = F.least(box(b, 3), box(t, 3)) - F.greatest(box(b, 1), box(t, 1))
    area = F.greatest(F.lit(1.0), (box(b, 2) - box(b, 0)) * (box(b, 3) - box(b, 1)))
    overlap = (width > 0) & (height > 0) & (width * height / area > 0.35)
    same_page = (F.col("doc") == F.col("_tdoc")) & (F.col("page_num") == F.col("_tpage"))
    text_blocks = blocks.join(boxes, same_page & ~F.col("is_heading") & (inside | overlap), "left_anti")
    if not include_tables:
        return text_blocks
    return text_blocks.unionByName(tables, allowMissingColumns=True)


def carry_sections(blocks: DataFrame, block_size: int = 65_536) -> DataFrame:
    """Every block takes the section number of the last heading above it."""
    number = F.when(F.col("is_heading"), F.col("section_number"))
    return carry_forward(blocks, ["doc"], "ord", number, "section", block_size)


def _headings(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("is_heading") & F.col("section_number").isNotNull()).select(
        "doc", "ord", F.col("section_number").alias("number"))


def section_roots(blocks: DataFrame) -> DataFrame:
    """Headings (doc, ord, number, is_root): top-level numbers, and deeper ones
    whose parent did not occur before."""
    heads = _headings(blocks).withColumn("_parent", section_parent(F.col("number")))
    first = heads.groupBy("doc", "number").agg(F.min("ord").alias("_first"))
    parents = first.select(F.col("doc").alias("_d"), F.col("number").alias("_n"), "_first")
    joined = heads.join(parents, (heads.doc == F.col("_d")) & (F.col("_parent") == F.col("_n")), "left")
    orphan = F.col("_first").isNull() | (F.col("_first") >= F.col("ord"))
    return joined.select("doc", "ord", "number", (F.col("_parent").isNull() | orphan).alias("is_root"))


def find_stop_section(blocks: DataFrame, main: str, target: str | None = None) -> DataFrame:
    """(doc, stop): the section that ends the request, for documents that have
    one: next sibling of the target, else the number after it, else the next
    root after the main section."""
    roots = section_roots(blocks)
    own = roots.where(F.col("is_root"))
    start = own.where(F.col("number") == main).groupBy("doc").agg(F.min("ord").alias("_main"))
    next_root = own.join(start, "doc").where(F.col("ord") > F.col("_main")).groupBy("doc").agg(
        F.min_by("number", "ord").alias("next_root"))
    if target is None:
        return next_root.select("doc", F.col("next_root").alias("stop"))
    last = target.split(".")[-1]
    candidate = ".".join([*target.split(".")[:-1], str(int(last) + 1)]) if last.isdigit() else None
    number = F.col("number")
    anchors = roots.groupBy("doc").agg(
        F.max(F.when(number == main, F.col("ord"))).alias("_main_last"),
        F.max(F.when(number == target, F.col("ord"))).alias("_target_last"),
        F.bool_or(number == F.lit(candidate)).alias("_has_candidate"),
    )
    is_child = section_parent(F.lit(target)) == F.lit(main)
    siblings = roots.join(anchors, "doc").where(
        is_child & (section_parent(number) == main) & (F.col("_main_last") < F.col("_target_last"))
        & (F.col("ord") > F.col("_target_last"))
    ).groupBy("doc").agg(F.min_by("number", "ord").alias("sibling"))
    joined = anchors.join(siblings, "doc", "left").join(next_root, "doc", "left")
    stop = F.coalesce("sibling", F.when(F.col("_has_candidate"), F.lit(candidate)), "next_root")
    return joined.select("doc", stop.alias("stop")).where(F.col("stop").isNotNull())


def extract_within_boundary(blocks: DataFrame, main: str, target: str | None = None) -> DataFrame:
    """Blocks from the main heading to the stop section that belong to the
    request. ``blocks`` come from :func:`carry_sections`."""
    section, heading = F.col("section"), F.col("is_heading")
    prefix = f"{target}." if target else f"{main}."
    wanted = (section == main) | section.startswith(prefix)
    if target:
        wanted = wanted | (section == target)
    wanted = F.coalesce(wanted, F.lit(False))
    body = blocks.where(~F.col("block_type").isin("header", "footer"))
    opens = heading & section.isin(*[s for s in (main, target) if s])
    starts = body.where(opens).groupBy("doc").agg(F.min("ord").alias("_start"))
    limits = starts.join(find_stop_section(blocks, main, target), "doc", "left")
    d = body.join(limits, "doc").where(F.col("ord") >= F.col("_start"))
    at_stop = F.coalesce(section == F.col("stop"), F.lit(False))
    if target:
        foreign = heading & ~section.isin(main, target) & ~section.startswith(f"{target}.")
        at_stop = at_stop | (F.col("stop").isNotNull() & foreign)
    breaks = (F.col("ord") > F.col("_start")) & (at_stop | (heading & ~wanted))
    ends = d.where(breaks).groupBy("doc").agg(F.min("ord").alias("_end"))
    kept = d.where(wanted).join(ends, "doc", "left").where(F.col("_end").isNull() | (F.col("ord") < F.col("_end")))
    return kept.drop("_start", "_end")


def section_page_bounds(blocks: DataFrame) -> DataFrame:
    """First and last page of every section with all its descendants.

    A section whose parent is missing is a root: it counts for itself and the
    sections below it, not for those further up.
    """
    pages = blocks.where(F.col("section").isNotNull()).groupBy("doc", "section").agg(
        F.min("page_num").alias("_lo"), F.max("page_num").alias("_hi"))
    chain = pages.select("doc", "section", "_lo", "_hi", F.explode(section_prefixes(F.col("section"))).alias("number"))
    roots = section_roots(blocks).groupBy("doc", "number").agg(F.bool_or("is_root").alias("_root"))
    known = chain.join(roots, ["doc", "number"], "left").withColumn("_level", section_level(F.col("number")))
    cut = known.groupBy("doc", "section").agg(F.max(F.when(F.col("_root"), F.col("_level"))).alias("_cut"))
    linked = known.where(F.col("_root").isNotNull()).join(cut, ["doc", "section"]).where(
        F.col("_level") >= F.coalesce("_cut", F.lit(1)))
    return linked.groupBy("doc", "number").agg(F.min("_lo").alias("start_page"), F.max("_hi").alias("end_page"))


def validation_checklist(extracted: DataFrame, blocks: DataFrame, main: str, target: str | None = None) -> DataFrame:
    """One row per document: what was found, pages, counts, sections left out
    and a confidence between 0 and 1."""
    docs = blocks.select("doc").distinct()
    found = extracted.groupBy("doc").agg(
        F.min("page_num").alias("start_page"), F.max("page_num").alias("end_page"),
        F.count(F.lit(1)).alias("total_blocks"), F.count_if(F.col("block_type") == "table").alias("tables_included"),
        F.bool_or(F.col("section") == main).alias("main_found"),
        (F.bool_or(F.col("section") == target) if target else F.lit(True)).alias("target_found"),
    )
    stops = find_stop_section(blocks, main, target)
    included = extracted.select("doc", F.col("section").alias("number")).distinct().withColumn("_in", F.lit(True))
    numbers = _headings(blocks).select("doc", "number").distinct().join(included, ["doc", "number"], "left")
    # Later sections are told apart as text, the way they are listed.
    excluded = numbers.join(stops, "doc").where(F.col("_in").isNull() & (F.col("number") >= F.col("stop"))).groupBy("doc").agg(
        F.count(F.lit(1)).alias("n_excluded"))
    stop_included = numbers.join(stops, "doc").where(F.col("_in") & (F.col("number") == F.col("stop"))).select(
        "doc", F.lit(1).alias("_leak"))
    d = docs.join(found, "doc", "left").join(excluded, "doc", "left").join(stop_included, "doc", "left")
    any_found = F.col("total_blocks").isNotNull()
    main_ok, target_ok = F.coalesce("main_found", F.lit(False)), F.coalesce("target_found", F.lit(False))
    warnings = (~main_ok).cast("int") + (~target_ok).cast("int") + F.coalesce("_leak", F.lit(0))
    score = (
        F.lit(0.5) + F.when(main_ok, 0.25).otherwise(0.0) + F.when(target_ok, 0.15).otherwise(0.0)
        + F.when(warnings == 0, 0.10).otherwise(-0.10 * warnings)
    )
    confidence = F.when(any_found, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 2)))).otherwise(0.0)
    status = (
        F.when(~any_found, f"Section {main} was not found in the document.")
        .when(confidence >= 0.8, "Extraction completed with high confidence.")
        .when(confidence >= 0.5, "Extraction completed with warnings.")
        .otherwise("Extraction completed with low confidence.")
    )
    return d.select(
        "doc", F.coalesce("start_page", F.lit(0)).alias("start_page"), F.coalesce("end_page", F.lit(0)).alias("end_page"),
        F.coalesce("total_blocks", F.lit(0)).alias("total_blocks"),
        F.coalesce("tables_included", F.lit(0)).alias("tables_included"), main_ok.alias("main_found"),
        (any_found & target_ok).alias("target_found"), F.coalesce("n_excluded", F.lit(0)).alias("n_excluded"),
        confidence.alias("confidence"), status.alias("status_message"),
    )


def subsection_rollup(extracted: DataFrame, main: str) -> DataFrame:
    """(doc, section, title, n_parts, n_tables, text_chars) of every subsection;
    its text is the non-heading blocks in order (:func:`section_text`)."""
    d = extracted.where(F.col("section").isNotNull() & (F.col("section") != main))
    is_text = (F.col("block_type") != "heading") & (text(F.col("text")) != "")
    return d.groupBy("doc", "section").agg(
        F.coalesce(
            F.min_by("text", F.when(F.col("block_type") == "heading", F.col("ord"))),
            F.concat(F.lit("Section "), F.max("section")),
        ).alias("title"),
        F.count_if(is_text).alias("n_parts"), F.count_if(F.col("block_type") == "table").alias("n_tables"),
        F.coalesce(F.sum(F.when(is_text, F.length("text"))), F.lit(0)).alias("text_chars"),
    )


def section_text(extracted: DataFrame) -> DataFrame:
    """Text parts of subsections, in reading order by ``ord``."""
    return extracted.where((F.col("block_type") != "heading") & (text(F.col("text")) != "")).select(
        "doc", "section", "ord", "text")


def block_trace(extracted: DataFrame) -> DataFrame:
    """Trace rows: element number, page, section, type, text on one line, box."""
    numbered = running_sum(extracted, ["doc"], "ord", F.lit(1), "_n")
    return numbered.select(
        "doc", F.concat(F.lit("elem_"), F.col("_n").cast("string")).alias("id"), F.col("page_num").alias("page"),
        text(F.col("section")).alias("section"), F.col("block_type").alias("type"),
        F.replace(text(F.col("text")), F.lit("\n"), F.lit(" ")).alias("text_or_caption"),
    )


def batch_summary(checklist: DataFrame, main: str, target: str | None = None) -> DataFrame:
    return checklist.select(
        F.col("doc"), F.lit(main).alias("section"), F.lit(target or "").alias("subsection"), "start_page", "end_page",
        F.when(F.col("main_found"), "success").otherwise("not_found").alias("status"),
        F.format_string("%.0f%%", F.col("confidence") * 100).alias("confidence"),
        F.col("total_blocks").alias("blocks_extracted"), F.col("tables_included").alias("tables_extracted"),
    )


def batch_counts(summary: DataFrame) -> DataFrame:
    return summary.groupBy("status").agg(F.count(F.lit(1)).alias("documents"))


def needs_scan(pages: DataFrame, threshold: int = 40, first_pages: int | None = None) -> DataFrame:
    """Documents whose pages, or only the first of them, carry few characters."""
    first = pages if first_pages is None else pages.where(F.col("page_num") <= first_pages)
    return first.groupBy("doc").agg(
        (F.sum(F.length(strip(F.col("text")))) / F.count(F.lit(1))).alias("avg_chars")
    ).withColumn("is_scanned", F.col("avg_chars") < threshold)


def in_document_product(pages: DataFrame, product: Column, ingredient: Column, first_pages: int | None = None) -> DataFrame:
    """Documents that name the product or ingredient on a page, or only on one
    of the first pages."""
    p, i = F.lower(strip(text(product))), F.lower(strip(text(ingredient)))
    low = F.lower("text")
    hit = (p == "") | F.contains(low, p) | ((F.length(i) > 3) & F.contains(low, i))
    first = pages if first_pages is None else pages.where(F.col("page_num") <= first_pages)
    return first.groupBy("doc").agg(F.bool_or(hit).alias("is_product"))


def label_section_bounds(blocks: DataFrame, start: str, stops: list[str], start_words: list[str], stop_words: list[str], contents_pages: int = 0) -> DataFrame:
    """Blocks of one numbered label section, which does not open or close on the
    contents pages at the start."""
    flat = F.upper(squeeze(F.col("text")))
    section, heading = text(F.col("section_number")), F.col("is_heading")

    def any_word(words: list[str]) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.col("_flat"), F.lit(w.upper()))
        return hit

    number = start.replace(".", r"\.")
    worded = any_word(start_words)
    f = F.col("_flat")
    opens = (
        (heading & (section == start) & ((f == start) | worded))
        | (heading & F.rlike(f, F.lit(rf"(?iU)^(?:SECTION\s*)?{number}[.\s]+")))
        | (worded & ((section == start) | (heading & F.rlike(f, F.lit(rf"(?U)\b{number}\b")))))
    )
    stop = F.lit(False)
    for s in stops:
        stop = stop | (section == s) | f.startswith(s)
    closes = heading & (stop | any_word(stop_words))
    d = blocks.withColumn("_flat", flat).withColumn("_open", opens & (F.col("page_num") > contents_pages)).withColumn(
        "_close", closes & (F.col("page_num") > contents_pages)).drop("_flat")
    starts = d.where("_open").groupBy("doc").agg(F.min("ord").alias("_start"))
    d = d.join(starts, "doc").where(F.col("ord") >= F.col("_start"))
    ends = d.where(F.col("_close") & (F.col("ord") > F.col("_start"))).groupBy("doc").agg(F.min("ord").alias("_end"))
    return d.join(ends, "doc", "left").where(
        (F.col("_end").isNull() | (F.col("ord") < F.col("_end"))) & ~F.col("block_type").isin("header", "footer")
    ).drop("_open", "_close", "_start", "_end")


# Subsection headings of an adverse-reactions section.
LABEL_SUBSECTIONS = (
    r"^(?:SECTION\s*)?6[.\s]+(\d+)[.\s]*(.*)", r"^(?:6[.\s]+)?(Clinical Trials?\s+Experience.*)",
    r"^(?:6[.\s]+)?(Postmarketing\s+Experience.*)", r"^(?:6[.\s]+)?(Post-Marketing\s+Experience.*)",
    r"^(?:6[.\s]+)?(Other\s+Clinical\s+Trial\s+Experience.*)", r"^(?:6[.\s]+)?(Immunogenicity.*)",
    r"^(?:6[.\s]+)?(Laboratory\s+Abnormalities.*)",
)
SPLIT_NUMBER = r"(?iU)^(?:SECTION\s*)?6[.\s]+(\d+)\s*$"


def split_subsections(blocks: DataFrame) -> DataFrame:
    """Blocks of a label section with ``sub_no`` (0 before the first heading)
    and the subsection's name on its heading row.

    A bare number takes the next block as its title when that is short.
    """
    d = neighbour(blocks, ["doc"], "ord", {"text": "_next"}, 1)
    own, following = strip(text(F.col("text"))), strip(text(F.col("_next")))
    bare = F.rlike(own, F.lit(SPLIT_NUMBER)) & F.col("is_heading")
    takes_next = bare & (following != "") & (F.length(following) < 100) & ~following.startswith("|")
    listed = F.rlike(own, F.lit("(?iU)" + "|".join(f"(?:{p})" for p in LABEL_SUBSECTIONS))) & (
        F.col("is_heading") | (F.length(own) < 90))
    number = F.regexp_extract(own, SPLIT_NUMBER, 1)
    name = (
        F.when(takes_next, F.concat(F.lit("6."), number, F.lit(" "), following))
        .when(bare, F.concat(F.lit("6."), number)).when(listed, own)
    )
    d = d.withColumn("_takes", takes_next).withColumn("sub_name", name)
    # A block that became a title opens nothing itself.
    used = d.where("_takes").select("doc", (F.col("ord") + 1).alias("ord"), F.lit(True).alias("_used"))
    d = merge_join(d, used, ["doc", "ord"], "left").withColumn("_used", F.coalesce("_used", F.lit(False)))
    d = d.withColumn("sub_name", F.when(~F.col("_used"), F.col("sub_name")))
    numbered = running_sum(d, ["doc"], "ord", F.col("sub_name").isNotNull().cast("int"), "sub_no")
    return numbered.withColumn("is_title", F.col("sub_name").isNotNull() | F.col("_used")).drop("_next", "_takes", "_used")


def subsection_tables(subsections: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables whose pages meet the pages of a subsection, as an equi-join on
    page. tables: doc, table_id, pages."""
    pages = subsections.select("doc", "sub_no", F.col("page_num").alias("page")).distinct()
    exploded = tables.select("doc", "table_id", F.explode("pages").alias("page"))
    return merge_join(pages, exploded, ["doc", "page"]).select("doc", "sub_no", "table_id").distinct()


def blocks_to_text(blocks: DataFrame) -> DataFrame:
    """Rendered pieces in reading order: a page mark where the page changes,
    ``###`` headings (a bare number joined with the next block), tables inline.
    The document text is the pieces joined by blank lines."""
    d = blocks.where((F.col("block_type") == "table") | (strip(text(F.col("text"))) != ""))
    dense = running_sum(d, ["doc"], "ord", F.lit(1), "_n").withColumn("_n", F.col("_n").cast("long"))
    d = neighbour(dense, ["doc"], "_n", {"text": "_next", "block_type": "_next_type"}, 1)
    own, following = strip(text(F.col("text"))), strip(text(F.col("_next")))
    bare = r"(?iU)^(?:SECTION\s*)?6[.\s]*(\d+)?\s*$"
    is_bare = F.col("is_heading") & F.rlike(own, F.lit(bare))
    joins = (
        is_bare & F.col("_next").isNotNull() & (F.col("_next_type") != "table") & (F.length(following) < 100)
        & ~following.startswith("|")
    )
    number = F.regexp_extract(own, bare, 1)
    merged = F.when(number != "", F.concat(F.lit("6."), number, F.lit(" "), following)).when(
        following.startswith("6"), following).otherwise(F.concat(F.lit("6. "), following))
    d = d.withColumn("_joins", F.coalesce(joins, F.lit(False)))
    used = d.where("_joins").select("doc", (F.col("_n") + 1).alias("_n"), F.lit(True).alias("_used"))
    d = merge_join(d, used, ["doc", "_n"], "left").where(F.col("_used").isNull())
    shifted = running_sum(d.where("block_type <> 'table'"), ["doc"], "_n", F.lit(1), "_m").withColumn(
        "_m", F.col("_m").cast("long"))
    with_prev = neighbour(shifted, ["doc"], "_m", {"page_num": "_prev_page"}, -1)
    new_page = F.col("_prev_page").isNull() | (F.col("_prev_page") != F.col("page_num"))
    body = (
        F.when(F.col("_joins"), F.concat(F.lit("\n### "), merged, F.lit("\n")))
        .when(F.col("is_heading"), F.concat(F.lit("\n### "), own, F.lit("\n"))).otherwise(own)
    )
    pieces = F.when(new_page, F.array(F.concat(F.lit("[Page "), F.col("page_num").cast("string"), F.lit("]")), body)).otherwise(
        F.array(body))
    lines = with_prev.select("doc", "ord", F.posexplode(pieces).alias("part", "piece"))
    tables = d.where("block_type = 'table'").select(
        "doc", "ord", F.lit(0).alias("part"), F.concat(F.lit("\n"), F.col("text"), F.lit("\n")).alias("piece"))
    return lines.unionByName(tables)


def paragraph_reflow(blocks: DataFrame) -> DataFrame:
    """Lines tagged with their paragraph: ``item_no`` counts up at every
    sub-heading, section header, pipe line, table and block end; a block whose
    sentence goes on in lower case on the next block does not end.

    An item's text is its lines joined by blanks, sub-headings with ``###``.
    """
    mark = r"(?iU)^\[Page\s+\d+\]\s*"
    clean = F.regexp_replace(strip(text(F.col("text"))), mark, "")
    d = neighbour(blocks, ["doc"], "ord", {"text": "_next"}, 1).withColumn("_clean", clean)
    next_clean = F.regexp_replace(strip(text(F.col("_next"))), mark, "")
    is_table = F.col("block_type") == "table"
    rows = F.when(is_table, F.array(strip(F.col("text")))).otherwise(
        F.filter(F.transform(F.split("_clean", "\n"), strip), lambda x: x != ""))
    header = r"(?iU)^(?:\[Page\s+\d+\]\s*)?(4\.[68]|5\.[0-9])\b"

    def kind_of(line: Column) -> Column:
        return (
            F.when(is_table, "table").when(is_subheading(line) | F.rlike(line, F.lit(header)), "heading")
            .when(F.rlike(line, F.lit(r"^\|.*\|")), "pipe").otherwise("text")
        )

    last_line = F.element_at("_rows", -1)
    goes_on = ~is_table & ~F.rlike(last_line, F.lit(r"[.!?:]$")) & F.rlike(next_clean, F.lit(r"^\p{Ll}")) & (
        kind_of(last_line) == "text")
    d = d.withColumn("_rows", rows).where(F.size("_rows") > 0).withColumn("_goes_on", F.coalesce(goes_on, F.lit(False)))
    lines = d.select("doc", "ord", "_goes_on", F.size("_rows").alias("_count"), F.posexplode("_rows").alias("line_no", "line"), is_table.alias("_table"))
    kind = F.when(F.col("_table"), "table").when(
        is_subheading(F.col("line")) | F.rlike("line", F.lit(header)), "heading").when(
        F.rlike("line", F.lit(r"^\|.*\|")), "pipe").otherwise("text")
    lines = lines.withColumn("kind", kind)
    lines = _number_lines(lines)
    ends = (F.col("kind") != "text") | ((F.col("line_no") + 1 == F.col("_count")) & ~F.col("_goes_on"))
    flagged = lines.withColumn("_ends", ends)
    prev = neighbour(flagged, ["doc"], "_k", {"_ends": "_prev_ends", "kind": "_prev_kind"}, -1)
    opens = F.col("_prev_ends").isNull() | F.col("_prev_ends") | (F.col("kind") != "text")
    numbered = running_sum(prev, ["doc"], "_k", opens.cast("int"), "item_no")
    shown = F.when(F.col("kind") == "heading", F.concat(F.lit("### "), F.regexp_replace("line", r"(?U)^###\s*", ""))).otherwise(F.col("line"))
    return numbered.select("doc", "item_no", "ord", "line_no", "kind", shown.alias("line"))


def _number_lines(lines: DataFrame) -> DataFrame:
    """Dense line number ``_k`` of (ord, line_no) per document."""
    counts = lines.select("doc", "ord", "_count").distinct()
    starts = running_sum(counts, ["doc"], "ord", F.col("_count").cast("long"), "_start", inclusive=False)
    joined = merge_join(lines, starts.select("doc", "ord", "_start"), ["doc", "ord"])
    return joined.withColumn("_k", (F.col("_start") + F.col("line_no")).cast("long")).drop("_start")


def section_response(sections: DataFrame, wanted: str | None, include_tables: bool, strip_tables, strip_headings) -> DataFrame:
    """Indexed section, or one of its subsections, with tables and headings
    removed on request. sections: id, section_title, text, subsections."""
    clean = lambda c: strip_headings(c if include_tables else strip_tables(c))
    if wanted is None:
        return sections.select("id", F.col("section_title").alias("title"), clean(F.col("text")).alias("text"))
    hit = F.get(F.filter("subsections", lambda s: s["number"] == wanted), F.lit(0))
    d = sections.withColumn("_s", hit)
    title = F.coalesce("_s.title", F.when(F.col("_s").isNotNull(), f"Section {wanted}"), "section_title")
    return d.select("id", title.alias("title"), clean(F.coalesce("_s.text", "text")).alias("text"))


