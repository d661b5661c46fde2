"""Exports: CSV, JSON, HTML and text forms of results, and table writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilake.functions.dates import format_report_date
from vigilake.functions.sections import clean_clinical_text, is_whitelisted, section_display_title, section_sort_key
from vigilake.functions.text import bind, record, strip, text, title_case
from vigilake.operators.changes import latest_date_records, longest_per_section

# Columns of the change CSV.
CSV_COLUMNS = (
    "Drug Name", "Active Ingredient", "Application Number", "Supplement Date", "Supplement ID", "Labeling Section",
    "Change Type", "Updated Text", "Original Text", "FDA Comment / PDF URL", "Content Hash (SHA-256)",
    "Last Verified Date",
)
NO_DATA = "<p>No data is present on adverse reaction or safety changes.</p>"
INTRO_SALTS = (
    "sulfate", "hydrochloride", "sodium", "potassium", "acetate", "maleate", "fumarate", "tartrate", "mesylate",
    "besylate", "succinate",
)
DRUG_COLUMNS = ("display_name", "active_ingredient", "application_number")


def _reported(changes: DataFrame) -> DataFrame:
    """Whitelisted rows of each drug's latest date."""
    kept = changes.where(is_whitelisted(F.col("section"), F.col("updated_text")))
    return latest_date_records(kept, keep_undated=True)


def _with_drug(changes: DataFrame, drugs: DataFrame) -> DataFrame:
    side = drugs.select(F.col("id").alias("drug_id"), *DRUG_COLUMNS)
    return changes.join(side, "drug_id")


def changes_csv(drugs: DataFrame, changes: DataFrame) -> DataFrame:
    """The 12 CSV columns plus the drug id and section order to sort by."""
    d = _with_drug(_reported(changes), drugs)
    comment = F.coalesce(F.nullif("fda_comment", F.lit("")), F.col("source_url"))
    values = (
        text(F.col("display_name")), text(F.col("active_ingredient")), text(F.col("application_number")),
        text(F.date_format("source_date", "yyyy-MM-dd")), text(F.col("source_record_id")), text(F.col("section")),
        F.coalesce("change_type", F.lit("Labeling Revision")), text(F.col("updated_text")),
        text(F.col("original_text")), text(comment), text(F.col("content_hash")),
        text(F.date_format("last_verified_at", "yyyy-MM-dd HH:mm:ss")),
    )
    order = section_sort_key(F.col("section"))
    return d.select(
        "drug_id", order["priority"].alias("section_order"), "id",
        *(v.alias(c) for v, c in zip(values, CSV_COLUMNS)),
    )


def write_changes_csv(rows: DataFrame, path: str, sort: bool = True) -> None:
    """Range-sorted files with minimal quoting; a quote is doubled."""
    d = rows.orderBy("drug_id", "section_order", "id") if sort else rows
    d.select(*CSV_COLUMNS).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def changes_json(drugs: DataFrame, changes: DataFrame) -> DataFrame:
    """(drug_id, total, json): the longest text of each section of the latest
    date, tags removed. There are as many items as section names."""
    longest = longest_per_section(_reported(changes), ["drug_id"], "id")

    def untagged(c: str) -> Column:
        return F.when(text(F.col(c)) != "", strip(F.regexp_replace(clean_clinical_text(F.col(c)), "<[^>]+>", "")))

    order = section_sort_key(F.col("section"))
    item = F.struct(
        "id", "section", "source_record_id", F.date_format("source_date", "yyyy-MM-dd").alias("source_date"),
        F.coalesce("change_type", F.lit("Labeling Revision")).alias("change_type"),
        untagged("updated_text").alias("updated_text"), untagged("original_text").alias("original_text"),
        "content_hash",
    )
    rows = longest.select("drug_id", F.struct(order["priority"].alias("p"), order["name"].alias("n"), "id", item.alias("item")).alias("_i"))
    items = rows.groupBy("drug_id").agg(
        F.transform(F.array_sort(F.collect_list("_i")), lambda s: s["item"]).alias("safety_changes")
    )
    head = drugs.select(F.col("id").alias("drug_id"), F.struct("id", *DRUG_COLUMNS, "source").alias("drug"))
    d = head.join(items, "drug_id")
    total = F.size("safety_changes")
    doc = F.to_json(F.struct("drug", total.alias("total_safety_changes"), "safety_changes"), {"ignoreNullFields": "false"})
    return d.select("drug_id", total.alias("total"), doc.alias("json"))


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def inline_html(c: Column) -> Column:
    """Text with only u, strong, b, i and em tags left, attributes dropped."""
    tags = "u|strong|b|i|em"
    kept = F.regexp_replace(c, rf"(?i)<(?!/?(?:{tags})\b)[^>]*>", "")
    kept = F.regexp_replace(kept, rf"(?i)<(/?)({tags})\b[^>]*>", "<$1$2>")
    kept = F.regexp_replace(kept, r"&(?![a-zA-Z#0-9]+;)", "&amp;")
    kept = F.regexp_replace(kept, rf"(?iU)<({tags})>\s*</\1>", "")
    plain = ~c.contains("<") & ~c.contains(">")
    return F.when(plain, escape_html(c)).otherwise(strip(kept))


_KEY = r"(?U)^(?:<strong>|<b>)?([A-Za-z\s\-]+:)(?:</strong>|</b>)?\s*(.*)"


def _keyed(c: Column, tag: str) -> Column:
    key = escape_html(strip(F.regexp_extract(c, _KEY, 1)))
    value = inline_html(F.regexp_extract(c, _KEY, 2))
    whole = F.concat(F.lit(f"<{tag}><strong>"), key, F.lit("</strong> "), value, F.lit(f"</{tag}>"))
    plain = F.concat(F.lit(f"<{tag}>"), inline_html(c), F.lit(f"</{tag}>"))
    return F.when(F.rlike(c, F.lit(_KEY)), whole).otherwise(plain)


def render_text(cleaned: Column, section_title: Column) -> Column:
    """HTML of a cleaned section text: bullets as lists, short title lines as
    headings, ``Key:`` openers bold, the rest paragraphs."""
    rows = F.filter(F.transform(F.split(cleaned, "\n"), strip), lambda x: x != "")

    def fragment(line: Column) -> Column:
        bare = strip(F.regexp_replace(line, "<[^>]+>", ""))
        notice = F.rlike(bare, F.lit(r"(?iU)^additions\s+and(?:/or)?\s+revisions\s+underlined\s*:?$"))
        bullet = F.rlike(line, F.lit(r"^[•\-*]"))
        head = r"(?U)^((?:\d+(?:\.\d+)*[.\s:-]*\s*)?[A-Z][A-Za-z0-9\s()\-/,?]{2,70})$"
        heading = F.rlike(bare, F.lit(head)) & ~line.endswith(".") & ~line.endswith(":")
        title = strip(F.regexp_replace(bare, r"(?U)^\d+(?:\.\d+)*[.\s:-]*", ""))
        item = strip(F.regexp_replace(line, r"(?U)^[•\-*]\s*", ""))
        html = (
            F.when(notice, "<p><em>Additions and/or revisions underlined:</em></p>")
            .when(bullet, _keyed(item, "li"))
            .when(heading, F.concat(F.lit("<h3>"), escape_html(title), F.lit("</h3>"))).otherwise(_keyed(line, "p"))
        )
        kind = F.when(notice, "notice").when(bullet, "bullet").when(heading, "heading").otherwise("text")
        return record(kind=kind, title=title, html=html)

    def without_repeat(fragments: Column) -> Column:
        repeats = lambda f: (f["kind"] == "heading") & (f["title"] == section_title)
        return F.filter(fragments, lambda f, i: ~F.forall(F.slice(fragments, F.lit(1), i + 1), repeats))

    def joined(fragments: Column) -> Column:
        def piece(f: Column, i: Column) -> Column:
            before, after = F.get(fragments, i - 1)["kind"], F.get(fragments, i + 1)["kind"]
            bullet = f["kind"] == "bullet"
            opens = bullet & F.coalesce(before != "bullet", F.lit(True))
            closes = bullet & F.coalesce(after != "bullet", F.lit(True))
            gap = F.when(before.isNull() | (bullet & ~opens), "").otherwise("\n")
            return F.concat(
                gap, F.when(opens, "<ul>").otherwise(""), f["html"], F.when(closes, "</ul>").otherwise("")
            )

        return F.array_join(F.transform(fragments, piece), "")

    return bind(bind(F.transform(rows, fragment), without_repeat), joined)


def intro_paragraph(day: Column, name: Column, ingredient: Column) -> Column:
    raw = F.lower(strip(text(ingredient)))
    raw = F.when(raw.isin("not specified", "n/a", "none"), "").otherwise(raw)
    cleaned = strip(F.regexp_replace(raw, rf"(?iU)\b({'|'.join(INTRO_SALTS)})\b", ""))
    label = F.coalesce(F.nullif(cleaned, F.lit("")), raw)
    brackets = F.when(
        label != "", F.concat(F.lit(" ("), escape_html(label), F.lit("; <em>Additions underlined</em>)"))
    ).otherwise(" (<em>Additions underlined</em>)")
    return F.concat(
        F.when(day.isNotNull(), F.concat(F.lit("<p>On "), format_report_date(day), F.lit(", the "))).otherwise("<p>The "),
        F.lit("United States Food and Drug Administration Center for Drug Evaluation and Research approved the "
              "following safety labeling changes for "),
        escape_html(name), brackets, F.lit(":</p>"),
    )


def changes_html(drugs: DataFrame, changes: DataFrame, latest_only: bool = True) -> DataFrame:
    """HTML fragments per drug and date: an intro, then its sections.

    ``ordinal`` columns give the reading order (newest date first); a drug
    without any section has one fragment that says so.
    """
    kept = changes.where(is_whitelisted(F.col("section"), F.col("updated_text")))
    shown = latest_date_records(kept, keep_undated=True) if latest_only else kept
    day = F.to_date("source_date")
    longest = longest_per_section(shown.withColumn("day", day), ["drug_id", "day"], "id")
    cleaned = longest.withColumn("_clean", clean_clinical_text(F.col("updated_text"))).where("_clean <> ''")
    tag = "h2" if latest_only else "h4"
    title = section_display_title(F.col("section"))
    heading = F.concat(F.lit(f"<{tag}>"), escape_html(title), F.lit(f"</{tag}>\n"))
    order = section_sort_key(F.col("section"))
    sections = cleaned.select(
        "drug_id", "day", (order["priority"] + 1).alias("section_order"), order["name"].alias("section_name"),
        F.concat(heading, render_text(F.col("_clean"), title)).alias("fragment"),
    )
    name = F.when(F.upper("display_name") == F.col("display_name"), title_case(F.col("display_name"))).otherwise(
        F.col("display_name"))
    head = drugs.select(F.col("id").alias("drug_id"), name.alias("_name"), F.col("active_ingredient").alias("_ingredient"))
    intros = sections.select("drug_id", "day").distinct().join(head, "drug_id").select(
        "drug_id", "day", F.lit(0).alias("section_order"), F.lit("").alias("section_name"),
        intro_paragraph(F.col("day"), F.col("_name"), F.col("_ingredient")).alias("fragment"),
    )
    empty = head.join(sections.select("drug_id").distinct(), "drug_id", "left_anti").select(
        "drug_id", F.lit(None).cast("date").alias("day"), F.lit(0).alias("section_order"),
        F.lit("").alias("section_name"), F.lit(NO_DATA).alias("fragment"),
    )
    return sections.unionByName(intros).unionByName(empty)


HTML_ORDER = ("drug_id", "day DESC", "section_order", "section_name")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite",
                dynamic: bool = False) -> None:
    """Parquet write. ``dynamic`` replaces only the partitions that occur in
    the data, which is how one dataset or dictionary version is reloaded."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if dynamic:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_text(df: DataFrame, column: str, order: list[str], path: str) -> None:
    df.orderBy(*order).select(column).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
