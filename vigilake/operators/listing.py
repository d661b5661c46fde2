"""Case listing → cases, events and products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from vigilake.functions.listing import (
    onset_for, outcome_for, parse_event_onsets, parse_event_verbatim, parse_outcomes, parse_products,
)
from vigilake.functions.text import clean_xml_hex, strip, text
from vigilake.operators.skew import pick

# Listing headers and the case column each one feeds.
REQUIRED = ("Case Number", "Event Verbatim")
HEADERS = {
    "Country": "country", "Report Type": "report_type", "Age": "age", "Sex": "sex",
    "Case Initial Receipt Date": "initial_receipt_date", "Case Seriousness?": "seriousness_raw",
    "Case Listedness": "listedness", "Outcome": "case_outcome", "System Organ Class": "primary_soc",
    "Primary Event": "primary_event_flag", "Previous Submission": "previous_submission",
    "Health Care Prof.": "healthcare_prof", "Non-Serious Listed": "non_serious_listed",
    "FollowUp": "follow_up", "Case Classification": "case_classification",
    "Relevant History Sort Order": "relevant_history", "Case Narrative": "narrative",
    "Death Cause": "death_cause", "Report Comment": "case_comments",
}
UNTRIMMED = ("Relevant History Sort Order", "Case Narrative")
CELLS = {
    "Event Verbatim": "_events", "Outcome of Event": "_outcomes", "Event Onset": "_onsets",
    "Product Name": "_products", "Daily Dose": "_dose", "Form": "_form", "Duration": "_duration",
    "Product Indication PT": "_indication",
}
CASE_KEY = ("dataset_id", "case_number")


def case_number_of(c: Column) -> Column:
    """The case number in a cell."""
    return strip(text(c.cast("string")))


def read_line_listing(rows: DataFrame, source_row: str = "source_row", dataset_id: str = "dataset_id",
                      product: str = "product_name", dealt_by: str | None = None) -> DataFrame:
    """Listing rows under canonical names.

    ``rows`` comes from CSV or parquet with the listing's own headers plus the
    source row, the dataset and its product. Optional headers may be absent;
    blank case numbers and repeated header rows are left out. ``dealt_by`` names
    a column that holds :func:`case_number_of` already: where the rows lie
    together by it, nothing that goes by case shuffles them again.
    """
    names = {strip_header(c): c for c in rows.columns}
    missing = [h for h in REQUIRED if h not in names]
    if missing:
        raise ValueError(f"Required header {missing[0]!r} not found; found {sorted(names)[:10]}")

    def cell(header: str) -> Column:
        return text(F.col(f"`{names[header]}`").cast("string")) if header in names else F.lit("")

    def case_field(header: str) -> Column:
        return clean_xml_hex(cell(header)) if header in UNTRIMMED else strip(cell(header))

    case_number = F.col(dealt_by) if dealt_by else case_number_of(F.col(f"`{names['Case Number']}`"))
    return (
        rows.select(
            F.col(dataset_id).alias("dataset_id"), case_number.alias("case_number"),
            F.col(source_row).cast("long").alias("source_row"), F.col(product).alias("product_name"),
            *(case_field(h).alias(c) for h, c in HEADERS.items()),
            *(cell(h).alias(c) for h, c in CELLS.items()),
        )
        .where((F.col("case_number") != "") & (F.lower("case_number") != "case number"))
        .withColumn("is_serious", F.lower("seriousness_raw") == "yes")
    )


def strip_header(name: str) -> str:
    return name.strip()


def case_records(listing: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """One row per case; the last source row of a case sets its fields.

    ``fields`` are those that are wanted, all of them without it.
    """
    kept = ["product_name", *HEADERS.values(), "is_serious"] if fields is None else fields
    return pick(listing.select(*CASE_KEY, *kept, "source_row"), CASE_KEY, F.col("source_row"))


def reingest(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of a child table after datasets were read again: everything that a
    dataset of the batch held before goes. On stored tables the same is a
    dynamic overwrite of the dataset's partition."""
    again = batch.select("dataset_id").distinct()
    return current.join(again, "dataset_id", "left_anti").unionByName(batch)


def _earlier_in_row(values: Column, index: Column) -> Column:
    """How often the element at ``index`` comes before it in its own array."""
    own = F.get(values, index)
    return F.size(F.filter(F.slice(values, F.lit(1), index), lambda v: v == own))


def dedupe_repeat_rows(items: DataFrame, item: str) -> DataFrame:
    """Items of a case's first row all stay; later rows only add new ones.

    ``items`` has ``source_row``, ``idx`` and ``repeat_no``, how often the item
    came before in its row; a row without items is there once with a NULL
    ``idx``. One aggregate, which combines on the map side, keeps the first row
    of every (case, item, repeat), so what is dealt out by case afterwards is no
    more than a case's distinct items. The first row of a case is always among
    what is kept, so no second reading of the listing is needed to find it.
    """
    first = pick(items, [*CASE_KEY, item, "repeat_no"], F.struct("source_row", "idx"), largest=False)
    first_row = F.first("source_row").over(_ordered().rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("first_row", first_row).where(
        F.col("idx").isNotNull() & ((F.col("repeat_no") == 0) | (F.col("source_row") == F.col("first_row")))
    ).drop("repeat_no", "first_row")


def _ordered() -> WindowSpec:
    return Window.partitionBy(*CASE_KEY).orderBy("source_row", "idx")


# What an event has beside its case, source row, position, term and organ class.
EVENT_FIELDS = (
    "product_name", "raw_verbatim", "seriousness_flag", "listedness_flag", "causality_flag", "event_onset",
    "onset_mapping_status", "event_outcome",
)


def explode_events(listing: DataFrame, clean_first: bool = False, fields: Sequence[str] = EVENT_FIELDS) -> DataFrame:
    """Event rows with 1-based positions that go on over repeated case rows.

    Within a row positions follow the cell and keep their gaps, so the
    position is the running sum of the steps from one kept event to the next.
    The outer explode keeps the optimizer from parsing every cell once more to
    filter out the empty ones, and rows without an event in the running.

    ``fields`` are the event fields that are wanted: the aggregate carries whole
    rows, so others would be parsed, sorted and shuffled although nobody reads them.
    """
    parsed = listing.select(
        *CASE_KEY, "product_name", "source_row", "primary_soc", "case_outcome",
        parse_outcomes(F.col("_outcomes")).alias("_outcomes"),
        parse_event_onsets(F.col("_onsets")).alias("_onsets"),
        parse_event_verbatim(F.col("_events"), clean_first).alias("_parsed"),
    ).select("*", F.posexplode_outer("_parsed").alias("idx", "_event"))
    onset = onset_for(F.col("_onsets"), F.col("idx"))
    terms = F.transform("_parsed", lambda e: e["normalized_term"])
    values = {
        "product_name": F.col("product_name"), "raw_verbatim": F.col("_event.raw_verbatim"),
        "seriousness_flag": F.col("_event.seriousness"), "listedness_flag": F.col("_event.listedness"),
        "causality_flag": F.col("_event.causality"), "event_onset": onset["onset"], "onset_mapping_status": onset["status"],
        "event_outcome": outcome_for(F.col("_outcomes"), F.col("_event.normalized_term"), F.col("case_outcome")),
    }
    exploded = parsed.select(
        *CASE_KEY, "source_row", "primary_soc", "idx",
        F.coalesce(_earlier_in_row(terms, F.col("idx")), F.lit(0)).alias("repeat_no"),
        F.col("_event.normalized_term").alias("normalized_term"), *(values[f].alias(f) for f in fields),
    )
    kept = dedupe_repeat_rows(exploded, "normalized_term")
    same_row = F.lag("source_row").over(_ordered()) == F.col("source_row")
    step = F.col("idx") - F.when(same_row, F.lag("idx").over(_ordered())).otherwise(-1)
    position = F.sum("_step").over(_ordered().rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    return kept.withColumn("_step", step).withColumn("position", position).select(
        *CASE_KEY, "source_row", "position", "normalized_term", *fields,
        F.when(F.col("position") == 1, F.col("primary_soc")).alias("soc"),
    )


def explode_products(listing: DataFrame) -> DataFrame:
    """Product rows: the primary suspect and every further product of a case."""
    products = parse_products(
        F.col("_products"), F.col("product_name"), F.col("_dose"), F.col("_form"), F.col("_duration"),
        F.col("_indication"),
    )
    parsed = listing.select(*CASE_KEY, "source_row", products.alias("_parsed")).select(
        "*", F.posexplode_outer("_parsed").alias("idx", "_p"))
    names = F.transform("_parsed", lambda p: p["product_name_raw"])
    exploded = parsed.select(
        *CASE_KEY, "source_row", "idx", F.coalesce(_earlier_in_row(names, F.col("idx")), F.lit(0)).alias("repeat_no"), "_p.*")
    return dedupe_repeat_rows(exploded, "product_name_raw")


def dataset_identity(
    file_name: Column, content: Column, product: Column, today: Column, periods: Sequence[tuple[str, str, str, str]] = (),
) -> Column:
    """STRUCT<dataset_id, file_hash, product_name, reporting_period, data_lock_point>.

    A blank product reads the first word of the file name. ``periods`` are known
    ones: a stamp of the file name, a product word, the period and its data lock
    point; a file that has the stamp or names the product is of that period.
    """
    first_word = F.split(file_name, r"[_ \-.]")[0]
    first_word = F.concat(F.upper(F.substring(first_word, 1, 1)), F.lower(F.substr(first_word, F.lit(2))))
    for _, word, _, _ in reversed(periods):
        first_word = F.when(F.lower(file_name).contains(word), word.capitalize()).otherwise(first_word)
    name = F.coalesce(F.nullif(strip(text(product)), F.lit("")), first_word)
    file_hash = F.sha2(content, 256)
    period = F.lit("Current Reporting Period")
    lock = F.date_format(today, "dd-MMM-yyyy")
    for stamp, word, known, known_lock in reversed(periods):
        hit = file_name.contains(stamp) | F.lower(name).contains(word)
        period = F.when(hit, known).otherwise(period)
        lock = F.when(hit, known_lock).otherwise(lock)
    dataset_id = F.concat(F.lit("ds_"), F.lower(name), F.lit("_"), file_hash)
    return F.struct(
        dataset_id.alias("dataset_id"), file_hash.alias("file_hash"), name.alias("product_name"),
        period.alias("reporting_period"), lock.alias("data_lock_point"),
    )
