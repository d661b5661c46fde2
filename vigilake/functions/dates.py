"""Date parsing and request date ranges as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from vigilake.functions.text import bind, record, strip, text

MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"

# What counts as a date inside a longer string.
DATE_IN_TEXT = (
    r"(?iU)(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2}|"
    + MONTH + r"[a-z]*\s+\d{1,2},?\s+\d{4}|"
    r"\d{1,2}[-\s]" + MONTH + r"[a-z]*[-\s]\d{2,4})"
)

# Date formats in the order in which they are tried.
NUMERIC_FORMATS = (
    "M/d/yyyy", "M-d-yyyy", "yyyy-M-d", "d/M/yyyy",
    "d-MMM-yyyy", "d-MMMM-yyyy", "d-MMM-yy", "MMM-d-yyyy", "MMMM-d-yyyy", "M/d/yy", "M-d-yy",
)
TEXTUAL_FORMATS = (
    "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy",
    "d MMMM yyyy", "d MMM yyyy", "d-MMM-yyyy", "d-MMMM-yyyy",
)
TGA_FORMATS = (
    "d MMMM yyyy", "d MMM yyyy", "yyyy-M-d", "yyyyMMdd'T'HHmmss", "yyyyMMdd", "d/M/yyyy",
    "d-M-yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM yyyy", "MMM yyyy", "yyyy/M/d",
)
_ANY_DATE = r"([0-9]{1,2}\s+[A-Za-z]+\s+[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4})"
# Phrases in front of an amendment or approval date.
AMENDMENT_DATE = (
    r"(?iU)(?:date\s+of\s+(?:most\s+recent\s+)?amendment|date\s+of\s+revision(?:\s+of\s+the\s+text)?"
    r"|last\s+amended|revised(?:\s+on)?|amended(?:\s+on)?)\s*[:\-]?\s*" + _ANY_DATE
)
APPROVAL_DATE = (
    r"(?iU)(?:date\s+of\s+first\s+approval|first\s+approved|approval\s+date)\s*[:\-]?\s*" + _ANY_DATE
)
# How a document version is written.
VERSION_IN_TEXT = r"(?iU)\b(?:version|ver\.?|v|rev\.?|revision)\s*[:\-]?\s*([0-9]+(?:\.[0-9]+)*)\b"
VERSION_ALONE = r"^([0-9]+(?:\.[0-9]+)*)$"


def _shape(fmt: str) -> str:
    """Regular expression of the strings a format can read."""
    parts = (
        ("'T'", "T"), ("MMMM", "[A-Za-z]+"), ("MMM", "[A-Za-z]{3}"), ("HHmmss", r"\d{6}"), ("yyyyMMdd", r"\d{8}"),
        ("yyyy", r"\d{4}"), ("yy", r"\d{2}"), ("M", r"\d{1,2}"), ("d", r"\d{1,2}"),
    )
    out, at = "", 0
    while at < len(fmt):
        token, pattern = next(((t, p) for t, p in parts if fmt.startswith(t, at)), (fmt[at], fmt[at]))
        out, at = out + pattern, at + len(token)
    return f"^{out}$"


def _try(c: Column, formats: tuple[str, ...]) -> Column:
    """First format that fits; ``c`` is cheap to repeat. Only strings of the
    right shape are parsed, because a failed parse is slow. Month words are
    spelled the way the formatter expects (``JUNE`` → ``June``)."""
    def attempt(fmt: str) -> Column:
        spelled = c
        if "MMM" in fmt:
            spelled = F.replace(F.initcap(F.replace(c, F.lit("-"), F.lit(" - "))), F.lit(" - "), F.lit("-"))
        parsed = F.try_to_timestamp(spelled, F.lit(fmt)).cast("timestamp_ntz")
        if not fmt.endswith("yyyy") and fmt.endswith("yy"):
            # A year of two digits is at most 49 years ahead.
            far = F.year(parsed) >= F.year(F.current_date()) + 50
            parsed = F.when(far, parsed - F.expr("INTERVAL '100' YEAR")).otherwise(parsed)
        return F.when(F.rlike(c, F.lit(_shape(fmt))), parsed)

    return F.coalesce(*(attempt(f) for f in formats))


@F.pandas_udf(T.TimestampNTZType())
def _lenient(values: pd.Series) -> pd.Series:
    from dateutil import parser

    def one(value):
        if value is None:
            return None
        try:
            return parser.parse(value)
        except (ValueError, OverflowError, TypeError):
            return None

    return pd.to_datetime(values.map(one), errors="coerce")


def parse_label_date(c: Column, lenient: bool = False) -> Column:
    """A date found anywhere in ``c``; supplement notes are dropped.

    Month comes before day where both readings are possible. With ``lenient``
    whatever is left over (times of day, odd spellings) goes through an
    Arrow UDF; without it those read as NULL and the plan stays free of
    Python.
    """
    def target_of(raw: Column) -> Column:
        found = F.regexp_extract(raw, DATE_IN_TEXT, 1)
        target = F.when(found != "", strip(found)).otherwise(raw)
        return strip(F.regexp_replace(target, r"(?i)\(SUPPL[^)]*\)", ""))

    def read(target: Column) -> Column:
        date_part = strip(F.split(F.split(target, " ")[0], "T")[0])
        return F.coalesce(bind(date_part, lambda d: _try(d, NUMERIC_FORMATS)), _try(target, TEXTUAL_FORMATS))

    target = bind(strip(text(c)), target_of)
    strict = bind(target, read)
    if not lenient:
        return strict
    leftover = bind(target, lambda t: F.when((t != "") & read(t).isNull(), t))
    return F.coalesce(strict, _lenient(leftover))


def parse_register_date(c: Column) -> Column:
    """A whole-string date in one of the register's formats, else a day-month-year
    or ISO date inside the string."""
    def read(value: Column) -> Column:
        cleaned = strip(F.regexp_replace(strip(value), r"(?U)[^\w\s/.-]", ""))
        inner = F.regexp_extract(value, r"(?U)(\d{1,2}\s+[A-Za-z]+\s+\d{4})", 1)
        iso = F.regexp_extract(value, r"(?U)(\d{4}-\d{2}-\d{2})", 1)
        return F.coalesce(
            bind(cleaned, lambda x: _try(x, TGA_FORMATS)),
            bind(inner, lambda x: _try(x, ("d MMMM yyyy", "d MMM yyyy"))),
            bind(iso, lambda x: _try(x, ("yyyy-M-d",))),
        )

    return bind(text(c), read)


def extract_amendment_date(c: Column) -> Column:
    return parse_register_date(F.nullif(F.regexp_extract(text(c), AMENDMENT_DATE, 1), F.lit("")))


def extract_approval_date(c: Column) -> Column:
    return parse_register_date(F.nullif(F.regexp_extract(text(c), APPROVAL_DATE, 1), F.lit("")))


def parse_version(c: Column) -> Column:
    """STRUCT<label, number>: ``v2.1`` → (``Version 2.1``, 2.1)."""
    value = text(c)
    found = F.coalesce(
        F.nullif(F.regexp_extract(value, VERSION_IN_TEXT, 1), F.lit("")),
        F.nullif(F.regexp_extract(strip(value), VERSION_ALONE, 1), F.lit("")),
    )
    label = F.coalesce(F.concat(F.lit("Version "), found), F.nullif(strip(value), F.lit("")))
    return record(label=label, number=found.try_cast("double"))


def format_report_date(ts: Column) -> Column:
    return F.date_format(ts, "dd-MMM-yyyy")


def extract_supplement_id(c: Column) -> Column:
    value = text(c)
    return F.coalesce(
        F.nullif(strip(F.regexp_extract(value, r"(?i)\((SUPPL-[^)]+)\)", 1)), F.lit("")),
        F.nullif(F.regexp_extract(value, r"(?iU)\b(SUPPL-\d+)\b", 1), F.lit("")),
    )


def month_year_to_date(c: Column) -> Column:
    """First day of a month such as ``August 2026``."""
    return F.try_to_timestamp(F.initcap(strip(text(c))), F.lit("MMMM yyyy")).cast("date")


# ---------------------------------------------------------------------------
# Request date ranges

DMY = r"^(\d{1,2})-(\d{1,2})-(\d{4})$"
SLASH = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
YMD = r"^(\d{4})-(\d{1,2})-(\d{1,2})"


def _parts(c: Column) -> Column:
    """STRUCT of the number groups of the three accepted shapes."""
    day_text = strip(F.split(strip(text(c)), "T")[0])

    def number(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(day_text, pattern, group), F.lit("")).cast("int")

    return record(
        blank=strip(text(c)) == "",
        **{f"d{i}": number(DMY, i) for i in (1, 2, 3)},
        **{f"s{i}": number(SLASH, i) for i in (1, 2, 3)},
        **{f"y{i}": number(YMD, i) for i in (1, 2, 3)},
    )


def _request_date(p: Column, us_order: Column) -> Column:
    """STRUCT<ts, error> of one bound; both NULL when blank."""
    d1, d2, s1, s2 = p["d1"], p["d2"], p["s1"], p["s2"]
    dash_month_first = ((d2 > 12) & (d1 <= 12)) | (~((d1 > 12) & (d2 <= 12)) & us_order)
    slash_day_first = (s1 > 12) & (s2 <= 12)
    year = F.coalesce(p["d3"], p["s3"], p["y1"])
    month = F.coalesce(F.when(dash_month_first, d1).otherwise(d2), F.when(slash_day_first, s2).otherwise(s1), p["y2"])
    day = F.coalesce(F.when(dash_month_first, d2).otherwise(d1), F.when(slash_day_first, s1).otherwise(s2), p["y3"])
    zero = F.lit(0)
    ts = F.try_make_timestamp_ntz(year, month, day, zero, zero, zero.cast("decimal(16,6)"))
    return bind(ts, lambda t: record(
        ts=t, error=F.when(p["blank"], None).when(year.isNull(), "format").when(t.isNull(), "calendar")))


def validate_date_range(start: Column, end: Column) -> Column:
    """STRUCT<start_ts, end_ts, error>: both bounds of a request.

    ``DD-MM-YYYY``, ``MM/DD/YYYY`` and ISO are read; a pair of dashed dates
    whose first parts agree and whose second parts rise is month-first. The
    end bound is the last microsecond of its day. ``error`` names the first
    problem: format, calendar or order.
    """
    def dates_of(p: Column) -> Column:
        s, e = p["s"], p["e"]
        us_order = F.coalesce(
            (s["d1"] <= 12) & (s["d2"] <= 12) & (e["d1"] <= 12) & (e["d2"] <= 12)
            & (s["d1"] == e["d1"]) & (s["d2"] <= e["d2"]), F.lit(False),
        )
        return record(s=_request_date(s, us_order), e=_request_date(e, us_order))

    def checked(b: Column) -> Column:
        start_ts, end_ts = b["s"]["ts"], b["e"]["ts"]
        error = F.coalesce(
            F.concat(F.lit("startDate:"), b["s"]["error"]), F.concat(F.lit("endDate:"), b["e"]["error"]),
            F.when(start_ts > end_ts, "order"),
        )
        last_instant = end_ts + F.expr("INTERVAL '0 23:59:59.999999' DAY TO SECOND")
        return record(
            start_ts=F.when(error.isNull(), start_ts), end_ts=F.when(error.isNull(), last_instant), error=error
        )

    return bind(bind(record(s=_parts(start), e=_parts(end)), dates_of), checked)


def transpose_day_month(ts: Column) -> Column:
    """Day and month swapped, time of day kept; NULL when the day is above 12."""
    seconds = F.second(ts).cast("decimal(16,6)")
    return F.when(
        F.dayofmonth(ts) <= 12,
        F.try_make_timestamp_ntz(F.year(ts), F.dayofmonth(ts), F.month(ts), F.hour(ts), F.minute(ts), seconds),
    )


def in_range(ts: Column, start: Column, end: Column) -> Column:
    """Inclusive bounds; an open bound is NULL; undated rows only pass when
    both bounds are open."""
    return (
        (start.isNull() & end.isNull())
        | (ts.isNotNull() & (start.isNull() | (ts >= start)) & (end.isNull() | (ts <= end)))
    )
