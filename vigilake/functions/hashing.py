"""Content hashes and record ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vigilake.functions.text import strip, text


def py_datetime(ts: Column) -> Column:
    """``str()`` of a datetime: microseconds only when there are any."""
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss"),
        F.when(F.date_format(ts, "SSSSSS") == "000000", "").otherwise(F.date_format(ts, "'.'SSSSSS")),
    )


def content_hash(
    display_name: Column, active_ingredient: Column, section: Column, source_date: Column,
    original_text: Column, updated_text: Column, comment: Column,
) -> Column:
    """SHA-256 over seven fields joined by ``|``; a missing value is ``None``."""
    fields = (display_name, active_ingredient, section, source_date, original_text, updated_text, comment)
    joined = F.concat_ws("|", *(F.coalesce(f.cast("string"), F.lit("None")) for f in fields))
    return F.sha2(joined, 256)


def section_hash(name: Column, section: Column, date: Column, content: Column) -> Column:
    parts = (F.lower(strip(text(name))), F.lower(strip(text(section))), strip(text(date)), strip(text(content)))
    return F.sha2(F.concat_ws("|", *parts), 256)


def _json_string(c: Column) -> Column:
    """One JSON string literal, ``null`` for NULL."""
    wrapped = F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v")))
    return F.when(c.isNull(), "null").otherwise(F.substr(wrapped, F.lit(6), F.length(wrapped) - 6))


def sorted_json_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of a flat JSON object with sorted keys and ``", "``/``": "``
    separators."""
    parts = [F.concat(F.lit(f'"{k}": '), _json_string(fields[k])) for k in sorted(fields)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256)


def record_id(url: Column, product: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", text(url), text(product)), 256), 1, 32)


def short_md5(c: Column, length: int = 8) -> Column:
    return F.substring(F.md5(text(c)), 1, length)
