"""Resolution of not-modified revisits in web archives.

A revisit record of the server-not-modified kind has headers but no payload. It
is joined as of its time to the latest earlier full response of its canonical
URL. The validators decide whether that response is what the server meant, and
the headers that a not-modified answer may change are merged into its own.

The time line of a URL is cut into spans. Within a span the last response is
carried along; one row per span carries it on to the next. A URL with a third of
all captures is so spread over as many tasks as it has spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SPAN = 86_400  # seconds
# Header fields that a 304 answer updates (RFC 9110, 15.4.5), fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Host lower-cased and without www. and the scheme's port, path without a
    last slash, no fragment, no utm_ parameters; NULL without ``://``."""
    bare = F.regexp_replace(url, "#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^?]*?://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike("^utm_"))), "&")
    return F.when(F.contains(url, F.lit("://")), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def lowered(headers: Column) -> Column:
    """A map of headers by lower-case name; of equal names the last counts."""
    pairs = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.array_distinct(F.transform(pairs, lambda e: F.lower(e["key"])))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.element_at(F.filter(pairs, lambda e: F.lower(e["key"]) == n), -1)["value"].alias("value"))))


def merged_headers(stored: Column, fresh: Column) -> Column:
    allowed = F.map_filter(fresh, lambda k, v: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame, span: int = SPAN) -> DataFrame:
    """One row per revisit of ``records`` (record_id long, kind ``response`` or
    ``revisit``, url, time in seconds, headers): record_id, url (canonical),
    time, status, response_id, response_time, headers.

    ``resolved``: the validators agree (the entity tag, compared weakly; without
    one, the date of last modification); ``changed``: they do not; ``unproven``:
    the revisit or the response has none; ``missing``: there is no earlier
    response. Only resolved and unproven records get merged headers, others keep
    their own. Of responses at one time the highest record id is the latest; a
    response at the time of the revisit is not earlier. NULL URLs, times or ids
    resolve to nothing; NULL headers are none; repeated rows give repeated rows.
    """
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("url"), F.col("time").cast("long").alias("time"),
        (F.col("kind") == "response").cast("int").alias("full"), lowered(F.col("headers")).alias("headers"),
    ).withColumn("span", F.floor(F.col("time") / F.lit(span)))
    usable = (F.col("full") == 1) & F.col("url").isNotNull() & F.col("time").isNotNull() & F.col("record_id").isNotNull()
    response = F.when(usable, F.struct(F.col("record_id").alias("id"), "time", "headers"))
    rows = rows.withColumn("response", response)
    # Revisits come before responses of the same second.
    inside = Window.partitionBy("url", "span").orderBy("time", "full", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("near", F.last("response", ignorenulls=True).over(inside)).where("full = 0")
    tails = rows.where(usable).groupBy("url", "span").agg(F.max_by("response", F.struct("time", "record_id")).alias("tail"))
    wanted = rows.where("full = 0 and url is not null and time is not null").select("url", "span").distinct()
    before = Window.partitionBy("url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        tails.join(wanted, ["url", "span"], "full").select("url", "span", F.last("tail", ignorenulls=True).over(before).alias("carried"))
    )
    found = local.join(carried, ["url", "span"], "left").withColumn(
        "from", F.when(F.col("url").isNotNull() & F.col("time").isNotNull(), F.coalesce("near", "carried")))
    stored, own = F.col("from.headers"), F.col("headers")
    agree = F.coalesce(_weak(own["etag"]) == _weak(stored["etag"]), own["last-modified"] == stored["last-modified"])
    status = F.when(F.col("from").isNull(), "missing").when(agree, "resolved").when(agree.isNull(), "unproven").otherwise("changed")
    return found.withColumn("status", status).select(
        "record_id", "url", "time", "status", F.col("from.id").alias("response_id"), F.col("from.time").alias("response_time"),
        F.when(F.col("status").isin("resolved", "unproven"), merged_headers(stored, own)).otherwise(own).alias("headers"),
    )


def restored(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """Resolved revisits with the payload of their response."""
    bodies = records.where("kind = 'response'").select(F.col("record_id").alias("response_id"), "payload")
    return resolved.where("status in ('resolved', 'unproven')").join(bodies, "response_id", "left")


def rendered(headers: Column) -> Column:
    """``name: value`` lines by name."""
    lines = F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.array_join(F.array_sort(lines), "\n")


def captures(pages: DataFrame) -> DataFrame:
    """An archive told from ``pages``: each page is a response, and an hour to
    three days later a revisit of its URL is answered with 304. Every seventh
    revisit names another entity tag, every fifth has none."""
    date = lambda s: F.date_format(F.timestamp_seconds(s), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    at = F.col("page_id") * 977 % 2_000_000
    later = at + 3600 * (F.col("page_id") % 72 + 1)
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", at.alias("time"),
        F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), date(at - at % 86_400), F.lit("Content-Type"), F.lit("text/html"),
                     F.lit("Content-Length"), F.octet_length("html").cast("string"), F.lit("Date"), date(at)).alias("headers"),
        F.col("html").alias("payload"),
    )
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", later.alias("time"),
        F.map_filter(
            F.create_map(F.lit("etag"), F.when(F.col("page_id") % 5 == 0, None).when(F.col("page_id") % 7 == 0, '"other"').otherwise(F.concat(F.lit("W/"), tag)),
                         F.lit("last-modified"), date(at - at % 86_400), F.lit("content-length"), F.lit("0"), F.lit("date"), date(later)),
            lambda k, v: v.isNotNull()).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return response.union(revisit)
