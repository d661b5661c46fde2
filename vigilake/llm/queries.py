"""Registered queries of the operators, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilake.llm import align, decontaminate, langid, mixing, near_dup, ngram, pii, quotes, resample, revisits, secrets, url_filter, vectors
from vigilake.plans.registry import table
from vigilake.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query()
def op10_minhash(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_dup.near_groups(table(spark, sf, "documents"))


SECRETS_SQL = r"""
WITH kinds(kind, place, pattern, grp, least) AS (VALUES
  ('assign', 1, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1, 8),
  ('access', 2, 'AKIA[A-Z0-9]+', 0, 16),
  ('hex', 3, '[0-9a-f]+', 0, 32),
  ('private_key', 4, '-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----', 0, 1),
  ('web_token', 5, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', 0, 1),
  ('forge_token', 6, 'gh[pousr]_[A-Za-z0-9]{36,}', 0, 1)),
cut AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT r, kind, place, least,
    CASE kind WHEN 'assign' THEN regexp_split_to_array(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
      WHEN 'access' THEN regexp_split_to_array(text, 'AKIA[A-Z0-9]+') WHEN 'hex' THEN regexp_split_to_array(text, '[0-9a-f]+')
      WHEN 'private_key' THEN regexp_split_to_array(text, '-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----')
      WHEN 'web_token' THEN regexp_split_to_array(text, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}')
      ELSE regexp_split_to_array(text, 'gh[pousr]_[A-Za-z0-9]{36,}') END AS pieces,
    CASE kind WHEN 'assign' THEN regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
      WHEN 'access' THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+') WHEN 'hex' THEN regexp_extract_all(text, '[0-9a-f]+')
      WHEN 'private_key' THEN regexp_extract_all(text, '-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----')
      WHEN 'web_token' THEN regexp_extract_all(text, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}')
      ELSE regexp_extract_all(text, 'gh[pousr]_[A-Za-z0-9]{36,}') END AS found,
    CASE kind WHEN 'assign' THEN regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) END AS groups
  FROM cut, kinds),
rows AS (SELECT r, kind, place, least, i, length(pieces[i]) AS gap, found[i] AS hit, coalesce(groups[i], found[i]) AS asked
  FROM parts, unnest(range(1, len(found) + 1)) AS t(i)),
placed AS (SELECT r, kind, place, hit, length(asked) >= least AS good,
    sum(gap + length(hit)) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM rows),
spans AS (SELECT r, kind, place, e - length(hit) AS s, e FROM placed WHERE good),
told AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, place) FILTER (place <= 3) AS base,
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, place) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM cut LEFT JOIN told USING (r)
"""


@query(SECRETS_SQL)
def op3_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets of all documents: counts, digest and spans."""
    return secrets.digest(secrets.scan(table(spark, sf, "documents")))


@query()
def op1_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data of all documents: counts, digest and spans."""
    return pii.digest(pii.detect(table(spark, sf, "documents")))


@query()
def op6_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate groups of all embeddings."""
    return vectors.near_vectors(table(spark, sf, "embeddings"))


@query()
def op8_language(spark: SparkSession, sf: str) -> DataFrame:
    """The language of all documents."""
    docs = table(spark, sf, "documents")
    return langid.predicted(docs, langid.train(docs)).withColumn("held_out", langid.held_out())


@query()
def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Overlaps of all documents with the benchmark."""
    return decontaminate.overlaps(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query()
def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """What a mix of all documents to target weights takes of each."""
    return mixing.taken(table(spark, sf, "documents")).drop("source")


URL_SQL = """
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, '.' || host AS h, CASE
  WHEN '.' || host LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
  WHEN '.' || host LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
  WHEN '.' || host LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
  WHEN '.' || host LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
  WHEN '.' || host LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule FROM parsed)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, 'casino|adult|pills|spam|ads-track') OR regexp_matches(path, '\\.(exe|zip|iso)$') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""


@query(URL_SQL)
def op5_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """A verdict on the URL of every page."""
    return url_filter.judge(table(spark, sf, "pages")).drop("glob")


REVISIT_SQL = r"""
WITH seen AS (SELECT page_id, url, page_id * 977 % 2000000 AS t, page_id * 977 % 2000000 + 3600 * (page_id % 72 + 1) AS l, '"' || md5(html) || '"' AS tag,
    strlen(html) AS size, regexp_replace(url, '#.*$', '') AS bare FROM pages),
parts AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^www\.', ''), ':(?:80|443)$', '') AS host,
    regexp_replace(regexp_extract(bare, '^[^?]*?://[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))), '&') AS query FROM seen),
c AS (SELECT *, CASE WHEN contains(url, '://') THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS curl,
    strftime(make_timestamp((t - t % 86400) * 1000000), '%a, %d %b %Y %H:%M:%S GMT') AS modified FROM parts),
revisits AS (SELECT page_id * 2 + 1 AS record_id, curl AS url, l AS time, modified,
    CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '"other"' ELSE 'W/' || tag END AS etag FROM c),
met AS (SELECT r.record_id, max_by(struct_pack(i := f.page_id * 2, t := f.t, tag := f.tag, modified := f.modified, size := f.size), f.t * 10000000000 + f.page_id) AS f
  FROM revisits r JOIN c f ON f.curl = r.url AND f.t < r.time GROUP BY r.record_id),
told AS (SELECT r.*, m.f, CASE WHEN m.f IS NULL THEN 'missing' WHEN coalesce(regexp_replace(r.etag, '^W/', '') = m.f.tag, r.modified = m.f.modified) THEN 'resolved' ELSE 'changed' END AS status
  FROM revisits r LEFT JOIN met m USING (record_id))
SELECT record_id, url, time, status, f.i AS response_id, f.t AS response_time,
  CASE WHEN status = 'resolved' THEN 'content-length: ' || f.size || chr(10) || 'content-type: text/html' ELSE 'content-length: 0' END || chr(10) ||
  'date: ' || strftime(make_timestamp(time * 1000000), '%a, %d %b %Y %H:%M:%S GMT') ||
  CASE WHEN etag IS NOT NULL THEN chr(10) || 'etag: ' || etag WHEN status = 'resolved' THEN chr(10) || 'etag: ' || f.tag ELSE '' END ||
  chr(10) || 'last-modified: ' || modified AS headers
FROM told"""


@query(REVISIT_SQL)
def op7_revisits(spark: SparkSession, sf: str) -> DataFrame:
    """All revisits of an archive told from the pages, resolved."""
    found = revisits.resolve(revisits.captures(table(spark, sf, "pages").select("page_id", "url", "html")))
    return found.withColumn("headers", revisits.rendered(F.col("headers")))


@query()
def op4_chat(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations, sent as mails with quotes, linked and cleaned."""
    return quotes.conversations(quotes.as_mails(table(spark, sf, "conversations")))


@query()
def op13_resampling(spark: SparkSession, sf: str) -> DataFrame:
    """All documents weighed towards the benchmark, a tenth drawn and ranked."""
    return resample.resampled(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query()
def op11_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of two tokenizers aligned over all documents."""
    return align.aligned(table(spark, sf, "documents"))


@query()
def op12_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    """All documents scored by a model of the training ones."""
    return ngram.scored(table(spark, sf, "documents"), ngram.held_out())
