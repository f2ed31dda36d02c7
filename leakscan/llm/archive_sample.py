"""Web archive records made of the table of pages, since no archive is among the inputs.

Every page is visited three times. A visit that finds nothing new is stored as a
not-modified revisit, under another spelling of the URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EPOCH = 1_700_000_000
VISITS = 3


def _lines(*lines: Column | str) -> Column:
    return F.concat(*[F.concat(F.lit(x) if isinstance(x, str) else x, F.lit("\r\n")) for x in lines])


def archive(pages: DataFrame) -> DataFrame:
    """A text column ``record``: the WARC records of all visits."""
    p, v, kind = F.col("page_id"), F.col("visit"), F.col("kind")
    visits = (
        pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
        .withColumn("visit", F.explode(F.sequence(F.lit(0), F.lit(VISITS - 1))))
        .withColumn("kind", F.when((v == 0) & (p % 11 != 0) | (v == 2) & (p % 4 == 0), "response").otherwise("revisit"))
        .withColumn("body", F.when((v == 2) & (kind == "response"), F.concat("html", F.lit("<!-- 2 -->"))).otherwise(F.col("html")))
        .withColumn("tag", F.concat(F.lit('"'), F.substring(F.md5(F.encode("body", "UTF-8")), 1, 12), F.lit('"')))
    )
    date = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + p % 10_000 * 60 + v * 3600 * (p % 5 + 1)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    sent = F.when(kind == "response", F.col("tag")).when(p % 7 == 0, '"stale"').when(p % 3 == 0, F.concat(F.lit("W/"), "tag")).otherwise(F.col("tag"))
    url = F.when(v == 1, F.concat("url", F.lit("#v"))).otherwise(F.regexp_replace("url", "^https?:", "HTTP:"))
    etag = F.when((p % 13 == 0) & (kind == "revisit"), "").otherwise(F.concat(F.lit("ETag: "), sent, F.lit("\r\n")))
    http = F.when(kind == "response", F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nLast-Modified: day "), (p % 17).cast("string"), F.lit("\r\n"), etag,
        F.lit("Content-Length: "), F.octet_length("body").cast("string"), F.lit("\r\nX-Visit: "), v.cast("string"), F.lit("\r\n\r\n"), F.col("body"),
    )).otherwise(F.concat(
        F.lit("HTTP/1.1 304 Not Modified\r\nContent-Length: 0\r\nX-Visit: "), v.cast("string"), F.lit("\r\nAge: "), (p % 100).cast("string"),
        F.lit("\r\n"), etag, F.when(p % 26 == 0, F.concat(F.lit("Last-Modified: day "), (p % 17).cast("string"), F.lit("\r\n"))).otherwise(""), F.lit("\r\n"),
    ))
    head = _lines(
        "WARC/1.1", F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), F.lpad(p.cast("string"), 15, "0"), F.lit("-"), v.cast("string")),
        F.concat(F.lit("WARC-Target-URI: "), F.when(v == 0, F.col("url")).otherwise(url)), F.concat(F.lit("WARC-Date: "), date),
        F.when(kind == "revisit", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/server-not-modified").otherwise("WARC-Block-Digest: none"), "",
    )
    return visits.select(F.concat(head, http).alias("record"))


# The same records as columns, and their resolution, on another engine.
RESOLVED_SQL = f"""
WITH visits AS (
  SELECT page_id AS p, v, url, coalesce(html, '') AS html,
    CASE WHEN v = 0 AND page_id % 11 <> 0 OR v = 2 AND page_id % 4 = 0 THEN 'response' ELSE 'revisit' END AS kind
  FROM pages, (SELECT unnest(range({VISITS})) AS v)
), bodies AS (
  SELECT *, CASE WHEN v = 2 AND kind = 'response' THEN html || '<!-- 2 -->' ELSE html END AS body FROM visits
), tags AS (
  SELECT *, '"' || substr(md5(body), 1, 12) || '"' AS tag,
    lpad(CAST(p AS VARCHAR), 15, '0') || '-' || v AS record_id,
    CAST({EPOCH} + p % 10000 * 60 + v * 3600 * (p % 5 + 1) AS BIGINT) AS secs,
    regexp_replace(regexp_replace(url, '#.*$', ''), '^https?://', '') AS bare
  FROM bodies
), parts AS (
  SELECT *,
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'),
      lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)'))) AS query
  FROM tags
), records AS (
  SELECT *, host || path || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS url_key,
    CASE WHEN p % 13 = 0 AND kind = 'revisit' THEN NULL WHEN kind = 'response' THEN tag WHEN p % 7 = 0 THEN '"stale"'
      WHEN p % 3 = 0 THEN 'W/' || tag ELSE tag END AS etag,
    CASE WHEN kind = 'response' OR p % 26 = 0 THEN 'day ' || (p % 17) END AS modified
  FROM parts
), latest AS (
  SELECT r.record_id AS rid, max_by(o.record_id, (o.secs, o.record_id)) AS oid
  FROM records r JOIN records o ON o.kind = 'response' AND o.url_key = r.url_key AND o.secs < r.secs
  WHERE r.kind = 'revisit' GROUP BY r.record_id
), judged AS (
  SELECT r.*, o.record_id AS oid, o.etag AS old_etag, o.modified AS old_modified, o.body AS old_body, o.v AS old_v,
    CASE WHEN r.kind = 'response' THEN 'full' WHEN o.record_id IS NULL THEN 'no_response'
      WHEN r.etag IS NOT NULL THEN CASE WHEN regexp_replace(r.etag, '^W/', '') = regexp_replace(o.etag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
      WHEN r.modified IS NOT NULL THEN CASE WHEN r.modified = o.modified THEN 'resolved' ELSE 'mismatch' END
      ELSE 'no_validator' END AS outcome
  FROM records r LEFT JOIN latest l ON l.rid = r.record_id LEFT JOIN records o ON o.record_id = l.oid
)
SELECT record_id, url_key, secs AS date_seconds, outcome, CASE WHEN outcome = 'resolved' THEN oid END AS original_id,
  CASE WHEN outcome = 'resolved' THEN sha256(old_body) WHEN kind = 'response' THEN sha256(body) END AS payload_sha256,
  CASE WHEN outcome = 'resolved' THEN strlen(old_body) WHEN kind = 'response' THEN strlen(body) END AS payload_bytes,
  CASE
    WHEN kind = 'response' THEN 'content-length: ' || strlen(body) || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || etag
      || chr(10) || 'last-modified: ' || modified || chr(10) || 'x-visit: ' || v
    WHEN outcome = 'resolved' THEN 'age: ' || (p % 100) || chr(10) || 'content-length: ' || strlen(old_body) || chr(10) || 'content-type: text/html'
      || chr(10) || 'etag: ' || coalesce(etag, old_etag) || chr(10) || 'last-modified: ' || coalesce(modified, old_modified) || chr(10) || 'x-visit: ' || v
    ELSE 'age: ' || (p % 100) || chr(10) || 'content-length: 0' || coalesce(chr(10) || 'etag: ' || etag, '')
      || coalesce(chr(10) || 'last-modified: ' || modified, '') || chr(10) || 'x-visit: ' || v
  END AS header_lines
FROM judged
"""
