"""Web archive records: not-modified revisits get back the response they stand for.

A crawler that is told "304 Not Modified" stores a revisit record: some headers
and no body. Here each one is joined, as of its date, to the latest earlier full
response of the same canonical URL; validators must agree; and the response's
headers are brought up to date with those that a 304 may change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leakscan.llm.common import settled
from leakscan.operators.ordered import with_carry

NOT_MODIFIED = "server-not-modified"
# Header fields that a 304 does not change in a stored response (RFC 9111, 3.2 and RFC 9110, 7.6.1).
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
TRACKING = r"(?:utm_[a-z]+|gclid|fbclid|ref)"
SLOT_SECONDS = 6 * 3600


def canonical_url(url: Column) -> Column:
    """One spelling for URLs that a crawler takes as the same.

    No scheme, "www.", default port, fragment or tracking parameter; host in
    lower case; parameters in order; no slash at the end. NULL stays NULL.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^(?i:https?)://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^{TRACKING}(?:=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _fields(block: Column) -> Column:
    """Header lines as an array of (name in lower case, value); a line without a colon is no field."""
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: F.instr(x, ":") > 1)
    return F.transform(lines, lambda x: F.struct(
        F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"),
        F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value"),
    ))


def _value(fields: Column, name: str) -> Column:
    return F.get(F.filter(fields, lambda f: f["name"] == name), F.lit(0))["value"]


def _merged(fields: Column) -> Column:
    """Fields as a map; the values of a repeated name are joined."""
    names = F.array_distinct(F.transform(fields, lambda f: f["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.array_join(
        F.transform(F.filter(fields, lambda f: f["name"] == n), lambda f: f["value"]), ", ")))


def parse_records(raw: DataFrame, record: str = "record") -> DataFrame:
    """A row for each WARC record in the text column ``record``.

    record_id, record_type, uri, date, profile from its header; status, headers
    and payload from the HTTP message in it. Other columns are left out. What a
    record lacks is NULL; NULL records are dropped, for they hold nothing.
    """
    end = "\r\n\r\n"
    text = F.col(record)
    head, rest = F.substring_index(text, end, 1), F.substring(text, F.instr(text, end) + len(end), F.length(text))
    message = F.when(F.instr(text, end) > 0, rest).otherwise("")
    parts = raw.where(text.isNotNull()).select(F.inline(F.array(F.struct(_fields(head).alias("_w"), message.alias("_m")))))
    http = F.when(F.col("_m").startswith("HTTP/"), F.substring_index("_m", end, 1))
    body = F.when(F.instr("_m", end) > 0, F.substring(F.col("_m"), F.instr("_m", end) + len(end), F.length("_m"))).otherwise("")
    w = F.col("_w")
    return parts.select(
        _value(w, "warc-record-id").alias("record_id"),
        F.lower(_value(w, "warc-type")).alias("record_type"),
        _value(w, "warc-target-uri").alias("uri"),
        F.try_to_timestamp(_value(w, "warc-date")).alias("date"),
        _value(w, "warc-profile").alias("profile"),
        F.regexp_extract(http, r"^HTTP/[0-9.]+ ([0-9]{3})", 1).try_cast("int").alias("status"),
        _merged(_fields(F.coalesce(http, F.lit("")))).alias("headers"),
        body.alias("payload"),
    )


def _opaque(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(tag, r"^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Every full response and not-modified revisit of ``records`` (as :func:`parse_records` gives them).

    Adds url_key, original_id, outcome, payload_sha256, payload_bytes and merged
    headers, and leaves the payload itself where it is. Outcomes: "full" for a
    response; for a revisit "resolved", "no_validator" (neither record has an
    entity tag or date to compare; not resolved), "mismatch" or "no_response".
    An entity tag of the revisit must match weakly; only without one its
    Last-Modified must be the same. Of responses at one time the greatest
    record_id counts; one at the revisit's own time is not earlier. Rows without
    URL or date are "no_response" as revisits and never an original. Repeated
    records give repeated rows.

    The key's rows are ordered in slots of time, so a URL with a third of all
    captures is the work of many tasks.
    """
    response = (F.col("record_type") == "response") & F.col("status").between(200, 203)
    revisit = (F.col("record_type") == "revisit") & (F.col("profile").contains(NOT_MODIFIED) | (F.col("status") == 304))
    # records are parsed once; what is written has no payload
    narrow = settled(records.where(response | revisit).select(
        "record_id", "date", canonical_url(F.col("uri")).alias("url_key"), "headers",
        F.coalesce(F.col("record_type") == "response", F.lit(False)).alias("is_full"),
        F.when(response, F.sha2(F.col("payload").cast("binary"), 256)).alias("payload_sha256"),
        F.when(response, F.octet_length("payload").cast("long")).alias("payload_bytes"),
    ))
    known = F.col("url_key").isNotNull() & F.col("date").isNotNull()
    original = F.struct("record_id", "headers", "payload_sha256", "payload_bytes")
    keyed = narrow.where(known).withColumn("full_one", F.when(F.col("is_full"), original))
    slot = F.floor(F.unix_seconds("date") / SLOT_SECONDS)
    joined = with_carry(keyed, ["url_key"], ["date", "is_full", "record_id", "payload_sha256"], slot, lasts=["full_one"])
    loose = narrow.where(~known).withColumn("full_one", F.lit(None).cast(keyed.schema["full_one"].dataType))
    both = joined.unionByName(loose.withColumn("last_full_one", F.col("full_one")))

    old, own = F.col("last_full_one"), F.col("headers")
    tag, seen = own["etag"], own["last-modified"]
    outcome = (
        F.when(F.col("is_full"), "full")
        .when(old.isNull(), "no_response")
        .when(tag.isNotNull(), F.when(_opaque(tag) == _opaque(old["headers"]["etag"]), "resolved").otherwise("mismatch"))
        .when(seen.isNotNull(), F.when(seen == old["headers"]["last-modified"], "resolved").otherwise("mismatch"))
        .otherwise("no_validator")
    )
    resolved = F.col("outcome") == "resolved"
    changes = F.map_filter("headers", lambda k, v: ~k.isin(*KEPT_HEADERS))
    stays = F.map_filter(old["headers"], lambda k, v: ~F.array_contains(F.map_keys(changes), k))
    told = both.withColumn("outcome", outcome)
    return told.select(
        "record_id", "url_key", "date", "outcome",
        F.when(resolved, old["record_id"]).alias("original_id"),
        F.when(resolved, old["payload_sha256"]).otherwise(F.col("payload_sha256")).alias("payload_sha256"),
        F.when(resolved, old["payload_bytes"]).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(resolved, F.map_concat(stays, changes)).otherwise(F.col("headers")).alias("headers"),
    )


def header_lines(headers: Column) -> Column:
    """A map of headers as lines in order of name."""
    entries = F.array_sort(F.map_entries(headers))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
