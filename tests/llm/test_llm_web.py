"""Revisit resolution beside a plain loop; template leaks beside a plain search."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F
from samples import clashing, empty_table, odd_rows, odd_table, words

from leakscan.llm import decontaminate as dec, warc


def record(rid, kind, uri, date, http=None, body="", profile=None):
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}"]
    head += [f"warc-target-uri: {uri}"] * (uri is not None) + [f"WARC-Date:{date}"] * (date is not None)
    head += [f"WARC-Profile: {profile}"] * (profile is not None)
    return "\r\n".join(head) + "\r\n\r\n" + ("\r\n".join(http) + "\r\n\r\n" + body if http else "")


NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"


def resolved(spark, records):
    raw = spark.createDataFrame([(r, "x") for r in records], "record string, outcome string").repartition(3)
    return {r.record_id: r for r in warc.resolve_revisits(warc.parse_records(raw)).collect()}


def test_canonical_urls(spark):
    cases = {
        "HTTP://WWW.Example.org:80/a/?b=2&utm_source=x&a=1#top": "example.org/a?a=1&b=2",
        "https://example.org": "example.org", "https://example.org/": "example.org", "http://e.org/A/B?ref=1": "e.org/A/B",
        "http://e.org/?": "e.org", "http://e.org/x?refer=1": "e.org/x?refer=1", " https://e.org:443/x/ ": "e.org/x", "": "",
    }
    df = spark.createDataFrame(list(cases.items()), "url string, want string")
    assert [r for r in df.select("*", warc.canonical_url(F.col("url")).alias("got")).collect() if r.got != r.want] == []


def test_the_latest_earlier_response_counts(spark):
    def full(rid, at, tag, url="http://e.org/p", *more):
        return record(rid, "response", url, at, ["HTTP/1.1 200 OK", f"ETag: {tag}", "Content-Type: text/html", "Content-Length: 4", *more], "b" + rid)

    def again(rid, at, *lines, url="https://www.e.org/p/#x"):
        return record(rid, "revisit", url, at, ["HTTP/1.1 304 Not Modified", *lines], profile=NOT_MODIFIED)

    got = resolved(spark, [
        full("f1", "2024-01-01T00:00:00Z", '"one"'), full("f2", "2024-01-03T00:00:00Z", '"two"', "http://e.org/p", "X-A: old", "Cache-Control: a", "Cache-Control: b"),
        full("f3", "2024-01-03T00:00:00Z", '"three"', "http://e.org/other"),
        again("r1", "2024-01-02T00:00:00Z", 'ETag: W/"one"', "X-A: new", "Content-Length: 0", "Content-Type: x/y"),
        again("r2", "2024-01-04T00:00:00Z", 'ETag: "one"'), again("r3", "2023-12-31T00:00:00Z", 'ETag: "one"'),
        again("r4", "2024-01-01T00:00:00Z", 'ETag: "one"'), again("r5", "2024-02-01T00:00:00Z", "Date: today"),
        again("r6", "2024-03-01T00:00:00Z", 'ETag: "two"', "X-A: newer"), again("r7", None, 'ETag: "two"'), again("r8", "2024-01-05T00:00:00Z", url=None),
        again("r9", "2024-01-06T00:00:00Z", "Last-Modified: Monday"), record("w1", "warcinfo", None, "2024-01-01T00:00:00Z"), None, "", "nonsense",
        record("n1", "response", "http://e.org/p", "2024-01-03T12:00:00Z", ["HTTP/1.1 404 Not Found"], "gone"),
    ])
    assert {k: (r.outcome, r.original_id) for k, r in got.items()} == {
        "f1": ("full", None), "f2": ("full", None), "f3": ("full", None), "r1": ("resolved", "f1"), "r2": ("mismatch", None),
        "r3": ("no_response", None), "r4": ("no_response", None), "r5": ("no_validator", None), "r6": ("resolved", "f2"),
        "r7": ("no_response", None), "r8": ("no_response", None), "r9": ("mismatch", None)}
    assert got["r1"].headers == {"etag": 'W/"one"', "content-type": "text/html", "content-length": "4", "x-a": "new"}
    assert got["r6"].headers["x-a"] == "newer" and got["r6"].headers["cache-control"] == "a, b"
    assert got["r1"].payload_sha256 == got["f1"].payload_sha256 and got["r1"].payload_bytes == 3 and got["r2"].payload_sha256 is None


def test_a_busy_url_and_ties_beside_a_plain_loop(spark):
    rnd = random.Random(4)
    rows, plain = [], []
    for i in range(400):
        hour, full, url = rnd.randrange(60), rnd.random() < 0.3, rnd.choice(["a", "a", "a", "b"])
        tag = rnd.choice(["x", "y"])
        date = f"2024-01-{1 + hour // 24:02d}T{hour % 24:02d}:00:00Z"
        http = [f"HTTP/1.1 {200 if full else 304} Z", f'ETag: "{tag}"']
        rows.append(record(f"{i:04d}", "response" if full else "revisit", f"http://e.org/{url}", date, http, "p", None if full else NOT_MODIFIED))
        plain.append((url, hour, f"{i:04d}", full, tag))
    got = resolved(spark, rows + rows[:5])
    for url, hour, rid, full, tag in plain:
        earlier = [(h, r, t) for u, h, r, f, t in plain if f and u == url and h < hour]
        want = ("full", None) if full else ("no_response", None) if not earlier else ("resolved", max(earlier)[1]) if max(earlier)[2] == tag else ("mismatch", None)
        assert (got[rid].outcome, got[rid].original_id) == want
    assert warc.resolve_revisits(warc.parse_records(spark.createDataFrame([], "record string"))).count() == 0


ITEM = "In the year 1850 a merchant named Walter sold 24 barrels of 30 kg to the town and Walter kept 6 barrels for himself there"


def leaks(spark, texts, items=((1, ITEM),), **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = dec.leaks(docs, spark.createDataFrame(list(items), "item_id long, text string"), **options).collect()
    return {(r.doc_id, r.item_id): r for r in found}


def test_changed_values_are_found_and_loose_likeness_is_not(spark):
    rnd = random.Random(3)
    other = "In the year 1790 a merchant named Ruth sold 17 barrels of 5 lb to the town and Ruth kept 3 barrels for himself there"
    mixed = "In the year 1790 a merchant named Ruth sold 17 barrels of 5 lb to the town and Paul kept 3 barrels for himself there"
    got = leaks(spark, [ITEM, words(rnd, 50) + " " + ITEM + " " + words(rnd, 50), other, mixed, ITEM.upper(), words(rnd, 300), "", None,
                        ITEM.replace("merchant", "trader"), "a text of a merchant named Walter sold"])
    assert {k[0]: r.kind for k, r in got.items()} == {0: "verbatim", 1: "verbatim", 2: "reparameterised", 8: "verbatim"}
    assert got[(0, 1)].coverage == 1 and 0.3 <= got[(8, 1)].coverage < 1


def test_placeholders(spark):
    df = spark.createDataFrame([("At noon Anna walked 3.5 km, then 12km; 7 Bob 5 metres in É 1,000",)], "t string")
    row = df.select(dec.tokens(F.col("t")).alias("k")).select("k", F.transform("k", dec.template).alias("p")).first()
    assert row.p == ["at", "noon", "<name>", "walked", "<num>", "<unit>", "then", "<num>", "<unit>", "<num>", "<name>", "<num>", "<unit>", "in", "é", "<num>"]


def plain_tokens(text):
    text = re.sub(r"([a-z0-9,;:] )([A-Z][a-z])", "\\1\x01\\2", text).lower()
    return [("<name>" if t[0] == "\x01" else "<num>" if t[0].isdigit() else t) for t in re.findall(r"\x01?[a-z]+|[0-9]+", text)]


def test_coverage_beside_a_plain_search(spark):
    rnd = random.Random(8)
    letters = "abc"
    items = [(i, words(rnd, rnd.randint(2, 30), letters)) for i in range(25)]
    texts = []
    for _ in range(60):
        w = items[rnd.randrange(25)][1].split()
        a = rnd.randrange(len(w))
        texts.append(words(rnd, rnd.randint(0, 40), letters) + " " + " ".join(w[a : a + rnd.randint(1, 30)]) + " " + words(rnd, 10, letters))
    got = {k: r.coverage for k, r in leaks(spark, texts, items).items()}
    want = {}
    for i, item in items:
        k = plain_tokens(item)
        size = min(len(k), dec.WINDOW)
        windows = {tuple(k[a : a + size]) for a in range(len(k) - size + 1)}
        for d, text in enumerate(texts):
            t = plain_tokens(text)
            hit = windows & {tuple(t[a : a + size]) for a in range(len(t) - size + 1)}
            if size < dec.SHORTEST:
                hit = hit if len(t) == size else set()
            lined = Counter(j - i for i in range(len(k) - size + 1) for j in range(len(t) - size + 1) if k[i : i + size] == t[j : j + size])
            if len(hit) / len(windows) >= dec.COVER or size == dec.WINDOW and max(lined.values(), default=0) + size - 1 >= dec.RUN:
                want[(d, i)] = len(hit) / len(windows)
    assert got == want and want


def test_leaks_of_odd_rows(spark):
    items = spark.createDataFrame([(1, odd_rows()[7][1]), (1, odd_rows()[7][1]), (2, None), (3, ""), (None, "no id here at all of any sort or kind")],
                                  "item_id long, text string")
    df = clashing(odd_table(spark))
    found = dec.leaks(df, items)
    long_enough = len(odd_rows()[7][1].split()) >= dec.SHORTEST
    assert {r.doc_id for r in found.collect()} == ({7, *range(200, 205)} if long_enough else set())
    kept = dec.without_leaks(df, items)
    assert kept.columns == df.columns and kept.count() == df.count() - (6 if long_enough else 0)
    assert dec.leaks(empty_table(spark), items).count() == 0 and dec.leaks(df, items.limit(0)).count() == 0
    assert dec.without_leaks(df, items.limit(0)).count() == df.count()


def test_joins_beyond_the_broadcast_bound(spark, monkeypatch):
    want = set(leaks(spark, [ITEM, "x " + ITEM, "nothing of it"]))
    monkeypatch.setattr(dec, "BROADCAST_ROWS", 0)
    assert set(leaks(spark, [ITEM, "x " + ITEM, "nothing of it"])) == want


def test_no_python_on_the_main_path(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = dec.leaks(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
