"""Keys and columns pass folds and streams as they are: large numbers beside missing ones, keys that are missing or empty."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_streaming import run, stream_of

from leakscan.operators import ordered
from leakscan.operators.alerts import state_change_detections, threshold_alerts
from leakscan.operators.session import repeat_suppress, session_combine, throttle
from leakscan.sources.bodies import extract_body_text
from leakscan.streaming import processors as p

BIG = 2**53 + 1


def reads(spark, seed=1, n=120, spread=400):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([None, "", "a", "b", "7"]), rnd.choice([None, BIG, -BIG, 3]), rnd.choice([None, float("nan"), 0.1]),
             rnd.choice(["x", "y", "", None]), rnd.randrange(spread)) for i in range(n)]
    return spark.createDataFrame(rows, "n int, key string, big long, share double, text string, sec int").withColumn("ts", F.timestamp_seconds(F.col("sec") + 1_700_000_000))


def same(a, b):
    return sorted(map(repr, (tuple(r) for r in a.collect()))) == sorted(map(repr, (tuple(r) for r in b.select(a.columns).collect())))


def plain_gate(rows, interval):
    """Whether each read is scanned, row by row."""
    state, made = {}, {}
    for r in sorted(rows, key=lambda r: (r.sec, r.n)):
        at, last = state.get(r.key, (None, None))
        go = at is None or r.sec - at >= interval
        fresh = bool(go and r.text and r.text != last)
        if go:
            state[r.key] = r.sec, r.text if fresh else last
        made[r.n] = fresh
    return made


@pytest.mark.parametrize("piece", [8192, 3])
def test_repeat_suppress_beside_plain_code(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(ordered.in_pieces, "__defaults__", ("_piece", piece))
    df = reads(spark)
    got = repeat_suppress(df, order=("n",), interval=20.0)
    assert {r.n: r.scanned for r in got.collect()} == plain_gate(df.collect(), 20)
    assert same(df, got)
    if piece > 3:
        stream = run(p.repeat_suppress_stream(stream_of(spark, df, tmp_path / "in"), order=("n",), interval=20.0), tmp_path)
        assert same(stream, got)


def test_one_key_without_rests_is_shared_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(ordered.in_pieces, "__defaults__", ("_piece", 50))
    df = reads(spark, 2, 2000, 3000).withColumn("key", F.lit("k"))
    cut = ordered.in_pieces(df.withColumn("_at", F.col("sec").cast("double")), "key", ["_at", "n"])
    assert cut.select("_piece").distinct().count() >= 40
    got = repeat_suppress(df, order=("n",), interval=20.0)
    assert {r.n: r.scanned for r in got.collect()} == plain_gate(df.collect(), 20)


def test_the_gate_beside_plain_steps():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        at = np.sort(rnd.integers(0, 60, rnd.integers(1, 40))).astype(float)
        following = ordered._next_admitted(at, 7.0)
        ends = ordered._last_of_chain(following)
        for i in range(len(at)):
            j = i
            while following[j] < len(at):
                j = following[j]
            assert ends[i] == j


def test_throttle(spark, tmp_path):
    df = reads(spark, 4)
    got = throttle(df, 1 / 30, 2, order=("n",))
    assert same(df, got) and 0 < got.where("admitted").count() < 120
    assert same(run(p.throttle_stream(stream_of(spark, df, tmp_path / "in"), 1 / 30, 2, order=("n",)), tmp_path), got)


def test_whole_number_keys(spark, tmp_path):
    df = reads(spark, 5).withColumn("key", F.when(F.col("n") % 3 == 0, None).when(F.col("n") % 3 == 1, F.lit(BIG)).otherwise(F.lit(BIG - 1)))
    got = repeat_suppress(df, order=("n",), interval=20.0)
    assert {r.n: r.scanned for r in got.collect()} == plain_gate(df.collect(), 20)
    assert same(run(p.repeat_suppress_stream(stream_of(spark, df, tmp_path / "in"), order=("n",), interval=20.0), tmp_path), got)


def test_alerts(spark, tmp_path):
    df = reads(spark, 6, 300, 4000).select(F.col("big").alias("agent"), "ts")
    want = threshold_alerts(df, threshold=5, interval=300)
    assert {r.agent for r in want.collect()} == {None, BIG, -BIG, 3}
    closing = df.limit(1).select(F.lit(99).cast("long").alias("agent"), F.timestamp_seconds(F.lit(1_800_000_000)).alias("ts"))
    got = run(p.threshold_alerts_stream(stream_of(spark, df.unionByName(closing), tmp_path / "in"), threshold=5, interval=300), tmp_path)
    assert same(got, want)


def test_sessions(spark, tmp_path):
    df = reads(spark, 7).withColumnRenamed("key", "session_id")
    got = session_combine(df, order=("n",), text="text")
    assert same(df, got)
    assert got.where("coalesce(session_id, '') = '' AND prior_tail <> ''").count() == 0 and got.where("prior_tail <> ''").count() > 0
    assert same(run(p.session_combine_stream(stream_of(spark, df, tmp_path / "in"), order=("n",), text="text"), tmp_path), got)


def test_notices(spark, tmp_path):
    df = reads(spark, 8)
    got = run(p.notify_once(stream_of(spark, df, tmp_path / "in"), "text", within=50.0, by=("big",), order=("n",)), tmp_path)
    last, want = {}, []
    for r in sorted(df.collect(), key=lambda r: (r.sec, r.n)):
        k = (r.big, r.text or "")
        if k not in last or r.sec - last[k] >= 50:
            last[k] = r.sec
            want.append(repr(tuple(r)))
    assert sorted(repr(tuple(r)) for r in got.select(df.columns).collect()) == sorted(want)


def test_state_changes_of_a_busy_host(spark, monkeypatch):
    monkeypatch.setattr(ordered.in_pieces, "__defaults__", ("_piece", 4))
    rnd = random.Random(9)
    rows = [(i, rnd.choice([None, "h"]), rnd.choice([True, False, None]), rnd.choice([True, False, None]), rnd.choice([None, BIG])) for i in range(100)]
    df = spark.createDataFrame(rows, "n int, host string, dns_ok boolean, proxy_ok boolean, big long").withColumn("ts", F.timestamp_seconds(F.lit(5)))
    want, was = set(), {}
    for n, host, dns, proxy, big in rows:
        now = (dns is not False, proxy is not False)
        before = was.get(host, (True, True))
        if (before[0] and not now[0]) or (before[1] and not now[1]):
            want.add((n, host, big, "dns" if now[1] else "proxy"))
        was[host] = now
    got = state_change_detections(df, order=("n",))
    assert {(r.n, r.host, r.big, r.reason) for r in got.collect()} == want


def test_bodies(spark):
    import zlib

    rows = [(BIG, "text/plain", "deflate", zlib.compress(b"hidden")[2:-4], 1), (None, "text/plain", "", b"open", None), (BIG + 2, "x", "gzip", b"no", BIG)]
    df = spark.createDataFrame(rows, "record_id long, content_type string, content_encoding string, body binary, other long")
    got = {r.record_id: (r.text, r.other, r.encoding_ok) for r in extract_body_text(df).collect()}
    assert got == {BIG: ("hidden", 1, True), None: ("open", None, True), BIG + 2: ("no", BIG, False)}
