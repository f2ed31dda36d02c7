"""Every stream must give what its batch form gives on the same rows."""

import os

import pytest
from pyspark.sql import functions as F
from test_scan import AWS

from leakscan.operators import policy, report
from leakscan.operators.alerts import threshold_alerts
from leakscan.operators.session import repeat_suppress, scan_session, session_combine, throttle
from leakscan.plans import all_queries
from leakscan.sources.builtin import RULES
from leakscan.streaming import processors as p, streams as s

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def stream_of(spark, df, folder, files=3):
    """The rows as a stream of ``files`` micro-batches in order of time."""
    rows = df.orderBy("ts").collect()
    size = max(1, -(-len(rows) // files))
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], df.schema).coalesce(1).write.mode("append").parquet(str(folder))
        # files are taken in order of their times
        for name in os.listdir(folder):
            if name.endswith(".parquet") and os.path.getmtime(f"{folder}/{name}") > 2_000:
                os.utime(f"{folder}/{name}", (1_000 + i, 1_000 + i))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(stream, tmp_path, mode="append"):
    name = f"out_{abs(hash(str(tmp_path)))}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return stream.sparkSession.table(name)


def events(spark):
    return spark.read.parquet(f"{DATA}/events.parquet").selectExpr(
        "event_id", "user_id % 5 AS key", "cast(ts AS timestamp) AS ts", "event_type AS text").limit(400)


def pastes(spark):
    half, rest = AWS[:9], AWS[9:]
    rows = [
        (1, 0, 0, f"é aws {half}", False), (1, 1, 10, f"{rest} then", False), (1, 2, 45, "late " + half, False), (1, 3, 75, rest, False),
        (1, 4, 80, "aws " + half, False), (1, 5, 81, "", False), (1, 6, 82, rest, False),
        (2, 0, 5, "aws " + half, False), (2, 1, 6, "", True), (2, 2, 7, rest, False), (2, 3, 36, "x" * 400, False), (2, 4, 40, "ü" * 200, False),
        (2, 5, 41, "ends", False), ("", 0, 1, half, False), ("", 1, 2, rest, False),
    ]
    return spark.createDataFrame([(str(a), b, c, d, e) for a, b, c, d, e in rows], "session_id string, n int, sec int, content string, ended boolean").withColumn(
        "ts", F.timestamp_seconds(F.col("sec") + 1_700_000_000))


@pytest.mark.parametrize("sep", ["\n", ""])
def test_session(spark, tmp_path, sep):
    df = pastes(spark)
    batch = session_combine(df, order=("n",), text="content", ended="ended", sep=sep)
    rows = {(r.session_id, r.n): r.prior_tail for r in batch.collect()}
    assert rows[("1", 1)].endswith(AWS[:9]) and rows[("1", 2)] == "" and rows[("1", 3)].startswith("late") and rows[("1", 6)] == ""
    assert rows[("2", 2)] == "" and rows[("2", 4)] == "x" * 256 and rows[("2", 5)] == "ü" * 128 and rows[("", 1)] == ""
    stream = p.session_combine_stream(stream_of(spark, df.filter("session_id <> ''"), tmp_path / "in"), order=("n",), text="content", ended="ended", sep=sep)
    got = run(stream, tmp_path)
    want = batch.filter("session_id <> ''").select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_session_scan(spark, tmp_path):
    df = pastes(spark).filter("session_id <> ''")
    batch = scan_session(df, RULES, order=("n",), ended="ended", sep="")
    got = run(p.scan_session_stream(stream_of(spark, df, tmp_path / "in"), RULES, order=("n",), ended="ended", sep=""), tmp_path)
    columns = ["session_id", "n", "blocked", "pattern_name", "score"]
    want = {tuple(r) for r in batch.select(columns).collect()}
    assert {tuple(r) for r in got.select(columns).collect()} == want
    assert {(r[0], r[1]) for r in want if r[2]} == {("1", 1), ("1", 3)}


def test_throttle(spark, tmp_path):
    df = events(spark)
    want = {r.event_id: r.admitted for r in throttle(df, 1 / 3600, 2, order=("event_id",)).collect()}
    got = run(p.throttle_stream(stream_of(spark, df, tmp_path / "in"), 1 / 3600, 2, order=("event_id",)), tmp_path)
    assert {r.event_id: r.admitted for r in got.collect()} == want
    assert 0 < sum(want.values()) < len(want)
    assert throttle(df, 0, 2).filter("NOT admitted").count() == 0


def test_repeat_suppress(spark, tmp_path):
    df = events(spark)
    want = {r.event_id: r.scanned for r in repeat_suppress(df, order=("event_id",), interval=7200.0).collect()}
    got = run(p.repeat_suppress_stream(stream_of(spark, df, tmp_path / "in"), order=("event_id",), interval=7200.0), tmp_path)
    assert {r.event_id: r.scanned for r in got.collect()} == want
    assert 0 < sum(want.values()) < len(want)


def test_alerts(spark, tmp_path):
    df = events(spark).select(F.col("key").alias("agent"), "ts")
    # a last row far in the future closes every window
    closing = spark.createDataFrame([(99, "2030-01-01 00:00:00")], "agent bigint, t string").select("agent", F.to_timestamp("t").alias("ts"))
    want = {tuple(r) for r in threshold_alerts(df, threshold=6, interval=3600 * 6).collect()}
    got = run(p.threshold_alerts_stream(stream_of(spark, df.unionByName(closing), tmp_path / "in"), threshold=6, interval=3600 * 6), tmp_path)
    assert {tuple(r) for r in got.collect()} == want and want


def test_alert_thresholds(spark):
    def fires(n, threshold):
        df = spark.range(n).select(F.lit("a").alias("agent"), F.timestamp_seconds(F.col("id") * 300).alias("ts"))
        return [r.blocks for r in threshold_alerts(df, threshold=threshold).orderBy("fired_at").collect()]

    assert fires(25, 0) == [10, 10]
    assert fires(12, 1) == [5, 5]
    assert fires(9, 7) == [7]


def test_counters_and_flush(spark, tmp_path):
    df = events(spark).selectExpr("key AS agent", "ts", "CASE text WHEN 'click' THEN 'dns' WHEN 'view' THEN 'scan' ELSE 'tamper' END AS kind", "event_id % 2 = 0 AS blocked")
    want = {tuple(r) for r in report.counters(df, ("agent",)).collect()}
    stream = stream_of(spark, df, tmp_path / "in")
    assert {tuple(r) for r in run(s.counters_stream(stream, ("agent",)), tmp_path, "complete").collect()} == want
    q = s.flush_counters(stream, str(tmp_path / "deltas"), str(tmp_path / "cp2"), ("agent",))
    q.awaitTermination(180)
    deltas = spark.read.parquet(str(tmp_path / "deltas"))
    assert deltas.select("batch").distinct().count() == 3
    totals = deltas.groupBy("agent").agg(*[F.sum(c).alias(c) for c in report.COUNTERS])
    assert {tuple(r) for r in totals.collect()} == want


def test_query_log(spark, tmp_path):
    log = spark.createDataFrame([(i, f"a{i % 4}.x.com", i) for i in range(20)], "id int, host string, sec int").withColumn("ts", F.timestamp_seconds(F.col("sec") + 1_700_000_000))
    domains = spark.createDataFrame([("Phishing", "a1.x.com", 0), ("News", ".x.com", 1)], "category string, entry string, source_ordinal int")
    policies = spark.createDataFrame([("Phishing", "deny"), ("News", "allow")], "category string, action string")
    want = {(r.id, r.verdict) for r in policy.query_log_verdicts(log, domains, policies).collect()}
    q = s.query_log_stream(stream_of(spark, log, tmp_path / "in"), lambda: (domains, policies), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(180)
    assert {(r.id, r.verdict) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    assert sum(v == "NXDOMAIN" for _, v in want) == 5


def test_notify_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("a", 3), ("a", 60), ("b", 61)], "content string, sec int").withColumn("ts", F.timestamp_seconds(F.col("sec") + 1_700_000_000))
    got = run(p.notify_once(stream_of(spark, df, tmp_path / "in", 5)), tmp_path)
    assert sorted((r.content, r.sec) for r in got.collect()) == [("a", 0), ("a", 60), ("b", 1), ("b", 61)]


STREAMS = ("t2_session_combine_stream", "t2_session_combine_strangers_stream", "t4_active_sessions_stream",
           "t4_active_sessions_sketch_stream", "p6_query_log_stream")


def test_tables_of_many_files(spark, tmp_path):
    """A stream reads a table that is a folder of files as it does one that is a file."""
    for name in ("conversations", "pages"):
        spark.read.parquet(f"{DATA}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    registry = all_queries().QUERIES
    for name in STREAMS:
        want, got = (sorted(registry[name](spark, folder).collect(), key=repr) for folder in (DATA, str(tmp_path)))
        assert want and got == want, name
