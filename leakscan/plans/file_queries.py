"""Readers, sinks and streams at work: files are written to the shared folder and read back by the library's own readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leakscan.functions import context as ctx
from leakscan.operators import report
from leakscan.plans import scan_queries  # noqa: F401  (its SQL is used again here)
from leakscan.plans.policy_queries import _history, _hosts
from leakscan.plans.registry import ORACLES, query
from leakscan.plans.report_queries import _count_events, _verdict_files
from leakscan.plans.session_queries import _as_pastes, _streamed, _TICKS
from leakscan.plans.source_queries import _LOADED, _exclusion_rows, _pattern_rows
from leakscan.plans.tables import documents
from leakscan.session import shared_dir
from leakscan.sources import files, rules
from leakscan.sources.builtin import RULES
from leakscan.streaming import processors, streams

RULES_A_FILE = 500


def _written(spark, df, *by):
    """The folder of a text file, or of one for each value of ``by``."""
    path = shared_dir(spark, f"files-{uuid.uuid4().hex}")
    df.write.partitionBy(*by).text(path)
    return path


def _rule_files(spark, rows, name):
    """JSON rule files of at most ``RULES_A_FILE`` rules each."""
    rule = F.struct(*[c for c in rows.columns if c != "ordinal"])
    listed = rows.groupBy(F.floor(F.col("ordinal") / RULES_A_FILE).alias("file")).agg(F.collect_list(rule).alias(name))
    return _written(spark, listed.select("file", F.to_json(F.struct(name)).alias("value")), "file")


@query("s1_load_pattern_files", f"SELECT name, regex, category FROM ({_LOADED})")
def load_pattern_files_query(spark, sf):
    return rules.read_patterns(spark, _rule_files(spark, _pattern_rows(spark, sf), "patterns")).select("name", "regex", "category")


@query("s2_load_exclusion_files", """SELECT p_name AS applies_to, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS pattern, p_brand AS word FROM part""")
def load_exclusion_files_query(spark, sf):
    loaded = rules.read_exclusions(spark, _rule_files(spark, _exclusion_rows(spark, sf), "exclusions"))
    return loaded.select("applies_to", "pattern", F.get("words", F.lit(0)).alias("word"))


@query("s5_read_domain_lists", """SELECT lower(url) AS entry, CAST(page_id % 2 AS INTEGER) AS source_ordinal FROM
  (SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages) WHERE page_id % 3 <> 0""")
def domain_list_files_query(spark, sf):
    n = F.col("page_id")
    line = F.when(n % 3 == 0, F.concat(F.lit("# "), "url")).otherwise(F.concat(F.lit("  "), "url", F.lit(" # of a page")))
    lists = [_written(spark, _hosts(spark, sf).filter(n % 2 == i).select(line.alias("value"))) for i in (0, 1)]
    return rules.read_domain_lists(spark, lists).select("entry", "source_ordinal")


@query("s7_read_files", """SELECT lang, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, CAST(sum(strlen(text) - strlen(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines
  FROM documents GROUP BY lang""")
def files_query(spark, sf):
    root = _written(spark, documents(spark, sf).select("lang", "content"), "lang")
    size = F.octet_length("content")
    return files.read_file_tree(spark, root).groupBy(F.regexp_extract("path", "lang=([^/]*)", 1).alias("lang")).agg(
        F.sum(size).alias("bytes"), F.sum(size - F.octet_length(F.replace("content", F.lit("\n"), F.lit("")))).alias("lines"))


@query("g7_sarif_file", f"SELECT line FROM ({ORACLES['g7_sarif']})")
def sarif_file_query(spark, sf):
    path = shared_dir(spark, f"files-{uuid.uuid4().hex}")
    report.write_lines(report.sarif_lines(report.findings(_verdict_files(spark, sf))), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


# --- streams -------------------------------------------------------------------


@query("v14_scan_stream", ORACLES["v14_scan"])
def scan_stream_query(spark, sf):
    def scanned(rows):
        return streams.scan_stream(rows.withColumnRenamed("text", "content"), RULES).select("doc_id", "lang", "blocked", "pattern_name", "score")

    return _streamed(spark, sf, "documents", scanned).groupBy("lang", "blocked", "pattern_name").agg(
        F.count("*").alias("records"), F.sum("score").alias("total_score"))


@query("v14_scan_session_stream", ORACLES["v14_scan_session"])
def scan_session_stream_query(spark, sf):
    def scanned(rows):
        combined = processors.scan_session_stream(_as_pastes(rows), RULES, order=("turn",))
        return combined.select("record_id", "blocked", "pattern_name", "score")

    return _streamed(spark, sf, "conversations", scanned)


@query("t5_threshold_alerts_stream", f"""WITH closed AS (SELECT * FROM ({_TICKS}) WHERE tick <= (SELECT max(epoch_us(ts)) / 1000000 - 3600 FROM events WHERE event_type = 'error'))
  SELECT a.* FROM ({ORACLES['t5_threshold_alerts']}) a WHERE fired_at <= (SELECT max(tick) FROM closed)""")
def threshold_alerts_stream_query(spark, sf):
    def alerted(rows):
        errors = rows.filter("event_type = 'error'").select((F.col("user_id") % 7).alias("agent"), F.col("ts").cast("timestamp").alias("ts"))
        return processors.threshold_alerts_stream(errors, threshold=8, interval=21600)

    # intervals within the delay of the last event stay open
    return _streamed(spark, sf, "events", alerted)


@query("g1_counters_stream", ORACLES["g1_counters"])
def counters_stream_query(spark, sf):
    folder = shared_dir(spark, f"flush-{uuid.uuid4().hex}")

    def flushed(rows):
        streams.flush_counters(_count_events(rows), f"{folder}/out", f"{folder}/checkpoint", ("agent",)).awaitTermination()

    _streamed(spark, sf, "events", flushed)
    deltas = spark.read.parquet(f"{folder}/out")
    return deltas.groupBy("agent").agg(*[F.sum(c).alias(c) for c in report.COUNTERS])


@query("p6_query_log_stream", ORACLES["p6_query_log_at"])
def query_log_stream_query(spark, sf):
    folder = shared_dir(spark, f"log-{uuid.uuid4().hex}")

    def judged(rows):
        log = rows.select("page_id", "url", ctx.url_host(F.col("url")).alias("host"))
        streams.query_log_stream(log, lambda: _history(rows.sparkSession, sf), f"{folder}/out", f"{folder}/checkpoint", ts="page_id").awaitTermination()

    _streamed(spark, sf, "pages", judged)
    return spark.read.parquet(f"{folder}/out").select("page_id", "host", "category", "verdict")
