"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the table folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from leakscan.operators.scan import scan
from leakscan.plans import all_queries
from leakscan.session import local_session
from leakscan.sources.builtin import RULES

COPIES = 16

QUERIES = (
    "v14_scan",
    "v14_scan_full",
    "v15_explain_scan",
    "v16_what_if",
    "v11_context_bias",
    "n5_normalize_content",
    "m1_prefix_candidates",
    "m6_validate_candidates",
    "m8_scan_dedup",
    "m9_repeat_suppress",
    "x3_allowlisted",
    "e1_confusion_matrix",
    "e5_segmentation",
    "e7_quantile_floor",
    "p2_check_domain",
    "p6_query_log_counters",
    "p13_manifest_delta",
    "r2_merge_spans",
    "r6_redact",
    "s8_parse_unified_diff",
    "s11_extract_body_text",
    "t1_session_combine",
    "t5_threshold_alerts",
    "t6_state_change_detections",
    "t7_throttle",
    "g1_counters",
    "g4_block_event_log",
    "g7_sarif",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    registry = all_queries()
    # the first query pays for the start of the JVM's compilers and the Python workers
    registry.QUERIES["v14_scan"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in QUERIES:
        start = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    text = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("sum(octet_length(text)) AS b", "count(*) AS n").first()
    # throughput of the scan proper: every text sixteen times, so that what any query costs besides hardly counts
    many = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.col("text").alias("content")).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES)))).repartition(4 * int(os.environ.get("BENCH_CPUS", "8")))
    start = time.perf_counter()
    scan(many, RULES).write.format("noop").mode("overwrite").save()
    steady = time.perf_counter() - start
    alone = times["v14_scan"]
    print(json.dumps({
        "metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "scan_mb_per_sec": round(COPIES * text["b"] / 1e6 / steady, 2), "scan_records_per_sec": round(COPIES * text["n"] / steady),
        "v14_scan_mb_per_sec": round(text["b"] / 1e6 / alone, 2),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
