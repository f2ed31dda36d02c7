"""Alerts on counts over time, and detections of a check going bad."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leakscan.operators.ordered import in_pieces, key_text, time_bucket, with_carry

# Polling interval in seconds, threshold when none is given, and its floor.
INTERVAL = 300
DEFAULT_THRESHOLD = 10
MIN_THRESHOLD = 5


def effective_threshold(threshold: int) -> int:
    return max(threshold if threshold > 0 else DEFAULT_THRESHOLD, MIN_THRESHOLD)


def threshold_alerts(blocks: DataFrame, key: str = "agent", ts: str = "ts", threshold: int = 0,
                     interval: int = INTERVAL) -> DataFrame:
    """An alert (key, fired_at, blocks) at the end of each interval with enough blocks since the last alert.

    Rows are first counted per interval, map-side too, so the fold over a key
    sees one number per interval however many blocks the key has. The intervals
    are streamed through it in order, with one number of state.
    """
    need = effective_threshold(threshold)
    ticks = blocks.groupBy(key, ((time_bucket(F.col(ts), interval) + 1) * interval).alias("tick")).agg(F.count("*").alias("n"))
    # as text a key equals itself, which a missing number does not
    named = ticks.withColumn("_key", key_text(F.col(key)))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, 0
        for batch in batches:
            fired, counts = [], []
            for i, (k, n) in enumerate(zip(batch.column("_key").to_pylist(), batch.column("n").to_pylist())):
                if k != current:
                    current, total = k, 0
                total += n
                if total >= need:
                    fired.append(i)
                    counts.append(total)
                    total = 0
            hit = batch.take(pa.array(fired, pa.int64()))
            yield pa.RecordBatch.from_arrays([hit.column(key), hit.column("tick"), pa.array(counts, pa.int64())], names=[key, "fired_at", "blocks"])

    kind = blocks.schema[key].dataType.simpleString()
    return named.repartition("_key").sortWithinPartitions("_key", "tick").mapInArrow(fold, f"`{key}` {kind}, fired_at bigint, blocks bigint")


def state_change_detections(checks: DataFrame, host: str = "host", ts: str = "ts", order: tuple[str, ...] = ()) -> DataFrame:
    """Checks at which dns_ok or proxy_ok went from true to false; a failed check (NULL) counts as ok.

    A host's checks are cut by their number, so a busy host's day is shared by tasks.
    """
    ok = checks.withColumns({c: F.coalesce(F.col(c), F.lit(True)) for c in ("dns_ok", "proxy_ok")})
    cut = in_pieces(ok, host, [ts, *order])
    stepped = with_carry(cut, [host], [ts, *order], F.col("_piece"), lag=["dns_ok", "proxy_ok"])
    was_dns, was_proxy = (F.coalesce(f"prev_{c}", F.lit(True)) for c in ("dns_ok", "proxy_ok"))
    fell = (~F.col("dns_ok") & was_dns) | (~F.col("proxy_ok") & was_proxy)
    return stepped.filter(fell).select(
        *checks.columns, F.when(~F.col("proxy_ok"), "proxy").otherwise("dns").alias("reason"))
