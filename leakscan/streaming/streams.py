"""Streams that need no state of their own: scans, counters, verdicts on a query log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from leakscan.operators.policy import query_log_verdicts, query_log_verdicts_at
from leakscan.operators.report import counters
from leakscan.operators.scan import scan
from leakscan.sources.rules import RuleSet


def counters_stream(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Running counters; write in complete or update mode."""
    return counters(events, by)


def flush_counters(events: DataFrame, path: str, checkpoint: str, by: tuple[str, ...] = ()) -> StreamingQuery:
    """Append each micro-batch's counts to a delta table; totals are sums over it.

    A batch that is repeated after a failure overwrites its own folder.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        counters(batch, by).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scan_stream(records: DataFrame, rules: RuleSet, **options) -> DataFrame:
    """``scan`` is a narrow projection and works on a stream as it stands."""
    return scan(records, rules, **options)


def query_log_stream(log: DataFrame, tables: Callable[[], tuple[DataFrame, DataFrame]], path: str, checkpoint: str,
                     host: str = "host", ts: str | None = None) -> StreamingQuery:
    """Verdicts on a query log. ``tables`` gives domains and policies anew for each micro-batch, so changes take hold.

    With ``ts``, the tables have ``since`` and ``until``, and each row is judged by what held at its time.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        domains, policies = tables()
        judged = query_log_verdicts_at(batch, domains, policies, ts, host) if ts else query_log_verdicts(batch, domains, policies, host)
        judged.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
