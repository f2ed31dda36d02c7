"""Per-key state over streams. Each processor keeps one small value per key.

Column names must not begin with an underscore on the way into a processor:
Spark hands rows over as named tuples, which rename them. Rows reach a processor
through pandas, which turns a whole number beside a missing one into a float and
takes a missing key for a new one every time; so numbers go in and come out as text,
and a state belongs to the text of its key.

All run in event time: the order of rows is that of their timestamps within a
micro-batch, and a row older than what its key has seen changes no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType

from leakscan.functions.text import byte_tail
from leakscan.operators.alerts import INTERVAL, effective_threshold
from leakscan.operators.normalize import normalize_content
from leakscan.operators.ordered import key_text
from leakscan.operators.scan import scan
from leakscan.operators.score import ScoreConfig
from leakscan.operators.session import READ_INTERVAL, SESSION_TTL, TAIL_BYTES
from leakscan.sources.rules import RuleSet


WHOLE = (ByteType, ShortType, IntegerType, LongType)


def _as_text(df: DataFrame, extra: dict[str, Column], order: list[str], out: dict[str, str]) -> tuple[DataFrame, StructType, list[str]]:
    """The rows with their numbers as text, ``extra`` and columns to sort by; the schema with ``out`` that comes back; those columns' names."""
    numbers = [f.name for f in df.schema if isinstance(f.dataType, (*WHOLE, FloatType, DoubleType))]
    rank = {}
    for i, c in enumerate(order):
        value = F.col(c)
        if isinstance(df.schema[c].dataType, WHOLE):  # text of one width sorts as the number does
            value = F.lpad((value.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
        rank[f"rank_{i}"] = F.coalesce(value.cast("string"), F.lit(""))
    texts = df.withColumns(extra | rank).withColumns({c: F.col(c).cast("string") for c in numbers})
    schema = StructType()
    for f in df.schema:
        schema.add(f.name, StringType() if f.name in numbers else f.dataType)
    for name, kind in out.items():
        schema.add(name, kind)
    return texts, schema, list(rank)


def _as_before(df: DataFrame, like: DataFrame) -> DataFrame:
    """Numbers back from text."""
    return df.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in like.schema if isinstance(f.dataType, (*WHOLE, FloatType, DoubleType))})


def _in_order(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


class SessionTail(StatefulProcessor):
    """Hands each paste the end of the one before it, if that is at most ``ttl`` seconds old."""

    def __init__(self, ttl: float, order: list[str], has_end: bool):
        self.ttl_us, self.order, self.has_end = int(ttl * 1_000_000), order, has_end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tail", "tail string, at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows, ["at_us", *self.order])
        tail, at = self.state.get() if self.state.exists() else ("", None)
        priors = []
        for now, own, ended in zip(batch["at_us"], batch["own_tail"], batch["tail_ended"]):
            if at is not None and now < at:
                priors.append("")
                continue
            priors.append(tail if at is not None and now - at <= self.ttl_us else "")
            tail, at = ("" if ended else own), int(now)
        if at is not None:
            self.state.update((tail, at))
            self.handle.registerTimer((at + self.ttl_us) // 1000 + 1)
        yield batch.drop(columns=["own_tail", "tail_ended", "at_us", "state_key", *self.order]).assign(prior_tail=priors)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            _, at = self.state.get()
            if (at + self.ttl_us) // 1000 + 1 <= timerValues.getCurrentWatermarkInMs():
                self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def session_combine_stream(pastes: DataFrame, session: str = "session_id", ts: str = "ts", order: tuple[str, ...] = (),
                           text: str = "canonical", ended: str | None = None, ttl: float = SESSION_TTL,
                           tail_bytes: int = TAIL_BYTES, sep: str = "\n", delay: str = "1 hour") -> DataFrame:
    """Streaming form of ``session_combine``. Spark drops rows more than ``delay`` late, so let it be ample.

    Pastes with no session, or an empty one, are strangers to each other and need no state.
    """
    over = F.coalesce(F.col(ended), F.lit(False)) if ended else F.lit(False)
    own = F.coalesce(F.col(text), F.lit(""))
    watched = pastes.withWatermark(ts, delay)
    named = F.coalesce(F.col(session).cast("string"), F.lit("")) != ""
    marked, schema, ranks = _as_text(watched.filter(named), {
        "own_tail": byte_tail(own, tail_bytes), "tail_ended": over, "at_us": F.unix_micros(F.col(ts).cast("timestamp")),
        "state_key": key_text(F.col(session))}, list(order), {"prior_tail": "string"})
    told = marked.groupBy("state_key").transformWithStateInPandas(
        SessionTail(ttl, ranks, ended is not None), schema, "Append", "EventTime")
    out = _as_before(told, pastes).unionByName(watched.filter(~named).withColumn("prior_tail", F.lit("")))
    prior = F.col("prior_tail")
    return out.withColumn("combined", F.when(prior == "", F.coalesce(F.col(text), F.lit(""))).otherwise(
        F.concat(prior, F.lit(sep), F.coalesce(F.col(text), F.lit("")))))


def scan_session_stream(pastes: DataFrame, rules: RuleSet, config: ScoreConfig = ScoreConfig(), content: str = "content",
                        session: str = "session_id", ts: str = "ts", order: tuple[str, ...] = (), ended: str | None = None,
                        sep: str = "\n", delay: str = "1 hour") -> DataFrame:
    """Streaming form of ``scan_session``."""
    normal = normalize_content(pastes, content, "canonical_text")
    combined = session_combine_stream(normal, session, ts, order, "canonical_text", ended, sep=sep, delay=delay).drop("prior_tail", "canonical_text")
    return scan(combined, rules, config, content=content, canonical="combined").drop("combined")


class BlockAlerts(StatefulProcessor):
    """Counts blocks per interval and reports one when those since the last report reach the threshold.

    Input rows are interval counts that arrive once their interval is over.
    """

    def __init__(self, need: int):
        self.need = need

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows, ["tick"])
        total = self.open.get()[0] if self.open.exists() else 0
        fired = []
        for tick, n in zip(batch["tick"], batch["n"]):
            total += int(n)
            if total >= self.need:
                fired.append((key[0], int(tick), total))
                total = 0
        if total:
            self.open.update((total,))
        else:
            self.open.clear()  # nothing open is what a new key begins with
        yield pd.DataFrame(fired, columns=["state_key", "fired_at", "blocks"])

    def close(self) -> None:
        pass


def threshold_alerts_stream(blocks: DataFrame, key: str = "agent", ts: str = "ts", threshold: int = 0, interval: int = INTERVAL,
                            delay: str = "1 hour") -> DataFrame:
    """Streaming form of ``threshold_alerts``: windowed counts feed a fold with one number of state per key."""
    counted = blocks.withWatermark(ts, delay).groupBy(key, F.window(ts, f"{interval} seconds").alias("w")).agg(F.count("*").alias("n"))
    ticks = counted.select(
        key_text(F.col(key)).alias("state_key"), F.window_time("w").alias("event_time"), F.unix_seconds(F.col("w.end").cast("timestamp")).alias("tick"), "n")
    told = ticks.groupBy("state_key").transformWithStateInPandas(
        BlockAlerts(effective_threshold(threshold)), "state_key string, fired_at long, blocks long", "Append", "None")
    own = F.when(F.col("state_key") != "", F.expr("substr(state_key, 2)")).cast(blocks.schema[key].dataType)
    return told.select(own.alias(key), "fired_at", "blocks")


class TokenBucket(StatefulProcessor):
    """Marks requests admitted by a token bucket."""

    def __init__(self, rate: float, burst: int, order: list[str]):
        self.rate, self.burst, self.order = rate, float(max(burst, 1)), order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "at double, tokens double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows, ["at_sec", *self.order])
        at, tokens = self.state.get() if self.state.exists() else (None, self.burst)
        admitted = []
        for now in batch["at_sec"]:
            if at is None or now > at:
                tokens = min(self.burst, tokens + ((now - at) if at is not None else 0.0) * self.rate)
                at = float(now)
            ok = tokens >= 1
            tokens -= 1.0 if ok else 0.0
            admitted.append(bool(ok))
        self.state.update((at, float(tokens)))
        yield batch.drop(columns=["at_sec", "state_key", *self.order]).assign(admitted=admitted)

    def close(self) -> None:
        pass


def throttle_stream(requests: DataFrame, rate: float, burst: int, key: str = "key", ts: str = "ts", order: tuple[str, ...] = ()) -> DataFrame:
    """Streaming form of ``throttle``."""
    if rate <= 0:
        return requests.withColumn("admitted", F.lit(True))
    timed, schema, ranks = _as_text(requests, {
        "at_sec": F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1_000_000.0), "state_key": key_text(F.col(key))}, list(order), {"admitted": "boolean"})
    told = timed.groupBy("state_key").transformWithStateInPandas(TokenBucket(rate, burst, ranks), schema, "Append", "None")
    return _as_before(told, requests)


class RepeatGate(StatefulProcessor):
    """Marks reads to scan: not within ``interval`` of the last one, and not the text scanned last."""

    def __init__(self, interval: float, order: list[str]):
        self.interval, self.order = interval, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("read", "at double, digest string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows, ["at_sec", *self.order])
        at, last = self.state.get() if self.state.exists() else (None, "")
        scanned = []
        for now, digest in zip(batch["at_sec"], batch["text_digest"]):
            go = at is None or now - at >= self.interval
            if go:
                at = float(now)
            fresh = go and digest != "" and digest != last
            if fresh:
                last = digest
            scanned.append(bool(fresh))
        if at is not None:
            self.state.update((at, last))
        yield batch.drop(columns=["at_sec", "text_digest", "state_key", *self.order]).assign(scanned=scanned)

    def close(self) -> None:
        pass


def repeat_suppress_stream(reads: DataFrame, key: str = "key", ts: str = "ts", order: tuple[str, ...] = (), text: str = "text",
                           interval: float = READ_INTERVAL, max_length: int | None = None) -> DataFrame:
    """Streaming form of ``repeat_suppress``; state holds a digest, never a text."""
    body = F.coalesce(F.col(text), F.lit(""))
    usable = F.length(body) > 0
    if max_length is not None:
        usable = usable & (F.length(body) <= max_length)
    timed, schema, ranks = _as_text(reads, {
        "at_sec": F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1_000_000.0),
        "text_digest": F.when(usable, F.sha2(body.cast("binary"), 256)).otherwise(""), "state_key": key_text(F.col(key))}, list(order), {"scanned": "boolean"})
    told = timed.groupBy("state_key").transformWithStateInPandas(RepeatGate(interval, ranks), schema, "Append", "None")
    return _as_before(told, reads)


class QuietPeriod(StatefulProcessor):
    """Passes a row on if its key passed none within ``interval`` seconds before."""

    def __init__(self, interval: float, order: list[str]):
        self.interval_us, self.order = int(interval * 1_000_000), order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("passed", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows, ["at_us", *self.order])
        at = self.state.get()[0] if self.state.exists() else None
        passed = []
        for now in batch["at_us"]:
            go = at is None or abs(now - at) >= self.interval_us
            if go:
                at = max(int(now), at or 0)
            passed.append(go)
        self.state.update((at,))
        self.handle.registerTimer((at + self.interval_us) // 1000 + 1)
        yield batch[passed].drop(columns=["at_us", "text_digest", *self.order])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and (self.state.get()[0] + self.interval_us) // 1000 + 1 <= timerValues.getCurrentWatermarkInMs():
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def notify_once(records: DataFrame, content: str = "content", ts: str = "ts", within: float = 5.0, delay: str = "1 minute",
                by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """Records whose text (and columns ``by``) was not passed on within the last seconds, for notices that should not repeat.

    A text's state goes once its time is over. Records more than ``delay`` late are dropped.
    """
    parts = [key_text(F.col(c)) for c in by]
    body = F.coalesce(F.col(content), F.lit(""))
    digest = F.sha2(F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts], body).cast("binary"), 256)
    timed, schema, ranks = _as_text(records.withWatermark(ts, delay), {
        "text_digest": digest, "at_us": F.unix_micros(F.col(ts).cast("timestamp"))}, list(order), {})
    told = timed.groupBy("text_digest").transformWithStateInPandas(QuietPeriod(within, ranks), schema, "Append", "EventTime")
    return _as_before(told, records)


def active_sessions_stream(pastes: DataFrame, session: str = "session_id", ts: str = "ts", ttl: int = 30, every: int = 10,
                           delay: str = "1 minute", spread: float | None = None) -> DataFrame:
    """Streaming form of ``active_sessions``: sessions seen within ``ttl`` seconds before each tick, once its window is closed.

    A session is first one row for each window, so a busy one counts once; the
    rows of a window are counted then. With ``spread``, the greatest relative
    standard deviation allowed, the state of a window is a sketch of its sessions
    instead of a row for each, and the count an estimate.
    """
    # both ends belong to a window, hence the microsecond
    window = F.window(ts, f"{ttl} seconds 1 microsecond", f"{every} seconds")
    watched = pastes.withWatermark(ts, delay).withColumn("session_text", key_text(F.col(session)))
    if spread is None:
        once = watched.groupBy(window.alias("w"), "session_text").agg(F.count("*").alias("pastes"))
        counted = once.groupBy("w").agg(F.count("*").alias("active"))
    else:
        counted = watched.groupBy(window.alias("w")).agg(F.approx_count_distinct("session_text", spread).alias("active"))
    return counted.select((F.unix_seconds(F.col("w.start").cast("timestamp")) + F.lit(ttl)).cast("double").alias("tick"), "active")
