"""Text carried over from one paste of a session to the next, and other per-session state in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from leakscan.functions.text import byte_tail
from leakscan.operators.match import MatchOptions
from leakscan.operators.normalize import normalize_content
from leakscan.operators.ordered import greedy_gate, key_text, seconds, time_bucket, with_carry
from leakscan.operators.scan import scan
from leakscan.operators.score import ScoreConfig
from leakscan.sources.rules import RuleSet

# How long and how much of a paste is remembered; gap between clipboard reads.
SESSION_TTL = 30.0
TAIL_BYTES = 256
READ_INTERVAL = 1.5


def session_combine(pastes: DataFrame, session: str = "session_id", ts: str = "ts", order: tuple[str, ...] = (),
                    text: str = "canonical", ended: str | None = None, ttl: float = SESSION_TTL,
                    tail_bytes: int = TAIL_BYTES, sep: str = "\n") -> DataFrame:
    """Adds ``prior_tail`` and ``combined``: the end of the previous paste, if recent, before the text.

    What is kept is the end of the paste itself, never of the combination. An
    empty paste, and a row whose ``ended`` is true, clear it. ``sep=""`` joins a
    value cut in two; the default keeps the pastes on lines of their own.

    Only the last ``ttl`` seconds matter, so rows are windowed per session and
    time slot, and each row is also handed, without its text, to the next slot.
    One busy session is thus shared by as many tasks as it has slots. Pastes with
    no session, or an empty one, are strangers to each other and stay where they are.
    """
    tail = byte_tail(F.coalesce(F.col(text), F.lit("")), tail_bytes)
    if ended:
        tail = F.when(F.coalesce(F.col(ended), F.lit(False)), "").otherwise(tail)
    named = F.coalesce(F.col(session).cast("string"), F.lit("")) != ""
    marked = pastes.filter(named).withColumns({"_tail": tail, "_at": seconds(F.col(ts))})
    copies = marked.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_copy")).withColumns({
        "_slot": time_bucket(F.col(ts), ttl) + F.col("_copy"),
        # the copy for the next slot needs neither the text nor anything else
        **{c: F.when(F.col("_copy") == 0, F.col(c)) for c in pastes.columns if c not in (session, ts, *order)},
    })
    in_slot = Window.partitionBy(session, "_slot").orderBy(ts, *order)
    seen = copies.withColumns({"_prev_tail": F.lag("_tail").over(in_slot), "_prev_at": F.lag("_at").over(in_slot)})
    alive = F.col("_at") - F.col("_prev_at") <= ttl
    prior = F.coalesce(F.when(alive, F.col("_prev_tail")), F.lit(""))
    own = F.coalesce(F.col(text), F.lit(""))
    alone = pastes.filter(~named).withColumn("prior_tail", F.lit(""))
    return seen.filter("_copy = 0").withColumn("prior_tail", prior).select(*pastes.columns, "prior_tail").unionByName(alone).select(
        *pastes.columns, "prior_tail",
        F.when(F.col("prior_tail") == "", own).otherwise(F.concat("prior_tail", F.lit(sep), own)).alias("combined"),
    )


def scan_session(pastes: DataFrame, rules: RuleSet, config: ScoreConfig = ScoreConfig(), options: MatchOptions = MatchOptions(),
                 content: str = "content", session: str = "session_id", ts: str = "ts", order: tuple[str, ...] = (),
                 ended: str | None = None, sep: str = "\n", source: str | None = None) -> DataFrame:
    """``scan`` on each paste together with the end of the one before it."""
    normal = normalize_content(pastes, content, "_canonical")
    combined = session_combine(normal, session, ts, order, "_canonical", ended, sep=sep).drop("prior_tail", "_canonical")
    scanned = scan(combined, rules, config, options, content, source, canonical="combined")
    return scanned.drop("combined")


def active_sessions(pastes: DataFrame, session: str = "session_id", ts: str = "ts", ttl: float = SESSION_TTL,
                    every: float = 10.0) -> DataFrame:
    """Sessions seen within ``ttl`` seconds before each tick (a multiple of ``every`` seconds)."""
    at = seconds(F.col(ts))
    first, last = F.ceil(at / F.lit(every)), F.floor((at + F.lit(ttl)) / F.lit(every))
    ticks = pastes.select(session, F.explode(F.sequence(first, F.greatest(first, last))).alias("_n"), last.alias("_last"))
    # distinct pairs meet map-side, so a busy session costs one row per tick and task
    pairs = ticks.filter(F.col("_n") <= F.col("_last")).select("_n", session).distinct()
    return pairs.groupBy("_n").agg(F.count("*").alias("active")).select((F.col("_n") * F.lit(every)).alias("tick"), "active")


def _rest_points(rows: DataFrame, key: str, at: str, order: tuple[str, ...], rest: float) -> DataFrame:
    """Adds ``_run``: where the run of rows with gaps below ``rest`` began that a row belongs to."""
    hour = F.floor(F.col(at) / 3600.0)
    stepped = with_carry(rows, [key], [at, *order], hour, lag=[at])
    fresh = F.col(f"prev_{at}").isNull() | (F.col(at) - F.col(f"prev_{at}") >= rest)
    begun = stepped.withColumn("_begin", F.when(fresh, F.col(at))).drop(f"prev_{at}")
    carried = with_carry(begun, [key], [at, *order], hour, lasts=["_begin"])
    return carried.withColumn("_run", F.coalesce("_begin", "last__begin")).drop("_begin", "last__begin")


def _fold_runs(rows: DataFrame, key: str, at: str, order: tuple[str, ...], step, flag: str) -> DataFrame:
    """Adds boolean ``flag`` by ``step(state, at) -> (state, flag)``, from a fresh state for each run.

    A run is streamed through its task in Arrow batches with one small state, so
    its length does not matter to memory. Runs of one key are independent and
    spread over tasks; a key that never rests is one run, in sequence by nature.
    All other columns pass as they are.
    """
    schema = rows.drop("_run").schema.add(flag, "boolean")
    columns = [f.name for f in schema][:-1]
    # rows without a key are one key of their own; as text it equals itself, which a missing number does not
    rows = rows.withColumn("_key", key_text(F.col(key)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            flags = []
            for k, run, t in zip(*[batch.column(c).to_pylist() for c in ("_key", "_run", at)]):
                if (k, run) != current:
                    current, state = (k, run), None
                state, admitted = step(state, t)
                flags.append(admitted)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(flags, pa.bool_())], names=[*columns, flag])

    return rows.repartition("_key", "_run").sortWithinPartitions("_key", "_run", at, *order).mapInArrow(walk, schema)


def throttle(requests: DataFrame, rate: float, burst: int, key: str = "key", ts: str = "ts", order: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``admitted``: a token bucket per key. A rate of 0 or less admits all; a burst is at least 1.

    After a rest of burst / rate seconds a bucket is full whatever came before,
    so the rows between rests are folded on their own.
    """
    if rate <= 0:
        return requests.withColumn("admitted", F.lit(True))
    full = float(max(burst, 1))

    def step(state, at):
        last, tokens = state if state else (at, full)
        tokens = min(full, tokens + (at - last) * rate)
        return ((at, tokens - 1), True) if tokens >= 1 else ((at, tokens), False)

    timed = requests.withColumn("_at", seconds(F.col(ts)))
    return _fold_runs(_rest_points(timed, key, "_at", order, full / rate), key, "_at", order, step, "admitted").drop("_at")


def repeat_suppress(reads: DataFrame, key: str = "key", ts: str = "ts", order: tuple[str, ...] = (), text: str = "text",
                    interval: float = READ_INTERVAL, max_length: int | None = None) -> DataFrame:
    """Adds ``scanned``: a read counts if the last one counted is ``interval`` seconds ago and its text is new.

    A read too early is ignored altogether. Of the others, empty texts (and
    those over ``max_length``, if given) are skipped, and so is a text equal to
    the last one scanned. Reads without a key are one key of their own. Of reads
    at one instant the first by ``order`` counts, any one if that leaves a tie.
    Reads without a time come first, all at one instant.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    usable = F.length(body) > 0
    if max_length is not None:
        usable = usable & (F.length(body) <= max_length)
    timed = reads.withColumns({
        "_at": F.coalesce(seconds(F.col(ts)), F.lit(float("-inf"))), "_digest": F.when(usable, F.sha2(body.cast("binary"), 256))})
    # flags stay on the rows, so neither a tie nor a missing key can lose them
    gated = greedy_gate(timed, key, "_at", order, interval, "_read", "_piece")
    seen = gated.withColumn("_digest", F.when(F.col("_read"), F.col("_digest")))
    carried = with_carry(seen, [key], ["_at", *order], F.col("_piece"), lasts=["_digest"])
    fresh = F.col("_digest").isNotNull() & ~F.col("_digest").eqNullSafe(F.col("last__digest"))
    return carried.select(*reads.columns, fresh.alias("scanned"))
