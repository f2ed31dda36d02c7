"""Running values over ordered rows without one task per key.

A window over a key puts all its rows in one task, and one key may hold a third
of the table. Here rows are windowed per key and time (or position) bucket, and
what a bucket needs from earlier ones is carried over in a table with one row
per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from leakscan.session import settle

PIECE = 8192  # rows of a key that are looked at together


def with_carry(df: DataFrame, key: Sequence[str], order: Sequence[str], bucket: Column, lag: Sequence[str] = (),
               sums: Sequence[str] = (), lasts: Sequence[str] = (), maxes: Sequence[str] = ()) -> DataFrame:
    """Adds for each row of ``df`` what the rows before it (not the row itself) give.

    ``prev_<c>``: value of ``c`` in the row just before; ``sum_<c>`` and
    ``max_<c>``: sum and maximum so far; ``last_<c>``: last value so far that is
    not NULL. ``bucket`` must not decrease along ``order`` (columns that order
    the rows of a key fully). NULL where no row came before; sums start at 0.
    """
    # spread once: the summary and the rows read the same shuffle
    keyed = df.withColumn("_bucket", bucket).repartition(*key, "_bucket")
    rows = F.struct(*order)
    within = Window.partitionBy(*key, "_bucket").orderBy(*order)
    before = within.rowsBetween(Window.unboundedPreceding, -1)

    # one row per bucket, whatever a bucket holds
    summary = [F.max_by(F.struct(*lag), rows).alias("_tail")] if lag else [F.lit(True).alias("_tail")]
    summary += [F.sum(c).alias(f"_sum_{c}") for c in sums]
    summary += [F.max(c).alias(f"_max_{c}") for c in maxes]
    summary += [F.max_by(c, F.when(F.col(c).isNotNull(), rows)).alias(f"_last_{c}") for c in lasts]
    per_bucket = keyed.groupBy(*key, "_bucket").agg(*summary)

    over_buckets = Window.partitionBy(*key).orderBy("_bucket")
    earlier = over_buckets.rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.lag("_tail").over(over_buckets).alias("_carry_tail")]
    carry += [F.sum(f"_sum_{c}").over(earlier).alias(f"_carry_sum_{c}") for c in sums]
    carry += [F.max(f"_max_{c}").over(earlier).alias(f"_carry_max_{c}") for c in maxes]
    carry += [F.last(f"_last_{c}", True).over(earlier).alias(f"_carry_last_{c}") for c in lasts]
    names = [*key, "_bucket"]
    carried = per_bucket.select(*[F.col(c).alias(f"_on_{i}") for i, c in enumerate(names)], *carry)

    # equal-or-both-NULL, so that no filter is added to one reader of the shuffle only
    same = [F.col(c).eqNullSafe(F.col(f"_on_{i}")) for i, c in enumerate(names)]
    joined = keyed.join(carried, reduce(and_, same), "left")
    first = F.row_number().over(within) == 1
    out = [F.when(first, F.col("_carry_tail")[c]).otherwise(F.lag(c).over(within)).alias(f"prev_{c}") for c in lag]
    zero = F.lit(0)
    out += [(F.coalesce(F.sum(c).over(before), zero) + F.coalesce(f"_carry_sum_{c}", zero)).alias(f"sum_{c}") for c in sums]
    out += [F.greatest(F.max(c).over(before), F.col(f"_carry_max_{c}")).alias(f"max_{c}") for c in maxes]
    out += [F.coalesce(F.last(c, True).over(before), F.col(f"_carry_last_{c}")).alias(f"last_{c}") for c in lasts]
    return joined.select(*df.columns, *out)


def seconds(ts: Column) -> Column:
    """Epoch seconds with fraction, for zoned and unzoned timestamps alike."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)


def time_bucket(ts: Column, width: float) -> Column:
    return F.floor(seconds(ts) / F.lit(float(width)))


def key_text(key: Column) -> Column:
    """A key as text that equals itself, also where it is missing."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def in_pieces(df: DataFrame, key: str, order: Sequence[str], piece: str = "_piece", size: int = PIECE) -> DataFrame:
    """``df``, written, with ``piece``: a number for each ``size`` rows of a key, or fewer, that does not decrease along ``order``.

    Rows are dealt by ranges of key and order and counted along, so pieces follow
    the volume of a key, not its times. Columns pass as they are.
    """
    text = key_text(F.col(key))
    dealt = df.withColumn("_key", text).repartitionByRange("_key", *order).sortWithinPartitions("_key", *order)
    source = dealt.withColumn("_task", F.spark_partition_id().cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            keys = batch.column("_key").to_pylist()
            tasks = batch.column("_task").to_numpy(zero_copy_only=False)
            places = np.empty(len(keys), np.int64)
            for i, k in enumerate(keys):
                last, count = k, (count + 1 if k == last else 0)
                places[i] = count
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((tasks << 32) + places // size)], names=[*batch.schema.names, piece])

    schema = StructType([*source.schema.fields]).add(piece, "long")
    return settle(source.mapInArrow(run, schema).drop("_task"))


def _next_admitted(at: np.ndarray, interval: float) -> np.ndarray:
    """For each of the ordered times the place of the first that is ``interval`` later; the count of times if there is none."""
    return np.maximum(np.searchsorted(at, at + interval, "left"), np.arange(len(at)) + 1)


def _last_of_chain(following: np.ndarray) -> np.ndarray:
    """Where the chain from each place ends, by doubling of the steps."""
    n = len(following)
    jump = np.append(following, n)
    end = np.arange(n + 1)
    while True:
        ahead = jump[:n]
        inside = ahead < n
        if not inside.any():
            return end[:n]
        end[:n] = np.where(inside, end[np.minimum(ahead, n)], end[:n])
        jump[:n] = np.where(inside, jump[ahead], n)


def greedy_gate(df: DataFrame, key: str, at: str, order: Sequence[str], interval: float, flag: str, piece: str = "_piece") -> DataFrame:
    """Adds boolean ``flag``: a row counts if the last one of its key that counted is ``interval`` seconds or more before it.

    The row that counts next after any other is a function of that row alone. So
    each piece of a key's rows first gives, for every row it could be entered at,
    the last one that would count in it; where several come to the same they are one
    step of a table that is no longer than the rows of an interval. Then the tables
    of a key are passed through in order, one look-up for each piece, and with its
    entry known each piece marks its rows. A key without rests is shared by as many
    tasks as it has pieces. ``piece`` is added, too.
    """
    def time_of(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(at).to_numpy(zero_copy_only=False).astype(float)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        current = None

        def out() -> pa.RecordBatch:
            times = np.concatenate(held)
            ends = times[_last_of_chain(_next_admitted(times, interval))]
            change = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
            # entering at a row up to ``upto`` leaves with ``leave`` as the last that counted
            upto = times[np.r_[change[1:], len(times)] - 1]
            return pa.RecordBatch.from_arrays(
                [pa.array([current[0]]), pa.array([current[1]], pa.int64()), pa.array([upto.tolist()], pa.list_(pa.float64())),
                 pa.array([ends[change].tolist()], pa.list_(pa.float64()))], names=["_key", piece, "upto", "leave"])

        for batch in batches:
            keys, pieces, times = batch.column("_key").to_pylist(), batch.column(piece).to_pylist(), time_of(batch)
            start = 0
            for i, pair in enumerate(zip(keys, pieces)):
                if pair != current:
                    if current is not None:
                        held.append(times[start:i])
                        yield out()
                    held, current, start = [], pair, i
            held.append(times[start:])
        if current is not None:
            yield out()

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, None
        for batch in batches:
            made = []
            for k, p, upto, leave in zip(*[c.to_pylist() for c in batch.columns]):
                if k != current:
                    current, last = k, None
                made.append(last)
                # the first row that may count; no such row: the piece changes nothing
                place = 0 if last is None else int(np.searchsorted(upto, last + interval, "left"))
                if place < len(leave):
                    last = leave[place]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.float64())], names=["_key", piece, "_last"])

    rows = in_pieces(df, key, [at, *order], piece)
    names = [*df.columns, piece]

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None

        def out() -> Iterator[pa.RecordBatch]:
            times = np.concatenate([time_of(b) for b in held])
            last = held[0].column("_last")[0].as_py()
            place = 0 if last is None else int(np.searchsorted(times, last + interval, "left"))
            following, flags = _next_admitted(times, interval), np.zeros(len(times), bool)
            while place < len(times):
                flags[place] = True
                place = int(following[place])
            start = 0
            for b in held:
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(flags[start : start + b.num_rows])], names=[*names, flag])
                start += b.num_rows

        for batch in batches:
            keys, pieces = batch.column("_key").to_pylist(), batch.column(piece).to_pylist()
            start = 0
            for i, pair in enumerate(zip(keys, pieces)):
                if pair != current:
                    if current is not None:
                        if i > start:
                            held.append(batch.slice(start, i - start))
                        yield from out()
                    held, current, start = [], pair, i
            held.append(batch.slice(start))
        if current is not None:
            yield from out()

    by = ["_key", piece]
    narrow = rows.select(*by, at).repartition(*by).sortWithinPartitions(*by, at)
    tables = narrow.mapInArrow(steps, f"_key string, `{piece}` long, upto array<double>, leave array<double>")
    entered = tables.repartition("_key").sortWithinPartitions(*by).mapInArrow(entries, f"_key string, `{piece}` long, _last double")
    together = rows.join(entered, by).repartition(*by).sortWithinPartitions(*by, at, *order)
    schema = StructType([rows.schema[c] for c in names]).add(flag, "boolean")
    return together.mapInArrow(marks, schema)
