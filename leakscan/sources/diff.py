"""Added lines of unified diffs.

Lines that come together move together, as one row of lists, and are put in order once,
per diff and slot of positions; whole slots are worked on many at a time. A slot knows its own
headers and hunks; what it takes over from earlier slots (the file it begins in, the
steps so far, the last hunk) is worked out on a table with one row per slot, so a
huge diff is shared by many tasks. Lines leave a slot as pieces, one for each run
of a file. The pieces are written, since both the slots' ends and the lines are read from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from leakscan.operators.lookup import fits_broadcast
from leakscan.session import settle, small_batches

SLOT = 100_000  # positions of a diff that are ordered together
_NUMBERS = pa.struct([("start", pa.int64()), ("steps", pa.int64()), ("open", pa.int64())])
_END = pa.struct([("file", pa.string()), ("steps", pa.int64()), ("open", pa.int64()), ("hunk", _NUMBERS)])
_CONTEXT, _ADDED, _HEADER, _HUNK = range(4)


def _changes(*columns: pa.Array) -> np.ndarray:
    """Whether a row differs from the one before it in any of the columns; the first one does."""
    apart = np.zeros(len(columns[0]), bool)
    apart[:1] = True
    for column in columns:
        try:
            codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
            apart[1:] |= codes[1:] != codes[:-1]
        except pa.ArrowNotImplementedError:
            rows = column.to_pylist()
            apart[1:] |= np.fromiter((x != y for x, y in zip(rows[1:], rows)), bool, len(rows) - 1)
    return apart


def _places(column: pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type):
        return column.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
    return column.cast(pa.float64()).fill_null(float(np.iinfo(np.int64).min)).to_numpy()


def _as_text(data: pa.Array) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(data), data.buffers(), data.null_count, data.offset)


def _after(data: pa.Array, size: int) -> pa.Array:
    return pc.binary_replace_slice(data, 0, size, b"")


def _path(header: pa.Array) -> pa.Array:
    """The file that a ``+++`` line names; empty if there is none."""
    tail = _after(header, 4)
    named = pc.if_else(pc.starts_with(tail, b"b/"), _after(tail, 2), tail)
    return pc.if_else(pc.equal(tail, b"/dev/null"), pa.scalar(b"", pa.binary()), named)


def _start(hunk: pa.Array) -> np.ndarray:
    """The new file's line at which a ``@@`` line says it begins; 1 if that is no number from 1 to the largest int."""
    digits = pc.struct_field(pc.extract_regex(hunk, r"\A[^+]*\+(?P<n>-?[0-9]+)(?:[, ]|\z)"), "n").to_pylist()
    numbers = (int(d) if d and len(d.lstrip(b"-0")) < 11 else 0 for d in digits)
    return np.fromiter((n if 1 <= n < 1 << 31 else 1 for n in numbers), np.int64, len(digits))


def _marked(batch: pa.RecordBatch, slot: int) -> list[pa.Array]:
    """Diff, slot, position, kind, start of the hunk and value (added text, or file) of the lines that bear on any number."""
    data = batch.column(2).cast(pa.binary())

    def begins(word: bytes) -> np.ndarray:
        return pc.starts_with(data, word).fill_null(False).to_numpy(zero_copy_only=False)

    kind = np.where(begins(b"+"), np.where(begins(b"+++ "), _HEADER, _ADDED), np.where(begins(b"@@"), _HUNK, _CONTEXT))
    kept = np.flatnonzero(~begins(b"-") & data.is_valid().to_numpy(zero_copy_only=False))
    diff, pos, data = [c.take(pa.array(kept)) for c in (batch.column(0), batch.column(1), data)]
    kind = kind[kept]
    header, hunk = kind == _HEADER, kind == _HUNK
    start = np.zeros(len(kind), np.int64)
    start[hunk] = _start(data.filter(pa.array(hunk)))
    value = pc.replace_with_mask(_after(data, 1), pa.array(header), _path(data.filter(pa.array(header))))
    value = pc.if_else(pa.array(header | (kind == _ADDED)), value, pa.scalar(None, pa.binary()))
    at = np.floor_divide(_places(pos), slot)
    slots = pa.array(at.astype(np.int64), mask=pos.is_null().to_numpy(zero_copy_only=False))
    return [diff, slots, pos, pa.array(kind.astype(np.int8)), pa.array(start), _as_text(value)]


def _runs(batch: pa.RecordBatch, slot: int, names: list[str]) -> pa.RecordBatch:
    """Neighbouring lines of a diff and slot as one row of lists, with the position of the first."""
    diff, slots, *lists = _marked(batch, slot)
    cuts = np.flatnonzero(_changes(diff, slots))
    offsets = pa.array(np.r_[cuts, len(diff)], pa.int32())
    heads = [c.take(pa.array(cuts)) for c in (diff, slots, lists[0])]
    return pa.RecordBatch.from_arrays([*heads, *[pa.ListArray.from_arrays(offsets, c) for c in lists]], names=names)


def _whole_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs in order of diff and slot, cut between slots only."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = int(np.flatnonzero(_changes(batch.column(0), batch.column(1)))[-1])
        before = held[-1].slice(held[-1].num_rows - 1) if held else None
        if cut == 0 and before is not None and not _changes(*[pa.concat_arrays([before.column(i), batch.column(i).slice(0, 1)]) for i in (0, 1)])[1]:
            held.append(batch)
            continue
        if held or cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _pieces_of(runs: pa.Table) -> list[pa.Array]:
    """For whole slots: diff, slot, file, lines and end of their pieces, and then of each slot's end.

    ``inside`` numbers a line for a slot that begins in a file, ``outside`` for one that does
    not; ``own`` says that the hunk is of the slot.
    """
    diff, slot, _, *lists = [pa.concat_arrays(c.chunks) for c in runs.columns]
    fresh = _changes(diff, slot)
    group = np.repeat(np.cumsum(fresh) - 1, lists[0].value_lengths().to_numpy())
    pos, kind, start, value = [c.flatten() for c in lists]
    at = _places(pos)
    if ((at[1:] < at[:-1]) & (group[1:] == group[:-1])).any():
        order = np.lexsort((at, group))  # groups stay where they are
        pos, kind, start, value = [c.take(pa.array(order)) for c in (pos, kind, start, value)]
    kind, start = kind.to_numpy(), start.to_numpy()
    places = np.arange(len(kind))
    firsts = np.flatnonzero(np.r_[True, np.diff(group) != 0])
    first = firsts[group]

    def latest(of: int) -> np.ndarray:
        found = np.maximum.accumulate(np.where(kind == of, places, -1))
        return np.where(found >= first, found, -1)

    def counted(flags: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags)]
        return total[1:] - total[first]

    def value_at(header: np.ndarray) -> pa.Array:
        return value.take(pa.array(header, mask=header < 0))

    header, hunk = latest(_HEADER), latest(_HUNK)
    in_file = (header >= 0) & pc.not_equal(value, "").fill_null(False).to_numpy(zero_copy_only=False)[header]
    known, open_ = (kind == _ADDED) & in_file, (kind == _ADDED) & (header < 0)
    steps, opens = counted((kind == _CONTEXT) | known), counted(open_)
    own = hunk >= 0
    outside = steps - 1 + np.where(own, start[hunk] - steps[hunk], 0)
    inside = outside + opens - np.where(own, opens[hunk], 0)

    wanted = np.flatnonzero(known | open_)
    new = (np.diff(header[wanted]) != 0) | (np.diff(group[wanted]) != 0)
    cuts = np.flatnonzero(np.r_[True, new]) if len(wanted) else np.empty(0, np.int64)
    heads, lasts = wanted[cuts], np.r_[firsts[1:], len(kind)] - 1
    taken = pa.array(wanted)
    each = pa.StructArray.from_arrays(
        [pos.take(taken), value.take(taken), pa.array(inside[wanted]), pa.array(outside[wanted]), pa.array(own[wanted])],
        names=["pos", "content", "inside", "outside", "own"])
    rows = np.r_[heads, lasts]
    no_end = np.arange(len(rows)) < len(heads)
    numbers = pa.StructArray.from_arrays([pa.array(c[hunk[rows]]) for c in (start, steps, opens)], fields=list(_NUMBERS), mask=pa.array(~own[rows]))
    end = pa.StructArray.from_arrays(
        [value_at(header[rows]), pa.array(steps[rows]), pa.array(opens[rows]), numbers], fields=list(_END), mask=pa.array(no_end))
    offsets = np.r_[cuts, np.full(len(lasts) + 1, len(wanted))]
    keys = pa.array(np.flatnonzero(fresh)[group[rows]])
    return [diff.take(keys), slot.take(keys), value_at(np.where(no_end, header[rows], -1)),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each), end]


def _pieces(lines: DataFrame, diff: str, pos: str, line: str, slot: int) -> DataFrame:
    """(diff, _slot, file, lines, end), written: the added lines of each run of a file within a slot, and a row for its end.

    ``file`` is NULL before the slot's first header.
    """
    given = lines.select(diff, pos, line)
    types = dict(given.dtypes)
    keys = f"`{diff}` {types[diff]}, _slot bigint"
    names = [diff, "_slot", "_at", "_pos", "_kind", "_start", "_value"]
    made = f"{keys}, _at {types[pos]}, _pos array<{types[pos]}>, _kind array<tinyint>, _start array<bigint>, _value array<string>"
    runs = given.mapInArrow(lambda batches: (_runs(b, slot, names) for b in batches if b.num_rows), made)
    source = runs.repartition(diff, "_slot").sortWithinPartitions(diff, "_slot", "_at")
    end = "struct<file:string,steps:bigint,open:bigint,hunk:struct<start:bigint,steps:bigint,open:bigint>>"
    each = f"array<struct<pos:{types[pos]},content:string,inside:bigint,outside:bigint,own:boolean>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slots in _whole_slots(batches):
            yield pa.RecordBatch.from_arrays(_pieces_of(slots), names=[diff, "_slot", "file", "lines", "end"])

    # a run is many lines, so batches are bounded by bytes
    with small_batches(lines.sparkSession):
        return settle(source.mapInArrow(run, f"{keys}, file string, lines {each}, end {end}"))


def _carried(pieces: DataFrame, diff: str) -> DataFrame:
    """What each slot takes over: ``from`` (file, or empty), ``before`` (steps), ``last`` (start and steps of a hunk)."""
    slots = pieces.filter("end IS NOT NULL").select(diff, "_slot", "end.*")
    earlier = Window.partitionBy(diff).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    filed = slots.withColumn("from", F.coalesce(F.last("file", True).over(earlier), F.lit("")))
    opened = F.when(F.col("from") == "", 0).otherwise(1)
    counted = filed.withColumn("before", F.coalesce(F.sum(F.col("steps") + opened * F.col("open")).over(earlier), F.lit(0)))
    hunk = F.when(F.col("hunk").isNotNull(), F.struct(
        F.col("hunk.start").alias("start"), (F.col("before") + F.col("hunk.steps") + opened * F.col("hunk.open")).alias("steps")))
    return counted.select(F.col(diff).alias("_of"), F.col("_slot").alias("_at"), "from", "before", F.last(hunk, True).over(earlier).alias("last"))


def _filed(pieces: DataFrame, diff: str) -> DataFrame:
    """Pieces that lie in a file, with it, and what their slot takes over."""
    same = F.col(diff).eqNullSafe(F.col("_of")) & F.col("_slot").eqNullSafe(F.col("_at"))
    # most diffs are one slot, which takes over nothing
    taken = settle(_carried(pieces, diff).filter("from <> '' OR before <> 0 OR last IS NOT NULL"))
    filed = pieces.filter(F.size("lines") > 0).drop("end")
    joined = filed.join(F.broadcast(taken) if fits_broadcast(taken) else taken, same, "left").withColumns(
        {"from": F.coalesce("from", F.lit("")), "before": F.coalesce("before", F.lit(0))})
    return joined.withColumn("file", F.coalesce("file", "from")).filter("file <> ''")


def _new_line(row: Column) -> Column:
    number = F.when(F.col("from") == "", row["outside"]).otherwise(row["inside"])
    carried = F.coalesce(F.col("last.start") - F.col("last.steps"), F.lit(0)) + F.col("before")
    return (number + F.when(row["own"], 0).otherwise(carried)).cast("int")


def added_lines(lines: DataFrame, diff: str = "diff_id", pos: str = "pos", line: str = "line", slot: int = SLOT) -> DataFrame:
    """Added lines (diff, pos, file, new_line, content) of diffs given line by line.

    The file and the hunk a line belongs to are the last headers before it, and
    its number is the hunk's start plus the lines of the new file since.
    """
    rows = _filed(_pieces(lines, diff, pos, line, slot), diff).withColumn("_row", F.explode("lines"))
    row = F.col("_row")
    return rows.select(diff, row["pos"].alias(pos), "file", _new_line(row).alias("new_line"), row["content"].alias("content"))


def parse_unified_diff(lines: DataFrame, diff: str = "diff_id", pos: str = "pos", line: str = "line", slot: int = SLOT) -> DataFrame:
    """One record per diff and file: its added lines as one text, and the number of the first."""
    first = F.get("lines", 0)
    pieces = _filed(_pieces(lines, diff, pos, line, slot), diff).select(
        diff, "file", first["pos"].alias("_pos"), _new_line(first).alias("_number"), F.array_join(F.col("lines.content"), "\n").alias("_text"))
    grouped = pieces.groupBy(diff, "file").agg(
        F.min_by("_number", "_pos").alias("first_line"), F.sort_array(F.collect_list(F.struct("_pos", "_text"))).alias("_texts"))
    return grouped.select(diff, "file", "first_line", F.array_join("_texts._text", "\n").alias("content"))
