"""Repeated byte windows: which strings of 200 bytes start at more than one place.

A suffix array over windows would need a row for each byte. Here each window is
represented by one place in it, its anchor: the ``GRAM`` bytes in it with the
least hash. Equal windows have equal anchors at equal offsets, and neighbouring
windows share theirs, so about one byte in eighty becomes a row. All windows of
one occurrence of an anchor make up its stretch of text.

1. Anchors that occur once are dropped: none of their windows repeats.
2. Stretches that occur twice or more are repeated as a whole.
3. The stretches left differ from others of the same anchor and may share some
   windows with them. These windows are sorted by a radix sort, most significant
   digit first and no deeper than the window; what is alone in its group after a
   digit goes no further, and the groups left at the full depth are exactly the
   repeated windows.

Only what may repeat is ever gathered, in groups of one anchor; a large group is
cut by ranges of offsets and by the bytes that all windows of a range share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leakscan.llm.bpe import _ddl
from leakscan.llm.common import arrow_schema, once, settled, whole

WINDOW = 200
GRAM = 50
PIECE = 1 << 18  # window starts of a long text that are looked at together; must be under half of PLACES
PLACES = (1 << 20) - 1
DIGIT = 40  # bytes of a window in one digit
GROUP = 1500  # stretches of an anchor that are compared in one task
RANGES = (32, 1)  # offsets in a range when a group is larger
HELD = 1 << 18  # bytes of small groups that a task sorts together
MOST = 1 << 20  # bytes that are hashed together, at most; a large group is under that
STEP = 256  # rows that are Python objects at a time
BASE = 0x9E3779B97F4A7C15


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2**64."""
    inverse = pow(BASE, -1, 1 << 64)
    made = []
    for base in (BASE, inverse):
        row = np.full(MOST, base, np.uint64)
        row[0] = 1
        made.append(np.multiply.accumulate(row))
    return made[0], made[1]


class Hasher:
    """Hashes of any stretch of some bytes, from sums over their starts.

    The sums are polynomials modulo 2**64 with an odd base; no two strings that
    are shorter than 2048 bytes collide by construction of such polynomials.
    """

    def __init__(self, data: np.ndarray):
        up, self.down = once("powers", _powers)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours: of a block's end and of the next one's start."""
    n = len(values) - width + 1
    filled = np.full(-(-len(values) // width) * width, ~np.uint64(0))
    filled[: len(values)] = values
    blocks = filled.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def stretches(data: bytes, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """A row for each anchor occurrence of a text: anchor hash, stretch hash, and anchor, start and end of the stretch.

    Columns of one uint64 array, in order of place. A text shorter than the window has none.
    """
    found = [np.empty((0, 5), np.uint64)]
    whole_text = np.frombuffer(data, np.uint8)
    for begin in range(0, len(data) - window + 1, PIECE):
        part = whole_text[begin : begin + PIECE + window - 1]
        hasher = Hasher(part)
        hashes = hasher.grams(gram)
        # the place in the low bits: of equal hashes the last one counts, which again only the window decides
        ranked = hashes & ~np.uint64(PLACES) | np.uint64(PLACES) - np.arange(len(hashes), dtype=np.uint64)
        anchor = PLACES - (_sliding_least(ranked, window - gram + 1) & np.uint64(PLACES)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        ends = np.r_[first[1:], len(anchor)] - 1 + window
        at = anchor[first]
        shape = (at - first).astype(np.uint64) << np.uint64(32) | (ends - first).astype(np.uint64)
        found.append(np.stack([hashes[at], _mixed(hasher.of(first, ends) + _mixed(shape)), at + begin, first + begin, ends + begin], axis=1)
                     .astype(np.uint64))
    return np.concatenate(found)


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are first with their stretch hash, and 2 for those that come again, else 1."""
    _, first, counts = np.unique(rows[:, 1], return_index=True, return_counts=True)
    return rows[first], np.minimum(counts, 2)


def equal_windows(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Whether each window shares its group with an equal one: a radix sort, first digit first, to the window's depth.

    Every digit is the hash of ``DIGIT`` bytes; a window that is alone after a
    digit is settled and not looked at again.
    """
    repeated = np.zeros(len(starts), bool)
    left = np.arange(len(starts))
    hasher = Hasher(data)
    for depth in range(0, window + 1, DIGIT):
        order = np.argsort(groups, kind="stable") if depth == 0 else None
        if depth:  # the digit before this depth
            digit = hasher.of(starts[left] + depth - DIGIT, starts[left] + min(depth, window))
            order = np.lexsort((digit, groups))
        keys = groups[order]
        new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, bool)
        if depth:
            digit = digit[order]
            new[1:] |= digit[1:] != digit[:-1]
        number = np.cumsum(new) - 1
        together = np.bincount(number)[number] > 1 if len(number) else np.empty(0, bool)
        left, groups = left[order][together], number[together]
    repeated[left] = True
    return repeated


# --- tables --------------------------------------------------------------------------------------


def _print(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _texts(docs: DataFrame, text: str) -> DataFrame:
    data = whole(F.col(text))
    return docs.select(*_print(data), data.alias("text"))


def _mapped(df: DataFrame, schema: str, each: Callable[[dict, dict], pa.RecordBatch | None]) -> DataFrame:
    """``each(row, seen)`` for every row; ``seen`` counts texts met by the task, see :func:`_copies`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        held, size = [], 0
        for batch in batches:
            names = batch.schema.names
            for start in range(0, batch.num_rows, STEP):
                for row in zip(*[c.to_pylist() for c in batch.slice(start, STEP).columns]):
                    made = each(dict(zip(names, row)), seen)
                    if made is not None and made.num_rows:
                        held.append(made)
                        size += made.num_rows
                if size > 10_000:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return df.mapInArrow(run, schema)


def _copies(row: dict, seen: dict, most: int) -> bool:
    """Whether the task has met this text ``most`` times already. What is forgotten only costs time."""
    if len(seen) > 500_000:
        seen.clear()
    key = (row["t1"], row["t2"])
    seen[key] = seen.get(key, 0) + 1
    return seen[key] > most


def _anchors(texts: DataFrame) -> DataFrame:
    """``anchor`` and ``n`` (1, or 2 for more), once a text and for no more than two copies of a text in a task."""
    schema = arrow_schema(texts.sparkSession, "anchor long, n int")

    def each(row, seen):
        if _copies(row, seen, 2):
            return None
        anchors, counts = np.unique(stretches(row["text"].encode())[:, 0], return_counts=True)
        return pa.RecordBatch.from_arrays([_signed(anchors), pa.array(np.minimum(counts, 2), pa.int32())], schema=schema)

    return _mapped(texts, "anchor long, n int", each)


def _stretch_rows(texts: DataFrame) -> DataFrame:
    """``anchor``, ``stretch``, the text, and ``n``, for each different stretch of a text."""
    ddl = "anchor long, stretch long, t1 long, t2 long, n int"
    schema = arrow_schema(texts.sparkSession, ddl)

    def each(row, seen):
        if _copies(row, seen, 2):
            return None
        rows, counts = _distinct(stretches(row["text"].encode()))
        same = [pa.array(np.full(len(rows), row[c]), pa.int64()) for c in ("t1", "t2")]
        return pa.RecordBatch.from_arrays([_signed(rows[:, 0]), _signed(rows[:, 1]), *same, pa.array(counts, pa.int32())], schema=schema)

    return _mapped(texts, ddl, each)


def _contexts(texts: DataFrame) -> DataFrame:
    """The bytes of the stretches that the array ``wanted`` of a text names."""
    ddl = "anchor long, stretch long, before int, bytes binary"
    schema = arrow_schema(texts.sparkSession, ddl)

    def each(row, seen):
        data = row["text"].encode()
        rows, _ = _distinct(stretches(data))
        rows = rows[np.isin(rows[:, 1].view(np.int64), np.array(row["wanted"], np.int64))]
        places = rows[:, 2:].astype(np.int64).tolist()
        return pa.RecordBatch.from_arrays([
            _signed(rows[:, 0]), _signed(rows[:, 1]), pa.array([at - a for at, a, _ in places], pa.int32()),
            pa.array([data[a:b] for _, a, b in places], pa.binary()),
        ], schema=schema)

    return _mapped(texts, ddl, each)


def _sorted_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of group in, the outermost repeated offsets of each stretch out."""
    schema = pa.schema([("anchor", pa.int64()), ("stretch", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])

    def found(rows: list[tuple]) -> pa.RecordBatch:
        joined = np.frombuffer(b"".join(r[7] for r in rows), np.uint8)
        sizes = np.array([len(r[7]) for r in rows])
        low, high, before = (np.array([r[i] for r in rows], np.int64) for i in (4, 5, 6))
        number = np.cumsum([1 if i == 0 or r[:3] != rows[i - 1][:3] else 0 for i, r in enumerate(rows)])
        each = high - low + 1
        owner = np.repeat(np.arange(len(rows)), each)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each) + low[owner]
        starts = (np.cumsum(sizes) - sizes + before)[owner] - offset
        again = equal_windows(joined, starts, number[owner] * WINDOW + offset)
        least, most = np.full(len(rows), WINDOW), np.full(len(rows), -1)
        np.minimum.at(least, owner[again], offset[again])
        np.maximum.at(most, owner[again], offset[again])
        hit = np.flatnonzero(most >= 0)
        return pa.RecordBatch.from_arrays([
            pa.array([rows[i][0] for i in hit], pa.int64()), pa.array([rows[i][3] for i in hit], pa.int64()),
            pa.array(least[hit], pa.int32()), pa.array(most[hit], pa.int32()),
        ], schema=schema)

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in (r for at in range(0, batch.num_rows, STEP) for r in zip(*[c.to_pylist() for c in batch.slice(at, STEP).columns])):
            if size >= HELD and row[:3] != held[-1][:3]:
                yield found(held)
                held, size = [], 0
            held.append(row)
            size += len(row[7])
    if held:
        yield found(held)


def _shared_windows(contexts: DataFrame, group: int) -> DataFrame:
    """``anchor``, ``stretch`` and the outermost offsets of windows that another stretch of the anchor has too.

    ``contexts``: anchor, stretch, before, bytes; one row for each stretch.
    """
    if HELD + group * 2 * WINDOW > MOST:
        raise ValueError(f"a group of {group} stretches is too large to be sorted at once")
    windows = F.octet_length("bytes") - F.col("before")  # bytes from the anchor on
    parts = contexts.select(
        "anchor", F.lit(0).alias("range"), F.lit(0).cast("long").alias("core"), "stretch",
        (WINDOW - windows).cast("int").alias("low"), F.col("before").alias("high"), "before", "bytes",
    )
    at = ["anchor", "range", "core"]
    found = None
    for size in (*RANGES, 0):
        counts = settled(parts.groupBy(*at).agg(F.count("*").alias("_n")).where("_n > 1"))
        shared = parts.join(counts, at)
        if size == 0:  # a group is one window by now
            made = shared.select("anchor", "stretch", "low", "high")
        else:
            some = shared.where(F.col("_n") <= group).drop("_n").select(*parts.columns)
            made = some.repartition(*at).sortWithinPartitions(*at).mapInArrow(_sorted_windows, "anchor long, stretch long, low int, high int")
        found = made if found is None else found.unionByName(made)
        if size == 0 or not counts.where(F.col("_n") > group).limit(1).count():
            return found
        ranges = F.sequence(F.floor(F.col("low") / size).cast("int"), F.floor(F.col("high") / size).cast("int"))
        cut = shared.where(F.col("_n") > group).drop("range", "core", "_n").withColumn("range", F.explode(ranges))
        first = F.col("range") * size
        core = F.substring(F.col("bytes"), F.col("before") - first + 1, F.lit(WINDOW - size + 1))
        parts = cut.select(
            "anchor", "range", F.xxhash64(core).alias("core"), "stretch", F.greatest("low", first).cast("int").alias("low"),
            F.least("high", first + size - 1).cast("int").alias("high"), "before", "bytes",
        )
    return found


def repeated_spans(docs: DataFrame, text: str = "text", group: int = GROUP) -> DataFrame:
    """For each text that has repeated windows: its print ``t1``, ``t2`` and ``spans``.

    ``spans`` tells for the text's stretches which part repeats: (stretch, low,
    high) with the outermost offsets of repeated windows before the anchor, NULL
    for all. All windows of a stretch hold its anchor, so what they cover is one run.
    """
    texts = _texts(docs, text)
    again = settled(_anchors(texts).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"))
    rows = settled(
        _stretch_rows(texts).join(again, "anchor").groupBy("anchor", "stretch", "t1", "t2").agg(F.sum("n").alias("n")))
    kinds = settled(rows.groupBy("anchor", "stretch").agg(F.sum("n").alias("n"), F.min(F.struct("t1", "t2")).alias("at")))
    mixed = settled(kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1").select("anchor"))
    wanted = kinds.join(mixed, "anchor").groupBy("at.t1", "at.t2").agg(F.collect_list("stretch").alias("wanted"))  # of one text
    contexts = settled(_contexts(_once(texts).join(wanted, ["t1", "t2"])).dropDuplicates(["anchor", "stretch"]))
    shared = _shared_windows(contexts, group).groupBy("anchor", "stretch").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    once_only = kinds.where("n = 1").select("anchor", "stretch").join(shared, ["anchor", "stretch"])
    none = F.lit(None).cast("int")
    answers = settled(
        kinds.where("n > 1").select("anchor", "stretch", none.alias("low"), none.alias("high")).unionByName(once_only))
    return rows.join(answers, ["anchor", "stretch"]).groupBy("t1", "t2").agg(
        F.collect_list(F.struct("stretch", "low", "high")).alias("spans"))  # of one text


def _once(texts: DataFrame) -> DataFrame:
    """The texts, each at most once a task."""
    schema = arrow_schema(texts.sparkSession, _ddl(texts, texts.columns).rstrip(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            keys = zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist())
            keep = [not _copies({"t1": a, "t2": b}, seen, 1) for a, b in keys]
            yield batch.filter(pa.array(keep, pa.bool_())).cast(schema)

    return texts.mapInArrow(run, _ddl(texts, texts.columns).rstrip(", "))


def removed_runs(data: bytes, spans: list[dict]) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the repeated windows of a text cover."""
    rows = stretches(data)
    known = {s["stretch"]: (s["low"], s["high"]) for s in spans}
    runs: list[tuple[int, int]] = []
    for stretch, at, start, end in zip(rows[:, 1].view(np.int64).tolist(), *[rows[:, i].astype(np.int64).tolist() for i in (2, 3, 4)]):
        if stretch in known:
            low, high = known[stretch]
            a, b = (start, end) if low is None else (at - high, at - low + WINDOW)
            if runs and a <= runs[-1][1]:
                runs[-1] = (min(a, runs[-1][0]), max(b, runs[-1][1]))
            else:
                runs.append((a, b))
    return runs


def kept_bytes(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for run in runs for x in run], len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """``key``, n_bytes, n_removed, n_spans and kept_sha256 for each row.

    A byte is removed if a window of ``WINDOW`` bytes that covers it starts at
    another place too, in this or any other text, whatever else is removed. NULL
    is the empty text. Repeated rows repeat each other's windows. Other columns
    are left out; an empty table gives no rows.
    """
    ddl = "t1 long, t2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema = arrow_schema(docs.sparkSession, ddl)
    spans = settled(repeated_spans(docs, text, group))

    def each(row, seen):
        data = row["text"].encode()
        runs = removed_runs(data, row["spans"]) if row["spans"] else []
        kept = kept_bytes(data, runs)
        values = [row["t1"], row["t2"], len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    made = _mapped(_once(_texts(docs, text)).join(spans, ["t1", "t2"], "left"), ddl, each)
    results = settled(made.dropDuplicates(["t1", "t2"]))
    return docs.select(key, *_print(whole(F.col(text)))).join(results, ["t1", "t2"]).drop("t1", "t2")


def without_repeats(docs: DataFrame, text: str = "text", group: int = GROUP) -> DataFrame:
    """The rows of ``docs`` with all their columns, ``text`` without its repeated windows.

    A character of which only a part is left goes too. Rows meet the spans of
    their text once and are cut where they then lie.
    """
    spans = settled(repeated_spans(docs, text, group))
    found = spans.select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("spans").alias("_spans_of_text"))
    first, second = [F.xxhash64(whole(docs[text])), F.xxhash64(F.lit("second"), whole(docs[text]))]
    joined = docs.join(found, (first == found["_t1"]) & (second == found["_t2"]), "left").select(*[docs[c] for c in docs.columns], "_spans_of_text")
    at = docs.columns.index(text)

    def cut(value: str | None, spans: list[dict] | None) -> str | None:
        if not spans:
            return value
        data = value.encode()
        return kept_bytes(data, removed_runs(data, spans)).decode(errors="ignore")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                columns = list(part.columns[:-1])
                kept = [cut(v, s) for v, s in zip(columns[at].to_pylist(), part.columns[-1].to_pylist())]
                columns[at] = pa.array(kept, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(part.schema)[:-1]))

    return joined.mapInArrow(run, docs.schema)
