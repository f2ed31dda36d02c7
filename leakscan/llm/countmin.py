"""A count-min sketch over the keys of many texts, for telling which of them may occur in more than one.

Each task sketches its own texts; what it gives out is sparse, the counters it
touched and whether more than once. Sketches are merged shard by shard in a shuffle.
Counters stop at two, so the merged sketch is a bit for each: "more than one". A key
met twice has all its bits set, so nothing repeated is ever taken for unique; a
sketch too small for its keys only takes more of the unique ones for repeated.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DEPTH = 2  # rows of the sketch
LEAST, MOST = 20, 29  # binary logarithms of a row's counters; 2**29 of them are 64 MB a row as bits
SHARD = 17  # binary logarithm of the counters that are merged in one piece
BUFFER = 1 << 19  # keys that a task sketches at once, 4 MB and some copies of it


def mixed(values: np.ndarray) -> np.ndarray:
    """The 64-bit values dealt out evenly, one to one."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def cells_of(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mixed(keys + np.uint64(row * 0x632BE59BD9B4E019 + 1 & (1 << 64) - 1)) >> np.uint64(64 - bits)


def _packed(cells: np.ndarray, twice: np.ndarray) -> bytes:
    """Sorted places in a shard with a bit that tells whether they were met more than once."""
    return zlib.compress(np.diff(cells.astype("<u4") << 1 | twice.astype("<u4"), prepend=np.uint32(0)).tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.cumsum(np.frombuffer(zlib.decompress(data), "<u4"), dtype="<u4")
    return both >> 1, both & 1


def bits_for(counters: int) -> int:
    """The binary logarithm of a row's counters, for so many or more of them, within bounds."""
    return min(MOST, max(LEAST, counters.bit_length()))


def sketch(texts: DataFrame, keys_of: Callable[[str], np.ndarray], bits: int, depth: int = DEPTH) -> np.ndarray:
    """For each row of the sketch, a bit for each of its 2**bits counters: whether it counts more than one.

    ``texts`` has one string column, each of whose values counts once for each of
    its different 64-bit keys. The driver gets a bit for each counter, at most.
    """
    shard_bits = min(SHARD, bits)

    def blobs(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, made = np.concatenate(held), []
        for row in range(depth):
            cells, n = np.unique(cells_of(keys, row, bits), return_counts=True)
            shards, starts = np.unique(cells >> np.uint64(shard_bits), return_index=True)
            for s, a, b in zip(shards, starts, np.r_[starts[1:], len(cells)]):
                made.append((row, int(s), _packed(cells[a:b] & np.uint64((1 << shard_bits) - 1), n[a:b] > 1)))
        for i in range(0, len(made), 1024):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made[i : i + 1024]), (pa.int32(), pa.int64(), pa.binary()))], names=["row", "shard", "data"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for value in batch.column(0):
                held.append(keys_of(value.as_py()))
                size += len(held[-1])
                if size >= BUFFER:
                    yield from blobs(held)
                    held, size = [], 0
        if size:
            yield from blobs(held)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if at is not None and (counts > 1).any():
                values = ([at[0]], [at[1]], [np.packbits(counts > 1, bitorder="little").tobytes()])
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.binary()))], names=["row", "shard", "data"])

        for batch in batches:
            for row, shard, data in zip(*[c.to_pylist() for c in batch.columns]):
                if (row, shard) != at:
                    yield from done()
                    at, counts = (row, shard), np.zeros(1 << shard_bits, np.uint8)
                cells, twice = _unpacked(data)
                counts[cells] = np.minimum(counts[cells] + 1 + twice, 2)
        yield from done()

    made = "row int, shard long, data binary"
    parts = texts.mapInArrow(partial, made).repartition("row", "shard").sortWithinPartitions("row", "shard")
    over = np.zeros((depth, max(1, (1 << bits) // 8)), np.uint8)
    step = (1 << shard_bits) // 8
    for r in parts.mapInArrow(merged, made).collect():  # a bit for each counter, as MOST bounds them
        over[r["row"], r["shard"] * step : (r["shard"] + 1) * step] = np.frombuffer(r["data"], np.uint8)
    return over


def estimated_repeated(keys: np.ndarray, over: np.ndarray, bits: int) -> np.ndarray:
    """Whether each counter of a key is above one, in every row."""
    found = np.ones(len(keys), bool)
    for row in range(len(over)):
        cells = cells_of(keys, row, bits)
        found &= (over[row][(cells >> np.uint64(3)).astype(np.int64)] >> (cells & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return found
