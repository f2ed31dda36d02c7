"""Near-duplicate groups by SimHash, compared in bit slices.

Fingerprints are narrow, so everything after them works on distinct 64-bit
values. Two values within the radius of 2 agree in two of four 16-bit blocks, so
they meet in one of six buckets. A bucket's members are stored as bit planes:
plane b holds bit b of all members, 64 to a word. A query's distances to all
members are then added up plane by plane in carry-save counters, two bits and an
overflow for each member. A query leaves a block of 64 members, one word, as soon
as all of them are beyond the radius, and goes on with the other blocks only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from leakscan.llm.bpe import _ddl
from leakscan.llm.common import map_rows, settled, whole
from leakscan.llm.components import components

RADIUS = 2
BLOCKS = 4
SLAB = 1024  # members of a bucket that are compared with each other in one piece
QUERIES = 256  # queries whose counters are updated together
LOOK = 8  # planes between two looks at which blocks are left


def fingerprint(text: str, width: int = 3) -> int:
    """The SimHash of a text as a signed 64-bit integer; 0 if it has no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(width)]))
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(s, 42) for s in shingles], "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit integer; 0 for none."""
    set_bits = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 14):  # bits of a long text are counted in pieces
        part = hashes[start : start + (1 << 14)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", width: int = 3) -> DataFrame:
    """The columns ``keep`` and ``fingerprint``; NULL texts have no words."""

    def rows(*columns):
        return dict(zip(keep, columns)) | {"fingerprint": [fingerprint(t, width) for t in columns[-1]]}

    return map_rows(docs.select(*keep, whole(F.col(text)).alias("_text")), _ddl(docs, keep) + "fingerprint long", rows)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Row b: bit b of all values, 64 values to a word; the last word is filled up with zeros."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    planes = np.zeros((64, -(-len(values) // 64) * 64), np.uint8)
    planes[:, : len(values)] = bits
    return np.packbits(planes, axis=1, bitorder="little").view("<u8")


def _near_in(ones: np.ndarray, twos: np.ndarray, over: np.ndarray) -> np.ndarray:
    """The lanes of each word that are still within the radius."""
    return ~(over | (ones & twos))


def within_radius(queries: np.ndarray, planes: np.ndarray, n: int, since: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, member) of at most two differing bits; ``n`` members lie in ``planes``.

    ``since`` is the first member that each query is compared with (all, if None).
    The counters are held for each query and block of 64 members; every
    ``LOOK`` planes, those whose members are all beyond the radius are left.
    """
    q, word = (a.ravel() for a in np.indices((len(queries), planes.shape[1])))
    full = ~np.uint64(0)
    over = np.zeros(len(q), np.uint64)
    if n % 64:
        over[word == planes.shape[1] - 1] = full << np.uint64(n % 64)  # lanes without a member
    if since is not None:
        skipped = np.clip(since[q] - 64 * word, 0, 64)
        over |= np.where(skipped == 64, full, (np.uint64(1) << (skipped % 64).astype(np.uint64)) - np.uint64(1))
    ones, twos = np.zeros_like(over), np.zeros_like(over)
    for b in range(64):
        if b % LOOK == 0:
            stay = _near_in(ones, twos, over) != 0
            if not stay.all():
                q, word, ones, twos, over = (a[stay] for a in (q, word, ones, twos, over))
            if not len(q):
                break
        differ = planes[b][word] ^ (np.uint64(0) - ((queries >> np.uint64(b)) & np.uint64(1)))[q]
        carry = ones & differ
        ones ^= differ
        over |= twos & carry
        twos ^= carry
    near = _near_in(ones, twos, over)
    cell, lane = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return q[cell], word[cell] * 64 + lane


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after all ``a[i]`` and ``b[i]`` are joined; a label is the least index of its set."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        low, high = np.minimum(la, lb)[apart], np.maximum(la, lb)[apart]
        np.minimum.at(labels, high, low)
        while not np.array_equal(labels[labels], labels):
            labels = labels[labels]


def tile_links(values: np.ndarray, in_first: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the members of a tile as all their near pairs do, at most one for each member.

    ``in_first`` tells the two slabs of a tile apart, which are compared with
    each other only; None: one slab, compared with itself.
    """
    order = np.argsort(values, kind="stable")
    values = values[order]
    first = np.arange(len(values)) if in_first is None else np.flatnonzero(in_first[order])
    second = first if in_first is None else np.flatnonzero(~in_first[order])
    labels = np.arange(len(values))
    if len(first) and len(second):
        unsigned = values.view("<u8")
        planes = bit_planes(np.ascontiguousarray(unsigned[second]))
        for start in range(0, len(first), QUERIES):
            part = first[start : start + QUERIES]
            q, m = within_radius(unsigned[part], planes, len(second), part + 1 if in_first is None else None)
            labels = _joined(labels, part[q], second[m])
    moved = np.flatnonzero(labels != np.arange(len(values)))
    return values[moved], values[labels[moved]]


def _links_of_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile; one tile, of at most a few thousand rows, is held at a time."""
    schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64())])
    held: list[np.ndarray] = []

    def close(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.r_[True, (rows[1:, :4] != rows[:-1, :4]).any(axis=1)])
        made = []
        for a, b in zip(starts, np.r_[starts[1:], len(rows)]):
            part = rows[a:b]
            made.append(tile_links(part[:, 5].copy(), None if part[0, 2] == part[0, 3] else part[:, 4] == part[:, 2]))
        return made

    def batch(made):
        hi, lo = (np.concatenate([m[i] for m in made]) if made else np.empty(0, np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], schema=schema)

    for b in batches:
        if not b.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1)
        rows = np.concatenate([*held, rows])
        last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        held = [rows[cut:]]
        if cut:
            yield batch(close(rows[:cut]))
    if held and len(held[0]):
        yield batch(close(held[0]))


def buckets(fingerprint: Column, radius: int, blocks: int) -> Column:
    """An array of longs of which two values within the radius have at least one in common.

    Of so many blocks of bits they agree in all but ``radius``; each choice of the others is a bucket.
    """
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << b - a) - 1)) for a, b in zip(cuts, cuts[1:])]
    made = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(k).cast("long")
        for i in chosen:
            key = F.shiftleft(key, cuts[i + 1] - cuts[i]) + parts[i]
        made.append(key)
    return F.array(*made)


def near_links(values: DataFrame) -> DataFrame:
    """Links ``(hi, lo)`` that join the distinct values of ``fingerprint`` as all pairs within the radius do."""
    parts = [F.shiftrightunsigned("fingerprint", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(BLOCKS)]
    keys = [
        F.struct(F.lit(k).alias("which"), (F.shiftleft(parts[i], 16) + parts[j]).alias("bits"))
        for k, (i, j) in enumerate(combinations(range(BLOCKS), BLOCKS - RADIUS))
    ]
    placed = values.select("fingerprint", F.inline(F.array(*keys)))
    crowded = settled(placed.groupBy("which", "bits").agg(F.count("*").alias("n")).where("n > 1"))
    # a large bucket is cut into slabs; each pair of slabs is a tile of its own
    slabs = F.ceil(F.col("n") / SLAB).cast("int")
    tiles = (
        placed.join(crowded, ["which", "bits"])
        .select("fingerprint", "which", "bits", slabs.alias("slabs"), F.pmod(F.xxhash64("fingerprint"), slabs).cast("int").alias("slab"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)).alias("other"))
        .select("which", "bits", F.least("slab", "other").alias("low"), F.greatest("slab", "other").alias("high"), "slab", "fingerprint")
    )
    at = ["which", "bits", "low", "high"]
    return tiles.repartition(*at).sortWithinPartitions(*at).mapInArrow(_links_of_tiles, "hi long, lo long")


def near_groups(prints: DataFrame, key: str) -> DataFrame:
    """``fingerprint`` and ``root``, the least fingerprint that it is linked to, for each distinct value;
    ``least``, the least ``key`` (NULLs last) that has the fingerprint."""
    values = settled(prints.groupBy("fingerprint").agg(F.min(key).alias("least")))
    stars = components(near_links(values))
    return values.join(stars.withColumnRenamed("hi", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", F.coalesce("lo", "fingerprint").alias("root"), "least"
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id`` for each row of ``docs``.

    ``component_id`` is the least key reachable over links, NULL only if no
    member has a key. Repeated rows stay, each with the group's id; NULL and
    empty texts have the fingerprint 0, linked like any other. Other columns are
    left out. An empty table gives no rows.
    """
    prints = settled(fingerprints(docs, [key], text, width))
    groups = settled(near_groups(prints, key))
    least = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    known = settled(groups.join(least, "root").select("fingerprint", "component_id"))
    return prints.join(known, "fingerprint").select(
        key, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row of ``docs``, with all its columns, for each group: that of the least key, NULLs last.

    Of several texts under that key the one of least hash stays, of repeated rows any one.
    """
    def named(df: DataFrame) -> list:
        return [df[key].alias("_key"), F.xxhash64(whole(df[text])).alias("_print")]

    prints = settled(fingerprints(docs.select(*named(docs), docs[text].alias("_text")), ["_key", "_print"], "_text", width))
    groups = settled(near_groups(prints, "_key").select("fingerprint", "root"))
    first = F.struct(F.col("_key").isNull().alias("last"), F.col("_key"), F.col("_print"))
    # rows are counted for each member before they meet in their group
    members = prints.groupBy("fingerprint", "_key", "_print").agg(F.count("*").alias("copies"))
    least = members.join(groups, "fingerprint").groupBy("root").agg(F.min(F.struct(first.alias("first"), "copies")).alias("kept"))
    kept = settled(least.select("kept.first._key", "kept.first._print", "kept.copies"))
    same = docs[key].eqNullSafe(kept["_key"]) & (F.xxhash64(whole(docs[text])) == kept["_print"])

    def of(rows: DataFrame) -> DataFrame:
        return docs.join(rows, same, "left_semi")

    # repeated rows are rare but for a few; only they are moved to be told apart
    if not kept.where("copies > 1").limit(1).count():
        return of(kept)
    return of(kept.where("copies = 1")).unionByName(of(kept.where("copies > 1")).dropDuplicates([key, text]))
