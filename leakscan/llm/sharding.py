"""Shards of equal load: vector bin packing of groups of equal texts.

A group's load is a vector of bytes, tokens and rows. It goes to the shard where
the dot product of this vector with what the shard can still take is highest,
large groups first. Groups that matter for the whole are few by definition and
are placed first, in one go; only a group that no shard has room for is cut. All
others are dealt to blocks by hash, and each block is packed on its own into its
share of what is left of every shard: so a block is level as far as its smallest
group allows, and the shards are level as their sums.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from leakscan.llm.common import settled, whole

DIMENSIONS = ("bytes", "tokens", "rows")
WEIGHTS = (256.0, 1.0, 1.0)  # in the dot product; the law of the shards is about bytes, the others decide between shards level in them
GRAIN = 1 << 20  # a cut group's rows are dealt to its pieces by hashes of their keys, of so many values
LARGE = 1 / 1024  # groups over this part of the whole in some dimension are placed first: 3 * 1024 of them at most
BLOCK = 2000  # groups in a block, about
SLOTS = 4096  # rows that are numbered together, about


def pack(loads: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The shard of each row of ``loads``, which must be in the order of placing.

    ``room`` is what each shard can take (shards x dimensions); both are used
    relative to the whole room, and dimensions weigh as ``WEIGHTS`` say. Of
    equal dot products the first shard wins.
    """
    whole_room = np.maximum(room.sum(axis=0), 1e-12)
    left, loads = room / whole_room, loads / whole_room
    chosen = np.empty(len(loads), np.int32)
    for i, (load, weighed) in enumerate(zip(loads, loads * np.array(WEIGHTS))):
        best = int((left @ weighed).argmax())
        left[best] -= load
        chosen[i] = best
    return chosen


def placing_order(loads: np.ndarray, names: list) -> list[int]:
    """Largest first by the sum of shares, then by name, so that a second run gives the same."""
    share = (loads / np.maximum(loads.sum(axis=0), 1e-12)).sum(axis=1)
    return sorted(range(len(names)), key=lambda i: (-share[i], names[i]))


def place_whole_or_cut(loads: np.ndarray, room: np.ndarray) -> list[list[tuple[float, int]]]:
    """For each row of ``loads``, in the order of placing, its pieces: (part of the group, shard); one piece if some shard can hold it.

    A group goes whole to the best of the shards that have room for it in every
    dimension. Where none has, the best shard takes as much as it can hold, and
    what is left goes on to the next; what no shard has any room for goes to the
    best one.
    """
    whole_room = np.maximum(room.sum(axis=0), 1e-12)
    left, loads, weights = room / whole_room, loads / whole_room, np.array(WEIGHTS)
    placed = []
    for load in loads:
        pieces: dict[int, float] = {}
        rest = 1.0
        while rest > 0:
            # the part of the group that each shard has room for
            parts = np.where(load > 0, np.maximum(left, 0) / np.where(load > 0, load, 1.0), 1.0).min(axis=1)
            able = parts >= rest - 1e-9
            cut = not able.any() and parts.max() >= 1 / GRAIN
            if cut:
                able = parts >= 1 / GRAIN
            best = int(np.where(able | ~able.any(), left @ (load * weights), -np.inf).argmax())
            part = float(parts[best]) if cut else rest
            left[best] -= load * part
            pieces[best] = pieces.get(best, 0.0) + part
            rest -= part
        placed.append([(part, shard) for shard, part in pieces.items()])
    return placed


def _loads(frame: DataFrame) -> list:
    return [F.sum(d).alias(d) for d in DIMENSIONS]


def pack_groups(rows: DataFrame, shards: int = 16) -> DataFrame:
    """``rows`` (columns ``key``, ``group`` and the dimensions, one row each) with ``shard``.

    Rows of a group share a shard unless no shard had room for the group.
    Nothing grows on the driver but the totals, the loads of the shards, and the
    few large groups.
    """
    groups = settled(rows.groupBy("group").agg(*_loads(rows)))
    total = groups.agg(F.count("*").alias("n"), *_loads(groups)).first()
    if not total["n"]:
        return rows.withColumn("shard", F.lit(0))
    whole_load = np.array([float(total[d]) for d in DIMENSIONS])
    large = F.greatest(*[F.col(d) / F.lit(max(w, 1.0) * LARGE) for d, w in zip(DIMENSIONS, whole_load)]) > 1

    few = groups.where(large).collect()
    loads = np.array([[float(r[d]) for d in DIMENSIONS] for r in few]).reshape(-1, len(DIMENSIONS))
    names = [bytes(r["group"]) for r in few]
    order = placing_order(loads, names)
    room = np.tile(whole_load / shards, (shards, 1))
    first = []
    for i, pieces in zip(order, place_whole_or_cut(loads[order], room)):
        upto = np.round(np.cumsum([part for part, _ in pieces]) * GRAIN).astype(int)
        upto[-1] = GRAIN
        first.append((names[i], [(int(u), shard) for u, (_, shard) in zip(upto, pieces)]))
    placed = rows.sparkSession.createDataFrame(first, "group binary, cuts array<struct<upto:int,shard:int>>")
    grain = F.pmod(F.xxhash64("key"), F.lit(GRAIN))
    chosen = F.filter("cuts", lambda c: grain < c["upto"])
    known = rows.join(F.broadcast(placed), "group", "left")  # 3 / LARGE groups at most
    early = known.where("cuts is not null").withColumn("shard", F.get(chosen, F.lit(0))["shard"]).drop("cuts")
    for r in early.groupBy("shard").agg(*_loads(rows)).collect():  # of a cut group, what its rows' hashes made of it
        room[r["shard"]] -= [float(r[d]) for d in DIMENSIONS]
    room = np.maximum(room, 0.0)
    share_of = room / np.maximum(room.sum(axis=0), 1e-12)  # of what is left in each dimension, a shard's part
    blocks = max(1, math.ceil(total["n"] / BLOCK))

    def pack_block(block: pd.DataFrame) -> pd.DataFrame:
        loads = block[list(DIMENSIONS)].to_numpy(float)
        order = placing_order(loads, list(block["group"]))
        chosen = np.empty(len(block), np.int32)
        chosen[order] = pack(loads[order], share_of * loads.sum(axis=0))
        return pd.DataFrame({"group": block["group"], "shard": chosen})

    rest = (
        groups.where(~large)
        .withColumn("block", F.pmod(F.xxhash64("group"), F.lit(blocks)))
        .groupBy("block")
        .applyInPandas(pack_block, "group binary, shard int")
    )
    # no group of the second join holds more than LARGE of the rows
    late = known.where("cuts is null").drop("cuts").join(rest, "group")
    return early.unionByName(late)


def with_slots(rows: DataFrame, n: int, shards: int) -> DataFrame:
    """``rows`` with ``slot``, 0 upwards without gaps in each shard, in order of bucket and key.

    Rows are numbered within buckets of about ``SLOTS`` rows; a bucket's first
    number is the count of the buckets before it. ``n`` is the count of all rows.
    """
    buckets = max(1, math.ceil(n / (SLOTS * shards)))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "group"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("rows_here"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("rows_here").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "group"))
    return dealt.withColumn("nth", nth).join(starts, ["shard", "bucket"]).withColumn("slot", (F.col("start") + F.col("nth") - 1).cast("long"))


def assign_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's ``key``, size, text_crc32, law, shard, slot and grown_shard.

    Bytes are balanced (law "bytes"), tokens (words) and rows with them. Equal
    texts share a shard if one has room for them all when they are placed. NULL
    and empty texts are one group of size 1 a row. Repeated rows get a slot
    each. Other columns are left out; an empty table gives no rows.
    """
    data = whole(F.col(text)).cast("binary")
    rows = settled(docs.select(
        F.col(key).alias("key"),
        (F.octet_length(data) + 1).cast("long").alias("bytes"),
        F.regexp_count(whole(F.col(text)), F.lit(r"\S+")).cast("long").alias("tokens"),
        F.lit(1).cast("long").alias("rows"),
        F.crc32(data).alias("text_crc32"),
        F.unhex(F.sha2(data, 256)).alias("group"),
    ))
    placed = settled(pack_groups(rows, shards))
    numbered = with_slots(placed, rows.count(), shards)
    return numbered.select(
        F.col("key").alias(key), F.col("bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
