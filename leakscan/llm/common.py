"""What the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from leakscan.session import small_batches  # noqa: F401, used by the operators here


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """The rows written once to the folder of ``spark.checkpoint.dir`` and read from there.

    Several later steps read them without a second run of what made them, and a
    lost executor costs nothing. Where the session names no folder (tests), a
    temporary one is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, as the session has it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def whole(text: Column) -> Column:
    """A text, the empty one for NULL."""
    return F.coalesce(text.cast("string"), F.lit(""))


def map_rows(df: DataFrame, schema: str, rows: Callable[..., dict], step: int = 512) -> DataFrame:
    """Columns made in Arrow batches: ``rows(*lists)`` gets the columns of ``df`` as lists.

    It returns a list for each column of ``schema``. Rows are handed on in
    batches of ``step``, so that a batch of long texts is not held twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                made = rows(*[c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)
        give_back()

    arrow = arrow_schema(df.sparkSession, schema)
    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def training_split(key: Column) -> Column:
    """0, 1 or 2; rows of 1 are held out from all learning."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def once(key: Hashable, build: Callable[[], Any]) -> Any:
    """What ``build`` makes, kept in the worker process for later tasks until something else is asked for.

    Functions travel to the workers by value, so a module of this package holds
    nothing there from one task to the next.
    """
    kept = sys.modules.setdefault("_leakscan_kept", types.ModuleType("_leakscan_kept")).__dict__.setdefault("kept", {})
    if key not in kept:
        kept.clear()  # a worker serves one operator after the other; what the last one held would only add up
        give_back()
        kept[key] = build()
    return kept[key]


def give_back() -> None:
    """Memory that is free in this worker goes back to the system; a worker outlives its tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
    if trim:
        trim(0)


def written(df: DataFrame) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back; :func:`discard` removes them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.written_to = path
    return made


def discard(*tables: DataFrame) -> None:
    """Remove what :func:`written` wrote, once nothing that is still to run reads it."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, key: str, order: list[Column], at: str, keep: list[str]) -> DataFrame:
    """The columns ``keep``, written, with the place ``at`` of each row among those of its ``key``, from 0, by ``order``.

    Rows are dealt by ranges of key and order, so a key with a third of them is
    spread over a third of the tasks, and each task counts along its sorted rows
    with one number of state. Only keys that reach over from one task to the next
    need more: a row for each such task, which the number of tasks bounds.
    Rows of equal key and order are numbered in any order. NULL keys come first.
    """
    sort = [F.col(key), *order]
    dealt = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    # a mixing of the key stands for it, so that one number tells neighbours apart whatever the key's type
    source = dealt.select(F.spark_partition_id().alias("_task"), F.xxhash64(F.col(key).isNull(), key).alias("_mixed"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            mixed = batch.column(1).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, mixed[1:] != mixed[:-1]])
            sizes = np.diff(np.r_[starts, len(mixed)])
            place = np.arange(len(mixed)) - np.repeat(starts, sizes)
            if mixed[0] == last:
                place[: sizes[0]] += count
            last, count = mixed[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, at])

    from pyspark.sql.types import StructType

    schema = StructType([*source.schema.fields]).add(at, "long")
    local = written(source.mapInArrow(run, schema))
    per = local.groupBy("_task", "_mixed").agg(F.max(at).alias("_most"))
    several = per.join(per.groupBy("_mixed").agg(F.count("*").alias("_tasks")).where("_tasks > 1").drop("_tasks"), "_mixed")
    before = F.sum(F.col("_most") + 1).over(Window.partitionBy("_mixed").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    carried = several.select("_task", "_mixed", F.coalesce(before, F.lit(0)).alias("_before"))
    # at most two rows for each task, its first and its last key
    placed = local.join(F.broadcast(carried), ["_task", "_mixed"], "left")
    return placed.select(*keep, (F.col(at) + F.coalesce("_before", F.lit(0))).alias(at))
