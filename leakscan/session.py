"""Session settings for local runs, tests and the benchmark.

On a cluster the session is made by the submitter; nothing in the library
calls :func:`local_session`.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "leakscan", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A folder every executor can reach, below ``spark.checkpoint.dir``.

    The cluster names that folder. Only where it is unset on a single machine
    is a local temporary one made and recorded in the session; on a cluster each
    executor would write to a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="leakscan-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, name)


def settle(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back.

    For small results of a costly scan that several later steps read: the scan
    runs once, and a lost executor costs no second one.
    """
    spark = df.sparkSession
    path = shared_dir(spark, f"settled-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, megabytes: int = 8) -> Iterator[None]:
    """Rows go to Python in batches of so many MB at most, whatever a row holds, in all that runs within the block."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(megabytes << 20))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
