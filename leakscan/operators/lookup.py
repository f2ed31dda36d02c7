"""Joins of a large table to a table with one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_BYTES = 8 << 20
SALTS = 16


def fits_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the plan's own estimate of ``df``, from the sizes of the tables it reads, is at most so many bytes.

    Runs nothing; a table that grows with the data soon fails the test.
    """
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


def lookup(facts: DataFrame, keyed: DataFrame, on: list[str], how: str = "left", most: int = BROADCAST_BYTES) -> DataFrame:
    """Join ``facts`` to ``keyed`` (unique on ``on``).

    A small ``keyed`` is broadcast. Otherwise it is repeated once per salt and
    the facts are spread over the salts, so that a key holding a third of the
    facts is shared by 16 tasks. No job runs while the plan is built.
    """
    if fits_broadcast(keyed, most):
        return facts.join(F.broadcast(keyed), on, how)
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), F.lit(SALTS)).cast("int"))
    copies = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
