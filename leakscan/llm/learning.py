"""Bounded, repeatable samples of labelled texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def sample_texts(docs: DataFrame, marks: DataFrame, key: str, text: str, mark: str, each: int) -> list[tuple[object, str]]:
    """Up to ``each`` whole texts of each ``mark``, as (mark, text) in a fixed pseudo-random order.

    ``marks`` has ``key`` and ``mark``; keys with more than one mark and NULLs are
    left out. Keys are drawn first, by hash, so that only the drawn texts leave
    their tables. ``each`` bounds what the driver gets.
    """
    known = marks.where(F.col(key).isNotNull() & F.col(mark).isNotNull()).select(F.col(key).alias("_key"), F.col(mark).alias("_mark"))
    clear = known.groupBy("_key").agg(F.min("_mark").alias("_mark"), F.max("_mark").alias("_other")).where("_mark = _other")
    drawn_at = (F.xxhash64("_key").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).alias("_at")
    placed = clear.select("_key", "_mark", drawn_at)
    # twice as many as are wanted pass by their draw alone, so no task ranks more than about that
    counts = placed.groupBy("_mark").agg(F.count("*").alias("_n"))
    near = placed.join(F.broadcast(counts), "_mark")  # a row for each mark, the labels there are.where(F.col("_at") * F.col("_n") < 2 * each)
    rank = F.row_number().over(Window.partitionBy("_mark").orderBy("_at", "_key"))
    drawn = near.select("_key", "_mark", "_at", rank.alias("_rank")).where(F.col("_rank") <= each).drop("_rank")
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.length("_text") > 0)
    found = texts.join(F.broadcast(drawn), "_key")  # at most ``each`` keys of each mark
    again = F.row_number().over(Window.partitionBy("_mark").orderBy("_at", "_key", F.xxhash64("_text")))
    rows = found.select("_mark", "_text", again.alias("_rank")).where(F.col("_rank") <= each).collect()
    return [(r["_mark"], r["_text"]) for r in sorted(rows, key=lambda r: (str(r["_mark"]), r["_rank"]))]
