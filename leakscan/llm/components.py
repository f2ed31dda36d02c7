"""Connected components of a table of links, by turns of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leakscan.llm.common import settled


def _ordered(links: DataFrame) -> DataFrame:
    return links.where("hi != lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct()


def _with_least(links: DataFrame) -> DataFrame:
    """Links ``(hi, lo)`` with the least ``lo`` of each ``hi``.

    The minima are combined before they are shuffled and written out, so the
    join is between two plain tables and the planner can split a hub's rows.
    """
    return links.join(settled(links.groupBy("hi").agg(F.min("lo").alias("least"))), "hi")


def components(links: DataFrame) -> DataFrame:
    """``(hi, lo)``: for each node but the least of its component, that least node.

    ``links`` has columns ``hi`` and ``lo`` of one ordered type, in any order
    and repeated or not; links of a node to itself are ignored. Each turn joins
    every node's larger neighbours, then its smaller ones, to its least
    neighbour; components are kept and shrink to stars in about log(n) turns.
    A turn is written to the shared folder, so lineage stays short.
    """
    links = settled(_ordered(links))
    before = None
    while True:
        # a digest of the whole table of links tells when nothing moves any more
        digest = links.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if before == digest:
            return links
        before = digest
        both = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        large = _with_least(both).where("lo > hi").select(F.col("lo").alias("hi"), F.least("hi", "least").alias("lo"))
        small = _with_least(settled(_ordered(large)))
        links = settled(_ordered(small.select(F.explode(F.array(
            F.struct("hi", F.col("least").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")),
        )).alias("link")).select("link.*")))
