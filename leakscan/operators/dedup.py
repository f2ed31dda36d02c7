"""Scan each distinct text once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leakscan.operators.lookup import lookup
from leakscan.operators.match import MatchOptions
from leakscan.operators.scan import scan
from leakscan.operators.score import ScoreConfig
from leakscan.sources.rules import RuleSet


def scan_distinct(records: DataFrame, rules: RuleSet, config: ScoreConfig = ScoreConfig(),
                  options: MatchOptions = MatchOptions(), content: str = "content") -> DataFrame:
    """As ``scan`` for records whose verdict depends on the text alone (no session, source or allowlist).

    Copies of one text meet map-side first, so a text that fills a third of the
    table is shuffled once per input partition. Only blocked texts come back to
    be joined, and the join is salted when they are many.
    """
    digest = F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256)
    keyed = records.withColumn("_digest", digest)
    distinct = keyed.groupBy("_digest").agg(F.any_value(content).alias("_text"))
    blocked = scan(distinct, rules, config, options, "_text").filter("blocked").drop("_text", "blocked")
    joined = lookup(keyed, blocked, ["_digest"])
    return joined.select(
        *records.columns,
        F.col("score").isNotNull().alias("blocked"),
        F.coalesce("pattern_name", F.lit("")).alias("pattern_name"),
        F.coalesce("score", F.lit(0)).alias("score"),
    )
