"""Values users have allowed, kept as salted digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leakscan.functions.text import salted_digest
from leakscan.operators.lookup import lookup
from leakscan.operators.match import MatchOptions
from leakscan.operators.scan import signals_of
from leakscan.operators.score import ScoreConfig, score_match, surviving, threshold
from leakscan.sources.rules import RuleSet

COLUMNS = ("salted_hash", "scope", "pattern_name", "expires_at", "created_at", "last_hit")


def entries(values: DataFrame, salt: str, value: str = "value") -> DataFrame:
    """Entries for values (value, scope, pattern_name, ttl, created_at); the values are dropped. A ttl of 0 never ends."""
    scope = F.coalesce(F.nullif(F.col("scope"), F.lit("")), F.lit("*"))
    expiry = F.when(F.col("ttl") > 0, F.col("created_at") + F.col("ttl")).otherwise(0)
    return values.filter(F.col(value) != "").select(
        salted_digest(F.col(value), salt).alias("salted_hash"), scope.alias("scope"), "pattern_name",
        expiry.cast("bigint").alias("expires_at"), F.col("created_at").cast("bigint").alias("created_at"),
        F.lit(0).cast("bigint").alias("last_hit"))


def upsert(current: DataFrame, added: DataFrame) -> DataFrame:
    """The list after additions: the newest entry per digest, with the last hit an older one had."""
    both = current.select(*COLUMNS, F.lit(0).alias("_new")).unionByName(added.select(*COLUMNS, F.lit(1).alias("_new")))
    newest = F.max_by(F.struct("scope", "pattern_name", "expires_at", "created_at"),
                      F.struct("_new", "created_at", "scope", "expires_at", "pattern_name"))
    hit = F.coalesce(F.max(F.when(F.col("_new") == 0, F.col("last_hit"))), F.lit(0)).cast("bigint")
    return both.groupBy("salted_hash").agg(newest.alias("e"), hit.alias("last_hit")).select("salted_hash", "e.*", "last_hit")


def remove(current: DataFrame, hashes: DataFrame) -> DataFrame:
    return current.join(hashes.select("salted_hash").distinct(), "salted_hash", "left_anti")


def newest_first(current: DataFrame) -> DataFrame:
    return current.orderBy(F.desc("created_at"), "salted_hash")


def cleanup(current: DataFrame, now: int) -> DataFrame:
    return current.filter(~((F.col("expires_at") > 0) & (F.col("expires_at") <= now)))


def touch(current: DataFrame, hits: DataFrame) -> DataFrame:
    """The list with ``last_hit`` moved to the newest hit (salted_hash, ts)."""
    newest = hits.groupBy("salted_hash").agg(F.max("ts").alias("_ts"))
    return current.join(newest, "salted_hash", "left").withColumn(
        "last_hit", F.greatest("last_hit", F.coalesce("_ts", F.lit(0)))).select(*COLUMNS)


def allowed_matches(records: DataFrame, rules: RuleSet, allowlist: DataFrame, salt: str, now: int,
                    options: MatchOptions = MatchOptions(), content: str = "content", kind: Column | None = None) -> DataFrame:
    """One row per surviving match with ``allowed`` and the digest; values do not leave the first stage."""
    prepared = records.withColumn("_kind", kind if kind is not None else F.lit(""))
    found = signals_of(prepared, rules, options, content, keep_values=True)
    parts = ("name", "severity", "weight", "hotword_boost", "require_hotword")
    per_pattern = found.select("record_id", "_kind", F.inline("signals")).select(
        "record_id", "_kind", "num_matches", "matches", *[F.col(f"rule.{c}").alias(f"_{c}") for c in parts])
    rows = per_pattern.select("record_id", "_kind", "num_matches", *[f"_{c}" for c in parts], F.inline(surviving(F.col("matches"))))
    hashed = rows.select(
        "record_id", "_kind", salted_digest(F.col("value"), salt).alias("salted_hash"), "num_matches",
        F.col("_name").alias("pattern_name"), F.col("_severity").alias("severity"),
        F.struct(*[F.col(f"_{c}").alias(c) for c in parts[2:]]).alias("rule"), "start", "end", "hotword", "entropy_ok", "excluded")
    active = cleanup(allowlist, now).select("salted_hash", F.col("scope").alias("_scope"))
    joined = lookup(hashed, active, ["salted_hash"])
    allowed = F.col("_scope").isNotNull() & ((F.col("_scope") == "*") | (F.col("_scope") == F.col("_kind")))
    return joined.withColumn("allowed", allowed)


def scan_with_allowlist(records: DataFrame, rules: RuleSet, allowlist: DataFrame, salt: str, now: int,
                        config: ScoreConfig = ScoreConfig(), options: MatchOptions = MatchOptions(), content: str = "content",
                        kind: Column | None = None) -> DataFrame:
    """``scan`` without allowed values. Only matches are shuffled, as digests, and joined back as verdicts."""
    matches = allowed_matches(records, rules, allowlist, salt, now, options, content, kind)
    weights = config.struct()
    score = score_match(F.col("rule"), weights, F.col("hotword"), F.col("entropy_ok"), F.col("num_matches"), F.col("excluded"))
    per_pattern = matches.filter(~F.col("allowed")).groupBy("record_id", "pattern_name", "severity").agg(
        F.max(score).alias("score"), F.max("hotword").alias("hot"), F.first("rule.require_hotword").alias("needs_hot"))
    blocked = per_pattern.filter((~F.col("needs_hot") | F.col("hot")) & (F.col("score") >= threshold(weights, F.col("severity"))))
    best = blocked.groupBy("record_id").agg(F.min(F.struct((-F.col("score")).alias("neg"), "pattern_name")).alias("b"))
    joined = records.join(best, "record_id", "left")
    return joined.select(
        *records.columns, F.col("b").isNotNull().alias("blocked"), F.coalesce("b.pattern_name", F.lit("")).alias("pattern_name"),
        F.coalesce(-F.col("b.neg"), F.lit(0)).alias("score"))


def hits(matches: DataFrame, now: int) -> DataFrame:
    """Digests that spared a match, for :func:`touch`."""
    return matches.filter("allowed").groupBy("salted_hash").agg(F.lit(now).cast("bigint").alias("ts"))
