"""Tripwire values: made once, watched for like any pattern."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from leakscan.functions.regex import quote
from leakscan.operators.lookup import lookup
from leakscan.operators.normalize import normalize_content
from leakscan.sources.rules import Pattern, RuleError

NAME_PREFIX = "Canary:"
TOKEN_PREFIX = "TRIPW"
RANDOM_LETTERS = 16
MAX_LABEL = 128
_LETTERS = string.ascii_uppercase + "234567"


def _drawn(digits: Column) -> Column:
    """A letter for each two of some random hexadecimal digits; 256 is a multiple of 32, so none is likelier."""
    places = F.sequence(F.lit(0), F.lit(RANDOM_LETTERS - 1))
    return F.array_join(F.transform(places, lambda i: F.substring(
        F.lit(_LETTERS), F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int") % 32 + 1, F.lit(1))), "")


def usable_labels(labels: DataFrame, label: str = "label") -> DataFrame:
    """Labels as canaries take them: trimmed, 1 to 128 bytes."""
    return labels.select(F.trim(label).alias("label")).filter(F.octet_length("label").between(1, MAX_LABEL))


def make_canaries(labels: DataFrame, created_at: int, label: str = "label", prefix: str = TOKEN_PREFIX) -> DataFrame:
    """A new canary for each usable label: a prefix, a tag of the label, and a random part.

    The random part is drawn anew whenever the rows are read, so write the table before using it.
    """
    fresh = usable_labels(labels, label).withColumn("_digits", F.md5(F.concat(F.uuid(), F.uuid()).cast("binary")))
    token = F.concat(F.lit(prefix), F.left(F.sha2("label", 256), F.lit(8)), _drawn(F.col("_digits")))
    zero = F.lit(0).cast("bigint")
    return fresh.select(
        F.left(F.sha2("_digits", 256), F.lit(16)).alias("id"), "label", token.alias("token"), F.lit(created_at).cast("bigint").alias("created_at"),
        zero.alias("last_triggered"), zero.alias("trigger_count"))


def canary_patterns(canaries: DataFrame, most: int, prefix: str = TOKEN_PREFIX) -> tuple[Pattern, ...]:
    """One pattern per canary that matches its token and nothing else.

    Patterns are rules, so they come to the driver; a table of more than ``most`` is refused.
    """
    rows = canaries.orderBy("created_at", "label", "token").limit(most + 1).collect()
    if len(rows) > most:
        raise RuleError(f"more than {most} canaries")
    return tuple(Pattern(NAME_PREFIX + r["label"], quote(r["token"]), prefix, "critical", 100, category="canary") for r in rows)


def canary_matches(records: DataFrame, canaries: DataFrame, record_id: str = "record_id", content: str = "content",
                   prefix: str = TOKEN_PREFIX) -> DataFrame:
    """Canaries (``record_id``, label, token, occurrences) whose tokens stand in the normalised text of a record.

    Every token has one shape, so one constant expression cuts all that may be
    tokens from a text, and these are joined to the table: canaries may be as
    many as they like and never come to the driver. A token that several rows
    have belongs to the least label. Missing texts and tokens match nothing.
    """
    # a look-ahead, since a token may begin inside what only looks like one
    shape = f"(?=({quote(prefix)}[0-9a-f]{{8}}[A-Z2-7]{{{RANDOM_LETTERS}}}))"
    texts = normalize_content(records.select(record_id, content), content, "_canonical")
    cut = texts.select(record_id, F.explode(F.regexp_extract_all("_canonical", F.lit(shape), F.lit(1))).alias("token"))
    counted = cut.groupBy(record_id, "token").agg(F.count("*").alias("occurrences"))
    known = canaries.groupBy("token").agg(F.min("label").alias("label"))
    return lookup(counted, known, ["token"], "inner").select(record_id, "label", "token", "occurrences")


def canary_triggers(canaries: DataFrame, verdicts: DataFrame, ts: str = "ts") -> DataFrame:
    """Canaries with the verdicts they won added to their counts."""
    won = verdicts.filter(F.col("blocked") & F.col("pattern_name").startswith(NAME_PREFIX))
    label = F.expr(f"substr(pattern_name, {len(NAME_PREFIX) + 1})")
    counts = won.groupBy(label.alias("label")).agg(F.count("*").alias("_n"), F.max(ts).cast("bigint").alias("_at"))
    joined = canaries.join(counts, "label", "left")
    return joined.withColumns({
        "trigger_count": F.col("trigger_count") + F.coalesce("_n", F.lit(0)),
        "last_triggered": F.greatest("last_triggered", F.coalesce("_at", F.lit(0))),
    }).select(*canaries.columns)
