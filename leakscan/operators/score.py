"""From matches to one explainable verdict per record."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, functions as F

from leakscan.functions.arrays import let, span_end, span_start
from leakscan.functions.context import source_bias
from leakscan.functions.text import byte_slice, fold_case, is_placeholder_shape, is_public_example, remove_first, shannon_entropy
from leakscan.operators.bind import bind, expression
from leakscan.sources.rules import RuleSet

# Fixed value: extra matches beyond this many add nothing to a score.
MULTI_MATCH_CAP = 5


@dataclass(frozen=True)
class ScoreConfig:
    """Weights and per-severity thresholds; the defaults are fixed values."""

    hotword_boost: int = 2
    entropy_boost: int = 1
    entropy_penalty: int = -2
    exclusion_penalty: int = -3
    multi_match_boost: int = 1
    threshold_critical: int = 1
    threshold_high: int = 2
    threshold_medium: int = 3
    threshold_low: int = 4

    def struct(self, **extra: Column) -> Column:
        known = [F.lit(getattr(self, f.name)).alias(f.name) for f in fields(self)]
        return F.struct(*known, *[c.alias(n) for n, c in extra.items()])


def hotword_present(data: Column, size: Column, start: Column, end: Column, words: Column, window: Column) -> Column:
    """A hotword in the ``window`` bytes before or after the span, each side on its own."""
    before = fold_case(byte_slice(data, F.greatest(start - window, F.lit(0).cast("bigint")), start))
    after = fold_case(byte_slice(data, end, F.least(end + window, size)))

    def either(sides: Column) -> Column:
        return F.exists(words, lambda w: F.contains(sides["b"], w) | F.contains(sides["a"], w))

    return (F.size(words) > 0) & (window > 0) & let(F.struct(before.alias("b"), after.alias("a")), either)


def exclusion_flags(data: Column, size: Column, start: Column, end: Column, value: Column, rule: Column) -> Column:
    """Struct (hit, suppress) over every exclusion that applies to the rule."""
    lowered = fold_case(value)

    def near(x: Column) -> Column:
        hay = fold_case(byte_slice(data, F.greatest(start - x["window"], F.lit(0).cast("bigint")),
                                   F.least(end + x["window"], size)))
        return let(remove_first(hay, lowered), lambda h: F.exists(x["words"], lambda w: F.contains(h, w)))

    fired = F.filter(rule["regexes"], lambda x: F.regexp_like(value, x["regex"]))
    return F.struct(
        ((F.size(fired) > 0) | F.exists(rule["nearby"], near)).alias("hit"),
        (F.array_contains(rule["exact"], lowered) | F.exists(fired, lambda x: x["suppress"])).alias("suppress"),
    )


def score_match(rule: Column, config: Column, hotword: Column, entropy_ok: Column, matches: Column, excluded: Column) -> Column:
    """Integer score of one match; ``entropy_ok`` is NULL for a rule without an entropy floor."""
    boost = F.when(rule["hotword_boost"] == 0, config["hotword_boost"]).otherwise(rule["hotword_boost"])
    return (
        rule["weight"]
        + F.when(hotword, boost).otherwise(0)
        + F.when(entropy_ok.isNull(), 0).when(entropy_ok, config["entropy_boost"]).otherwise(config["entropy_penalty"])
        + config["multi_match_boost"] * F.least(matches - 1, F.lit(MULTI_MATCH_CAP))
        + F.when(excluded, config["exclusion_penalty"]).otherwise(0)
    ).cast("int")


def threshold(config: Column, severity: Column) -> Column:
    level = F.lower(F.trim(severity))
    return (
        F.when(level == "critical", config["threshold_critical"])
        .when(level == "high", config["threshold_high"])
        .when(level == "medium", config["threshold_medium"])
        .otherwise(config["threshold_low"])
    )


def add_signals(matched: DataFrame, rules: RuleSet, text: str = "canonical", keep_values: bool = False) -> DataFrame:
    """Adds ``signals``: per pattern the rule attributes, match count and the evidence of each match.

    Counts are taken before any match is suppressed, and a pattern below its
    ``min_matches`` is dropped here. ``keep_values`` also keeps the matched
    text, for steps that need it (allowlist, redaction) and drop it themselves.
    """
    size = F.octet_length(F.col(text)).cast("bigint")

    def evidence(data: Column, rule: Column, span: Column) -> Column:
        start, end = span_start(span), span_end(span)

        def of_value(value: Column) -> Column:
            public, placeholder = is_public_example(value), is_placeholder_shape(value)

            def of_excluded(x: Column) -> Column:
                entropy = shannon_entropy(value)
                return F.struct(
                    start.alias("start"),
                    end.alias("end"),
                    *([value.alias("value")] if keep_values else []),
                    x["public"].alias("public_example"),
                    x["placeholder"].alias("placeholder"),
                    hotword_present(data, size, start, end, rule["hotwords"], rule["hotword_window"]).alias("hotword"),
                    entropy.alias("entropy"),
                    F.when(rule["entropy_min"] > 0, entropy >= rule["entropy_min"]).alias("entropy_ok"),
                    x["flags"]["hit"].alias("excluded"),
                    x["flags"]["suppress"].alias("suppressed"),
                )

            flags = exclusion_flags(data, size, start, end, value, rule)
            return let(F.struct(public.alias("public"), placeholder.alias("placeholder"), flags.alias("flags")), of_excluded)

        return let(byte_slice(data, start, end), of_value)

    def signal(data: Column, hit: Column) -> Column:
        def for_rule(rule: Column) -> Column:
            return F.struct(
                hit["ordinal"].alias("ordinal"),
                rule.alias("rule"),
                F.size(hit["spans"]).alias("num_matches"),
                F.when(
                    F.size(hit["spans"]) >= rule["min_matches"],
                    F.transform(hit["spans"], lambda s: evidence(data, rule, s)),
                ).alias("matches"),
            )

        return let(rules.literal(), lambda all_rules: let(F.get(all_rules, hit["ordinal"]), for_rule))

    # the bytes are taken once per record, not once per match
    found = expression(rules, ("signals", text, keep_values), lambda: let(
        F.col(text).cast("binary"), lambda data: F.transform(F.col("hits"), lambda h: signal(data, h))))
    return bind(matched, signals=F.filter(found, lambda s: s["matches"].isNotNull()))


def surviving(matches: Column) -> Column:
    return F.filter(matches, lambda m: ~(m["public_example"] | m["placeholder"] | m["suppressed"]))


def pattern_results(signals: Column, config: Column, source: Column | None = None) -> Column:
    """Per pattern with a surviving match: score components and whether it blocks."""

    def result(s: Column) -> Column:
        rule = s["rule"]

        def of_live(live: Column) -> Column:
            def scored(m: Column) -> Column:
                return score_match(rule, config, m["hotword"], m["entropy_ok"], s["num_matches"], m["excluded"])

            bias = source_bias(rule, source) if source is not None else F.lit(0)
            return let(
                F.struct(
                    F.array_max(F.transform(live, scored)).alias("top"),
                    F.exists(live, lambda m: m["hotword"]).alias("hot"),
                    bias.cast("int").alias("bias"),
                ),
                lambda t: F.struct(
                    s["ordinal"].alias("ordinal"),
                    rule["name"].alias("pattern_name"),
                    rule["severity"].alias("severity"),
                    s["num_matches"].alias("num_matches"),
                    F.size(live).alias("num_surviving"),
                    t["hot"].alias("hotword"),
                    t["top"].alias("top_score"),
                    t["bias"].alias("bias"),
                    (t["top"] + t["bias"]).alias("score"),
                    threshold(config, rule["severity"]).alias("threshold"),
                    (
                        (~rule["require_hotword"] | t["hot"])
                        & (t["top"] + t["bias"] >= threshold(config, rule["severity"]))
                    ).alias("blocked"),
                ),
            )

        return let(surviving(s["matches"]), lambda live: F.when(F.size(live) > 0, of_live(live)))

    return F.filter(F.transform(signals, result), lambda r: r.isNotNull())


def best_verdict(results: Column, prefix: str = "") -> Column:
    """Highest score wins, then the smallest name; (false, '', 0) when nothing blocks. Fields take ``prefix``."""
    ranked = F.array_min(
        F.transform(
            F.filter(results, lambda r: r["blocked"]),
            lambda r: F.struct((-r["score"]).alias("neg"), r["pattern_name"].alias("name")),
        )
    )
    return let(
        ranked,
        lambda b: F.struct(
            b.isNotNull().alias(prefix + "blocked"),
            F.coalesce(b["name"], F.lit("")).alias(prefix + "pattern_name"),
            F.coalesce(-b["neg"], F.lit(0)).alias(prefix + "score"),
        ),
    )
