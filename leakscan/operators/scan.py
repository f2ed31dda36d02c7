"""Scans: records in, one verdict per record out, in one narrow stage."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from leakscan.functions.context import source_columns, source_struct
from leakscan.operators.bind import bind_fields, expression
from leakscan.operators.match import MatchOptions, find_matches
from leakscan.operators.normalize import normalize_content
from leakscan.operators.score import ScoreConfig, add_signals, best_verdict, pattern_results
from leakscan.sources.rules import RuleSet

# Fixed value: larger records are not scanned by clients.
MAX_RECORD_BYTES = 1 << 20

VERDICT = ("blocked", "pattern_name", "score")


def _with_source(records: DataFrame, source: str | None) -> tuple[DataFrame, Column | None]:
    """Records with the context spread over columns, and the struct made of them."""
    if source is None:
        return records, None
    fields = records.schema[source].dataType.names
    return records.withColumns(source_columns(F.col(source), fields)), source_struct()


def _with_verdict(scored: DataFrame, columns: list[str], *extra: Column) -> DataFrame:
    kept = [c for c in columns if c not in VERDICT]
    return scored.select(*kept, *extra, *[F.col("_v_" + c).alias(c) for c in VERDICT])


def signals_of(records: DataFrame, rules: RuleSet, options: MatchOptions = MatchOptions(), content: str = "content",
               canonical: str | None = None, keep_values: bool = False) -> DataFrame:
    """Records with ``signals``; pass ``canonical`` when the text is normalised already."""
    text = canonical or "_canonical"
    normal = records if canonical else normalize_content(records, content, text)
    found = add_signals(find_matches(normal, rules, options, text), rules, text, keep_values).drop("hits")
    return found if canonical else found.drop(text)


def scan(records: DataFrame, rules: RuleSet, config: ScoreConfig = ScoreConfig(), options: MatchOptions = MatchOptions(),
         content: str = "content", source: str | None = None, canonical: str | None = None) -> DataFrame:
    """Adds blocked, pattern_name and score to every record; no shuffle."""
    prepared, context = _with_source(records, source)
    found = signals_of(prepared, rules, options, content, canonical)
    verdict = expression(None, ("verdict", config, source is not None), lambda: best_verdict(
        pattern_results(F.col("signals"), config.struct(), context), "_v_"))
    return _with_verdict(bind_fields(found, verdict), records.columns)


def explain_scan(records: DataFrame, rules: RuleSet, config: ScoreConfig = ScoreConfig(),
                 options: MatchOptions = MatchOptions(), content: str = "content", source: str | None = None,
                 canonical: str | None = None, keep: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """One row per record and pattern with a surviving match, with the parts of its score; never the value."""
    prepared, context = _with_source(records, source)
    found = signals_of(prepared, rules, options, content, canonical)
    rows = found.select(*keep, F.inline(pattern_results(F.col("signals"), config.struct(), context)))
    return rows.drop("ordinal")


def match_evidence(records: DataFrame, rules: RuleSet, options: MatchOptions = MatchOptions(), content: str = "content",
                   canonical: str | None = None, keep: tuple[str, ...] = ("record_id",),
                   keep_values: bool = False) -> DataFrame:
    """One row per match with the evidence gathered for it."""
    found = signals_of(records, rules, options, content, canonical, keep_values)
    per_pattern = found.select(*keep, F.inline("signals")).withColumn("pattern_name", F.col("rule.name"))
    return per_pattern.select(*keep, "pattern_name", "num_matches", F.inline("matches"))


def compare_configs(records: DataFrame, rules: RuleSet, configs: Mapping[str, ScoreConfig],
                    options: MatchOptions = MatchOptions(), content: str = "content",
                    source: str | None = None) -> DataFrame:
    """Verdicts of the same records under several weights and thresholds; the text is matched once."""
    prepared, context = _with_source(records, source)
    found = signals_of(prepared, rules, options, content)
    table = F.array(*[c.struct(config=F.lit(name)) for name, c in configs.items()])
    each = found.select("*", F.explode(table).alias("_config")).withColumn("config", F.col("_config.config"))
    scored = bind_fields(each, best_verdict(pattern_results(F.col("signals"), F.col("_config"), context), "_v_"))
    return _with_verdict(scored, records.columns, F.col("config"))


def compare_context(records: DataFrame, rules: RuleSet, source: str, config: ScoreConfig = ScoreConfig(),
                    options: MatchOptions = MatchOptions(), content: str = "content") -> DataFrame:
    """Verdicts without and with the source context (``baseline_*`` and ``context_*`` columns); matched once."""
    prepared, biased = _with_source(records, source)
    found = signals_of(prepared, rules, options, content)
    plain = bind_fields(found, best_verdict(pattern_results(F.col("signals"), config.struct()), "baseline_"))
    scored = bind_fields(plain, best_verdict(pattern_results(F.col("signals"), config.struct(), biased), "context_"))
    return scored.select(*records.columns, *[f"{mode}_{c}" for mode in ("baseline", "context") for c in VERDICT])


def size_gate(records: DataFrame, content: str = "content", limit: int = MAX_RECORD_BYTES) -> DataFrame:
    """Adds ``skipped``: empty and oversized records are passed on unscanned."""
    length = F.octet_length(F.coalesce(F.col(content), F.lit("")))
    return records.withColumn("skipped", (length < 1) | (length > limit))
