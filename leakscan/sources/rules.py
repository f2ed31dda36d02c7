"""Rule tables: patterns, exclusions, domain lists.

A rule table is a DataFrame while it is loaded and merged. It is small by
nature, so the scanner takes it as a :class:`RuleSet` on the driver, checked
and translated once, and ships it inside the plan as one literal.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from leakscan.functions.regex import RuleError, to_java

UNCATEGORIZED = "uncategorized"
MAX_RULES = 20_000

PATTERN_FIELDS = (
    "name string, regex string, prefix string, severity string, score_weight int, min_matches int, "
    "hotwords array<string>, hotword_window int, hotword_boost int, require_hotword boolean, "
    "entropy_min double, disabled boolean, category string, context_bias map<string,int>"
)
EXCLUSION_FIELDS = (
    "applies_to string, type string, words array<string>, pattern string, window int, "
    "match_type string, suppress boolean"
)


@dataclass(frozen=True)
class Pattern:
    name: str
    regex: str
    prefix: str = ""
    severity: str = "medium"
    score_weight: int = 1
    min_matches: int = 0
    hotwords: tuple[str, ...] = ()
    hotword_window: int = 0
    hotword_boost: int = 0
    require_hotword: bool = False
    entropy_min: float = 0.0
    category: str = UNCATEGORIZED
    context_bias: dict[str, int] | None = field(default=None, hash=False)


@dataclass(frozen=True)
class Exclusion:
    applies_to: str = "*"
    type: str = "dictionary"
    words: tuple[str, ...] = ()
    pattern: str = ""
    window: int = 0
    match_type: str = ""
    suppress: bool = False

    def applies(self, name: str) -> bool:
        return self.applies_to in ("", "*") or self.applies_to.lower() == name.lower()


# What a pattern looks like inside the plan.
_RULE_LITERAL = (
    "array<struct<name string, regex string, prefix string, severity string, weight int, min_matches int, "
    "hotwords array<string>, hotword_window int, hotword_boost int, require_hotword boolean, entropy_min double, "
    "category string, context_bias map<string,int>, exact array<string>, "
    "nearby array<struct<window int, words array<string>>>, regexes array<struct<regex string, suppress boolean>>>>"
)


@dataclass(frozen=True)
class RuleSet:
    patterns: tuple[Pattern, ...]
    exclusions: tuple[Exclusion, ...] = ()

    def __post_init__(self) -> None:
        if len(self.patterns) + len(self.exclusions) > MAX_RULES:
            raise RuleError(f"more than {MAX_RULES} rules")
        for p in self.patterns:
            to_java(p.regex)
        for x in self.exclusions:
            if x.type == "regex":
                to_java(x.pattern)

    def with_patterns(self, extra: Iterable[Pattern]) -> RuleSet:
        return replace(self, patterns=self.patterns + tuple(extra))

    def literal(self) -> Column:
        """All patterns, each with the exclusions that apply to it, as one constant."""
        return F.from_json(F.lit(json.dumps([self._row(p) for p in self.patterns])), _RULE_LITERAL)

    def _row(self, p: Pattern) -> dict:
        mine = [x for x in self.exclusions if x.applies(p.name)]
        words = [(x, [w for w in (w.strip().lower() for w in x.words) if w]) for x in mine if x.type == "dictionary"]
        return {
            "name": p.name,
            "regex": to_java(p.regex),
            "prefix": p.prefix.lower(),
            "severity": p.severity,
            "weight": p.score_weight if p.score_weight > 0 else 1,
            "min_matches": p.min_matches,
            "hotwords": [w for w in (w.strip().lower() for w in p.hotwords) if w],
            "hotword_window": p.hotword_window,
            "hotword_boost": p.hotword_boost,
            "require_hotword": p.require_hotword,
            "entropy_min": p.entropy_min,
            "category": p.category or UNCATEGORIZED,
            "context_bias": p.context_bias or {},
            "exact": sorted({w for x, ws in words if x.match_type == "exact" for w in ws}),
            "nearby": [
                {"window": x.window if x.window > 0 else 50, "words": ws}
                for x, ws in words
                if x.match_type in ("", "proximity") and ws
            ],
            "regexes": [{"regex": to_java(x.pattern), "suppress": x.suppress} for x in mine if x.type == "regex"],
        }


def check_rules(spark: SparkSession, rules: RuleSet) -> RuleSet:
    """Compile every regex in one small Spark job and refuse any that matches the empty string.

    An empty match has no position a record could be cut at, and such a rule
    would flag every text.
    """
    regexes = [to_java(p.regex) for p in rules.patterns]
    regexes += [to_java(x.pattern) for x in rules.exclusions if x.type == "regex"]
    probes = [F.exists(F.regexp_extract_all(F.lit("a b"), F.lit(r), F.lit(0)), lambda m: m == "") for r in regexes]
    if probes:
        row = spark.range(1).select(F.array(*probes).alias("empty")).first()
        bad = [p.name for p, empty in zip(rules.patterns, row["empty"]) if empty]
        if bad:
            raise RuleError(f"patterns that match the empty string: {bad}")
    return rules


def parse_patterns(rows: DataFrame) -> DataFrame:
    """Pattern rows as loaded: nulls and disabled dropped, defaults filled in. Needs ``ordinal``."""
    return (
        rows.filter(F.col("name").isNotNull() | F.col("regex").isNotNull())
        .filter(~F.coalesce(F.col("disabled"), F.lit(False)))
        .withColumn("category", F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(UNCATEGORIZED)))
    )


def rejected_patterns(rows: DataFrame) -> DataFrame:
    """Active patterns whose regex is empty; one such row fails a load."""
    return parse_patterns(rows).filter(F.coalesce(F.col("regex"), F.lit("")) == "")


def rejected_exclusions(rows: DataFrame) -> DataFrame:
    """Regex exclusions without a pattern; one such row fails a load."""
    return rows.filter((F.col("type") == "regex") & (F.coalesce(F.col("pattern"), F.lit("")) == ""))


def list_categories(patterns: DataFrame) -> DataFrame:
    """Categories of a pattern table, in order."""
    return patterns.select(F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(UNCATEGORIZED)).alias("category")).distinct().orderBy("category")


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(f"patterns array<struct<{_as_struct(PATTERN_FIELDS)}>>").option("multiLine", True).json(path)
    return parse_patterns(doc.select(F.posexplode("patterns").alias("ordinal", "p")).select("ordinal", "p.*"))


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(f"exclusions array<struct<{_as_struct(EXCLUSION_FIELDS)}>>").option("multiLine", True).json(path)
    return doc.select(F.posexplode("exclusions").alias("ordinal", "x")).select("ordinal", "x.*")


def _as_struct(fields: str) -> str:
    return ", ".join(part.strip().replace(" ", ":", 1) for part in fields.split(", "))


def merge_patterns(base: DataFrame, override: DataFrame) -> DataFrame:
    """An override takes the place of the base pattern of its name; new names follow the base."""
    return _merge(base, override, [F.col("name")])


def merge_exclusions(base: DataFrame, override: DataFrame) -> DataFrame:
    """As :func:`merge_patterns`; an exclusion is known by its type, target, pattern and words."""
    blank = F.lit("")
    key = [
        F.coalesce(F.col("type"), blank),
        F.coalesce(F.col("applies_to"), blank),
        F.coalesce(F.col("pattern"), blank),
        F.concat_ws("\0", F.coalesce(F.col("words"), F.array().cast("array<string>"))),
    ]
    return _merge(base, override, key)


def _merge(base: DataFrame, override: DataFrame, key: Sequence[Column]) -> DataFrame:
    """Full outer join on the key.

    A base key that occurs twice is replaced at its last position only; of
    several overrides with one key the last counts, at the place of the first.
    """
    keyed = F.to_json(F.array(*key))
    columns = base.columns
    same = Window.partitionBy("_key")
    over = (
        override.select(keyed.alias("_key"), "*")
        .withColumn("_last", F.row_number().over(same.orderBy(F.desc("ordinal"))))
        .withColumn("_first", F.min("ordinal").over(same))
        .filter("_last = 1")
        .select("_key", "_first", F.struct(*columns).alias("_over"))
    )
    under = (
        base.select(keyed.alias("_key"), "*")
        .withColumn("_last", F.row_number().over(same.orderBy(F.desc("ordinal"))))
        .select("_key", F.col("ordinal").alias("_place"), F.struct(*columns).alias("_base"),
                F.when(F.col("_last") == 1, F.col("_key")).alias("_target"))
    )
    joined = under.join(over, under["_target"] == over["_key"], "full_outer")
    chosen = F.coalesce(F.col("_over"), F.col("_base"))
    place = F.coalesce(F.col("_place").cast("bigint"), F.lit(1_000_000_000) + F.col("_first"))
    return joined.select(chosen.alias("_row"), place.alias("_place")).select(
        *[F.col(f"_row.{c}").alias(c) for c in columns if c != "ordinal"], F.col("_place").alias("ordinal")
    )


def rule_set(spark: SparkSession, patterns: DataFrame, exclusions: DataFrame | None = None) -> RuleSet:
    """Bring loaded rule tables to the driver; refuses tables that are not small."""

    def rows(df: DataFrame) -> list[dict]:
        found = df.orderBy("ordinal").limit(MAX_RULES + 1).collect()
        if len(found) > MAX_RULES:
            raise RuleError(f"more than {MAX_RULES} rules")
        return [r.asDict() for r in found]

    def build(kind, row: dict):
        given = {k: v for k, v in row.items() if v is not None and k in kind.__dataclass_fields__}
        for k in ("hotwords", "words"):
            if k in given:
                given[k] = tuple(given[k])
        return kind(**given)

    pattern_rows = rows(patterns)
    empty = [r["name"] for r in pattern_rows if not r.get("regex")]
    if empty:
        raise RuleError(f"patterns with an empty regex: {empty}")
    return check_rules(spark, RuleSet(
        tuple(build(Pattern, {"prefix": "", **r}) for r in pattern_rows),
        tuple(build(Exclusion, r) for r in rows(exclusions)) if exclusions is not None else (),
    ))


def load_rules(spark: SparkSession, patterns: str, exclusions: str | None = None,
               pattern_override: str | None = None, exclusion_override: str | None = None) -> RuleSet:
    p = read_patterns(spark, patterns)
    if pattern_override:
        p = merge_patterns(p, read_patterns(spark, pattern_override))
    x = read_exclusions(spark, exclusions) if exclusions else None
    if x is not None and exclusion_override:
        x = merge_exclusions(x, read_exclusions(spark, exclusion_override))
    return rule_set(spark, p, x)


def category_from_path(path: Column) -> Column:
    """``rules/ai_chat_dlp.txt`` names the category ``AI Chat DLP``."""
    base = F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"\.[^.]*$", "")
    words = F.filter(F.split(base, "[_-]"), lambda w: w != "")
    titled = F.transform(
        words,
        lambda w: F.when(F.lower(w).isin("ai", "dlp"), F.upper(w)).otherwise(
            F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))
        ),
    )
    return F.array_join(titled, " ")


def parse_domain_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Domain entries of a list: comments and blank lines dropped, lower-cased."""
    blanks = F.lit(" \t\n\x0b\x0c\r\x85\xa0")
    bare = F.trim(F.regexp_replace(F.col(line), r"(?s)#.*", ""), blanks)
    return lines.withColumn("entry", F.lower(bare)).filter(F.col("entry") != "")


def read_domain_lists(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Domain table (category, entry, source_ordinal) of list files, first file first."""
    if not paths:
        raise RuleError("no domain list given")
    parts = [
        spark.read.text(p).select(
            category_from_path(F.col("_metadata.file_path")).alias("category"), "value", F.lit(i).alias("source_ordinal")
        )
        for i, p in enumerate(paths)
    ]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return parse_domain_lines(lines).select("category", "entry", "source_ordinal")
