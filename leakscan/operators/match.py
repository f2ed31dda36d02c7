"""Candidates and matches of a rule set in canonical text.

All offsets are byte offsets. Nothing here shuffles: each record carries its
matches as an array until a caller explodes them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from leakscan.functions.arrays import chunks, let, pack_span, prefix_sums, span_end, span_start
from leakscan.functions.regex import required_literal, to_java
from leakscan.functions.text import byte_slice, fold_case
from leakscan.operators.bind import bind, expression
from leakscan.sources.rules import RuleSet

# Half-width of the regex window and the size that counts as large content.
REGEX_WINDOW = 1024
LARGE_CONTENT = 50 * 1024

FEW_PREFIXES = 32  # so many literals are found faster one by one than together


@dataclass(frozen=True)
class MatchOptions:
    """How candidates become matches.

    By default every pattern sees the whole of every text. ``windowed``: above
    2048 bytes a pattern with a literal prefix sees only the 1024 bytes either
    side of each prefix, which can cut a long match short. ``large_filter``: in
    texts of ``large_content`` bytes or more only critical and high patterns run.
    """

    windowed: bool = False
    large_content: int = LARGE_CONTENT
    large_filter: bool = False
    disabled_categories: tuple[str, ...] = ()


def prefix_offsets(lowered: Column, prefix: Column) -> Column:
    """Byte offsets of every non-overlapping occurrence of a lower-cased literal."""
    pattern = F.concat(F.lit(r"\Q"), F.replace(prefix, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))

    def offsets(gaps: Column) -> Column:
        heads = F.slice(gaps, F.lit(1), F.size(gaps) - 1)
        width = F.octet_length(prefix).cast("bigint")
        ends = prefix_sums(F.transform(heads, lambda g: F.octet_length(g).cast("bigint") + width))
        return F.transform(ends, lambda e: e - width)

    return let(F.split(lowered, pattern, F.lit(-1)), offsets)


def regex_spans(text: Column, regex: Column, base: Column) -> Column:
    """Packed byte spans of every match of ``regex``, shifted by ``base``.

    Splitting at the matches gives the text between them, so the spans are
    running totals of the lengths of both.
    """
    none = F.array().cast("array<bigint>")

    def spans(values: Column) -> Column:
        def from_gaps(gaps: Column) -> Column:
            steps = F.transform(values, lambda v, i: (F.octet_length(F.get(gaps, i)) + F.octet_length(v)).cast("bigint"))
            return let(
                prefix_sums(steps),
                lambda ends: F.transform(
                    values,
                    lambda v, i: pack_span(base + F.get(ends, i) - F.octet_length(v), base + F.get(ends, i)),
                ),
            )

        return F.when(F.size(values) == 0, none).otherwise(let(F.split(text, regex, F.lit(-1)), from_gaps))

    return let(F.regexp_extract_all(text, regex, F.lit(0)), spans)


def _char_start(data: Column, at: Column) -> Column:
    """The first character boundary at or after byte ``at``."""

    rest = F.regexp_extract(F.hex(F.substring(data, at + 1, F.lit(3))), "^(?:[89AB][0-9A-F])*", 0)
    return at + (F.length(rest) / 2).cast("bigint")


def rule_spans(text: Column, data: Column, lowered: Column, size: Column, rule: Column, windowed: bool) -> Column:
    """Spans of one rule in the whole text, or in the window around each prefix of a long one.

    A span seen from two windows counts once.
    """
    if not windowed:
        return regex_spans(text, rule["regex"], F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")

    def window(offset: Column) -> Column:
        start = F.greatest(offset - REGEX_WINDOW, zero)
        return pack_span(_char_start(data, start), F.least(offset + REGEX_WINDOW, size))

    def inside(w: Column) -> Column:
        # a character cut at the end is dropped, so that lengths stay true
        cut = F.regexp_replace(byte_slice(data, span_start(w), span_end(w)), "\uFFFD{1,3}$", "")
        piece = F.when((span_start(w) == 0) & (span_end(w) == size), text).otherwise(cut)
        return let(piece, lambda t: regex_spans(t, rule["regex"], span_start(w)))

    def distinct(block: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(block, inside)))

    many = (rule["prefix"] != "") & (size > 2 * REGEX_WINDOW)
    windows = F.when(many, F.transform(prefix_offsets(lowered, rule["prefix"]), window)).otherwise(F.array(pack_span(zero, size)))
    return F.array_distinct(F.flatten(F.transform(chunks(windows), distinct)))


def _any_of(words: list[str]) -> str:
    """A regex for the longest of some words that begins at a place, branching letter by letter."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    branches = [(c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}") + _any_of(rest) for c, rest in sorted(heads.items())]
    if not branches:
        return ""
    return f"(?:{'|'.join(branches)})" + ("?" if "" in words else "")


def present_prefixes(lowered: Column, prefixes: dict[int, str], few: int = FEW_PREFIXES) -> Column:
    """Ordinals, in order, of the lower-cased literals (none empty) that a text holds.

    A few are looked for one by one. Of more, one pass finds the longest at every
    place; the shorter ones that stand at a place are just those it begins with.
    """
    words = sorted(set(prefixes.values()))
    if len(words) <= few:
        table = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(p).alias("prefix")) for i, p in sorted(prefixes.items())])
        present = F.filter(table, lambda r: F.contains(lowered, r["prefix"]))
        return F.transform(present, lambda r: r["ordinal"])
    longest = F.create_map(*[x for w in words for x in (
        F.lit(w), F.array(*[F.lit(i) for i, p in sorted(prefixes.items()) if w.startswith(p)]))])
    found = F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"(?=({_any_of(words)}))"), F.lit(1)))
    ordinals = F.array_distinct(F.flatten(F.transform(found, lambda w: F.element_at(longest, w))))
    return F.coalesce(F.array_sort(ordinals), F.array().cast("array<int>"))


def candidate_ordinals(text: Column, lowered: Column, size: Column, rules: RuleSet, options: MatchOptions) -> Column:
    """Ordinals of the patterns worth running: literal prefix present, or no prefix and a likely match.

    Prefixes are data, so the plan does not grow with them; regexes without a
    prefix stay constants, which Spark compiles once per task.
    """
    allowed = [(i, p) for i, p in enumerate(rules.patterns) if p.category not in options.disabled_categories]
    if not allowed:
        return F.array().cast("array<int>")
    small_only = F.lit(False)
    if options.large_filter:
        limit = options.large_content if options.large_content > 0 else LARGE_CONTENT
        small_only = size >= limit

    def always(p) -> Column:
        return F.lit(p.severity in ("critical", "high")) | ~small_only

    parts = []
    prefixed = [(i, p) for i, p in allowed if p.prefix]
    if prefixed:
        present = present_prefixes(lowered, {i: p.prefix.lower() for i, p in prefixed})
        if options.large_filter:
            kept = [i for i, p in prefixed if p.severity in ("critical", "high")]
            present = F.filter(present, lambda o: o.isin(*kept) | ~small_only)
        parts.append(present)

    def may_match(p) -> Column:
        literal = required_literal(p.regex)
        gate = F.contains(text, F.lit(literal)) if literal else F.lit(True)
        return always(p) & gate & text.rlike(to_java(p.regex, loose=True))

    bare = [F.when(may_match(p), F.lit(i)) for i, p in allowed if not p.prefix]
    if bare:
        parts.append(F.array_compact(F.array(*bare)))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def find_matches(canonical: DataFrame, rules: RuleSet, options: MatchOptions = MatchOptions(),
                 text: str = "canonical") -> DataFrame:
    """Adds ``hits``: per pattern with a match its ordinal and packed spans."""
    col = F.col(text)
    prepared = bind(canonical, _lower=F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(fold_case(col)),
                    _size=F.octet_length(col).cast("bigint"))
    ordinals = expression(rules, ("ordinals", text, options), lambda: candidate_ordinals(col, F.col("_lower"), F.col("_size"), rules, options))
    gated = bind(prepared, _ordinals=ordinals)

    def hit(data: Column, ordinal: Column) -> Column:
        def spans(rule: Column) -> Column:
            return rule_spans(col, data, F.col("_lower"), F.col("_size"), rule, options.windowed)

        return F.struct(
            ordinal.alias("ordinal"),
            let(rules.literal(), lambda all_rules: let(F.get(all_rules, ordinal), spans)).alias("spans"),
        )

    # the bytes are taken once per record, not once per window
    found = expression(rules, ("hits", text, options.windowed), lambda: let(
        col.cast("binary"), lambda data: F.transform(F.col("_ordinals"), lambda o: hit(data, o))))
    return bind(gated, hits=F.filter(found, lambda h: F.size(h["spans"]) > 0)).drop("_lower", "_size", "_ordinals")


def prefix_candidates(canonical: DataFrame, rules: RuleSet, record_id: str = "record_id",
                      text: str = "canonical") -> DataFrame:
    """One row per record, pattern and prefix occurrence; a pattern without prefix gives one row at 0."""
    col = F.col(text)
    table = F.array(*[
        F.struct(F.lit(p.name).alias("pattern_name"), F.lit(p.prefix.lower()).alias("prefix")) for p in rules.patterns
    ])
    lowered = bind(canonical.select(record_id, text), _lower=fold_case(col))
    prefixes = {i: p.prefix.lower() for i, p in enumerate(rules.patterns) if p.prefix}
    bare = F.array(*[F.lit(i) for i in range(len(rules.patterns)) if i not in prefixes]).cast("array<int>")
    ordinals = F.concat(present_prefixes(F.col("_lower"), prefixes), bare) if prefixes else bare
    present = let(table, lambda every: F.transform(ordinals, lambda o: F.get(every, o)))
    rows = lowered.select(record_id, "_lower", F.inline(present))
    offsets = F.when(F.col("prefix") == "", F.array(F.lit(0).cast("bigint"))).otherwise(
        prefix_offsets(F.col("_lower"), F.col("prefix"))
    )
    return rows.select(record_id, "pattern_name", F.explode(offsets).alias("offset"))
