"""The scan in plain SQL, for checking the Spark form on another engine.

It shares nothing with the operators but the rule values. Offsets are counted
on a view of the text in which every character is followed by as many filler
characters as it has further UTF-8 bytes, so that positions are byte offsets.
"""

from __future__ import annotations

from dataclasses import dataclass

from leakscan.functions.normalize import HOMOGLYPHS, ZERO_WIDTH
from leakscan.functions.text import PLACEHOLDER_MARKERS, PUBLIC_EXAMPLES
from leakscan.operators.score import ScoreConfig
from leakscan.plans.tables import sql_text
from leakscan.sources.rules import Pattern, RuleSet


def _class(chars: str) -> str:
    return "'[" + "".join(f"\\x{{{ord(c):X}}}" for c in chars) + "]'"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, {_class(ZERO_WIDTH)}, '', 'g')"


def fold_sql(text: str) -> str:
    src, dst = "".join(a for a, _ in HOMOGLYPHS), "".join(b for _, b in HOMOGLYPHS)
    return f"translate({text}, {sql_text(src)}, '{dst}')"


def base64_sql(text: str) -> str:
    """Decoded printable runs, newline-joined, '' when there is none."""
    runs = f"list_filter(regexp_extract_all({text}, '[A-Za-z0-9+/=]{{16,}}'), lambda r: length(r) % 4 = 0)"
    blobs = f"list_filter(list_transform({runs}, lambda r: try(from_base64(r))), lambda b: b IS NOT NULL)"
    printable = "len(list_filter(regexp_extract_all(hex(b), '..'), lambda h: h BETWEEN '20' AND '7E'))"
    kept = f"list_filter({blobs}, lambda b: octet_length(b) > 0 AND {printable} / octet_length(b) >= 0.8)"
    return f"coalesce(array_to_string(list_transform({kept}, lambda b: try(decode(b))), chr(10)), '')"


def append_base64_sql(text: str) -> str:
    return f"(CASE WHEN {base64_sql(text)} = '' THEN {text} ELSE {text} || chr(10) || {base64_sql(text)} END)"


def byte_view_sql(text: str) -> str:
    two = f"regexp_replace({text}, '([\\x{{80}}-\\x{{7FF}}])', '\\1' || chr(1), 'g')"
    three = f"regexp_replace({two}, '([\\x{{800}}-\\x{{FFFF}}])', '\\1' || chr(1) || chr(1), 'g')"
    return f"regexp_replace({three}, '([\\x{{10000}}-\\x{{10FFFF}}])', '\\1' || chr(1) || chr(1) || chr(1), 'g')"


def normalize_value_sql(value: str) -> str:
    return (f"translate(regexp_replace({value}, '[ \\t\\n\\r_-]', '', 'g'), "
            "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


def public_example_sql(value: str) -> str:
    digests = ", ".join(f"'{d}'" for d in PUBLIC_EXAMPLES)
    return f"({value} <> '' AND sha256({normalize_value_sql(value)}) IN ({digests}))"


def placeholder_sql(value: str) -> str:
    markers = " OR ".join(f"contains(lower({value}), '{m}')" for m in PLACEHOLDER_MARKERS)
    bare = f"regexp_replace({value}, '[ \\t._-]', '', 'g')"
    return f"""(strlen({value}) >= 4 AND (
      (strlen({value}) >= 5 AND regexp_full_match({value}, '<[A-Za-z0-9_. -]*[A-Za-z][A-Za-z0-9_. -]*>'))
      OR (starts_with({value}, '{{{{') AND ends_with({value}, '}}}}'))
      OR (starts_with({value}, '${{') AND ends_with({value}, '}}'))
      OR {markers}
      OR (length({bare}) >= 6 AND replace({bare}, left({bare}, 1), '') = ''
          AND regexp_matches(left({bare}, 1), '[xXoO*#\\x{{25CF}}\\x{{2022}}\\x{{22C6}}\\x{{2042}}\\p{{P}}\\p{{S}}\\p{{Cc}}]'))))"""


def entropy_sql(value: str) -> str:
    share = f"((length({value}) - length(replace({value}, c, ''))) / length({value}))"
    terms = f"list_transform(list_sort(list_distinct(string_split({value}, ''))), lambda c: -({share} * log2({share})))"
    return f"(CASE WHEN {value} = '' THEN 0.0 ELSE list_reduce({terms}, lambda a, b: a + b) END)"


@dataclass(frozen=True)
class ScanSql:
    """SQL for one scan. ``records`` yields record_id and content, plus any columns in ``keep``."""

    records: str
    rules: RuleSet
    config: ScoreConfig = ScoreConfig()
    windowed: bool = False
    large: int = 0
    disabled: tuple[str, ...] = ()
    normalized: bool = False
    bias: str = "0"
    allowed: str = "false"
    drop_short_groups: bool = True

    def canonical(self) -> str:
        if self.normalized:
            return "content"
        return append_base64_sql("folded")

    def ctes(self) -> str:
        folded = "content" if self.normalized else fold_sql(strip_sql("content"))
        parts = [
            f"rec AS MATERIALIZED ({self.records})",
            f"folded AS (SELECT record_id, {folded} AS folded{', content' if self.normalized else ''} FROM rec)",
            f"canon AS MATERIALIZED (SELECT record_id, {self.canonical()} AS canonical FROM folded)",
            f"bytes AS MATERIALIZED (SELECT record_id, v, lower(v) AS lv, length(v) AS n FROM "
            f"(SELECT record_id, {byte_view_sql('canonical')} AS v FROM canon))",
        ]
        kept = [(i, p) for i, p in enumerate(self.rules.patterns) if p.category not in self.disabled]
        for i, p in kept:
            parts += self._pattern(i, p)
        parts.append("evid AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM p{i}" for i, _ in kept) + ")")
        live = f"NOT (public_example OR placeholder OR suppressed OR ({self.allowed}))"
        c = self.config
        parts.append(f"""scored AS (SELECT *, CAST(weight
          + CASE WHEN hotword THEN CASE WHEN hotword_boost = 0 THEN {c.hotword_boost} ELSE hotword_boost END ELSE 0 END
          + CASE WHEN entropy_min > 0 THEN CASE WHEN entropy >= entropy_min THEN {c.entropy_boost} ELSE {c.entropy_penalty} END ELSE 0 END
          + {c.multi_match_boost} * least(num_matches - 1, 5)
          + CASE WHEN excluded THEN {c.exclusion_penalty} ELSE 0 END AS INTEGER) AS match_score
          FROM evid WHERE {live})""")
        parts.append(f"""pat AS (SELECT record_id, pattern_name, severity, num_matches, count(*) AS num_surviving,
          bool_or(hotword) AS hotword, max(match_score) AS top_score, any_value(require_hotword) AS require_hotword,
          any_value(context_bias) AS context_bias,
          CASE severity WHEN 'critical' THEN {c.threshold_critical} WHEN 'high' THEN {c.threshold_high}
            WHEN 'medium' THEN {c.threshold_medium} ELSE {c.threshold_low} END AS threshold
          FROM scored GROUP BY record_id, pattern_name, severity, num_matches)""")
        parts.append(f"""biased AS (SELECT pat.*, CAST({self.bias} AS INTEGER) AS bias, top_score + CAST({self.bias} AS INTEGER) AS score
          FROM pat JOIN rec USING (record_id))""")
        parts.append("""judged AS (SELECT *, (NOT require_hotword OR hotword) AND score >= threshold AS blocked FROM biased)""")
        parts.append("""best AS (SELECT record_id, pattern_name, score FROM judged WHERE blocked
          QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY score DESC, pattern_name) = 1)""")
        parts.append("""verdict AS (SELECT record_id, best.record_id IS NOT NULL AS blocked, coalesce(pattern_name, '') AS pattern_name,
          coalesce(score, 0) AS score FROM rec LEFT JOIN best USING (record_id))""")
        return "WITH " + ",\n".join(parts)

    def select(self, query: str) -> str:
        return self.ctes() + "\n" + query

    def _pattern(self, i: int, p: Pattern) -> list[str]:
        regex = sql_text(p.regex)
        gate = "true"
        if p.severity not in ("critical", "high") and self.large:
            gate = f"n < {self.large}"
        if not p.prefix or not self.windowed:
            where = f"{gate} AND contains(lv, {sql_text(p.prefix.lower())})" if p.prefix else gate
            windows = f"SELECT record_id, 0 AS base, v AS w FROM bytes WHERE {where}"
        else:
            prefix, width = sql_text(p.prefix.lower()), len(p.prefix)
            windows = f"""SELECT record_id, 0 AS base, v AS w FROM bytes WHERE {gate} AND n <= 2048 AND contains(lv, {prefix})
              UNION ALL SELECT record_id, b AS base, substr(v, b + 1, least(o + 1024, n) - b) AS w
              FROM (SELECT *, greatest(o - 1024, 0) AS b FROM (SELECT record_id, v, n,
                CAST(list_sum(list_transform(gaps[:k], lambda g: length(g))) AS BIGINT) + (k - 1) * {width} AS o
              FROM (SELECT record_id, v, n, gaps, unnest(generate_series(1, len(gaps) - 1)) AS k
                FROM (SELECT record_id, v, n, string_split(lv, {prefix}) AS gaps FROM bytes
                  WHERE {gate} AND n > 2048 AND contains(lv, {prefix})))))"""
        parts = [
            f"w{i} AS ({windows})",
            f"""s{i} AS (SELECT DISTINCT record_id, CAST(base + e - length(val) AS BIGINT) AS s, CAST(base + e AS BIGINT) AS e FROM (
              SELECT record_id, base, val, sum(length(gap) + length(val)) OVER (PARTITION BY record_id, base ORDER BY k) AS e FROM (
              SELECT record_id, base, unnest(vals) AS val, unnest(gaps[:len(vals)]) AS gap, unnest(generate_series(1, len(vals))) AS k FROM (
              SELECT record_id, base, regexp_extract_all(w, {regex}) AS vals, string_split_regex(w, {regex}) AS gaps FROM w{i}))))""",
        ]
        near = "false"
        regexes, suppress_regexes, exact = [], [], []
        hays = []
        for x in self.rules.exclusions:
            if not x.applies(p.name):
                continue
            words = [w.strip().lower() for w in x.words if w.strip()]
            if x.type == "regex":
                test = f"regexp_matches(value, {sql_text(x.pattern)})"
                regexes.append(test)
                if x.suppress:
                    suppress_regexes.append(test)
            elif x.match_type == "exact":
                exact += [f"lower(value) = {sql_text(w)}" for w in words]
            else:
                win = x.window or 50
                hay = f"lower(substr(v, greatest(s - {win}, 0) + 1, least(e + {win}, n) - greatest(s - {win}, 0)))"
                cut = (f"(left({hay}, CAST(instr({hay}, lower(value)) AS BIGINT) - 1) || "
                       f"substr({hay}, instr({hay}, lower(value)) + length(value)))")
                hays += [f"contains({cut}, {sql_text(w)})" for w in words]
        if hays:
            near = " OR ".join(hays)
        hot = []
        for word in (w.strip().lower() for w in p.hotwords):
            win = p.hotword_window
            hot.append(f"contains(lower(substr(v, greatest(s - {win}, 0) + 1, s - greatest(s - {win}, 0))), {sql_text(word)})")
            hot.append(f"contains(lower(substr(v, e + 1, least(e + {win}, n) - e)), {sql_text(word)})")
        if not hot or p.hotword_window <= 0:
            hot = ["false"]
        bias = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in (p.context_bias or {"": 0}).items()) + "}"
        enough = f"WHERE num_matches >= {p.min_matches}" if self.drop_short_groups else ""
        parts.append(
            f"""p{i} AS (SELECT record_id, {i} AS ordinal, {sql_text(p.name)} AS pattern_name, '{p.severity}' AS severity,
              CAST({p.score_weight} AS INTEGER) AS weight, {p.hotword_boost} AS hotword_boost, {p.require_hotword} AS require_hotword,
              CAST({p.entropy_min} AS DOUBLE) AS entropy_min, {bias} AS context_bias, '{p.category}' AS category,
              s AS start, e AS "end", value, num_matches,
              {public_example_sql('value')} AS public_example, {placeholder_sql('value')} AS placeholder,
              ({' OR '.join(hot)}) AS hotword, {entropy_sql('value')} AS entropy,
              ({' OR '.join(regexes + [near])}) AS excluded, ({' OR '.join(suppress_regexes + exact) or 'false'}) AS suppressed
              FROM (SELECT s{i}.*, v, n, substr(v, s + 1, e - s) AS value, count(*) OVER (PARTITION BY record_id) AS num_matches
                FROM s{i} JOIN bytes USING (record_id)) {enough})"""
        )
        return parts
