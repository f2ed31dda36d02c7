"""Source contexts, their effect on scores, and the evaluation of scan modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from leakscan.functions import context as ctx
from leakscan.operators import evaluate
from leakscan.operators.scan import compare_context, explain_scan, scan
from leakscan.plans.oracle import ScanSql, byte_view_sql
from leakscan.plans.registry import query
from leakscan.plans.tables import PLANTED_SQL, PLANTS, planted, planted_documents, planted_sql, spread, sql_text, table
from leakscan.sources.builtin import RULES


def _pick(values, key):
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(key, F.lit(len(values))).cast("int"))


def _pick_sql(values, key):
    items = ", ".join(sql_text(v) if isinstance(v, str) else str(v).lower() for v in values)
    return f"list_extract([{items}], CAST({key} % {len(values)} AS INTEGER) + 1)"


HOSTS = tuple(h for _, hosts in ctx.DESTINATIONS for h in hosts) + ("example.com", "")
FOLDERS = ("/src", "/tests", "/a_test.x", "/Fixtures", "/x.spec.ts", "/__mocks__", "/docs", "/latest", "/testdata")

_HOST_SQL = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"
_PATH_SQL = "CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END"


def _kind_sql(host):
    cases = " ".join(f"WHEN {host} IN ({', '.join(repr(h) for h in hosts)}) THEN '{kind}'" for kind, hosts in ctx.DESTINATIONS)
    return f"CASE {cases} ELSE 'unknown' END"


def _class_sql(path, start):
    cases = " ".join(f"WHEN regexp_matches({path}, {sql_text('(?i)' + rx.replace('{s}', start))}) THEN '{name}'"
                     for name, rx in ctx.PATH_CLASSES)
    return f"CASE {cases} ELSE '' END"


_PAGES_SQL = (f"SELECT page_id, url, html, CASE WHEN page_id % 3 = 0 THEN {_HOST_SQL} ELSE {_pick_sql(HOSTS, 'page_id')} END AS host, "
              f"{_pick_sql(FOLDERS, 'page_id')} || {_PATH_SQL} AS path FROM pages")


def _pages(spark, sf):
    pages = spread(table(spark, sf, "pages"))
    host = F.when(F.col("page_id") % 3 == 0, ctx.url_host(F.col("url"))).otherwise(_pick(HOSTS, F.col("page_id")))
    return pages.withColumns({"host": host, "path": F.concat(_pick(FOLDERS, F.col("page_id")), ctx.url_path(F.col("url")))})


@query("c1_classify_destination", f"SELECT page_id, {_kind_sql('host')} AS kind FROM ({_PAGES_SQL})")
def classify_destination_query(spark, sf):
    return _pages(spark, sf).select("page_id", ctx.classify_destination(F.col("host")).alias("kind"))


@query("c2_path_hint", f"SELECT page_id, {_class_sql('path', '/')} AS hint FROM ({_PAGES_SQL})")
def path_hint_query(spark, sf):
    return _pages(spark, sf).select("page_id", ctx.path_hint(F.col("path")).alias("hint"))


@query("c3_classify_path", f"SELECT page_id, {_class_sql('substr(path, 2)', '(?:/|^)')} AS hint FROM ({_PAGES_SQL})")
def classify_path_query(spark, sf):
    return _pages(spark, sf).select("page_id", ctx.classify_path(F.expr("substr(path, 2)")).alias("hint"))


@query("c4_context_hashes", f"""SELECT page_id, left(sha256(html || '|' || host || '|textarea'), 16) AS surrounding_hash,
  left(sha256(host || path), 16) AS page_url_hash FROM ({_PAGES_SQL})""")
def context_hash_query(spark, sf):
    pages = _pages(spark, sf)
    return pages.select(
        "page_id", ctx.surrounding_hash(F.col("html"), F.col("host"), F.lit("textarea")).alias("surrounding_hash"),
        ctx.page_url_hash(F.col("host"), F.col("path")).alias("page_url_hash"))


_URL_SQL = f"SELECT page_id, html, 'https://' || CASE WHEN host = '' THEN 'x.org' ELSE host END || path || '?q=1' AS url FROM ({_PAGES_SQL})"


@query("c5_source_context", f"""SELECT page_id, {_kind_sql('host')} AS destination_kind, host AS destination_host, 'input' AS element_kind,
  false AS in_code_fence, '' AS language_hint, {_class_sql('path', '/')} AS path_hint,
  left(sha256(html || '|' || host || '|input'), 16) AS surrounding_hash, left(sha256(host || path), 16) AS page_url_hash
  FROM (SELECT page_id, html, {_HOST_SQL} AS host, {_PATH_SQL} AS path FROM ({_URL_SQL}))""")
def source_context_query(spark, sf):
    host = F.when(F.col("host") == "", F.lit("x.org")).otherwise(F.col("host"))
    pages = _pages(spark, sf).withColumn("url", F.concat(F.lit("https://"), host, F.col("path"), F.lit("?q=1")))
    return pages.select("page_id", ctx.source_context(F.col("url"), F.lit("input"), F.col("html")).alias("s")).select("page_id", "s.*")


def _replay_sql(key):
    digest = f"md5('1|' || {key})"
    draw = f"CAST(('0x' || substr({digest}, 1, 8)) AS BIGINT) % 100"
    pick = f"CAST(('0x' || substr({digest}, 9, 8)) AS BIGINT)"
    host = " ".join(f"WHEN draw < {upper} THEN {_pick_sql(ctx.REPLAY_HOSTS[kind], 'pick')}" for upper, kind, _ in ctx.REPLAY_MIX)
    kind = " ".join(f"WHEN draw < {upper} THEN '{kind}'" for upper, kind, _ in ctx.REPLAY_MIX)
    element = " ".join(f"WHEN draw < {upper} THEN '{how}'" for upper, _, how in ctx.REPLAY_MIX)
    return f"{draw} AS draw, {pick} AS pick", f"CASE {kind} END", f"CASE {host} END", f"CASE {element} END"


# --- a corpus of lines -------------------------------------------------------

PATHS = ("src", "tests", "pkg/fixtures", "app", "docs/samples", "lib/x.spec.y")
_LINES_SQL = f"""SELECT path, line_no, content, path || ':' || line_no AS record_id FROM (
  SELECT {_pick_sql(PATHS, 'doc_id')} || '/' || source || '/' || doc_id AS path, unnest(lines) AS content,
    CAST(unnest(generate_series(1, len(lines))) AS INTEGER) AS line_no
  FROM (SELECT doc_id, source, string_split({planted_sql('text', 'doc_id')}, chr(10)) AS lines FROM documents))"""


def corpus_lines(spark, sf):
    """The planted documents as lines of files on paths of several classes."""
    docs = spread(table(spark, sf, "documents"))
    path = F.concat_ws("/", _pick(PATHS, F.col("doc_id")), "source", F.col("doc_id").cast("string"))
    lines = F.posexplode(F.split(planted(F.col("text"), F.col("doc_id")), "\n"))
    rows = docs.select(path.alias("path"), lines.alias("pos", "content"))
    return rows.select("path", (F.col("pos") + 1).alias("line_no"), "content")


_DRAW, _KIND, _HOST, _ELEMENT = _replay_sql("path || '|' || line_no")
_REPLAY_SQL = f"""SELECT record_id, path, line_no, content, {_KIND} AS kind, {_HOST} AS host, {_ELEMENT} AS element, false AS fence, '' AS lang_hint,
  {_class_sql('path', '(?:/|^)')} AS path_hint FROM (SELECT *, {_DRAW} FROM ({_LINES_SQL}))"""


def _replayed(spark, sf, mix="realistic"):
    lines = corpus_lines(spark, sf)
    return lines.withColumn("source", ctx.replay_source(mix, F.col("path"), F.col("path"), F.col("line_no")))


@query("c6_sample_destination", f"SELECT kind, host, element, path_hint, count(*) AS n FROM ({_REPLAY_SQL}) GROUP BY ALL")
def sample_destination_query(spark, sf):
    s = _replayed(spark, sf).select("source.*")
    return s.groupBy(F.col("destination_kind").alias("kind"), F.col("destination_host").alias("host"),
                     F.col("element_kind").alias("element"), "path_hint").agg(F.count("*").alias("n"))


# --- biases ------------------------------------------------------------------

_DEST = "CASE WHEN kind = '' THEN 0 ELSE coalesce(context_bias[kind], CASE WHEN kind = 'code_host' THEN -2 ELSE 0 END) END"
_ELEM = "CASE WHEN element = 'network_body' THEN 1 ELSE 0 END"
_FENCE = "CASE WHEN fence AND severity IN ('medium', 'low') THEN -1 ELSE 0 END"
_LANG = "CASE WHEN lower(trim(lang_hint)) IN ('test', 'fixture', 'spec') THEN -1 ELSE 0 END"
_PATH = "CASE WHEN kind = 'code_host' AND lower(trim(path_hint)) IN ('test', 'fixture', 'spec', 'mock') THEN -1 ELSE 0 END"
_BIAS = " + ".join((_DEST, _ELEM, _FENCE, _LANG, _PATH))

AXES = {
    "destination_kind": ("kind", ("", "code_host", "ai_chat", "paste_bin", "unknown", "email")),
    "element_kind": ("element", ("input", "network_body", "textarea", "")),
    "in_code_fence": ("fence", (False, True)),
    "language_hint": ("lang_hint", ("", "yaml", "Test", " SPEC ", "fixture", "mock")),
    "path_hint": ("path_hint", ("", "test", "docs", "Mock", " fixture", "src")),
}


def _bias_query(name, *axes):
    columns = ", ".join(
        f"{_pick_sql(values, f'(doc_id // {i + 2})') if axis in axes else ('false' if axis == 'in_code_fence' else repr(''))} AS {short}"
        for i, (axis, (short, values)) in enumerate(AXES.items()))
    records = f"SELECT doc_id AS record_id, {planted_sql('text', 'doc_id')} AS content, {columns} FROM documents"

    @query(name, ScanSql(records, RULES, bias=_BIAS).select("SELECT record_id, pattern_name, bias, score, blocked FROM judged"))
    def run(spark, sf):
        fields = [
            _pick(values, F.floor(F.col("record_id") / (i + 2))).alias(axis)
            for i, (axis, (_, values)) in enumerate(AXES.items()) if axis in axes
        ]
        docs = planted_documents(spark, sf).withColumn("context", F.struct(*fields))
        return explain_scan(docs, RULES, source="context").select("record_id", "pattern_name", "bias", "score", "blocked")


_bias_query("v6_destination_bias", "destination_kind")
_bias_query("v7_element_bias", "element_kind")
_bias_query("v8_code_fence_bias", "in_code_fence")
_bias_query("v9_language_bias", "language_hint")
_bias_query("v10_path_bias", "destination_kind", "path_hint")
_bias_query("v11_context_bias", *AXES)


# --- evaluation --------------------------------------------------------------

_MUST = f"list_contains([1, 3, 4, 6, 9, 10], record_id % {len(PLANTS)})"
_LABELLED = f"SELECT v.record_id, lang AS file, {_MUST.replace('record_id', 'v.record_id')} AS must_block, blocked FROM verdict v JOIN rec USING (record_id)"
_COUNTS = """SELECT file, count_if(must_block AND blocked) AS tp, count_if(NOT must_block AND blocked) AS fp,
  count_if(NOT must_block AND NOT blocked) AS tn, count_if(must_block AND NOT blocked) AS fn"""
_RATED = f"""SELECT file, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn,
  coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
  coalesce(fp / nullif(fp + tn, 0), 0.0) AS fp_rate FROM ({_COUNTS} FROM ({_LABELLED}) GROUP BY ROLLUP(file))"""


def _labelled(spark, sf):
    must = F.pmod("record_id", F.lit(len(PLANTS))).isin(1, 3, 4, 6, 9, 10)
    return scan(planted_documents(spark, sf), RULES).select("record_id", F.col("lang").alias("file"), must.alias("must_block"), "blocked")


@query("e1_confusion_matrix", ScanSql(PLANTED_SQL, RULES).select(f"""SELECT coalesce(file, 'total') AS file, tp, fp, tn, fn, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(fp_rate, 6) AS fp_rate,
  round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0), 6) AS f1 FROM ({_RATED})"""))
def confusion_query(spark, sf):
    m = evaluate.confusion_matrix(_labelled(spark, sf))
    return m.select(F.coalesce("file", F.lit("total")).alias("file"), "tp", "fp", "tn", "fn",
                    *[F.round(c, 6).alias(c) for c in ("precision", "recall", "fp_rate", "f1")])


@query("e2_error_budget", ScanSql(PLANTED_SQL, RULES).select(f"""SELECT round(fp_rate, 6) AS fp_rate, round(coalesce(fn / nullif(tp + fn, 0), 0.0), 6) AS fn_rate,
  fp_rate < 0.10 AND coalesce(fn / nullif(tp + fn, 0), 0.0) < 0.05 AS passed FROM ({_RATED}) WHERE file IS NULL"""))
def budget_query(spark, sf):
    b = evaluate.within_budget(evaluate.confusion_matrix(_labelled(spark, sf)))
    return b.select(F.round("fp_rate", 6).alias("fp_rate"), F.round("fn_rate", 6).alias("fn_rate"), "passed")


_BASE = ScanSql(_REPLAY_SQL, RULES).select("SELECT path, line_no, content, v.blocked, v.pattern_name, v.score FROM verdict v JOIN rec USING (record_id)")
_CTX = ScanSql(_REPLAY_SQL, RULES, bias=_BIAS).select("SELECT path, line_no, content, v.blocked, v.pattern_name, v.score FROM verdict v JOIN rec USING (record_id)")
_MODES = f"WITH a AS MATERIALIZED ({_BASE}), b AS MATERIALIZED ({_CTX}), m AS (SELECT 'baseline' AS mode, * FROM a UNION ALL SELECT 'context', * FROM b)\n"
_KEYS = "path, line_no, pattern_name"
_SUPPRESSED = "SELECT * FROM a WHERE blocked AND NOT EXISTS (SELECT 1 FROM b WHERE b.blocked AND b.path = a.path AND b.line_no = a.line_no AND b.pattern_name = a.pattern_name)"
_EXPOSED = "SELECT * FROM b WHERE blocked AND NOT EXISTS (SELECT 1 FROM a WHERE a.blocked AND b.path = a.path AND b.line_no = a.line_no AND b.pattern_name = a.pattern_name)"
_FP_LIKELY = _class_sql("path", "(?:/|^)") + " <> ''"
_TOP = "SELECT mode, pattern_name, count(*) AS blocks, CAST(row_number() OVER (PARTITION BY mode ORDER BY count(*) DESC, pattern_name) AS INTEGER) AS place FROM m WHERE blocked GROUP BY mode, pattern_name QUALIFY place <= 5"


def _compared(spark, sf):
    return compare_context(_replayed(spark, sf), RULES, "source")


@query("e3_mode_report", _MODES + """SELECT mode, CAST(count_if(blocked) AS BIGINT) AS blocks, count(*) AS scanned,
  round(count_if(blocked) * 100.0 / count(*), 6) AS block_rate_pct FROM m GROUP BY mode""")
def mode_report_query(spark, sf):
    return evaluate.mode_report(evaluate.mode_verdicts(_compared(spark, sf))).withColumn("block_rate_pct", F.round("block_rate_pct", 6))


@query("e3_top_patterns", _MODES + _TOP)
def top_patterns_query(spark, sf):
    return evaluate.top_patterns(evaluate.mode_verdicts(_compared(spark, sf)))


@query("e4_mode_difference", _MODES + f"""SELECT 'suppressed' AS change, {_KEYS}, score, {_FP_LIKELY} AS fp_likely FROM ({_SUPPRESSED})
  UNION ALL SELECT 'exposed', {_KEYS}, score, {_FP_LIKELY} FROM ({_EXPOSED})""")
def mode_difference_query(spark, sf):
    return evaluate.changed_blocks(_compared(spark, sf)).select("change", "path", "line_no", "pattern_name", "score", "fp_likely")


@query("e4_run_difference", _MODES + f"SELECT {_KEYS}, score FROM ({_SUPPRESSED})")
def run_difference_query(spark, sf):
    rows = evaluate.mode_verdicts(_compared(spark, sf))
    left, right = rows.filter("mode = 'baseline'"), rows.filter("mode = 'context'")
    return evaluate.block_difference(left, right).select("path", "line_no", "pattern_name", "score")


@query("e5_segmentation", _MODES + f"""SELECT segment, baseline_blocks, context_blocks,
  round(coalesce((baseline_blocks - context_blocks) * 100.0 / nullif(baseline_blocks, 0), 0.0), 6) AS drop_pct FROM (
  SELECT CASE WHEN {_FP_LIKELY} THEN 'fp_likely' ELSE 'tp_candidate' END AS segment,
    CAST(count_if(blocked AND mode = 'baseline') AS BIGINT) AS baseline_blocks, CAST(count_if(blocked AND mode = 'context') AS BIGINT) AS context_blocks
  FROM m GROUP BY 1)""")
def segmentation_query(spark, sf):
    return evaluate.segmentation(_compared(spark, sf)).withColumn("drop_pct", F.round("drop_pct", 6))


@query("e6_suppressed_dump", _MODES + f"""SELECT {_KEYS}, score, false AS fp_likely,
  replace(CASE WHEN strlen(content) > 200 THEN replace(CASE WHEN substr(view, 198, 1) = chr(1) THEN regexp_replace(left(view, 197), '[^\\x01]\\x01*$', '')
    ELSE left(view, 197) END, chr(1), '') || '...' ELSE content END, chr(9), ' ') AS excerpt
  FROM (SELECT *, {byte_view_sql('content')} AS view FROM ({_SUPPRESSED})) WHERE NOT ({_FP_LIKELY})""")
def suppressed_dump_query(spark, sf):
    return evaluate.suppressed_dump(_compared(spark, sf))


QUANTILES = {"p50": 0.50, "p90": 0.90, "p99": 0.99, "max": 1.0}


@query("e7_quantile_floor", " UNION ALL ".join(
    f"(SELECT '{name}' AS quantile, value FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events) WHERE i = floor((n - 1) * {q}))"
    for name, q in QUANTILES.items()))
def quantile_query(spark, sf):
    return evaluate.quantile_floor(spread(table(spark, sf, "events")), "value", QUANTILES)


@query("e7_every_nth", "SELECT event_id, value FROM events WHERE event_id % 100 = 0")
def every_nth_query(spark, sf):
    return evaluate.every_nth(table(spark, sf, "events"), "event_id").select("event_id", "value")


@query("e8_report_json", _MODES + f""", t AS (SELECT mode, list({{'name': pattern_name, 'count': blocks}} ORDER BY place) AS top FROM ({_TOP}) GROUP BY mode),
  r AS (SELECT mode, CAST(count_if(blocked) AS BIGINT) AS blocks, count(*) AS scanned, round(CAST(count_if(blocked) * 100.0 / count(*) AS DOUBLE), 4) AS rate FROM m GROUP BY mode)
  SELECT mode, CAST(to_json({{'blocks': blocks, 'scanned': scanned, 'fp_rate_pct': rate, 'top_patterns': top}}) AS VARCHAR) AS report FROM r JOIN t USING (mode)""".replace("\n, t AS", ", t AS"))
def report_json_query(spark, sf):
    return evaluate.report_json(evaluate.mode_verdicts(_compared(spark, sf)))
