"""Rule tables, files, diffs, bodies and pages, derived from the given tables."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from leakscan.functions.base64text import decode_base64_text
from leakscan.plans.context_queries import _pick, _pick_sql
from leakscan.plans.registry import query
from leakscan.plans.tables import documents, encoded, spread, table
from leakscan.sources import bodies, diff, files, html, rules

# --- rule tables: one row per part -------------------------------------------

_PATTERNS = f"""SELECT CAST(p_partkey AS INTEGER) AS ordinal, p_name || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' ' || p_brand END AS name,
  CASE WHEN p_partkey % 31 = 0 THEN '' ELSE 'x' || p_partkey || '[0-9]+' END AS regex, p_partkey % 7 = 0 AS disabled,
  {_pick_sql(("", "cloud", "payment", "personal"), "p_size")} AS category FROM part"""


def _pattern_rows(spark, sf):
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        key.cast("int").alias("ordinal"), F.concat("p_name", F.when(key % 2 == 0, "").otherwise(F.concat(F.lit(" "), "p_brand"))).alias("name"),
        F.when(key % 31 == 0, "").otherwise(F.concat(F.lit("x"), key.cast("string"), F.lit("[0-9]+"))).alias("regex"),
        (key % 7 == 0).alias("disabled"), _pick(("", "cloud", "payment", "personal"), F.col("p_size")).alias("category"))


_LOADED = f"SELECT ordinal, name, regex, CASE WHEN category = '' THEN 'uncategorized' ELSE category END AS category FROM ({_PATTERNS}) WHERE NOT disabled"


@query("s1_load_patterns", _LOADED)
def load_patterns_query(spark, sf):
    return rules.parse_patterns(_pattern_rows(spark, sf)).select("ordinal", "name", "regex", "category")


@query("s1_rejected_patterns", f"SELECT ordinal, name FROM ({_LOADED}) WHERE regex = ''")
def rejected_patterns_query(spark, sf):
    return rules.rejected_patterns(_pattern_rows(spark, sf)).select("ordinal", "name")


_EXCLUSIONS = f"""SELECT CAST(p_partkey AS INTEGER) AS ordinal, p_name AS applies_to, {_pick_sql(("regex", "dictionary"), "p_size")} AS type,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS pattern, p_brand AS word, CAST(p_size AS INTEGER) AS "window" FROM part"""


def _exclusion_rows(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("int").alias("ordinal"), F.col("p_name").alias("applies_to"), _pick(("regex", "dictionary"), F.col("p_size")).alias("type"),
        F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_type")).alias("pattern"), F.array("p_brand").alias("words"),
        F.col("p_size").cast("int").alias("window"))


@query("s2_rejected_exclusions", f"SELECT ordinal, applies_to FROM ({_EXCLUSIONS}) WHERE type = 'regex' AND pattern = ''")
def rejected_exclusions_query(spark, sf):
    return rules.rejected_exclusions(_exclusion_rows(spark, sf)).select("ordinal", "applies_to")


def _merge_sql(rows, key, column):
    return f"""WITH r AS ({rows}), b AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ordinal DESC) AS last FROM r WHERE ordinal % 3 <> 0),
      o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ordinal DESC) AS last, min(ordinal) OVER (PARTITION BY {key}) AS first_at FROM r WHERE ordinal % 3 = 0),
      o1 AS (SELECT * FROM o WHERE last = 1)
      SELECT CAST(b.ordinal AS BIGINT) AS ordinal, coalesce(o1.{column}, b.{column}) AS {column} FROM b LEFT JOIN o1 ON b.last = 1 AND {' AND '.join(f'b.{k} = o1.{k}' for k in key.split(', '))}
      UNION ALL SELECT 1000000000 + first_at, {column} FROM o1 WHERE NOT EXISTS (SELECT 1 FROM b WHERE {' AND '.join(f'b.{k} = o1.{k}' for k in key.split(', '))})"""


@query("s3_merge_patterns", _merge_sql(_PATTERNS, "name", "regex"))
def merge_patterns_query(spark, sf):
    rows = _pattern_rows(spark, sf)
    return rules.merge_patterns(rows.filter("ordinal % 3 <> 0"), rows.filter("ordinal % 3 = 0")).select("ordinal", "regex")


@query("s4_merge_exclusions", _merge_sql(_EXCLUSIONS.replace('"window"', "win"), "type, applies_to, pattern, word", "win").replace(
    "coalesce(o1.win, b.win) AS win", "coalesce(o1.win, b.win) AS \"window\""))
def merge_exclusions_query(spark, sf):
    rows = _exclusion_rows(spark, sf)
    return rules.merge_exclusions(rows.filter("ordinal % 3 <> 0"), rows.filter("ordinal % 3 = 0")).select("ordinal", "window")


@query("m5_list_categories", f"SELECT DISTINCT category FROM ({_LOADED})")
def list_categories_query(spark, sf):
    return rules.list_categories(rules.parse_patterns(_pattern_rows(spark, sf)))


_DOMAIN_LINES = f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN '# ' || url WHEN 1 THEN '  .' || upper(url) || chr(9) || '# note' WHEN 2 THEN '   '
  WHEN 3 THEN url || ' ' ELSE ' # ' || url || ' # x' END AS value FROM pages"""


@query("s5_load_domain_list", f"""SELECT page_id, entry FROM (SELECT page_id, lower(trim(regexp_replace(value, '#.*', '', 's'), ' ' || chr(9))) AS entry FROM ({_DOMAIN_LINES}))
  WHERE entry <> ''""")
def domain_list_query(spark, sf):
    pages, url, n = spread(table(spark, sf, "pages")), F.col("url"), F.col("page_id") % 5
    line = (F.when(n == 0, F.concat(F.lit("# "), url)).when(n == 1, F.concat(F.lit("  ."), F.upper(url), F.lit("\t# note"))).when(n == 2, "   ")
            .when(n == 3, F.concat(url, F.lit(" "))).otherwise(F.concat(F.lit(" # "), url, F.lit(" # x"))))
    return rules.parse_domain_lines(pages.select("page_id", line.alias("value"))).select("page_id", "entry")


_WORDS = """list_transform(list_filter(string_split_regex(base, '[_-]'), lambda w: w <> ''),
  lambda w: CASE WHEN lower(w) IN ('ai', 'dlp') THEN upper(w) ELSE upper(left(w, 1)) || lower(substr(w, 2)) END)"""


@query("s6_category_from_path", f"""SELECT doc_id, array_to_string({_WORDS}, ' ') AS category FROM (SELECT doc_id,
  regexp_replace(regexp_replace('rules/' || lang || '/ai_' || source || '-dlp__' || (doc_id % 9) || '.list.txt', '^.*[/\\\\]', ''), '\\.[^.]*$', '') AS base FROM documents)""")
def category_query(spark, sf):
    path = F.concat(F.lit("rules/"), "lang", F.lit("/ai_"), "source", F.lit("-dlp__"), (F.col("doc_id") % 9).cast("string"), F.lit(".list.txt"))
    return table(spark, sf, "documents").select("doc_id", rules.category_from_path(path).alias("category"))


# --- files -------------------------------------------------------------------

_DIRS = ("src", "src/vendor", ".git/x", "a/node_modules/b", "lib", "vendored")
_FILES = f"""SELECT doc_id, {_pick_sql(_DIRS, 'doc_id')} || '/' || source || '/f' || doc_id || '.txt' AS path,
  CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'x' || chr(0) || text WHEN 2 THEN repeat('y', 8192) || chr(0) || text WHEN 3 THEN repeat(text || ' ', CAST(1 + 1100000 // (strlen(text) + 1) AS BIGINT))
  ELSE text END AS content, doc_id % 8 AS kind FROM documents"""


@query("s7_read_file_tree", f"""SELECT path, sha256(content) AS digest FROM ({_FILES}) WHERE strlen(content) > 0 AND kind NOT IN (1, 2)
  AND NOT regexp_matches(path, '(^|/)(vendor|\\.git|node_modules)/')""")
def file_tree_query(spark, sf):
    docs, kind = spread(table(spark, sf, "documents")), F.col("doc_id") % 8
    path = F.concat(_pick(_DIRS, F.col("doc_id")), F.lit("/"), "source", F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".txt"))
    content = (F.when(kind == 0, "").when(kind == 1, F.concat(F.lit("x\0"), "text")).when(kind == 2, F.concat(F.lit("y" * 8192 + "\0"), "text"))
               .when(kind == 3, F.repeat(F.concat("text", F.lit(" ")), 1 + F.floor(F.lit(1100000) / (F.octet_length("text") + 1)).cast("int")))
               .otherwise(F.col("text")))
    rows = docs.select(path.alias("path"), content.cast("binary").alias("content")).withColumn("length", F.octet_length("content").cast("bigint"))
    return files.text_files(rows).select("path", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))


_DIFF_LINE = """CASE pos % 9 WHEN 0 THEN CASE (pos // 9) % 4 WHEN 3 THEN '+++ /dev/null' ELSE '+++ b/' || source || '/' || (pos // 27) || '.txt' END
  WHEN 1 THEN '@@ -1,2 +' || (pos * 3) || CASE WHEN pos % 2 = 0 THEN ',4' ELSE '' END || ' @@ f()' WHEN 2 THEN '+' || l WHEN 3 THEN '-' || l
  WHEN 4 THEN '+' || l WHEN 5 THEN ' ' || l WHEN 6 THEN '--- a/x' WHEN 7 THEN '@@ bad' ELSE '+' || l END"""
_DIFFS = f"""SELECT doc_id AS diff_id, pos, {_DIFF_LINE} AS line FROM (SELECT doc_id, source, unnest(words) AS l, unnest(generate_series(0, len(words) - 1)) AS pos
  FROM (SELECT doc_id, source, string_split(text, ' ') AS words FROM documents))"""


def _diff_lines(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    words = docs.select(F.col("doc_id").alias("diff_id"), "source", F.posexplode(F.split("text", " ")).alias("p", "l"))
    pos = F.col("p").cast("bigint")
    line = F.expr(_DIFF_LINE.replace("//", "DIV").replace("pos", "CAST(p AS BIGINT)"))
    return words.select("diff_id", pos.alias("pos"), line.alias("line"))


_ADDED = f"""WITH l AS ({_DIFFS}), k AS (SELECT *, starts_with(line, '+++ ') AS h, starts_with(line, '@@') AS hunk,
    starts_with(line, '+') AND NOT starts_with(line, '+++ ') AS plus, starts_with(line, '-') AS minus FROM l),
  f AS (SELECT *, coalesce(last_value(CASE WHEN h THEN CASE WHEN line = '+++ /dev/null' THEN '' ELSE regexp_replace(substr(line, 5), '^b/', '') END END IGNORE NULLS)
    OVER (PARTITION BY diff_id ORDER BY pos), '') AS file, sum(CAST(hunk AS INTEGER)) OVER (PARTITION BY diff_id ORDER BY pos) AS hunk_no FROM k),
  s AS (SELECT *, CASE WHEN (plus AND file <> '') OR NOT (h OR hunk OR plus OR minus) THEN 1 ELSE 0 END AS step,
    CASE WHEN hunk THEN coalesce(nullif(greatest(coalesce(try_cast(regexp_extract(line, '^[^+]*\\+([0-9]+)(?:[, ]|$)', 1) AS INTEGER), 0), 0), 0), 1) END AS start FROM f),
  n AS (SELECT *, coalesce(max(start) OVER (PARTITION BY diff_id, hunk_no), 0) + coalesce(sum(step) OVER (PARTITION BY diff_id, hunk_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new_line FROM s),
  added AS (SELECT diff_id, pos, file, CAST(new_line AS INTEGER) AS new_line, substr(line, 2) AS content FROM n WHERE plus AND file <> '')
"""


@query("s8_added_lines", _ADDED + "SELECT diff_id, file, new_line, content FROM added")
def added_lines_query(spark, sf):
    return diff.added_lines(_diff_lines(spark, sf), slot=5000).select("diff_id", "file", "new_line", "content")


@query("s8_parse_unified_diff", _ADDED + """SELECT diff_id, file, arg_min(new_line, pos) AS first_line, sha256(string_agg(content, chr(10) ORDER BY pos)) AS digest
  FROM added GROUP BY diff_id, file""")
def parse_diff_query(spark, sf):
    rows = diff.parse_unified_diff(_diff_lines(spark, sf))
    return rows.select("diff_id", "file", "first_line", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))


_CORPUS_PATHS = ("src/a.py", "docs/b.MD", "build/c.py", "x/target/d.go", "bin/e.exe", "lib/f.tar.json")
_CORPUS_FILES = f"SELECT {_pick_sql(_CORPUS_PATHS, 'doc_id')} AS tail, doc_id || '/' || tail AS path, replace(replace(text, ', ', '|'), ' ', chr(10)) AS content FROM documents"


@query("s9_build_corpus", f"""SELECT path, CAST(line_no AS INTEGER) AS line_no, replace(l, '|', chr(9)) AS content FROM (
  SELECT path, tail, unnest(ls) AS l, unnest(generate_series(1, len(ls))) AS line_no FROM (SELECT path, tail, string_split(regexp_replace(content, '\\n$', ''), chr(10)) AS ls FROM ({_CORPUS_FILES})))
  WHERE strlen(l) >= 4 AND tail IN ('src/a.py', 'docs/b.MD', 'lib/f.tar.json')""")
def build_corpus_query(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    content = F.replace(F.replace("text", F.lit(", "), F.lit("|")), F.lit(" "), F.lit("\n"))
    path = F.concat_ws("/", F.col("doc_id").cast("string"), _pick(_CORPUS_PATHS, F.col("doc_id")))
    return files.build_corpus(docs.select(path.alias("path"), content.alias("content")), target=None)


_CORPUS_LINE = "source || CASE doc_id % 5 WHEN 0 THEN '|x' WHEN 1 THEN '' ELSE '|' || (doc_id * 7) END || '|' || text"


@query("s10_read_corpus", f"""SELECT path, line_no, sha256(content) AS digest FROM (SELECT string_split(v, '|') AS p, p[1] AS path, coalesce(try_cast(p[2] AS INTEGER), 0) AS line_no,
  array_to_string(p[3:], '|') AS content FROM (SELECT {_CORPUS_LINE.replace('text', "replace(text, ',', '|')")} AS v FROM documents)) WHERE len(p) >= 3""")
def read_corpus_query(spark, sf):
    docs, n = spread(table(spark, sf, "documents")), F.col("doc_id") % 5
    middle = F.when(n == 0, "|x").when(n == 1, "").otherwise(F.concat(F.lit("|"), (F.col("doc_id") * 7).cast("string")))
    lines = docs.select(F.concat("source", middle, F.lit("|"), F.replace("text", F.lit(","), F.lit("|"))).alias("value"))
    return files.parse_corpus(lines).select("path", "line_no", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))


# --- bodies ------------------------------------------------------------------

_KINDS = ("plain", "gzip", "deflate", "form", "multipart", "json")


def _make_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Request bodies around the documents, one kind after the other."""
    types = (pa.int64(), pa.string(), pa.string(), pa.binary())
    for batch in (b.slice(start, bodies.STEP) for b in batches for start in range(0, b.num_rows, bodies.STEP)):
        rows = []
        for key, text in zip(*[batch.column(c).to_pylist() for c in ("record_id", "content")]):
            kind, data = _KINDS[key % len(_KINDS)], text.encode()
            content_type, encoding = "text/plain", ""
            if kind == "gzip":
                encoding, data = "gzip", gzip.compress(data)
            elif kind == "deflate":
                engine = zlib.compressobj(wbits=-15)
                encoding, data = "deflate", engine.compress(data) + engine.flush()
            elif kind == "multipart":
                content_type = "multipart/form-data; boundary=XX"
                data = (b'--XX\r\nContent-Disposition: form-data; name="f"; filename="a.env"\r\n\r\n' + data
                        + b'\r\n--XX\r\nContent-Disposition: form-data; name="g"\r\n\r\nsecond\r\n--XX--\r\n')
            rows.append((key, content_type, encoding, data))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["record_id", "content_type", "content_encoding", "body"])


def request_bodies(docs):
    """(record_id, content_type, content_encoding, body) around the texts of (record_id, content)."""
    kind = F.pmod("record_id", F.lit(len(_KINDS)))
    key = F.col("record_id")
    form = F.concat(F.lit("z=last&b="), F.url_encode("content"), F.lit("&a=first%20one"))
    json = F.concat(F.lit('{"data":"'), encoded(F.concat(F.lit("secret of number "), key.cast("string"))), F.lit('"}'))
    made = docs.filter(~kind.isin(3, 5)).mapInArrow(_make_bodies, "record_id bigint, content_type string, content_encoding string, body binary")
    native = docs.filter(kind.isin(3, 5)).select(
        "record_id", F.when(kind == 3, "application/x-www-form-urlencoded").otherwise("application/json").alias("content_type"),
        F.lit("identity").alias("content_encoding"), F.when(kind == 3, form).otherwise(json).cast("binary").alias("body"))
    return made.unionByName(native)


BODY_TEXT_SQL = """SELECT record_id, CASE record_id % 6
  WHEN 3 THEN 'first one' || chr(10) || content || chr(10) || 'last' WHEN 4 THEN 'a.env' || chr(10) || content || chr(10) || 'second'
  WHEN 5 THEN '{{"data":"' || to_base64(encode('secret of number ' || record_id)) || '"}}' || chr(10) || 'secret of number ' || record_id
  ELSE content END AS content FROM ({records})"""


@query("s11_extract_body_text", "SELECT record_id, true AS encoding_ok, sha256(content) AS digest FROM ("
       + BODY_TEXT_SQL.format(records="SELECT doc_id AS record_id, text AS content FROM documents") + ")")
def body_text_query(spark, sf):
    rows = bodies.extract_body_text(request_bodies(documents(spark, sf).select("record_id", "content")))
    return rows.select("record_id", "encoding_ok", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))



@query("s12_decode_base64_text", """SELECT doc_id AS record_id, CASE doc_id % 4 WHEN 0 THEN text || ' of some length' WHEN 1 THEN 'one of several things ' || text || chr(10) || 'two of several things ?>~ ' || text
  WHEN 2 THEN 'a part of it: ' || text ELSE '' END AS decoded FROM documents""")
def base64_text_query(spark, sf):
    docs, n = spread(table(spark, sf, "documents")), F.col("doc_id") % 4

    one = encoded(F.concat(F.lit("one of several things "), "text"))
    two = F.rtrim(F.translate(encoded(F.concat(F.lit("two of several things ?>~ "), "text")), "+/", "-_"), F.lit("="))
    body = F.when(n == 0, encoded(F.concat("text", F.lit(" of some length")))).when(n == 2, F.concat(
        F.lit('{"b":"'), encoded(F.concat(F.lit("a part of it: "), "text")), F.lit('"}'))).when(
        n == 1, F.concat(F.lit('{"a":"'), one, F.lit('", "b": "'), two, F.lit('"}'))).otherwise(F.concat(F.lit("number "), F.col("doc_id").cast("string")))
    return docs.select(F.col("doc_id").alias("record_id"), decode_base64_text(body).alias("decoded"))


# --- pages -------------------------------------------------------------------

_LANGS = ("yaml", "go", "test")
_MARKED = f"""SELECT page_id, replace(replace(html, '<p>', '<pre class=x><code class="hl language-' || {_pick_sql(_LANGS, 'page_id')} || ' y">'), '</p>', '</code></pre>') AS html FROM pages"""


@query("s13_explode_code_blocks", f"""SELECT page_id, count(*) AS blocks, {_pick_sql(_LANGS, 'page_id')} AS language_hint, CAST(sum(strlen(b)) AS BIGINT) AS bytes
  FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<pre\\b[^>]*>.*?</pre\\s*>|<code\\b[^>]*>.*?</code\\s*>')) AS b FROM ({_MARKED})) GROUP BY page_id""")
def code_blocks_query(spark, sf):
    pages = spread(table(spark, sf, "pages"))
    tag = F.concat(F.lit('<pre class=x><code class="hl language-'), _pick(_LANGS, F.col("page_id")), F.lit(' y">'))
    marked = pages.withColumn("html", F.replace(F.replace("html", F.lit("<p>"), tag), F.lit("</p>"), F.lit("</code></pre>")))
    code = html.explode_code_blocks(marked).filter("in_code_fence")
    return code.groupBy("page_id").agg(F.count("*").alias("blocks"), F.max("language_hint").alias("language_hint"),
                                       F.sum(F.octet_length("content")).cast("bigint").alias("bytes"))
