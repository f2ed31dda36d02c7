import gzip
import json
import re
import zlib

import pytest
from pyspark.sql import functions as F

from leakscan.functions.base64text import decode_base64_text
from leakscan.functions.form import form_text, path_escape, query_escape
from leakscan.functions.regex import required_literal, to_java
from leakscan.operators.scan import scan
from leakscan.sources import bodies, diff, files, html, rules


def test_rule_files(spark, tmp_path):
    base, over, ex, ex_over = (str(tmp_path / n) for n in ("p.json", "po.json", "x.json", "xo.json"))
    json.dump({"patterns": [
        {"name": "A", "regex": "aaa[0-9]", "prefix": "aaa", "severity": "critical", "score_weight": 1, "context_bias": {"code_host": -5}},
        {"name": "Off", "regex": "x", "disabled": True}, None, {"name": "B", "regex": "bbb", "severity": "low", "hotwords": ["h"], "hotword_window": 5}]}, open(base, "w"))
    json.dump({"patterns": [{"name": "B", "regex": "bbb+", "severity": "critical"}, {"name": "Off", "regex": "ooo", "severity": "high", "score_weight": 9},
                            {"name": "A", "regex": "zzz", "disabled": True}]}, open(over, "w"))
    json.dump({"exclusions": [{"applies_to": "a", "type": "dictionary", "match_type": "exact", "words": ["AAA1"]},
                              {"applies_to": "*", "type": "regex", "pattern": "9$", "suppress": True}]}, open(ex, "w"))
    json.dump({"exclusions": [{"applies_to": "*", "type": "regex", "pattern": "9$", "suppress": False},
                              {"applies_to": "B", "type": "dictionary", "words": ["near"], "window": 5}]}, open(ex_over, "w"))
    rs = rules.load_rules(spark, base, ex, over, ex_over)
    assert [(p.name, p.regex, p.category) for p in rs.patterns] == [
        ("A", "aaa[0-9]", "uncategorized"), ("B", "bbb+", "uncategorized"), ("Off", "ooo", "uncategorized")]
    assert [(x.applies_to, x.suppress, x.window) for x in rs.exclusions] == [("a", False, 0), ("*", False, 0), ("B", False, 5)]
    df = spark.createDataFrame([(1, "aaa1"), (2, "aaa2"), (3, "bbbb"), (4, "near bbbb"), (5, "ooo")], "record_id int, content string")
    got = {r.record_id: (r.blocked, r.pattern_name, r.score) for r in scan(df, rs).collect()}
    assert got == {1: (False, "", 0), 2: (True, "A", 1), 3: (True, "B", 1), 4: (False, "", 0), 5: (True, "Off", 9)}
    json.dump({"patterns": [{"name": "A", "regex": ""}]}, open(base, "w"))
    with pytest.raises(ValueError):
        rules.load_rules(spark, base)


def test_regex_dialect():
    assert to_java(r"a$").endswith(r"\z") and to_java(r"[$]") == "(?d)[$]" and to_java(r"(?P<n>x)") == "(?d)(?<n>x)"
    assert to_java(r"[\s]") == "(?d)[\\t\\n\\f\\r ]" and to_java(r"[[:alpha:]_]") == r"(?d)[\p{Alpha}_]"
    for bad in (r"(?=a)", r"(?<!a)b", r"(a)\1", r"a++", ""):
        with pytest.raises(rules.RuleError):
            to_java(bad)
    assert required_literal(r"(?i)token\s*=") == "=" and required_literal("a|b") == "" and required_literal(r"[a-z]+@x\.com") == "@x.com"


def test_regexes_begin_with_a_cheap_test():
    """A boundary is met after the first character only, and a loose form reads no word from each of its letters."""
    for pattern in (r"\b[0-9]{16}\b", r"(?i)\bapi[_-]?key", r"\b[^a\]]x|y"):
        assert re.match(r"\(\?d\)(\(\?i\))?\(\?=[^)]+\)\(\?:\(\?<=", to_java(pattern)), pattern
    for pattern in (r"\ba?b", r"\ba*b", r"\ba{0,2}b", r"\b(a|b)c", r"a+b", r"^\ba"):
        assert "(?=a" not in to_java(pattern) and ("a+" in to_java(pattern)) == ("a+" in pattern)
    assert to_java("[.a]+@b+", loose=True) == "(?d)[.a]@b+" and to_java("(?i)a+?c", loose=True) == "(?d)(?i)ac"


@pytest.mark.parametrize("pattern", [r"\b[0-9]{3}\b", r"(?i)\bap[_-]?i\b", r"[a-z.]+@[a-z]+", r"\b[^a]+c", r"\bAb+|[0-9]", r"\b.c", r"\b-a"])
def test_regexes_match_as_before(spark, pattern):
    words = ["123", "a123", "1234", "API x", "xapi", "ap_i-ap_i9", "a.b@c", "@c", "bc ac", "abbb", "7", "-c", "x-a", "é123", ""]
    rows = spark.createDataFrame([(w, " ".join([w, *words])) for w in words], "w string, t string")
    java = F.lit(to_java(pattern))
    for r in rows.select("w", "t", *[F.regexp_extract_all(c, java, F.lit(0)).alias("x" + c) for c in "wt"],
                         *[F.col(c).rlike(to_java(pattern, loose=True)).alias("l" + c) for c in "wt"]).collect():
        for c in "wt":
            found = [m.group() for m in re.finditer(pattern, r[c], re.ASCII)]
            assert r["x" + c] == found and (r["l" + c] or not found)


def test_domain_lists(spark, tmp_path):
    (tmp_path / "ai_chat_dlp.txt").write_text("# head\n.Example.com  # note\n\n  exact.org \n")
    (tmp_path / "news-list.txt").write_text("n.com")
    rows = rules.read_domain_lists(spark, [str(tmp_path / "ai_chat_dlp.txt"), str(tmp_path / "news-list.txt")]).collect()
    assert {tuple(r) for r in rows} == {("AI Chat DLP", ".example.com", 0), ("AI Chat DLP", "exact.org", 0), ("News List", "n.com", 1)}


def test_file_tree(spark, tmp_path):
    for name, data in {"a.txt": b"hello", "sub/b.py": "é".encode(), "node_modules/c.txt": b"x", "sub/.git/d": b"x", "e.bin": b"a\0b", "empty": b"",
                       "big": b"x" * ((1 << 20) + 1), "late": b"y" * 8192 + b"\0"}.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data)
    rows = {r.path: r.content for r in files.read_file_tree(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.txt", "sub/b.py", "big"} and rows["sub/b.py"] == "é" and len(rows["big"]) == (1 << 20) + 1
    raw = spark.createDataFrame([("a", 5, b"hello"), ("b", 6, b"hello!")], "path string, length bigint, content binary")
    assert [r.path for r in files.text_files(raw, max_bytes=5).collect()] == ["a"]


def test_corpus(spark, tmp_path):
    long = "z" * (16 * 1024)
    df = spark.createDataFrame([("b/x.py", "abcd\nab\r\npipe|d\r\n" + long + "\nafter"), ("a/y.GO", "one1\n\ntwo2"), ("vendor/z.py", "skip"), ("q.exe", "skip")],
                               "path string, content string")
    whole = files.build_corpus(df)
    assert {(r.path, r.line_no) for r in whole.collect()} >= {("b/x.py", 4), ("b/x.py", 5)}
    assert files.build_corpus(df, per_file=1).count() == 2
    corpus = files.build_corpus(df, max_line=16 * 1024)
    want = [("a/y.GO", 1, "one1"), ("a/y.GO", 3, "two2"), ("b/x.py", 1, "abcd"), ("b/x.py", 3, "pipe\td")]
    assert sorted(tuple(r) for r in corpus.collect()) == want
    for target in range(6):
        assert sorted(tuple(r) for r in files.build_corpus(df, target=target, max_line=16 * 1024).collect()) == want[:target]
    files.format_corpus(corpus).write.text(str(tmp_path / "c"))
    assert sorted(tuple(r) for r in files.read_corpus(spark, str(tmp_path / "c")).collect()) == want
    lines = spark.createDataFrame([("p|x|a|b",), ("p|2",), ("p|-3|",)], "value string")
    assert [tuple(r) for r in files.parse_corpus(lines).collect()] == [("p", 0, "a|b"), ("p", -3, "")]


DIFF = """diff --git a/x b/x
--- a/x
+++ b/x
@@ -1,0 +10,2 @@
+one
+two
 context
+four
-gone
+five
--- a/y
+++ /dev/null
@@ -1 +0,0 @@
-z
+ignored
+++ b/w
+before any hunk of it
@@ bad
+at one
+++ b/x
@@ -9 +90 @@ f(a+b)
+more""".split("\n")


def test_diff(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(DIFF)], "diff_id int, pos int, line string")
    for slot in (3, 100_000):
        rows = [(r.file, r.new_line, r.content) for r in diff.added_lines(df, slot=slot).orderBy("pos").collect()]
        assert rows == [("x", 10, "one"), ("x", 11, "two"), ("x", 13, "four"), ("x", 14, "five"), ("w", 1, "before any hunk of it"),
                        ("w", 1, "at one"), ("x", 90, "more")]
        got = {r.file: (r.first_line, r.content) for r in diff.parse_unified_diff(df, slot=slot).collect()}
        assert got == {"x": (10, "one\ntwo\nfour\nfive\nmore"), "w": (1, "before any hunk of it\nat one")}


def test_diff_lines_that_come_apart(spark):
    """Lines of many diffs, shuffled and not, in small slots and missing keys, give what reading each diff in order gives."""
    rows = [(d, i * 2 - 5, x) for d in (None, 1, 2, 3) for i, x in enumerate(DIFF * (1 if d == 2 else 3))] + [(4, 0, None), (5, 1, "-gone")]
    want = {s: None for s in (4, 100_000)}
    for order in (rows, sorted(rows, key=lambda r: hash((r[0] or 0, r[1])) % 97), rows[::-1]):
        df = spark.createDataFrame(order, "diff_id int, pos int, line string").repartition(3)
        for slot in want:
            got = sorted(diff.added_lines(df, slot=slot).collect(), key=repr)
            want[slot] = want[slot] or got
            assert got == want[slot] and len(got) == 7 * (3 + 3 + 1 + 3)
    assert want[4] == want[100_000]


def test_diff_slots_are_made_once(spark):
    """The lines are not put in order a second time for what slots take over."""
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(DIFF)], "diff_id int, pos int, line string")
    for rows in (diff.added_lines(df), diff.parse_unified_diff(df)):
        assert "MapInArrow" not in rows._jdf.queryExecution().executedPlan().toString()


def test_bodies(spark):
    import base64

    text = "a secret text that is long enough"
    b64 = base64.b64encode(text.encode())
    deflate = zlib.compressobj(wbits=-15)
    multi = (b'--B\r\nContent-Disposition: form-data; name="f"; filename="dir/id_rsa"\r\n\r\n' + b64 + b"\r\n--B\r\n\r\nplain part\r\n--B--\r\n")
    rows = [
        (1, "text/plain", "", b"hello"), (2, "text/plain", "gzip", gzip.compress(b"hello zip")),
        (3, "text/plain", "deflate", deflate.compress(b"hello flat") + deflate.flush()), (4, "text/plain", "gzip", b"not gzip"),
        (5, "text/plain", "br", b"odd"), (6, "multipart/form-data; boundary=B", None, multi), (7, "multipart/form-data", None, b"no boundary"),
        (8, "application/x-www-form-urlencoded", "", b"b=2%20x&a=1&b=3"), (9, "application/x-www-form-urlencoded", "", b"a=%zz&b=1"),
        (10, "application/json", "", b'{"d":"' + b64 + b'"}'), (11, "application/octet-stream", "identity", b64), (12, None, None, None),
        (13, "application/x-www-form-urlencoded", "", b"a=1;b=%41"), (14, "text/plain", "", b"x" * (4 * 1024 * 1024 + 5)),
        (15, "multipart/form-data; boundary=B", "gzip", gzip.compress(multi)),
    ]
    df = spark.createDataFrame(rows, "record_id int, content_type string, content_encoding string, body binary")
    got = {r.record_id: (r.text, r.encoding_ok) for r in bodies.extract_body_text(df).collect()}
    part = "id_rsa\n" + b64.decode() + "\n" + text + "\nplain part"
    assert {k: v[0] for k, v in got.items() if k != 14} == {
        1: "hello", 2: "hello zip", 3: "hello flat", 4: "not gzip", 5: "odd", 6: part, 7: "no boundary", 8: "1\n2 x\n3", 9: "a=%zz&b=1",
        10: '{"d":"' + b64.decode() + '"}\n' + text, 11: b64.decode() + "\n" + text, 12: "", 13: "a=1;b=A", 15: part}
    assert len(got[14][0]) == 4 * 1024 * 1024 + 5
    assert {k for k, v in got.items() if not v[1]} == {4, 5}


def test_base64_text(spark):
    import base64

    good = base64.urlsafe_b64encode("ünïcode ?>~ text of some length".encode()).decode()
    cases = [good, good.rstrip("="), good[:30] + "\n" + good[30:], "x " + good + " y", "short", base64.b64encode(bytes(range(200))).decode(),
             good + "=", base64.b64encode(b"1234567").decode()]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = [r.d for r in df.orderBy("i").select(decode_base64_text(F.col("t")).alias("d")).collect()]
    text = "ünïcode ?>~ text of some length"
    assert got[:4] == [text] * 4 and got[4] == "" and got[5] == "" and got[7] == ""


def test_escapes(spark):
    from urllib.parse import quote, quote_plus

    values = ["a b/c?d=e&f+g~h*i", "é:@$,;", "plain", "%2F"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for r in df.select("v", query_escape(F.col("v")).alias("q"), path_escape(F.col("v")).alias("p")).collect():
        assert r.q == quote_plus(r.v, safe="~") and r.p == quote(r.v, safe="$&+:=@~")
    forms = spark.createDataFrame([("c=&a=%41+1&b",), ("=x",), ("&&",), ("a=1=2",)], "v string")
    assert [r.t for r in forms.select(form_text(F.col("v")).alias("t")).collect()] == ["A 1\n\n", "x", "&&", "1=2"]


def test_code_blocks(spark):
    page = 'a<pre class="x"><code class="hl language-yaml">k: v</code></pre>b <code>c</code><CODE class=\'language-go\'>d</CODE>'
    df = spark.createDataFrame([(1, page), (2, "no code"), (3, "")], "page_id int, html string")
    rows = [(r.page_id, r.block, r.in_code_fence, r.language_hint) for r in html.explode_code_blocks(df).orderBy("page_id", "block").collect()]
    assert rows == [(1, 0, False, ""), (1, 1, True, "yaml"), (1, 2, False, ""), (1, 3, True, ""), (1, 4, True, "go"), (2, 0, False, "")]


def test_bodies_are_made_in_slices():
    import pyarrow as pa

    from leakscan.plans.source_queries import _make_bodies

    batch = pa.RecordBatch.from_pydict({"record_id": list(range(0, 6000, 6)), "content": ["x"] * 1000})
    made = list(_make_bodies(iter([batch])))
    assert max(b.num_rows for b in made) <= bodies.STEP
    assert [k for b in made for k in b.column("record_id").to_pylist()] == list(range(0, 6000, 6))
