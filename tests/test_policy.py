import pytest
from pyspark.sql import functions as F
from test_scan import AWS, frame

from leakscan.functions import context as ctx
from leakscan.operators import allowlist, canary, evaluate, policy, report
from leakscan.operators.dedup import scan_distinct
from leakscan.operators.lookup import lookup
from leakscan.operators.scan import scan
from leakscan.sources.builtin import RULES
from leakscan.sources.rules import RuleError


def test_domain_lookup(spark):
    domains = spark.createDataFrame([
        ("A", ".example.com", 0), ("B", "sub.example.com", 1), ("C", "exact.org", 1), ("D", ".example.com", 2), ("E", ".deep.sub.example.com", 1),
        ("F", ".", 0), ("G", "..odd.org", 0)], "category string, entry string, source_ordinal int")
    hosts = ["example.com", "x.example.com", "SUB.example.com.", "y.sub.example.com", "z.deep.sub.example.com", "a.exact.org", "exact.org", "badexample.com",
             "", "com", None]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r.host: r.category for r in policy.lookup_domain(df, domains).collect()}
    assert got == {"example.com": "A", "x.example.com": "A", "SUB.example.com.": "B", "y.sub.example.com": "A", "z.deep.sub.example.com": "E",
                   "a.exact.org": None, "exact.org": "C", "badexample.com": None, "": None, "com": None, None: None}
    policies = spark.createDataFrame([("A", "deny"), ("C", "allow_with_dlp")], "category string, action string")
    acts = {r.host: r.action for r in policy.check_domain(df, domains, policies).collect()}
    assert acts["example.com"] == "deny" and acts["SUB.example.com."] == "deny" and acts["exact.org"] == "allow_with_dlp" and acts["com"] == "allow"


def test_large_lookup_is_salted(spark):
    facts = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    keyed = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, v string")
    small, large = lookup(facts, keyed, ["k"]), lookup(facts, keyed, ["k"], most=0)
    assert sorted(small.collect()) == sorted(large.select(small.columns).collect())
    assert large.columns == small.columns


def test_overrides(spark):
    log = [(1, "add", "allow", "HTTP://A.com/x"), (2, "add", "block", "a.com"), (3, "add", "allow", "b.com"), (4, "remove", None, "b.com"),
           (5, "add", "allow", "c.com"), (6, "add", "nope", "d.com"), (7, "add", "allow", "two words"), (8, "add", "allow", " ")]
    df = spark.createDataFrame(log, "ts int, op string, list string, domain string")
    assert {tuple(r) for r in policy.apply_domain_overrides(df).collect()} == {("block", "a.com"), ("allow", "c.com")}
    assert {r.ts for r in policy.rejected_overrides(df).collect()} == {6, 7, 8}
    many = spark.range(30).select(F.col("id").alias("ts"), F.lit("add").alias("op"), F.lit("allow").alias("list"), F.concat(F.lit("h"), F.col("id"), F.lit(".com")).alias("domain"))
    assert policy.apply_domain_overrides(many).count() == many.select("domain").distinct().count()


def test_policy_changes(spark):
    cur = spark.createDataFrame([("A", "deny"), ("B", "allow")], "category string, action string")
    want = spark.createDataFrame([("A", "allow"), ("B", "deny"), ("C", "deny"), ("D", "redact")], "category string, action string")
    diff = {r.category: (r.have, r.relaxation) for r in policy.policy_diff(cur, want).collect()}
    assert diff == {"A": ("deny", True), "B": ("allow", False), "C": ("", False), "D": ("", False)}
    assert {tuple(r) for r in policy.policy_apply(cur, want).collect()} == {("A", "allow"), ("B", "deny"), ("C", "deny")}
    light = {tuple(r) for r in policy.protection_plan(cur, "light").collect()}
    assert ("AI Chat DLP", "deny") in light and ("A", "deny") in light and len(light) == 5
    profiles = spark.createDataFrame([(1, "x", {"A": "deny"}), (2, "x", {"A": "redact"}), (3, " ", None), (4, "y", None)], "id int, name string, categories map<string,string>")
    settings = profiles.withColumns({c: F.lit(0) for c in policy.SETTINGS})
    assert {r.id for r in policy.valid_profiles(settings).collect()} == {1, 4}


def test_context(spark):
    urls = [("https://gist.github.com/a", "paste_bin", ""), ("https://github.com/o/r/blob/main/tests/x.go", "code_host", "test"),
            ("https://claude.ai", "ai_chat", ""), ("https://x.com/docs/a_spec.rb", "social", "spec"), ("not a url", "unknown", "")]
    df = spark.createDataFrame(urls, "url string, kind string, hint string")
    for r in df.select("*", ctx.source_context(F.col("url"), F.lit("input"), F.lit("c")).alias("s")).collect():
        assert (r.s.destination_kind, r.s.path_hint) == (r.kind, r.hint)
        assert len(r.s.surrounding_hash) == 16
    paths = spark.createDataFrame([("tests/a", "test"), ("a/Fixture/b", "fixture"), ("x.mock.ts", "mock"), ("latest/a", ""), ("samples", "docs")], "p string, w string")
    assert all(r.c == r.w for r in paths.select("w", ctx.classify_path(F.col("p")).alias("c")).collect())


def test_allowlist(spark):
    values = spark.createDataFrame([(AWS, "", "aws", 0, 100), (AWS.lower(), "ai_chat", "aws", 50, 120), ("4785 3805 9239 1139", "code_host", "card", 0, 90)],
                                   "value string, scope string, pattern_name string, ttl int, created_at int")
    new = allowlist.entries(values, "salt")
    old = new.limit(0).unionByName(new.filter("scope = '*'").withColumn("last_hit", F.lit(7).cast("bigint")))
    table = allowlist.upsert(old, new)
    rows = {r.scope: r for r in table.collect()}
    assert set(rows) == {"ai_chat", "code_host"} and rows["ai_chat"].last_hit == 7 and rows["ai_chat"].expires_at == 170
    texts = [f"aws {AWS}", "card 4785380592391139", f"aws {AWS}"]
    kinds = F.element_at(F.array(F.lit("ai_chat"), F.lit("code_host"), F.lit("email")), (F.col("record_id") + 1).cast("int"))
    at = lambda now: [r.blocked for r in allowlist.scan_with_allowlist(frame(spark, texts), RULES, table, "salt", now, kind=kinds).orderBy("record_id").collect()]
    assert at(150) == [False, False, True] and at(170) == [True, False, True]
    assert allowlist.cleanup(table, 170).count() == 1 and allowlist.remove(table, new).count() == 0
    assert [r.scope for r in allowlist.newest_first(table).collect()] == ["ai_chat", "code_host"]


def test_canaries(spark):
    made = canary.make_canaries(spark.createDataFrame([("a.b",), (" two ",), ("",), ("x" * 129,)], "label string"), 10)
    tokens = {r.label: r.token for r in made.collect()}
    made = spark.createDataFrame(made.collect(), made.schema)
    assert set(tokens) == {"a.b", "two"} and all(len(t) == 29 and t.startswith("TRIPW") for t in tokens.values())
    rules = RULES.with_patterns(canary.canary_patterns(made, 2))
    with pytest.raises(RuleError):
        canary.canary_patterns(made, 1)
    texts = [f"x {tokens['two']} y", f"aws {AWS}", tokens["two"][:-1]]
    verdicts = scan(frame(spark, texts), rules).withColumn("ts", F.lit(99))
    assert [r.pattern_name for r in verdicts.orderBy("record_id").collect()] == ["Canary:two", "AWS Access Key", ""]
    after = {r.label: (r.trigger_count, r.last_triggered) for r in canary.canary_triggers(made, verdicts).collect()}
    assert after == {"a.b": (0, 0), "two": (1, 99)}


def test_quantiles(spark):
    for n in (1, 2, 10, 1001):
        data = [(float((i * 37) % n) if i % 3 else 5.0,) for i in range(n)]
        df = spark.createDataFrame(data, "v double")
        order = sorted(v for v, in data)
        qs = {"a": 0.0, "b": 0.5, "c": 0.99, "d": 1.0}
        got = {r.quantile: r.value for r in evaluate.quantile_floor(df, "v", qs, splits=7).collect()}
        assert got == {k: order[int((n - 1) * q)] for k, q in qs.items()}


def test_documents_are_json(spark, tmp_path):
    import json

    rows = spark.createDataFrame([(f"f{i}", i % 2 == 0, "P\"1" if i % 4 else "P2", i) for i in range(9)], "file string, blocked boolean, pattern_name string, score int")

    def read(lines, name):
        report.write_lines(lines, str(tmp_path / name))
        parts = sorted((tmp_path / name).glob("part-*"))
        return json.loads("\n".join(p.read_text() for p in parts))

    doc = read(report.findings_lines(rows), "json")
    assert doc["scanned"] == 9 and doc["blocked"] == 5 and [f["file"] for f in doc["findings"]] == ["f0", "f2", "f4", "f6", "f8"]
    sarif = read(report.sarif_lines(report.findings(rows)), "sarif")
    run = sarif["runs"][0]
    assert sarif["version"] == "2.1.0" and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["P\"1", "P2"]
    assert [r["level"] for r in run["results"]] == ["warning", "warning", "error", "error", "error"]
    empty = rows.filter("false")
    assert read(report.findings_lines(empty), "none") == {"scanned": 0, "blocked": 0, "findings": []}
    assert read(report.sarif_lines(report.findings(empty)), "nosarif")["runs"][0]["results"] == []


def test_copies_are_scanned_once(spark):
    texts = [f"aws {AWS}", "clean", f"aws {AWS}", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "record_id bigint, content string")
    got = {r.record_id: (r.blocked, r.pattern_name, r.score) for r in scan_distinct(df, RULES).collect()}
    assert got == {r.record_id: (r.blocked, r.pattern_name, r.score) for r in scan(df, RULES).collect()}


def test_verdicts_by_time(spark):
    domains = spark.createDataFrame(
        [("Phishing", "a.com", 0, 0, 10), ("News", ".a.com", 1, 0, None), ("News", "b.org", 0, 5, None), ("News", "b.org", 0, 5, None),
         ("Phishing", None, 0, 0, None), ("Phishing", "c.net", 0, None, None)],
        "category string, entry string, source_ordinal int, since bigint, until bigint")
    policies = spark.createDataFrame(
        [("Phishing", "deny", 0, None), ("News", "allow", 0, 20), ("News", "deny", 15, 20), ("News", "allow", 30, None)],
        "category string, action string, since bigint, until bigint")
    log = spark.createDataFrame(
        [(1, "a.com", 3), (2, "A.com.", 10), (3, "x.a.com", 3), (4, "x.a.com", 15), (5, "x.a.com", 25), (6, "b.org", 4), (7, "b.org", 40),
         (8, None, 3), (9, "a.com", None), (10, "c.net", 3), (11, "", 3)], "id int, host string, ts bigint")
    want = {1: ("Phishing", "NXDOMAIN"), 2: ("News", "forward"), 3: ("News", "forward"), 4: ("News", "NXDOMAIN"), 5: ("News", "NXDOMAIN"),
            6: (None, "forward"), 7: ("News", "forward"), 8: (None, "forward"), 9: (None, "forward"), 10: (None, "forward"), 11: (None, "forward")}
    assert {r.id: (r.category, r.verdict) for r in policy.query_log_verdicts_at(log, domains, policies).collect()} == want
    none = policy.query_log_verdicts_at(log, domains.limit(0), policies.limit(0)).collect()
    assert {r.id: r.verdict for r in none} == dict.fromkeys(want, "forward")


def test_any_number_of_canaries(spark):
    token = lambda i: f"TRIPW{i:08x}" + "ABCDEFGHIJKLMNOP"
    many = spark.range(100_000).selectExpr("concat('trap ', id) AS label", "concat('TRIPW', lower(lpad(hex(id), 8, '0')), 'ABCDEFGHIJKLMNOP') AS token")
    own = "TRIPW23456723" + "Q" * 16
    canaries = many.union(spark.createDataFrame([("z", token(1)), ("own", own), ("no token", None)], "label string, token string"))
    rows = [(1, f"a {token(7)}{token(99_999)} {token(7)}"), (2, token(100_000)), (3, None), (4, ""), (5, "TRIPW00000000" + "A" * 11 + own),
            (6, f"x{token(1)[:9]}\u200b{token(1)[9:]}"), (7, token(7).lower())]
    got = canary.canary_matches(spark.createDataFrame(rows, "record_id int, content string"), canaries).collect()
    assert sorted((r.record_id, r.label, r.occurrences) for r in got) == [(1, "trap 7", 2), (1, "trap 99999", 1), (5, "own", 1), (6, "trap 1", 1)]
