"""Hosts against domain lists and policies derived from the page and customer tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leakscan.functions import context as ctx
from leakscan.operators import policy
from leakscan.plans.context_queries import _HOST_SQL, _PATH_SQL, _pick, _pick_sql
from leakscan.plans.registry import query
from leakscan.plans.tables import spread, table

CATEGORIES = ("AI Chat DLP", "Phishing", "News", "AI Chat Blocked", "Unruled")
_CATEGORIES_SQL = _pick_sql(CATEGORIES, "page_id")


def _hosts(spark, sf):
    pages = spread(table(spark, sf, "pages"))
    return pages.select("page_id", "url", ctx.url_host(F.col("url")).alias("host"), ctx.url_path(F.col("url")).alias("path"))


_HOSTS = f"SELECT page_id, url, {_HOST_SQL} AS host, {_PATH_SQL} AS path FROM pages"


def _domains(spark, sf):
    """A domain list of every fifth page: exact hosts, parents of hosts, and upper-case spellings of them."""
    return _entries(_hosts(spark, sf).filter("page_id % 5 = 0")).drop("page_id")


def _entries(rows):
    parent = F.regexp_replace("host", r"^[^.]*", "")
    entry = F.when(F.col("page_id") % 3 == 0, F.col("host")).when(F.col("page_id") % 3 == 1, F.upper(parent)).otherwise(
        F.concat(F.lit("."), F.col("host")))
    return rows.select("page_id", _pick(CATEGORIES, F.col("page_id")).alias("category"), entry.alias("entry"),
                       (F.col("page_id") % 2).cast("int").alias("source_ordinal"))


_DOMAINS = f"""SELECT {_CATEGORIES_SQL} AS category, CASE page_id % 3 WHEN 0 THEN host WHEN 1 THEN upper(regexp_replace(host, '^[^.]*', ''))
  ELSE '.' || host END AS entry, page_id % 2 AS source_ordinal FROM ({_HOSTS}) WHERE page_id % 5 = 0"""

POLICIES = (("AI Chat DLP", "allow_with_dlp"), ("Phishing", "deny"), ("News", "allow"), ("AI Chat Blocked", "deny"))
_POLICIES = "(VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in POLICIES) + ") p(category, action)"

_LOOKUP = f"""WITH hosts AS ({_HOSTS}), dom AS (SELECT category, lower(trim(entry)) AS entry, source_ordinal FROM ({_DOMAINS})),
  keys AS (SELECT regexp_replace(entry, '^\\.', '') AS key, starts_with(entry, '.') AS wide, category, source_ordinal FROM dom),
  exact AS (SELECT key, category FROM keys QUALIFY row_number() OVER (PARTITION BY key ORDER BY source_ordinal, category) = 1),
  below AS (SELECT key, category FROM keys WHERE wide QUALIFY row_number() OVER (PARTITION BY key ORDER BY source_ordinal, category) = 1),
  found AS (SELECT page_id, category, 0 AS gap FROM hosts JOIN exact ON hosts.host = exact.key
    UNION ALL SELECT page_id, category, length(host) - length(key) AS gap FROM hosts JOIN below ON ends_with(host, '.' || key)),
  cat AS (SELECT hosts.*, f.category FROM hosts LEFT JOIN (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY gap) = 1) f USING (page_id)),
  ruled AS (SELECT cat.*, CASE WHEN category IS NULL THEN 'allow' ELSE coalesce(action, 'deny') END AS action FROM cat LEFT JOIN {_POLICIES} USING (category))
"""


def _policies(spark):
    return spark.createDataFrame(list(POLICIES), "category string, action string")


@query("p1_lookup_domain", _LOOKUP + "SELECT page_id, host, category FROM cat")
def lookup_domain_query(spark, sf):
    return policy.lookup_domain(_hosts(spark, sf), _domains(spark, sf)).select("page_id", "host", "category")


@query("p2_check_domain", _LOOKUP + "SELECT page_id, host, category, action FROM ruled")
def check_domain_query(spark, sf):
    rows = policy.check_domain(_hosts(spark, sf), _domains(spark, sf), _policies(spark))
    return rows.select("page_id", "host", "category", "action")


@query("p3_is_categorized", _LOOKUP + "SELECT page_id, host FROM cat WHERE category IS NOT NULL")
def is_categorized_query(spark, sf):
    return policy.is_categorized(_hosts(spark, sf), _domains(spark, sf)).select("page_id", "host")


_CHANGES = f"""SELECT page_id AS ts, CASE WHEN page_id % 4 = 3 THEN 'remove' ELSE 'add' END AS op,
  {_pick_sql(("allow", "block", "allow", "other"), "(page_id // 2)")} AS list, CASE WHEN page_id % 11 = 0 THEN 'not a host' ELSE upper(url) END AS domain FROM pages"""
_NORMAL = """(CASE WHEN contains(d0, ' ') OR contains(d0, chr(9)) OR d0 = '' THEN NULL ELSE d0 END)"""
_D0 = "regexp_replace(regexp_replace(regexp_replace(lower(trim(domain)), '^http://', ''), '^https://', ''), '[/?#].*$', '', 's')"


def _changes(spark, sf):
    pages = spread(table(spark, sf, "pages"))
    return pages.select(
        F.col("page_id").alias("ts"), F.when(F.col("page_id") % 4 == 3, "remove").otherwise("add").alias("op"),
        _pick(("allow", "block", "allow", "other"), F.floor(F.col("page_id") / 2)).alias("list"),
        F.when(F.col("page_id") % 11 == 0, "not a host").otherwise(F.upper("url")).alias("domain"))


@query("p4_domain_overrides", f"""SELECT list, domain FROM (SELECT ts, op, list, {_NORMAL} AS domain FROM (SELECT *, {_D0} AS d0 FROM ({_CHANGES})))
  WHERE domain IS NOT NULL AND (op = 'remove' OR list IN ('allow', 'block'))
  QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ts DESC) = 1 AND op = 'add'""")
def domain_overrides_query(spark, sf):
    return policy.apply_domain_overrides(_changes(spark, sf))


@query("p5_normalise_domain", f"SELECT ts, {_NORMAL} AS domain FROM (SELECT *, {_D0} AS d0 FROM ({_CHANGES}))")
def normalise_domain_query(spark, sf):
    return _changes(spark, sf).select("ts", policy.normalise_domain(F.col("domain")).alias("domain"))


@query("p5_rejected_overrides", f"""SELECT ts, domain FROM (SELECT *, {_NORMAL} AS d FROM (SELECT *, {_D0} AS d0 FROM ({_CHANGES})))
  WHERE d IS NULL OR (op = 'add' AND list NOT IN ('allow', 'block'))""")
def rejected_overrides_query(spark, sf):
    return policy.rejected_overrides(_changes(spark, sf)).select("ts", "domain")


@query("p6_query_log_verdicts", _LOOKUP + "SELECT page_id, host, CASE WHEN action = 'deny' THEN 'NXDOMAIN' ELSE 'forward' END AS verdict FROM ruled")
def query_log_query(spark, sf):
    rows = policy.query_log_verdicts(_hosts(spark, sf), _domains(spark, sf), _policies(spark))
    return rows.select("page_id", "host", "verdict")


@query("p6_query_log_counters", _LOOKUP + "SELECT count(*) AS dns_queries, CAST(count_if(action = 'deny') AS BIGINT) AS dns_blocks FROM ruled")
def query_counters_query(spark, sf):
    return policy.query_log_counters(policy.query_log_verdicts(_hosts(spark, sf), _domains(spark, sf), _policies(spark)))


# a page's number is its time; a domain is of a category from the first page that says so to the last, every fifth one for good
_HISTORY = f"""SELECT category, entry, source_ordinal, min(page_id) AS since, CASE WHEN min(page_id) % 5 > 0 THEN max(page_id) END AS until
  FROM ({_DOMAINS.removesuffix(" WHERE page_id % 5 = 0").replace("AS source_ordinal", "AS source_ordinal, page_id")}) GROUP BY category, entry, source_ordinal"""
RULED = (("AI Chat DLP", "allow_with_dlp", 0, 300), ("AI Chat DLP", "deny", 300, None), ("Phishing", "deny", 0, None),
         ("News", "allow", 0, 150), ("News", "deny", 200, 400), ("News", "allow", 350, None))
_RULED = "(VALUES " + ", ".join(f"('{c}', '{a}', {s}, {'NULL' if u is None else u})" for c, a, s, u in RULED) + ") p(category, action, since, until)"
_AT_TIME = f"""WITH hosts AS ({_HOSTS}), hist AS (SELECT lower(trim(entry)) AS entry, category, source_ordinal, since, until FROM ({_HISTORY})),
  keys AS (SELECT *, regexp_replace(entry, '^\\.', '') AS key, starts_with(entry, '.') AS wide FROM hist),
  found AS (SELECT page_id, category, source_ordinal, length(host) - length(key) AS gap FROM hosts
    JOIN keys ON (host = key OR (wide AND ends_with(host, '.' || key))) AND since <= page_id AND (until IS NULL OR page_id < until)),
  cat AS (SELECT hosts.*, f.category FROM hosts LEFT JOIN (
    SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY gap, source_ordinal, category) = 1) f USING (page_id)),
  rule AS (SELECT page_id, action FROM cat JOIN {_RULED} USING (category) WHERE since <= page_id AND (until IS NULL OR page_id < until)
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY since DESC) = 1)
  SELECT page_id, host, category, CASE WHEN category IS NOT NULL AND coalesce(action, 'deny') = 'deny' THEN 'NXDOMAIN' ELSE 'forward' END AS verdict
  FROM cat LEFT JOIN rule USING (page_id)"""


def _history(spark, sf):
    """The domain list with times, and the policies of each time."""
    rows = _entries(_hosts(spark, sf)).withColumn("_at", F.col("page_id").cast("bigint"))
    first, last = F.min("_at"), F.max("_at")
    domains = rows.groupBy("category", "entry", "source_ordinal").agg(first.alias("since"), F.when(first % 5 > 0, last).alias("until"))
    return domains, spark.createDataFrame(list(RULED), "category string, action string, since bigint, until bigint")


@query("p6_query_log_at", _AT_TIME)
def query_log_at_query(spark, sf):
    rows = policy.query_log_verdicts_at(_hosts(spark, sf), *_history(spark, sf), ts="page_id")
    return rows.select("page_id", "host", "category", "verdict")


# requests carry the planted document of the same number, under a mode and a path in turn
MODES = ("block", "mask", "bypass", "mask")
TAILS = ("/chat", "/v1/PREPARE/x", "/send", "/ces/v1", "/ping", "/upload")
_REQUESTS = _LOOKUP + f""", req AS (SELECT page_id, host, action, {_pick_sql(MODES, "(page_id // 3)")} AS mode, path || {_pick_sql(TAILS, "(page_id // 7)")} AS path,
  CASE WHEN page_id % 17 = 0 THEN 0 ELSE 1 END AS body_bytes, page_id % 13 <> 0 AS encoding_ok FROM ruled),
  tele AS (SELECT *, regexp_matches(lower(path), '/prepare|/ping|/telemetry|/ces/|/lat/r') AS telemetry FROM req),
  route AS (SELECT *, CASE WHEN action = 'deny' THEN 'denied' WHEN action <> 'allow_with_dlp' THEN 'pass'
    WHEN mode = 'bypass' OR telemetry OR body_bytes = 0 THEN 'pass' WHEN mode = 'mask' AND NOT encoding_ok THEN 'unsupported_encoding'
    WHEN mode = 'mask' THEN 'redact' ELSE 'scan' END AS route FROM tele)
"""


def _requests(spark, sf):
    rows = policy.check_domain(_hosts(spark, sf), _domains(spark, sf), _policies(spark))
    return rows.select(
        "page_id", "host", "action", _pick(MODES, F.floor(F.col("page_id") / 3)).alias("mode"),
        F.concat("path", _pick(TAILS, F.floor(F.col("page_id") / 7))).alias("path"),
        F.when(F.col("page_id") % 17 == 0, 0).otherwise(1).alias("body_bytes"), (F.col("page_id") % 13 != 0).alias("encoding_ok"))


@query("p7_request_verdicts", _REQUESTS + "SELECT page_id, host, action, mode, path, route FROM route")
def request_query(spark, sf):
    rows = _requests(spark, sf)
    route = policy.request_route(*[F.col(c) for c in ("action", "mode", "path", "body_bytes", "encoding_ok")])
    return rows.select("page_id", "host", "action", "mode", "path", route.alias("route"))


@query("p8_telemetry_path", _REQUESTS + "SELECT page_id, telemetry FROM tele")
def telemetry_query(spark, sf):
    return _requests(spark, sf).select("page_id", policy.is_telemetry_path(F.col("path")).alias("telemetry"))


# policies of many tenants: one category per customer
ACTS = ("allow", "deny", "allow_with_dlp", "redact")
_CURRENT = f"SELECT c_name AS category, {_pick_sql(ACTS[:3], 'c_custkey')} AS action FROM customer WHERE c_custkey % 5 <> 0"
_DESIRED = f"SELECT c_name AS category, {_pick_sql(ACTS, '(c_custkey // 3)')} AS action FROM customer WHERE c_custkey % 7 <> 0"


def _tenant_policies(spark, sf):
    c = table(spark, sf, "customer")
    current = c.filter("c_custkey % 5 <> 0").select(F.col("c_name").alias("category"), _pick(ACTS[:3], F.col("c_custkey")).alias("action"))
    desired = c.filter("c_custkey % 7 <> 0").select(
        F.col("c_name").alias("category"), _pick(ACTS, F.floor(F.col("c_custkey") / 3)).alias("action"))
    return current, desired


_PLAN = "(VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in policy.PLANS["extra"].items()) + ") p(category, action)"
_SEGMENTS = f"SELECT CASE WHEN c_custkey % 10 < 3 THEN {_pick_sql(('AI Chat DLP', 'AI Code Blocked', 'Other'), 'c_custkey')} || '' ELSE c_name END AS category, c_custkey FROM customer"


@query("p9_protection_plan", f"""SELECT category, coalesce(p.action, c.action) AS action FROM
  (SELECT category, any_value(action) AS action FROM (SELECT category, 'deny' AS action FROM ({_SEGMENTS})) GROUP BY category) c
  FULL JOIN {_PLAN} USING (category)""")
def protection_plan_query(spark, sf):
    c = table(spark, sf, "customer")
    shared = _pick(("AI Chat DLP", "AI Code Blocked", "Other"), F.col("c_custkey"))
    category = F.when(F.col("c_custkey") % 10 < 3, shared).otherwise(F.col("c_name"))
    current = c.select(category.alias("category"), F.lit("deny").alias("action")).distinct()
    return policy.protection_plan(current, "extra")


_RANK = "CASE {c} WHEN 'deny' THEN 3 WHEN 'redact' THEN 2 WHEN 'allow_with_dlp' THEN 1 ELSE 0 END"


@query("p10_policy_diff", f"""SELECT category, have, want, {_RANK.format(c='want')} < {_RANK.format(c='have')} AS relaxation FROM (
  SELECT d.category, coalesce(c.action, '') AS have, d.action AS want FROM ({_DESIRED}) d LEFT JOIN ({_CURRENT}) c USING (category)) WHERE have <> want""")
def policy_diff_query(spark, sf):
    return policy.policy_diff(*_tenant_policies(spark, sf))


@query("p11_policy_apply", f"""SELECT category, coalesce(d.action, c.action) AS action FROM ({_CURRENT}) c
  FULL JOIN (SELECT * FROM ({_DESIRED}) WHERE action <> 'redact') d USING (category)""")
def policy_apply_query(spark, sf):
    return policy.policy_apply(*_tenant_policies(spark, sf))


def _setting(i, shift, zero):
    return f"CAST(CASE WHEN (c_custkey + {i}) % {zero} = 0 THEN 0 ELSE (c_custkey * {i + 3} + {shift}) % 5 END AS INTEGER)"


_SETTINGS = [f"SELECT c_custkey AS tenant, {', '.join(f'{_setting(i, shift, zero)} AS {s}' for i, s in enumerate(policy.SETTINGS))} FROM customer"
             for shift, zero in ((1, 1000000), (2, 3))]


def _settings(spark, sf, shift, zero):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("tenant"), *[F.expr(_setting(i, shift, zero)).alias(s) for i, s in enumerate(policy.SETTINGS)])


def _long(sql, name):
    return " UNION ALL ".join(f"SELECT tenant, '{s}' AS setting, {s} AS {name} FROM ({sql})" for s in policy.SETTINGS)


_GIVEN = " OR ".join(f"{s} <> 0" for s in policy.SETTINGS)


@query("p10_settings_diff", f"""SELECT tenant, setting, have, want FROM ({_long(_SETTINGS[0], 'have')})
  JOIN ({_long(f'SELECT * FROM ({_SETTINGS[1]}) WHERE {_GIVEN}', 'want')}) USING (tenant, setting) WHERE have <> want""")
def settings_diff_query(spark, sf):
    return policy.settings_diff(_settings(spark, sf, 1, 1000000), _settings(spark, sf, 2, 3), ["tenant"])


@query("p12_merge_profile", f"""SELECT c.tenant, {', '.join(f'coalesce(nullif(o.{s}, 0), c.{s}) AS {s}' for s in policy.SETTINGS)}
  FROM ({_SETTINGS[0]}) c LEFT JOIN (SELECT * FROM ({_SETTINGS[1]}) WHERE tenant % 9 <> 0) o USING (tenant)""")
def merge_profile_query(spark, sf):
    profile = _settings(spark, sf, 2, 3).withColumn("name", F.when(F.col("tenant") % 9 == 0, " ").otherwise("managed"))
    return policy.merge_profile(_settings(spark, sf, 1, 1000000), profile, ["tenant"])


@query("p13_manifest_delta", """SELECT name, sha256, missing FROM (
  SELECT m.name, m.sha256, f.name IS NULL AS missing, coalesce(sha256(f.content) = lower(m.sha256), false) AS same FROM (
    SELECT CASE WHEN doc_id % 19 = 0 THEN '../' ELSE '' END || 'rule_' || doc_id || '.txt' AS name,
      CASE WHEN doc_id % 23 = 0 THEN 'short' WHEN doc_id % 4 = 0 THEN sha256(text || '!') ELSE upper(sha256(text)) END AS sha256 FROM documents) m
  LEFT JOIN (SELECT 'rule_' || doc_id || '.txt' AS name, text AS content FROM documents WHERE doc_id % 6 <> 0) f USING (name)
  WHERE NOT contains(m.name, '/') AND NOT starts_with(m.name, '.') AND length(m.sha256) = 64) WHERE NOT same""")
def manifest_delta_query(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    key, name = F.col("doc_id"), F.concat(F.lit("rule_"), F.col("doc_id").cast("string"), F.lit(".txt"))

    def digest(text):
        return F.sha2(text.cast("binary"), 256)

    manifest = docs.select(
        F.concat(F.when(key % 19 == 0, "../").otherwise(""), name).alias("name"),
        F.when(key % 23 == 0, "short").when(key % 4 == 0, digest(F.concat("text", F.lit("!")))).otherwise(F.upper(digest(F.col("text")))).alias("sha256"))
    files = docs.filter("doc_id % 6 <> 0").select(name.alias("name"), F.col("text").alias("content"))
    return policy.manifest_delta(manifest, files)


@query("p14_new_hosts", f"""SELECT DISTINCT host FROM (SELECT CASE WHEN page_id % 10 = 0 THEN 'localhost' WHEN page_id % 10 = 1 THEN 'a b.org'
  ELSE ' ' || upper(host) END AS h, lower(trim(h)) AS host FROM ({_HOSTS}))
  WHERE regexp_full_match(host, '[a-z0-9.-]+') AND contains(host, '.') AND host NOT IN (SELECT host FROM ({_HOSTS}) WHERE page_id % 3 = 0)""")
def new_hosts_query(spark, sf):
    hosts = _hosts(spark, sf)
    remote = hosts.select(F.when(F.col("page_id") % 10 == 0, "localhost").when(F.col("page_id") % 10 == 1, "a b.org").otherwise(
        F.concat(F.lit(" "), F.upper("host"))).alias("host"))
    return policy.new_hosts(remote, hosts.filter("page_id % 3 = 0").select("host")).distinct()
