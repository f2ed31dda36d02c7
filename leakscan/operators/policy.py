"""Hosts joined with domain lists and category policies, and changes to policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leakscan.operators.lookup import lookup

# Policy actions from loose to strict, and what the store accepts.
ACTION_RANK = {"allow": 0, "allow_with_dlp": 1, "redact": 2, "deny": 3}
ACTIONS = ("allow", "allow_with_dlp", "deny")
TELEMETRY_PATHS = ("/prepare", "/ping", "/telemetry", "/ces/", "/lat/r")
PLANS = {
    "extra": {"AI Chat DLP": "allow_with_dlp", "AI Chat Blocked": "allow_with_dlp", "AI Code Blocked": "allow_with_dlp"},
    "light": {"AI Chat DLP": "deny", "AI Chat Blocked": "deny", "AI Code Blocked": "deny"},
}
SETTINGS = ("threshold_critical", "threshold_high", "threshold_medium", "threshold_low", "hotword_boost",
            "entropy_boost", "entropy_penalty", "exclusion_penalty", "multi_match_boost")


def normalise_domain(text: Column) -> Column:
    """Bare lower-case domain of what an admin typed; NULL if it is none."""
    bare = F.lower(F.trim(text, F.lit(" \t\n\x0b\x0c\r\x85\xa0")))
    bare = F.regexp_replace(F.regexp_replace(bare, r"\Ahttp://", ""), r"\Ahttps://", "")
    bare = F.regexp_replace(bare, r"(?s)[/?#].*", "")
    return F.when((bare != "") & ~bare.rlike("[ \t]"), bare)


def domain_index(domains: DataFrame) -> DataFrame:
    """One row per domain (key, exact, below): its category, and that of names below it.

    ``.x.com`` covers x.com and everything below; of several sources the first wins.
    """
    entry = F.lower(F.trim("entry"))
    base = F.regexp_replace(entry, r"\A\.", "")
    first = F.struct("source_ordinal", "category")
    rows = domains.select(base.alias("key"), entry.startswith(".").alias("wide"), first.alias("first")).filter("key <> ''")
    return rows.groupBy("key").agg(
        F.min("first")["category"].alias("exact"),
        F.min(F.when(F.col("wide"), F.col("first")))["category"].alias("below"),
    )


def lookup_domain(hosts: DataFrame, domains: DataFrame, host: str = "host") -> DataFrame:
    """Adds ``category`` (NULL if none): the exact entry, else the longest parent that covers names below it.

    Each distinct host is looked up once, whatever its share of the rows.
    """
    name = F.lower(F.regexp_replace(F.trim(F.col(host)), r"\.\z", ""))
    keyed = hosts.withColumn("_name", name)
    labels = F.split("_name", r"\.")
    suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    parents = keyed.select("_name").distinct().select("_name", F.posexplode(suffixes).alias("level", "key")).filter("key <> ''")
    found = lookup(parents, domain_index(domains), ["key"], "inner").withColumn(
        "category", F.when(F.col("level") == 0, F.col("exact")).otherwise(F.col("below"))
    )
    best = found.filter("category IS NOT NULL").groupBy("_name").agg(F.min_by("category", "level").alias("category"))
    return lookup(keyed, best, ["_name"]).select(*hosts.columns, "category")


def check_domain(hosts: DataFrame, domains: DataFrame, policies: DataFrame, host: str = "host") -> DataFrame:
    """Adds ``category`` and ``action``: allow without a category, deny without a policy for it."""
    found = lookup_domain(hosts, domains, host)
    ruled = lookup(found, policies.select("category", "action"), ["category"])
    action = F.when(F.col("category").isNull(), "allow").otherwise(F.coalesce("action", F.lit("deny")))
    return ruled.select(*hosts.columns, "category", action.alias("action"))


def is_categorized(hosts: DataFrame, domains: DataFrame, host: str = "host") -> DataFrame:
    """Rows whose host is in any list."""
    return lookup_domain(hosts, domains, host).filter("category IS NOT NULL").select(*hosts.columns)


def apply_domain_overrides(changes: DataFrame) -> DataFrame:
    """Allow and block lists after a log of changes (ts, op, list, domain).

    The latest change to a domain decides, so the lists never share one. Lists
    have no limit: one aggregate per domain, whatever their length.
    """
    valid = changes.withColumn("domain", normalise_domain(F.col("domain"))).filter(
        F.col("domain").isNotNull() & ((F.col("op") == "remove") | F.col("list").isin("allow", "block"))
    )
    latest = valid.groupBy("domain").agg(F.max(F.struct("ts", "op", "list")).alias("c"))
    return latest.filter(F.col("c.op") == "add").select(F.col("c.list").alias("list"), "domain")


def rejected_overrides(changes: DataFrame) -> DataFrame:
    bad_list = (F.col("op") == "add") & ~F.coalesce(F.col("list").isin("allow", "block"), F.lit(False))
    return changes.filter(normalise_domain(F.col("domain")).isNull() | bad_list)


def query_log_verdicts(log: DataFrame, domains: DataFrame, policies: DataFrame, host: str = "host") -> DataFrame:
    """Adds ``verdict`` to a name-lookup log: NXDOMAIN where policy denies, else forward."""
    checked = check_domain(log, domains, policies, host)
    return checked.withColumn("verdict", F.when(F.col("action") == "deny", "NXDOMAIN").otherwise("forward"))


def _in_force(history: Column, at: Column) -> Column:
    """Entries of an array that hold at a time: from ``since`` on, and before ``until`` if that is given."""
    return F.filter(history, lambda h: (h["since"] <= at) & F.coalesce(at < h["until"], F.lit(True)))


def lookup_domain_at(hosts: DataFrame, domains: DataFrame, ts: str = "ts", host: str = "host") -> DataFrame:
    """:func:`lookup_domain` by the entries that hold at ``ts`` of each row.

    ``domains`` also has ``since`` and ``until`` (NULL: still in force). A distinct host takes along
    the history of its own and its parents' entries, so rows are not moved for it. A row
    without a time has no category.
    """
    entry = F.lower(F.trim("entry"))
    history = domains.select(
        F.regexp_replace(entry, r"\A\.", "").alias("key"),
        F.struct(entry.startswith(".").alias("wide"), "source_ordinal", "category", "since", "until").alias("e")).filter("key <> ''")
    index = history.groupBy("key").agg(F.collect_set("e").alias("entries"))
    keyed = hosts.withColumn("_name", F.lower(F.regexp_replace(F.trim(F.col(host)), r"\.\z", "")))
    labels = F.split("_name", r"\.")
    suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    parents = keyed.select("_name").distinct().select("_name", F.posexplode(suffixes).alias("level", "key")).filter("key <> ''")
    covering = F.filter("entries", lambda e: (F.col("level") == 0) | e["wide"])
    found = lookup(parents, index, ["key"], "inner").select("_name", F.transform(covering, lambda e: F.struct(
        F.col("level").alias("level"), e["source_ordinal"].alias("source_ordinal"), e["category"].alias("category"),
        e["since"].alias("since"), e["until"].alias("until"))).alias("entries"))
    per_name = found.groupBy("_name").agg(F.flatten(F.collect_list("entries")).alias("_history"))
    return lookup(keyed, per_name, ["_name"]).select(
        *hosts.columns, F.array_min(_in_force(F.col("_history"), F.col(ts)))["category"].alias("category"))


def query_log_verdicts_at(log: DataFrame, domains: DataFrame, policies: DataFrame, ts: str = "ts", host: str = "host") -> DataFrame:
    """:func:`query_log_verdicts` by the domains and policies that hold at each row's own time.

    Both tables have ``since`` and ``until``. A late row is judged by the versions of its time, and
    a repeated batch gives what it gave before. Of several policies of a category the latest counts.
    """
    found = lookup_domain_at(log, domains, ts, host)
    history = policies.groupBy("category").agg(F.collect_set(F.struct("since", "until", "action")).alias("_policies"))
    ruled = lookup(found, history, ["category"])
    action = F.array_max(_in_force(F.col("_policies"), F.col(ts)))["action"]
    decided = F.when(F.col("category").isNull(), "allow").otherwise(F.coalesce(action, F.lit("deny")))
    judged = ruled.select(*log.columns, "category", decided.alias("action"))
    return judged.withColumn("verdict", F.when(F.col("action") == "deny", "NXDOMAIN").otherwise("forward"))


def query_log_counters(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.count("*").alias("dns_queries"), F.count_if(F.col("verdict") == "NXDOMAIN").alias("dns_blocks"))


def is_telemetry_path(path: Column) -> Column:
    low = F.lower(path)
    found = F.lit(False)
    for part in TELEMETRY_PATHS:
        found = found | F.contains(low, F.lit(part))
    return found


def request_route(action: Column, mode: Column, path: Column, body_bytes: Column, encoding_ok: Column) -> Column:
    """What happens to a request: denied, pass, redact, scan, or blocked for an unreadable encoding."""
    return (
        F.when(action == "deny", "denied")
        .when(action != "allow_with_dlp", "pass")
        .when((mode == "bypass") | is_telemetry_path(path) | (F.coalesce(body_bytes, F.lit(0)) == 0), "pass")
        .when((mode == "mask") & ~encoding_ok, "unsupported_encoding")
        .when(mode == "mask", "redact")
        .otherwise("scan")
    )


def protection_plan(policies: DataFrame, plan: str) -> DataFrame:
    """Policies after a preset: its categories are set, all others stay."""
    spark = policies.sparkSession
    preset = spark.createDataFrame(list(PLANS[plan].items()), "category string, action string")
    return policy_apply(policies, preset)


def policy_apply(current: DataFrame, desired: DataFrame) -> DataFrame:
    """Current policies with the desired ones put over them; unknown actions are left out."""
    wanted = desired.filter(F.col("action").isin(*ACTIONS)).select("category", F.col("action").alias("_wanted"))
    return current.join(wanted, "category", "full_outer").select("category", F.coalesce("_wanted", "action").alias("action"))


def policy_diff(current: DataFrame, desired: DataFrame) -> DataFrame:
    """Categories the desired policies would change, and whether that loosens them (no policy ranks as allow)."""
    ranks = F.create_map(*[F.lit(x) for pair in ACTION_RANK.items() for x in pair])

    def rank(action: str) -> Column:
        return F.coalesce(F.try_element_at(ranks, F.col(action)), F.lit(0))

    have = current.select("category", F.col("action").alias("have"))
    want = desired.select("category", F.col("action").alias("want"))
    joined = want.join(have, "category", "left").withColumn("have", F.coalesce("have", F.lit("")))
    return joined.filter("want <> have").select("category", "have", "want", (rank("want") < rank("have")).alias("relaxation"))


def settings_diff(current: DataFrame, desired: DataFrame, key: list[str]) -> DataFrame:
    """Numeric settings that differ, one row each; a desired row that is zero throughout was not given."""
    given = F.lit(False)
    for c in SETTINGS:
        given = given | (F.col(c) != 0)

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.unpivot(key, list(SETTINGS), "setting", name)

    return long(current, "have").join(long(desired.filter(given), "want"), [*key, "setting"]).filter("have <> want")


def merge_profile(current: DataFrame, profile: DataFrame, key: list[str]) -> DataFrame:
    """Settings with the non-zero ones of a valid profile over them."""
    over = valid_profiles(profile).select(*key, *[F.col(c).alias(f"_{c}") for c in SETTINGS])
    joined = current.join(over, key, "left")
    return joined.select(*key, *[F.coalesce(F.nullif(F.col(f"_{c}"), F.lit(0)), F.col(c)).alias(c) for c in SETTINGS])


def valid_profiles(profile: DataFrame) -> DataFrame:
    """Profiles with a name, known category actions and no negative threshold."""
    ok = F.trim(F.coalesce(F.col("name"), F.lit(""))) != ""
    for c in SETTINGS[:4]:
        ok = ok & (F.coalesce(F.col(c), F.lit(0)) >= 0)
    if "categories" in profile.columns:
        actions = F.map_values(F.coalesce(F.col("categories"), F.create_map().cast("map<string,string>")))
        ok = ok & F.forall(actions, lambda a: F.coalesce(a.isin(*ACTIONS), F.lit(False)))
    return profile.filter(ok)


def valid_manifest(manifest: DataFrame) -> DataFrame:
    name = F.coalesce(F.col("name"), F.lit(""))
    return manifest.filter((name != "") & ~name.rlike(r"[/\\]") & ~name.startswith(".") & (F.length("sha256") == 64))


def manifest_delta(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest files that are missing or differ; ``files`` has name and content. Invalid names are left out."""
    have = files.select("name", F.sha2(F.col("content").cast("binary"), 256).alias("_have"))
    joined = valid_manifest(manifest).join(have, "name", "left")
    same = F.coalesce(F.col("_have") == F.lower("sha256"), F.lit(False))
    return joined.filter(~same).select(*manifest.columns, F.col("_have").isNull().alias("missing"))


def new_hosts(remote: DataFrame, known: DataFrame, host: str = "host") -> DataFrame:
    """Host-shaped remote hosts that are not known yet."""
    clean = F.lower(F.trim(F.col(host)))
    shaped = remote.withColumn(host, clean).filter(F.col(host).rlike(r"\A[a-z0-9.-]+\z") & F.contains(F.col(host), F.lit(".")))
    return shaped.join(known.select(F.lower(host).alias(host)).distinct(), host, "left_anti")
