"""Counters, histories and documents made of verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leakscan.operators.lookup import lookup
from leakscan.session import settle

# Counters, lengths of histories, finding document.
COUNTERS = ("dns_queries_total", "dns_blocks_total", "dlp_scans_total", "dlp_blocks_total", "tamper_detections_total")
KEEP_EVENTS = 500
DEFAULT_LIST = 50
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
SARIF_VERSION = "2.1.0"


def counters(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The five counters of events with a ``kind`` and, for scans and lookups, ``blocked``."""
    kind, blocked = F.col("kind"), F.coalesce(F.col("blocked"), F.lit(False))
    return events.groupBy(*by).agg(
        F.count_if(kind == "dns").alias("dns_queries_total"),
        F.count_if((kind == "dns") & blocked).alias("dns_blocks_total"),
        F.count_if(kind == "scan").alias("dlp_scans_total"),
        F.count_if((kind == "scan") & blocked).alias("dlp_blocks_total"),
        F.count_if(kind == "tamper").alias("tamper_detections_total"),
    )


def flushed_totals(deltas: DataFrame, resets: DataFrame, key: str = "agent") -> DataFrame:
    """Totals per agent: deltas are added up, and a reset sets all back to zero."""
    last = resets.groupBy(key).agg(F.max("ts").alias("_reset"))
    live = lookup(deltas, last, [key])
    after = F.col("_reset").isNull() | (F.col("ts") > F.col("_reset"))
    return live.groupBy(key).agg(*[F.sum(F.when(after, F.col(c)).otherwise(0)).alias(c) for c in COUNTERS])


def stats_export(snapshots: DataFrame, key: str = "agent") -> DataFrame:
    """Newest snapshot of every agent as the JSON it would export."""
    doc = F.struct("agent_version", "os_type", "os_arch", F.struct(*COUNTERS).alias("aggregate_counters"))
    newest = snapshots.groupBy(key).agg(F.max_by(doc, "ts").alias("d"), F.max("ts").alias("exported_at"))
    return newest.select(key, "exported_at", F.to_json("d").alias("payload"))


def block_event_log(events: DataFrame, owner: str = "owner", keep: int | None = None) -> DataFrame:
    """Blocks of owners who consented; with ``keep`` the newest of each owner, and no task keeps more before the shuffle."""
    consented = events.filter(F.coalesce(F.col("consent"), F.lit(False))).withColumn("action", F.lit("blocked"))
    if keep is None:
        return consented
    newest = Window.partitionBy(owner).orderBy(F.desc("event_id"))
    return consented.withColumn("_place", F.row_number().over(newest)).filter(F.col("_place") <= keep).drop("_place")


def list_events(log: DataFrame, limit: int = DEFAULT_LIST) -> DataFrame:
    """The newest ``limit`` events of a log."""
    if limit < 1:
        raise ValueError("a list has at least one event")
    return log.orderBy(F.desc("event_id")).limit(limit)


def findings(verdicts: DataFrame, file: str = "file") -> DataFrame:
    """Blocked files (file, blocked, pattern_name, score)."""
    return verdicts.filter("blocked").select(F.col(file).alias("file"), "blocked", "pattern_name", "score")


def findings_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.count("*").alias("scanned"), F.count_if("blocked").alias("blocked"))


def _with_commas(rows: DataFrame, order: list[str], line: str) -> DataFrame:
    """A comma before every line but the first, and ``position``, which follows the order.

    Rows are dealt by ranges, sorted and numbered where they lie, and written; the
    first is the one of the least number. So neither repeated rows nor missing keys
    are taken for it, and no key comes to the driver.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settle(dealt.withColumn("position", F.monotonically_increasing_id()))
    first = placed.agg(F.min("position").alias("position")).withColumn("_first", F.lit(True))  # one row
    told = placed.join(F.broadcast(first), "position", "left")
    return told.withColumn(line, F.concat(F.when(F.col("_first"), "").otherwise(","), F.col(line))).drop("_first")


def findings_lines(verdicts: DataFrame, file: str = "file") -> DataFrame:
    """The findings document as lines (section, sort_key, line, position).

    Sorted by section and position and written one after the other the lines are
    one JSON document; no task holds all findings. Repeated rows stay, and files
    without a name come first. The verdicts are read several
    times, so pass a written table (``session.settle``).
    """
    s, zero = findings_summary(verdicts), F.lit(0).cast("long").alias("position")
    head = s.select(F.lit(0).alias("section"), F.lit("").alias("sort_key"), F.concat(
        F.lit('{"scanned":'), F.col("scanned").cast("string"), F.lit(',"blocked":'), F.col("blocked").cast("string"),
        F.lit(',"findings":[')).alias("line"), zero)
    found = findings(verdicts, file)
    body = found.select(F.lit(1).alias("section"), F.col("file").alias("sort_key"),
                        F.to_json(F.struct("file", "blocked", "pattern_name", "score")).alias("line"))
    foot = s.select(F.lit(2).alias("section"), F.lit("").alias("sort_key"), F.lit("]}").alias("line"), zero)
    return head.unionByName(_with_commas(body, ["sort_key", "line"], "line")).unionByName(foot)


def sarif_level(score: Column) -> Column:
    return F.when(score >= 3, "error").otherwise("warning")


def sarif_results(found: DataFrame) -> DataFrame:
    """One SARIF result object per finding, as JSON."""
    region = F.struct(F.lit(1).alias("startLine"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    text = F.concat(F.coalesce("file", F.lit("")), F.lit(" has a match of "), F.coalesce("pattern_name", F.lit("")))
    result = F.struct(F.col("pattern_name").alias("ruleId"), sarif_level(F.col("score")).alias("level"),
                      F.struct(text.alias("text")).alias("message"), F.array(place).alias("locations"))
    return found.select("file", "pattern_name", F.to_json(result).alias("result"))


def sarif_lines(found: DataFrame, tool: str = "leakscan", uri: str = "", version: str = "dev") -> DataFrame:
    """A SARIF 2.1.0 document as lines (section, sort_key, line, position); see :func:`findings_lines`."""
    spark = found.sparkSession
    help_text = "This file holds what looks like a credential or personal data. Take it out, and replace it wherever it is in use."
    names = F.col("pattern_name")
    rule = F.struct(names.alias("id"), names.alias("name"),
                    F.struct(F.concat(F.lit("Match of "), names).alias("text")).alias("shortDescription"),
                    F.struct(F.lit(help_text).alias("text")).alias("help"))
    rules = found.select("pattern_name").distinct().select(
        F.lit(1).alias("section"), names.alias("sort_key"), F.to_json(rule).alias("line"))
    results = sarif_results(found).select(F.lit(3).alias("section"), F.col("file").alias("sort_key"), F.col("result").alias("line"))
    frame = spark.createDataFrame([
        (0, "", f'{{"$schema":"{SARIF_SCHEMA}","version":"{SARIF_VERSION}","runs":[{{"tool":{{"driver":'
                f'{{"name":"{tool}","informationUri":"{uri}","version":"{version}","rules":[', 0),
        (2, "", ']}},"results":[', 0),
        (4, "", "]}]}", 0),
    ], "section int, sort_key string, line string, position long")
    return (
        frame.unionByName(_with_commas(rules, ["sort_key"], "line"))
        .unionByName(_with_commas(results, ["sort_key", "line"], "line"))
    )


def write_lines(lines: DataFrame, path: str) -> None:
    """Part files that give the document when read in the order of their names."""
    lines.orderBy("section", "position").select("line").write.mode("overwrite").text(path)


def privacy_sweep(df: DataFrame, forbidden: list[str], name: str = "table") -> DataFrame:
    """Rows in which a text column (nested ones as JSON) holds a forbidden value, counted per column."""
    def holds(c: str) -> Column:
        text = F.col(f"`{c}`") if df.schema[c].dataType.typeName() == "string" else F.to_json(F.struct(F.col(f"`{c}`")))
        return F.exists(F.array(*[F.lit(v) for v in forbidden]), lambda v: F.contains(text, v))

    kinds = ("string", "struct", "array", "map")
    columns = [f.name for f in df.schema if f.dataType.typeName() in kinds]
    counts = df.agg(*[F.count_if(F.coalesce(holds(c), F.lit(False))).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "hits").select(F.lit(name).alias("table"), "column", "hits")


def diff_findings(verdicts: DataFrame) -> DataFrame:
    """Blocked files of scanned diffs, at the line of their first addition; a diff is blocked if it has one."""
    return verdicts.filter("blocked").select(
        "diff_id", "file", F.col("first_line").alias("line"), "blocked", "pattern_name", "score")
