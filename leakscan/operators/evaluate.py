"""How good a detector is: confusion matrices and comparisons of scan modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leakscan.functions.context import classify_path
from leakscan.functions.text import byte_slice

# Error budget of a release, and the length of an excerpt.
MAX_FALSE_POSITIVE_RATE = 0.10
MAX_FALSE_NEGATIVE_RATE = 0.05
EXCERPT = 200


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def confusion_matrix(labelled: DataFrame, group: str = "file") -> DataFrame:
    """Per ``group`` and in total (group NULL) of rows with ``must_block`` and ``blocked``."""
    want, got = F.col("must_block"), F.col("blocked")
    counts = labelled.rollup(group).agg(
        F.count_if(want & got).alias("tp"), F.count_if(~want & got).alias("fp"),
        F.count_if(~want & ~got).alias("tn"), F.count_if(want & ~got).alias("fn"),
    )
    rated = counts.withColumns({
        "precision": _rate(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": _rate(F.col("tp"), F.col("tp") + F.col("fn")),
        "fp_rate": _rate(F.col("fp"), F.col("fp") + F.col("tn")),
    })
    f1 = _rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rated.withColumn("f1", f1)


def within_budget(matrix: DataFrame, group: str = "file") -> DataFrame:
    """The total row of a confusion matrix against the error budget."""
    fn_rate = _rate(F.col("fn"), F.col("tp") + F.col("fn"))
    return matrix.filter(F.col(group).isNull()).select(
        "fp_rate", fn_rate.alias("fn_rate"),
        ((F.col("fp_rate") < MAX_FALSE_POSITIVE_RATE) & (fn_rate < MAX_FALSE_NEGATIVE_RATE)).alias("passed"),
    )


def mode_verdicts(compared: DataFrame, keep: tuple[str, ...] = ("path", "line_no")) -> DataFrame:
    """Long form (mode, blocked, pattern_name, score) of rows of ``compare_context``."""
    modes = F.array(*[
        F.struct(F.lit(m).alias("mode"), *[F.col(f"{m}_{c}").alias(c) for c in ("blocked", "pattern_name", "score")])
        for m in ("baseline", "context")
    ])
    return compared.select(*keep, F.inline(modes))


def mode_report(verdicts: DataFrame) -> DataFrame:
    """Blocks, records and block rate (percent) per mode."""
    return verdicts.groupBy("mode").agg(F.count_if("blocked").alias("blocks"), F.count("*").alias("scanned")).withColumn(
        "block_rate_pct", F.col("blocks") * 100.0 / F.col("scanned"))


def top_patterns(verdicts: DataFrame, k: int = 5) -> DataFrame:
    """The k patterns with the most blocks per mode, equal counts by name."""
    counts = verdicts.filter("blocked").groupBy("mode", "pattern_name").agg(F.count("*").alias("blocks"))
    place = F.row_number().over(Window.partitionBy("mode").orderBy(F.desc("blocks"), "pattern_name"))
    return counts.withColumn("place", place).filter(F.col("place") <= k)


def changed_blocks(compared: DataFrame) -> DataFrame:
    """Blocks of one mode that the other lacks, by path, line and pattern: ``suppressed`` or ``exposed``.

    Both verdicts of a record lie in one row, so no join is needed.
    """
    same = F.col("baseline_blocked") & F.col("context_blocked") & (F.col("baseline_pattern_name") == F.col("context_pattern_name"))

    def side(kind: str, mode: str) -> Column:
        return F.when(F.col(f"{mode}_blocked") & ~same, F.struct(
            F.lit(kind).alias("change"), F.col(f"{mode}_pattern_name").alias("pattern_name"), F.col(f"{mode}_score").alias("score")))

    changes = F.array_compact(F.array(side("suppressed", "baseline"), side("exposed", "context")))
    return compared.select("*", F.inline(changes)).withColumn("fp_likely", classify_path(F.col("path")) != "")


def block_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Blocks of ``left`` that ``right`` lacks, for verdicts of separate runs."""
    keys = ["path", "line_no", "pattern_name"]
    return left.filter("blocked").join(right.filter("blocked").select(*keys), keys, "left_anti")


def segmentation(compared: DataFrame) -> DataFrame:
    """Blocks on paths that are likely false positives and on the rest, per mode, with the percentage dropped."""
    likely = classify_path(F.col("path")) != ""
    a, b = F.col("baseline_blocked"), F.col("context_blocked")
    counts = compared.groupBy(F.when(likely, "fp_likely").otherwise("tp_candidate").alias("segment")).agg(
        F.count_if(a).alias("baseline_blocks"), F.count_if(b).alias("context_blocks"))
    drop = (F.col("baseline_blocks") - F.col("context_blocks")) * 100.0
    return counts.withColumn("drop_pct", _rate(drop, F.col("baseline_blocks")))


def excerpt(content: Column, size: int = EXCERPT) -> Column:
    """One line of at most ``size`` bytes; a character that the cut would split is left out."""
    head = byte_slice(content.cast("binary"), F.lit(0), F.lit(size - 3))
    cut = F.concat(F.regexp_replace(head, "\uFFFD{1,3}$", ""), F.lit("..."))
    short = F.when(F.octet_length(content) > size, cut).otherwise(content)
    return F.replace(short, F.lit("\t"), F.lit(" "))


def suppressed_dump(compared: DataFrame, content: str = "content") -> DataFrame:
    """Suppressed blocks on other than likely false-positive paths, with an excerpt, for a reader."""
    rows = changed_blocks(compared).filter((F.col("change") == "suppressed") & ~F.col("fp_likely"))
    return rows.select("path", "line_no", "pattern_name", "score", "fp_likely", excerpt(F.col(content)).alias("excerpt"))


def quantile_floor(df: DataFrame, value: str, quantiles: dict[str, float], splits: int = 1000) -> DataFrame:
    """Exact quantiles: the element at position floor((n - 1) * q) of the sorted values.

    Values are counted, the counts are cut into buckets of roughly equal weight,
    and only buckets, never rows, are summed in one place.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    bounds = df.agg(F.percentile_approx(value, [i / splits for i in range(1, splits)], 10_000).alias("b")).first()["b"] or []
    edges = F.array(*[F.lit(b) for b in sorted(set(bounds))]) if bounds else F.array(F.lit(0.0))
    # where the value falls among the sorted edges; the array is a constant of at most ``splits`` numbers
    bucketed = counts.withColumn("_bucket", F.size(F.filter(edges, lambda e: e < F.col(value))))
    sums = bucketed.groupBy("_bucket").agg(F.sum("n").alias("_in"))
    over = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    starts = sums.select("_bucket", F.coalesce(F.sum("_in").over(over), F.lit(0)).alias("_start"), "_in",
                         F.sum("_in").over(whole).alias("_total"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(q).alias("q")) for name, q in quantiles.items()])
    targets = starts.select("_bucket", "_start", "_in", F.inline(F.transform(
        wanted, lambda w: F.struct(w["name"].alias("quantile"), F.floor((F.col("_total") - 1) * w["q"]).alias("_at"))
    ))).filter((F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_start") + F.col("_in")))
    inside = Window.partitionBy("_bucket").orderBy(value)
    placed = bucketed.withColumn("_upto", F.sum("n").over(inside))
    hit = placed.join(F.broadcast(targets), "_bucket").filter(
        (F.col("_at") - F.col("_start") < F.col("_upto")) & (F.col("_at") - F.col("_start") >= F.col("_upto") - F.col("n")))
    return hit.select("quantile", F.col(value).alias("value"))


def every_nth(df: DataFrame, position: str, n: int = 100) -> DataFrame:
    """Rows whose position (from 0) is a multiple of ``n``: the sampling of latency measurements."""
    return df.filter(F.col(position) % n == 0)


def report_json(verdicts: DataFrame, k: int = 5) -> DataFrame:
    """One JSON document per mode: counts, block rate and top patterns."""
    tops = top_patterns(verdicts, k).groupBy("mode").agg(
        F.sort_array(F.collect_list(F.struct("place", "pattern_name", "blocks"))).alias("t"))
    joined = mode_report(verdicts).join(tops, "mode", "left")
    listed = F.transform(F.coalesce("t", F.array().cast("array<struct<place:int,pattern_name:string,blocks:bigint>>")),
                         lambda x: F.struct(x["pattern_name"].alias("name"), x["blocks"].alias("count")))
    doc = F.to_json(F.struct("blocks", "scanned", F.round("block_rate_pct", 4).alias("fp_rate_pct"), listed.alias("top_patterns")))
    return joined.select("mode", doc.alias("report"))
