"""Benchmark decontamination by templates: leaks stay found when their numbers, names or units change.

Texts become rows of tokens in which numbers, units after numbers, and names
(capitalised words within a sentence) are typed placeholders. Windows of tokens
are hashed and joined to those of the benchmark's items. Where windows line up
with an item, its placeholders are checked: each value of the item must stand
for one value of the document throughout, else the likeness is one of form only.

Everything is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leakscan.llm.common import settled, whole

WINDOW = 8  # tokens; an item of fewer is one window of its own length
SHORTEST = 3  # items with fewer tokens than this match only texts that have no other tokens
COVER = 0.3  # part of an item's different windows that a document must hold
RUN = 13  # tokens in one alignment that are a leak whatever part of the item they are
BROADCAST_ROWS = 100_000  # about 10 MB of windows or hits; beyond it, joins are shuffled
NAME_MARK, UNIT_MARK = "\x01", "\x02"
# Units of measurement.
UNITS = (
    "km", "cm", "mm", "m", "kg", "mg", "g", "lb", "lbs", "oz", "mi", "ft", "in", "yd", "l", "ml", "s", "ms", "min", "h", "hr", "hrs",
    "meters", "metres", "miles", "feet", "inches", "yards", "grams", "kilograms", "pounds", "ounces", "liters", "litres", "seconds",
    "minutes", "hours", "days", "weeks", "months", "years", "dollars", "cents", "euros", "percent", "degrees",
)
NAME = r"([\p{Ll}0-9,;:] )(\p{Lu}\p{Ll})"
UNIT = "([0-9] ?)(" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + r")([^\p{L}\p{N}]|$)"
TOKEN = r"[\x01\x02]?[\p{L}\p{M}]+|[0-9]+(?:[.,:][0-9]+)*"


def tokens(text: Column) -> Column:
    """Words and numbers in lower case; names and units begin with their marks."""
    plain = F.replace(F.replace(text, F.lit(NAME_MARK), F.lit(" ")), F.lit(UNIT_MARK), F.lit(" "))
    named = F.lower(F.regexp_replace(plain, NAME, f"$1{NAME_MARK}$2"))
    united = F.when(named.rlike("[0-9]"), F.regexp_replace(named, UNIT, f"$1{UNIT_MARK}$2$3")).otherwise(named)
    return F.regexp_extract_all(united, F.lit(TOKEN), F.lit(0))


def template(token: Column) -> Column:
    """The token, or the placeholder of its type; marks and digits sort before all letters."""
    return F.when(token >= ":", token).when(token >= "0", "<num>").when(token >= UNIT_MARK, "<unit>").otherwise("<name>")


def _windows(hashes: str, size: int) -> Column:
    """Hashes of all windows of ``size`` tokens, with their places."""
    at = F.col(hashes)
    fits = F.size(at) >= size if size >= SHORTEST else F.size(at) == size  # so short a window says something only of a whole text
    places = F.when(fits, F.sequence(F.lit(0), F.size(at) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(size), *[F.get(at, i + k) for k in range(size)]).alias("window")))


def _placed(texts: DataFrame, keep: list[str], sizes: list[int]) -> DataFrame:
    """``keep``, ``at`` and ``window`` for each window of the sizes; the token column is ``_tokens``."""
    hashed = texts.select(*keep, F.transform("_tokens", lambda t: F.xxhash64(template(t))).alias("_hashes"))
    found = F.concat(*[_windows("_hashes", s) for s in sizes]) if len(sizes) > 1 else _windows("_hashes", sizes[0])
    return hashed.select(*keep, F.inline(found))


def benchmark_windows(items: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Each different window of each item with its first place, ``size`` and ``of``, the item's count of them."""
    tokenised = items.where(F.col(text).isNotNull()).select(F.col(item).alias("item_id"), tokens(F.col(text)).alias("_tokens")).distinct()
    sized = tokenised.withColumn("size", F.least(F.size("_tokens"), F.lit(window))).where(F.col("size") > 0)
    parts = [
        _placed(sized.where(F.col("size") == s), ["item_id", "size"], [s]) for s in range(1, window + 1)
    ]
    placed = parts[0]
    for part in parts[1:]:
        placed = placed.unionByName(part)
    first = placed.groupBy("item_id", "size", "window").agg(F.min("at").alias("item_at"))
    counts = first.groupBy("item_id").agg(F.count("*").alias("of"))
    return first.join(counts, "item_id")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked for broadcast if a count finds no more than ``rows`` narrow rows in it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, cover: float = COVER, run: int | None = RUN) -> DataFrame:
    """Pairs of document and item: ``key``, ``_print`` (of the text), item_id, n_windows, of, coverage, kind.

    A pair is there if the windows that line up consistently with the item are
    at least ``cover`` of its different ones, or, unless ``run`` is None, if the windows of
    one such alignment hold that many tokens. An item without a full window is one
    window; one of fewer than ``SHORTEST`` tokens matches a text of just these. ``kind`` is "verbatim" if some
    alignment has all values unchanged, else "reparameterised". NULL and empty
    texts match nothing; repeated rows give one pair.
    """
    known = settled(benchmark_windows(items, window=window))
    sizes = sorted(r[0] for r in known.select("size").distinct().collect()) or [window]  # as many sizes as a window has tokens, at most
    named = docs.select(F.col(key).alias("_key"), F.xxhash64(whole(F.col(text))).alias("_print"), whole(F.col(text)).alias("_text"))
    tokenised = named.select("_key", "_print", tokens(F.col("_text")).alias("_tokens"))
    hits = settled(
        _placed(tokenised, ["_key", "_print"], sizes)
        .join(_small(known.select("window", "item_id", "item_at", "of"), BROADCAST_ROWS), "window")
        .groupBy("_key", "_print", "item_id", (F.col("at") - F.col("item_at")).alias("shift"), "item_at")
        .agg(F.first("of").alias("of"))
    )
    lined = hits.groupBy("_key", "_print", "item_id", "shift").agg(F.min("item_at").alias("low"), (F.max("item_at") + window).alias("high"), F.count("*").alias("line"))

    # the tokens of the documents that were hit, once for each; then the values of the placeholders side by side
    hit = hits.select(F.col("_key").alias("_hit_key"), F.col("_print").alias("_hit_print")).distinct()
    texts = named.join(_small(hit, BROADCAST_ROWS), _same("_key", "_hit_key") & (F.col("_print") == F.col("_hit_print")), "left_semi")
    doc_tokens = texts.dropDuplicates(["_key", "_print"]).select(
        F.col("_key").alias("_doc_key"), F.col("_print").alias("_doc_print"), tokens(F.col("_text")).alias("_doc_tokens"))
    item_tokens = items.where(F.col("text").isNotNull()).groupBy("item_id").agg(F.min("text").alias("_item_text")).select(
        "item_id", tokens(F.col("_item_text")).alias("_item_tokens"))
    from_here, length = F.greatest(F.col("low"), -F.col("shift")), F.col("high") - F.greatest(F.col("low"), -F.col("shift"))
    pairs = F.filter(
        F.arrays_zip(
            F.slice("_item_tokens", from_here + 1, length).alias("item"), F.slice("_doc_tokens", from_here + F.col("shift") + 1, length).alias("doc"),
        ),
        lambda p: (p["item"] < ":") & (template(p["item"]) == template(p["doc"])),
    )
    values = F.array_distinct(pairs)
    checked = (
        lined.join(doc_tokens, _same("_key", "_doc_key") & (F.col("_print") == F.col("_doc_print")))
        .join(item_tokens, "item_id")
        .select("_key", "_print", "item_id", "shift", "line", values.alias("values"))
        .select(
            F.col("_key").alias("_c_key"), F.col("_print").alias("_c_print"), F.col("item_id").alias("_c_item"), F.col("shift").alias("_c_shift"), "line",
            # consistent: no value of the item stands for two of the document
            (F.size("values") == F.size(F.array_distinct(F.transform("values", lambda p: p["item"])))).alias("consistent"),
            F.exists("values", lambda p: p["item"] != p["doc"]).alias("changed"),
        )
        .where("consistent")
    )
    same = _same("_key", "_c_key") & (F.col("_print") == F.col("_c_print")) & (F.col("item_id") == F.col("_c_item")) & (F.col("shift") == F.col("_c_shift"))
    found = hits.join(checked, same).groupBy("_key", "_print", "item_id").agg(
        F.countDistinct("item_at").alias("n_windows"), F.max("of").alias("of"), F.min("changed").alias("changed"), F.max("line").alias("line"))
    # so many different windows at one shift hold at least that many tokens
    long = F.lit(False) if run is None else F.col("line") + (window - 1) >= run
    return found.withColumn("coverage", F.col("n_windows") / F.col("of")).where((F.col("coverage") >= cover) | long).select(
        F.col("_key").alias(key), "_print", "item_id", "n_windows", "of", "coverage",
        F.when(F.col("changed"), "reparameterised").otherwise("verbatim").alias("kind"),
    )


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, item_id, n_windows, coverage and kind of each leak; texts under one key count together."""
    return matches(docs, items, key, text).groupBy(key, "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.max("coverage").alias("coverage"), F.max("kind").alias("kind"))


def without_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", run: int | None = RUN) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no leak; ``run`` as in :func:`matches`."""
    found = settled(matches(docs, items, key, text, run=run).select(F.col(key).alias("_leak_key"), F.col("_print").alias("_leak_print")).distinct())
    mine = F.xxhash64(whole(docs[text]))
    return docs.join(_small(found, BROADCAST_ROWS), docs[key].eqNullSafe(found["_leak_key"]) & (mine == found["_leak_print"]), "left_anti")
