"""Replace found secrets by tokens; block what cannot be redacted safely."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType

from leakscan.functions.arrays import chunks, let, pack_span, prefix_sums, span_end, span_start
from leakscan.functions.context import source_columns, source_struct
from leakscan.functions.form import form_pairs, path_escape, query_escape
from leakscan.functions.text import byte_slice, is_placeholder_shape, is_public_example
from leakscan.operators.bind import bind, bind_fields
from leakscan.operators.match import MatchOptions, find_matches, prefix_offsets
from leakscan.operators.normalize import normalize_content
from leakscan.operators.ordered import with_carry
from leakscan.operators.scan import scan
from leakscan.operators.score import ScoreConfig, add_signals, best_verdict, pattern_results
from leakscan.sources.rules import UNCATEGORIZED, RuleSet

# Fixed value: the token of a region that covers several secrets.
MIXED_TOKEN = "**"

FEW_SECRETS = 16  # so many are looked for one by one
_HEAD = 8  # bytes of a literal that single out its places
_SWEEP = 1 << 20  # places that are looked at together

_SPAN = "struct<start:bigint,end:bigint,token:string,pattern_name:string>"


def category_slug(category: Column, name: Column) -> Column:
    label = F.when((category == "") | (category == UNCATEGORIZED) | category.isNull(), name).otherwise(category)
    slug = F.trim(F.regexp_replace(F.upper(label), "[^A-Z0-9]+", "_"), F.lit("_"))
    return F.when(slug == "", "REDACTED").otherwise(slug)


def spellings(value: Column) -> Column:
    """The value as it may stand in a text: plain or percent-encoded."""
    return F.array_distinct(F.array(value, query_escape(value), path_escape(value), F.replace(value, F.lit("/"), F.lit("%2F"))))


def merge_sorted_spans(spans: Column) -> Column:
    """Spans in order of start, with those that overlap or touch made one; unlike tokens become ``**``."""
    none = F.array().cast(f"array<{_SPAN}>")
    nothing = F.lit(None).cast(_SPAN)

    def join(a: Column, b: Column) -> Column:
        same = a["token"] == b["token"]
        return F.struct(a["start"].alias("start"), F.greatest(a["end"], b["end"]).alias("end"),
                        F.when(same, a["token"]).otherwise(MIXED_TOKEN).alias("token"),
                        F.when(same, a["pattern_name"]).otherwise("").alias("pattern_name"))

    def add(acc: Column, s: Column) -> Column:
        state = lambda done, open_: F.struct(done.alias("done"), open_.alias("open"))
        return (
            F.when(acc["open"].isNull(), state(acc["done"], s))
            .when(s["start"] <= acc["open"]["end"], state(acc["done"], join(acc["open"], s)))
            .otherwise(state(F.array_append(acc["done"], acc["open"]), s))
        )

    def add_chunk(acc: Column, chunk: Column) -> Column:
        folded = F.aggregate(chunk, F.struct(none.alias("done"), acc["open"].alias("open")), add)
        return let(folded, lambda f: F.struct(F.array_append(acc["done"], f["done"]).alias("done"), f["open"].alias("open")))

    start = F.struct(F.array().cast(f"array<array<{_SPAN}>>").alias("done"), nothing.alias("open"))
    finish = lambda acc: F.concat(F.flatten(acc["done"]), F.array(acc["open"]))
    return F.when(F.size(spans) > 0, F.aggregate(chunks(spans), start, add_chunk, finish)).otherwise(none)


def allocate_tokens(text: Column, secrets: Column) -> Column:
    """Map from secret key to token. ``secrets`` is an array of (key, slug) in order.

    Tokens count from 1 per slug, over numbers whose token is not in the text
    already. The numbers that stand after a label rule out themselves and all
    that they begin with, so one search of the text tells what is taken.
    """
    def of_slug(slug: Column) -> Column:
        keys = F.transform(F.filter(secrets, lambda s: s["slug"] == slug), lambda s: s["key"])
        label = F.concat(F.lit("KEY_"), slug, F.lit("_"))

        def tokens(p: Column) -> Column:
            numbers = F.transform(F.sequence(F.lit(1), F.size(p["keys"]) + F.size(p["taken"])), lambda n: n.cast("string"))
            free = F.when(F.size(p["taken"]) == 0, numbers).otherwise(F.array_except(numbers, p["taken"]))
            chosen = F.transform(F.slice(free, F.lit(1), F.size(p["keys"])), lambda n: F.concat(label, n))
            return F.arrays_zip(p["keys"].alias("key"), chosen.alias("token"))

        # looked at from every place, as one label may begin within another
        after = F.regexp_extract_all(text, F.concat(F.lit("(?="), label, F.lit("([1-9][0-9]{0,18}))")), F.lit(1))
        beginnings = F.flatten(F.transform(F.array_distinct(after), lambda n: F.transform(
            F.sequence(F.lit(1), F.length(n)), lambda k: F.substring(n, F.lit(1), k))))
        taken = F.when(F.contains(text, label), F.array_distinct(beginnings)).otherwise(F.array().cast("array<string>"))
        return let(F.struct(keys.alias("keys"), taken.alias("taken")), tokens)

    slugs = F.array_distinct(F.transform(secrets, lambda s: s["slug"]))
    pairs = F.flatten(F.transform(slugs, of_slug))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["key"], p["token"])))


def secrets_of(hits: Column, canonical: Column, rules: RuleSet) -> Column:
    """Distinct secrets (key, name, slug, value) by pattern order, then first position; known examples are none."""
    def of_hit(data: Column, hit: Column) -> Column:
        def distinct(spans: Column) -> Column:
            values = F.transform(spans, lambda s: byte_slice(data, span_start(s), span_end(s)))
            real = F.filter(values, lambda v: (v != "") & ~is_public_example(v) & ~is_placeholder_shape(v))
            # distinct as text, which hashes, rather than as structs
            return F.array_distinct(F.transform(real, lambda v: F.concat(hit["ordinal"].cast("string"), F.lit(":"), v)))

        return let(F.array_sort(hit["spans"]), distinct)

    def described(key: Column) -> Column:
        at = F.position(F.lit(":"), key)
        return let(
            rules.literal(),
            lambda all_rules: let(
                F.get(all_rules, F.substring(key, F.lit(1), at - 1).cast("int")),
                lambda rule: F.struct(
                    key.alias("key"), rule["name"].alias("pattern_name"),
                    category_slug(rule["category"], rule["name"]).alias("slug"),
                    F.substring(key, at + 1, F.length(key)).alias("value")),
            ),
        )

    ordered = F.array_sort(hits, lambda a, b: (a["ordinal"] - b["ordinal"]).cast("int"))
    keys = let(canonical.cast("binary"), lambda data: F.flatten(F.transform(ordered, lambda h: of_hit(data, h))))
    return F.transform(keys, described)


def _spans_one_by_one(text: Column, secrets: Column) -> Column:
    """For each secret the packed spans of its spellings, each looked for by itself."""
    def occurrences(s: Column) -> Column:
        def at(target: Column) -> Column:
            width = F.octet_length(target).cast("bigint")
            return F.transform(prefix_offsets(text, target), lambda o: pack_span(o, o + width))

        present = F.filter(spellings(s["value"]), lambda t: F.contains(text, t))
        return F.flatten(F.transform(present, at))

    return F.transform(secrets, occurrences)


def literal_spans(data: bytes, groups: list[list[bytes]]) -> list[list[int]]:
    """For each group of literals (none empty) the packed spans of all of them in ``data``; those of one literal do not overlap.

    One sweep for all: places are kept where the next eight bytes (fewer for a
    shorter literal) begin some literal, and there a table by length and bytes
    is asked. What it takes grows with the text and with the number of literals,
    not with their product.
    """
    literals = {t for group in groups for t in group}
    heads: dict[int, set[bytes]] = {}
    lengths: dict[bytes, set[int]] = {}
    for t in literals:
        heads.setdefault(min(len(t), _HEAD), set()).add(t[:_HEAD])
        lengths.setdefault(t[:_HEAD], set()).add(len(t))
    known = {size: np.sort(np.array([int.from_bytes(h, "little") for h in begins], np.uint64)) for size, begins in heads.items()}
    found: dict[bytes, list[int]] = {t: [] for t in literals}
    padded = data + bytes(_HEAD)
    for start in range(0, len(data), _SWEEP):
        places = min(_SWEEP, len(data) - start)
        piece = np.frombuffer(padded, np.uint8, places + _HEAD - 1, start)
        eight = np.zeros(places, np.uint64)
        for i in range(_HEAD):
            eight |= piece[i : i + places].astype(np.uint64) << np.uint64(8 * i)
        for size, begins in known.items():
            here = (eight & np.uint64((1 << 8 * size) - 1))[: max(0, len(data) - start - size + 1)]
            at = np.minimum(np.searchsorted(begins, here), len(begins) - 1)
            for p in (np.flatnonzero(begins[at] == here) + start).tolist():
                for n in lengths.get(data[p : p + size], ()):
                    spans = found.get(data[p : p + n])
                    if spans is not None and p + n <= len(data) and (not spans or spans[-1] & 0xFFFFFFFF <= p):
                        spans.append(p << 32 | p + n)
    return [[span for t in dict.fromkeys(group) for span in found[t]] for group in groups]


@arrow_udf(ArrayType(ArrayType(LongType())))
def _literal_spans_batch(data: pa.Array, groups: pa.Array) -> pa.Array:
    kind = pa.list_(pa.list_(pa.int64()))
    if data.null_count == len(data):
        return pa.nulls(len(data), kind)
    return pa.array([literal_spans(d.as_py(), gs.as_py()) if d.is_valid else None for d, gs in zip(data, groups)], kind)


def with_secret_spans(records: DataFrame, text: Column, secrets: str, few: int = FEW_SECRETS) -> DataFrame:
    """Adds ``_spans_of``: for each of ``secrets`` the packed spans where one of its spellings stands in ``text``.

    Few secrets are looked for one by one. The texts that hold more go through
    one sweep in Python; all other rows pass there as NULL.
    """
    many = F.size(secrets) > few
    groups = F.transform(F.col(secrets), lambda s: F.transform(spellings(s["value"]), lambda t: t.cast("binary")))
    swept = records.withColumn("_swept", _literal_spans_batch(F.when(many, text.cast("binary")), F.when(many, groups)))
    return bind(swept, _spans_of=F.when(many, F.col("_swept")).otherwise(_spans_one_by_one(text, F.col(secrets)))).drop("_swept")


def locate_secrets(text: Column, secrets: Column, spans_of: Column) -> Column:
    """Struct (found, spans): every occurrence of every secret under its token, and whether each has one."""
    def named(secret: Column, token: Column, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(
            span_start(s).alias("start"), span_end(s).alias("end"), token.alias("token"), secret["pattern_name"].alias("pattern_name")))

    def of_all(token_of: Column) -> Column:
        return F.array_sort(F.flatten(F.transform(secrets, lambda s, i: let(
            F.element_at(token_of, s["key"]), lambda token: named(s, token, F.get(spans_of, i))))))

    keys = F.transform(secrets, lambda s: F.struct(s["key"].alias("key"), s["slug"].alias("slug")))
    return F.struct(F.forall(spans_of, lambda o: F.size(o) > 0).alias("found"), let(allocate_tokens(text, keys), of_all).alias("spans"))


def splice_spans(text: Column, merged: Column) -> Column:
    """Struct (redacted_content, redactions); offsets are byte offsets in the new text."""
    size = F.octet_length(text).cast("bigint")

    def build(data: Column, spans: Column) -> Column:
        def gap(i: Column) -> Column:
            before = F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(spans, i - 1)["end"])
            return byte_slice(data, before, F.get(spans, i)["start"])

        pieces = F.transform(spans, lambda s, i: F.concat(gap(i), s["token"]))
        rest = byte_slice(data, F.element_at(spans, -1)["end"], size)

        def with_offsets(p: Column) -> Column:
            ends = prefix_sums(F.transform(p, lambda x: F.octet_length(x).cast("bigint")))
            return let(ends, lambda e: F.struct(
                F.concat(F.array_join(p, ""), rest).alias("redacted_content"),
                F.transform(spans, lambda s, i: F.struct(
                    s["pattern_name"].alias("pattern_name"), s["token"].alias("token"),
                    (F.get(e, i) - F.octet_length(s["token"])).alias("start"), F.get(e, i).alias("end"))).alias("redactions")))

        return let(pieces, with_offsets)

    return let(text.cast("binary"), lambda data: build(data, merged))


def _whole(options: MatchOptions) -> MatchOptions:
    """What is given out must be free of secrets, so nothing of a text may be left unseen."""
    return replace(options, windowed=False, large_filter=False)


def _located(records: DataFrame, text: Column) -> DataFrame:
    """``found`` and ``spans`` for ``_secrets``, NULL where that is NULL."""
    placed = with_secret_spans(records, text, "_secrets")
    secrets, spans_of = F.col("_secrets"), F.col("_spans_of")
    return bind_fields(placed, F.when(secrets.isNotNull(), locate_secrets(text, secrets, spans_of))).drop("_secrets", "_spans_of")


def redact(records: DataFrame, rules: RuleSet, config: ScoreConfig = ScoreConfig(), options: MatchOptions = MatchOptions(),
           content: str = "content", source: str | None = None) -> DataFrame:
    """Adds the verdict, ``action`` (allow, redact or block), ``redacted_content`` and ``redactions``.

    A blocked text whose every secret stands in it verbatim is rebuilt with
    tokens and scanned again; if that scan blocks, or a secret exists in the
    normalised text only, the action is block and no text is given out. Whole
    texts are searched, whatever ``options`` say of windows and large texts.
    """
    options = _whole(options)
    prepared, context = records, None
    if source is not None:
        fields = records.schema[source].dataType.names
        prepared, context = records.withColumns(source_columns(F.col(source), fields)), source_struct()
    normal = normalize_content(prepared, content, "_canonical")
    found = add_signals(find_matches(normal, rules, options, "_canonical"), rules, "_canonical")
    judged = bind_fields(found, best_verdict(pattern_results(F.col("signals"), config.struct(), context), "_first_")).drop("signals")
    text = F.coalesce(F.col(content), F.lit(""))
    named = bind(judged, _secrets=F.when(F.col("_first_blocked"), secrets_of(F.col("hits"), F.col("_canonical"), rules))).drop("hits", "_canonical")
    located = _located(named, text)
    usable = F.coalesce(F.col("found"), F.lit(False)) & (F.size("spans") > 0)
    spliced = bind_fields(located, F.when(usable, let(merge_sorted_spans(F.col("spans")), lambda m: splice_spans(text, m))),
                          "redacted_content", "redactions").drop("found", "spans")
    # rows without a redacted text cost the second scan nothing
    verified = scan(spliced, rules, config, options, "redacted_content", source)
    clean = F.col("redacted_content").isNotNull() & ~F.col("blocked")
    action = F.when(~F.col("_first_blocked"), "allow").when(clean, "redact").otherwise("block")
    out = bind(verified, action=action)
    given = F.when(F.col("action") == "allow", F.col(content)).when(F.col("action") == "redact", F.col("redacted_content"))
    return out.select(
        *records.columns, *[F.col(f"_first_{c}").alias(c) for c in ("blocked", "pattern_name", "score")], "action",
        given.alias("redacted_content"), F.when(F.col("action") == "redact", F.col("redactions")).alias("redactions"))


def located_secrets(records: DataFrame, rules: RuleSet, options: MatchOptions = MatchOptions(), content: str = "content") -> DataFrame:
    """Adds ``found`` and ``spans``: where the secrets of each record stand in its own text, and under which tokens."""
    normal = normalize_content(records, content, "_canonical")
    hits = find_matches(normal, rules, _whole(options), "_canonical")
    text = F.coalesce(F.col(content), F.lit(""))
    located = _located(bind(hits, _secrets=secrets_of(F.col("hits"), F.col("_canonical"), rules)), text)
    return located.select(*records.columns, "found", "spans")


def merge_spans(spans: DataFrame, key: str = "record_id", slot: int = 1 << 16) -> DataFrame:
    """Merged spans of a span table (key, start, end, token, pattern_name), by slots of the text."""
    order = ["start", "end", "token", "pattern_name"]
    exact = spans.groupBy(key, *order).agg(F.lit(1).alias("_one")).drop("_one")
    reached = with_carry(exact, [key], order, F.floor(F.col("start") / slot), maxes=["end"])
    opened = reached.withColumn("_island", F.when(
        F.col("max_end").isNull() | (F.col("start") > F.col("max_end")), F.col("start"))).drop("max_end")
    named = with_carry(opened, [key], order, F.floor(F.col("start") / slot), lasts=["_island"]).withColumn(
        "_island", F.coalesce("_island", "last__island"))
    one = F.min("token") == F.max("token")
    return named.groupBy(key, "_island").agg(
        F.max("end").alias("end"), F.when(one, F.min("token")).otherwise(MIXED_TOKEN).alias("token"),
        F.when(one, F.min("pattern_name")).otherwise("").alias("pattern_name"),
    ).withColumnRenamed("_island", "start").select(key, "start", "end", "token", "pattern_name")


def redact_form_fields(bodies: DataFrame, rules: RuleSet, body: str = "body", key: str = "record_id",
                       config: ScoreConfig = ScoreConfig(), options: MatchOptions = MatchOptions()) -> DataFrame:
    """Adds ``redacted_body`` and ``is_redacted`` to form bodies, field by field, keys in order.

    A field that cannot be redacted stays as it was, unlike a whole text. A body
    that is no well-formed form is one field. Only fields that changed are
    shuffled; the others are re-encoded in place.
    """
    text = F.coalesce(F.col(body), F.lit(""))
    parsed = bind_fields(bodies, form_pairs(text)).withColumnsRenamed({"pairs": "_pairs", "whole": "_whole"})
    fields = parsed.select(key, F.inline("_pairs")).select(key, "pos", F.col("value").alias("content"))
    changed = redact(fields, rules, config, options).filter("action = 'redact'")
    # one map per body of the fields that changed
    per_body = changed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("pos", "redacted_content"))).alias("_new"))
    joined = parsed.join(per_body, key, "left")
    whole = F.try_element_at(F.col("_new"), F.lit(0))
    encoded = F.array_join(F.transform(F.col("_pairs"), lambda p: F.concat(
        query_escape(p["name"]), F.lit("="), query_escape(F.coalesce(F.try_element_at(F.col("_new"), p["pos"]), p["value"])))), "&")
    rebuilt = F.when(~F.col("_whole"), encoded).when(F.try_url_decode(text).isNotNull(), query_escape(whole)).otherwise(whole)
    return joined.select(*bodies.columns, F.when(F.col("_new").isNotNull(), rebuilt).otherwise(F.col(body)).alias("redacted_body"),
                         F.col("_new").isNotNull().alias("is_redacted"))


def request_outcomes(routes: DataFrame, bodies: DataFrame, rules: RuleSet, key: str = "record_id", content: str = "content",
                     config: ScoreConfig = ScoreConfig(), options: MatchOptions = MatchOptions(), form: str | None = None) -> DataFrame:
    """What became of requests routed by ``policy.request_route``: denied, pass, redacted or blocked, and by which pattern.

    ``content`` is a body's text, inflated and unwrapped. Only bodies whose route
    asks for it are scanned, and only those to be masked go through the second
    scan. ``form`` names a column that holds the body of a form and is NULL for
    others: a form is masked field by field and passes if no field could be.
    """
    joined = bodies.join(routes.select(key, "route"), key)
    masked = joined.filter("route = 'redact'")
    forms = None
    if form is not None:
        fields = masked.filter(F.col(form).isNotNull()).select(key, form)
        forms = redact_form_fields(fields, rules, form, key, config, options).select(
            key, F.when(F.col("is_redacted"), "redacted").otherwise("pass").alias("outcome"), F.lit("").alias("pattern_name"))
        masked = masked.filter(F.col(form).isNull())
    seen = joined.filter("route = 'scan'")
    after = F.when(F.col("action") == "allow", "pass").when(F.col("action") == "redact", "redacted").otherwise("blocked")
    columns = [key, "outcome", "pattern_name"]
    fixed = routes.filter(F.col("route").isin("denied", "pass", "unsupported_encoding")).select(
        key, F.when(F.col("route") == "unsupported_encoding", "blocked").otherwise(F.col("route")).alias("outcome"),
        F.when(F.col("route") == "unsupported_encoding", "Unsupported Compression").otherwise("").alias("pattern_name"))
    scanned = scan(seen, rules, config, options, content).withColumn("outcome", F.when(F.col("blocked"), "blocked").otherwise("pass"))
    redacted = redact(masked, rules, config, options, content).withColumn("outcome", after)
    told = fixed.unionByName(scanned.select(*columns)).unionByName(redacted.select(*columns))
    return told if forms is None else told.unionByName(forms)
