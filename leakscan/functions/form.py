"""Percent-encoding and form bodies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def query_escape(value: Column) -> Column:
    """Percent-encoding of a form value: space as '+', unreserved characters kept."""
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def path_escape(value: Column) -> Column:
    """Percent-encoding of a path segment."""
    out = F.replace(query_escape(value), F.lit("+"), F.lit("%20"))
    for code, ch in (("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3A", ":"), ("%3D", "="), ("%40", "@")):
        out = F.replace(out, F.lit(code), F.lit(ch))
    return out


def form_pairs(body: Column) -> Column:
    """Struct (pairs, whole): decoded (name, pos, value) in order of name.

    A body that is no well-formed form is one pair without a name that holds all
    of it, decoded if that is possible; ``whole`` says so.
    """
    raw = F.filter(F.split(body, "&"), lambda p: p != "")

    def half(p: Column, name: bool) -> Column:
        eq = F.position(F.lit("="), p)
        if name:
            return F.try_url_decode(F.when(eq > 0, F.substring(p, F.lit(1), eq - 1)).otherwise(p))
        return F.try_url_decode(F.when(eq > 0, F.substring(p, eq + 1, F.length(p))).otherwise(F.lit("")))

    pairs = F.transform(raw, lambda p, i: F.struct(half(p, True).alias("name"), i.alias("pos"), half(p, False).alias("value")))
    broken = F.contains(body, F.lit(";")) | F.exists(pairs, lambda p: p["name"].isNull() | p["value"].isNull())
    one = F.array(F.struct(F.lit("").alias("name"), F.lit(0).alias("pos"), F.coalesce(F.try_url_decode(body), body).alias("value")))
    return F.struct(F.when(broken, one).otherwise(F.array_sort(pairs)).alias("pairs"), broken.alias("whole"))


def form_text(body: Column) -> Column:
    """The values of a form body in order of name, one per line; the body itself if it has none."""
    values = F.array_join(F.transform(form_pairs(body)["pairs"], lambda p: p["value"]), "\n")
    # a line break is written before a value only once something was written
    values = F.regexp_replace(values, r"\A\n+", "")
    return F.when(values == "", body).otherwise(values)
