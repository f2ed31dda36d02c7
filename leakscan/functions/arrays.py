"""Array helpers built from Spark's higher-order functions."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

_BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Lambda bodies get no common-subexpression elimination, so an expensive
    value is bound as the only element of an array.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def constant(values: Sequence[str]) -> Column:
    """A constant array of strings, sent to the JVM in one piece."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def chunks(values: Column, size: int = _BLOCK) -> Column:
    """Cut an array into an array of arrays of at most ``size`` elements."""
    last = F.floor((F.size(values) - 1) / F.lit(size)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda b: F.slice(values, b * size + 1, F.lit(size)),
    )


def prefix_sums(values: Column) -> Column:
    """Inclusive running totals of an ``array<bigint>``.

    Appending in a fold copies the array, so totals are built per block of 64
    and offset by the block starts: close to linear where one fold is quadratic.
    """

    def append_total(acc: Column, x: Column) -> Column:
        return F.array_append(acc, F.element_at(acc, -1) + x)

    def totals(start: Column, block: Column) -> Column:
        return F.slice(F.aggregate(block, F.array(start), append_total), 2, _BLOCK)

    def over_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + x))
        starts = F.aggregate(sums, F.array(F.lit(0).cast("bigint")), append_total)
        return let(starts, lambda s: F.flatten(F.transform(blocks, lambda b, i: totals(F.get(s, i), b))))

    empty = F.array().cast("array<bigint>")
    return F.when(F.size(values) > 0, let(chunks(values), over_blocks)).otherwise(empty)


def pack_span(start: Column, end: Column) -> Column:
    """One bigint per span, so that duplicates are removed by hashing."""
    return F.shiftleft(start.cast("bigint"), 32) + end.cast("bigint")


def span_start(span: Column) -> Column:
    return F.shiftright(span, 32)


def span_end(span: Column) -> Column:
    return span.bitwiseAND(F.lit(4294967295).cast("bigint"))
