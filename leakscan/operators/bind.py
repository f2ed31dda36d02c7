"""Compute a costly column exactly once."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

MOST_EXPRESSIONS = 64
_expressions: dict[tuple, tuple[Any, Column]] = {}


def expression(owner: Any, key: Hashable, build: Callable[[], Column]) -> Column:
    """The column that ``build`` makes for ``owner`` under ``key``, made once.

    A scan's expressions are large trees of the same shape each time; putting
    one together takes longer than planning it.
    """
    name = (id(owner), key)
    if name not in _expressions:
        while len(_expressions) >= MOST_EXPRESSIONS:
            _expressions.pop(next(iter(_expressions)))
        _expressions[name] = (owner, build())  # the owner is kept, so its id stays its own
    return _expressions[name][1]


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Like ``withColumns``, but later filters cannot re-evaluate the expressions.

    The optimizer copies an alias into any filter pushed below it. A generated
    column is opaque to that, and generating one row per row moves no data.
    """
    return bind_fields(df, F.struct(*[expr.alias(name) for name, expr in columns.items()]), *columns)


def bind_fields(df: DataFrame, struct: Column, *replaced: str) -> DataFrame:
    """Adds the fields of ``struct`` as columns, computed once; a NULL struct gives NULLs.

    Later steps then read plain columns: field access of a struct column by
    several generators in a row defeats Spark's nested column pruning.
    """
    return df.select(*[c for c in df.columns if c not in replaced], F.inline(F.array(struct)))
