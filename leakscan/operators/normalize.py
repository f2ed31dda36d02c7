"""Canonical text of every record, computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leakscan.functions.normalize import append_decoded_base64, is_odd, nfkc, strip_and_fold
from leakscan.operators.bind import bind


def normalize_content(records: DataFrame, content: str = "content", to: str = "canonical") -> DataFrame:
    """Adds column ``to``; rows and their partitioning stay as they are."""
    text = F.coalesce(F.col(content), F.lit(""))
    marked = bind(records, _odd=is_odd(text))
    folded = bind(marked, _folded=strip_and_fold(text, F.col("_odd")))
    composed = folded.withColumn("_folded", nfkc(F.col("_folded"), F.col("_odd")))
    return bind(composed, **{to: append_decoded_base64(F.col("_folded"))}).drop("_folded", "_odd")
