"""Canonical text: undo the usual ways of hiding a secret from a pattern.

The order is fixed: drop invisible characters, fold look-alike letters, NFKC,
then append decoded base64. It is not idempotent (a second pass would append
the decoded text again), so a record is normalised exactly once.
"""

from __future__ import annotations

import string
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from leakscan.functions.arrays import let

# The invisible characters that are dropped.
ZERO_WIDTH = "\u200B\u200C\u200D\u200E\u200F\u2060\uFEFF\u00AD\u180E\u061C"

# Look-alike letters and the Latin letters they stand for.
HOMOGLYPHS = (
    ("АВЕКМНОРСТХУЅІЈѴԚ", "ABEKMHOPCTXYSIJVQ"),  # Cyrillic capitals
    ("аеорсхуѕіјѵԛ", "aeopcxysijvq"),  # Cyrillic small letters
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),  # Greek capitals
    ("αορτν", "aoptv"),  # Greek small letters
)

# The least run of the base64 pass, and the share of printable bytes that makes it a text.
BASE64_MIN_RUN = 16
BASE64_PRINTABLE = 0.80

_FOLD_FROM = "".join(pair[0] for pair in HOMOGLYPHS)
_FOLD_TO = "".join(pair[1] for pair in HOMOGLYPHS)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


# Java walks a character class range by range, so rows are first tested against few, wide ranges.
_BEYOND_LATIN = r"[^\x{0}-\x{AC}\x{AE}-\x{36F}]"
_BEYOND_PLAIN_LATIN = r"[^\x{0}-\x{9F}\x{BF}-\x{131}]"

# Ranges in which no character is changed by NFKC or can join the one before it
# (tests check them against the Unicode tables). Other characters go to Python.
NFKC_INERT = (
    (0x0000, 0x009F), (0x00BF, 0x0131), (0x0134, 0x013E), (0x0391, 0x03A9), (0x03B1, 0x03C9), (0x0400, 0x0481),
    (0x2012, 0x2016), (0x2018, 0x201E), (0x2020, 0x2022), (0x3001, 0x3029), (0x3041, 0x3096), (0x30A1, 0x30FA),
    (0x4E00, 0x9FFF), (0xAC00, 0xD7A3),
)
_BEYOND_INERT = "[^" + "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in NFKC_INERT) + "]"


def strip_zero_width(text: Column) -> Column:
    hidden = ~is_ascii(text) & text.rlike(_BEYOND_LATIN)
    return F.when(hidden, F.translate(text, ZERO_WIDTH, "")).otherwise(text)


def fold_homoglyphs(text: Column) -> Column:
    foreign = ~is_ascii(text) & text.rlike(_BEYOND_LATIN)
    return F.when(foreign, F.translate(text, _FOLD_FROM, _FOLD_TO)).otherwise(text)


def is_odd(text: Column) -> Column:
    """Whether the text holds any character that stripping, folding or NFKC could touch."""
    return ~is_ascii(text) & text.rlike(_BEYOND_PLAIN_LATIN)


def strip_and_fold(text: Column, odd: Column) -> Column:
    """Both of the above in one pass, for odd texts: ``translate`` drops what has no counterpart."""
    return F.when(odd, F.translate(text, _FOLD_FROM + ZERO_WIDTH, _FOLD_TO)).otherwise(text)


@arrow_udf(StringType())
def _nfkc_batch(text: pa.Array) -> pa.Array:
    # not by way of pa.array or pandas, which a worker would load for this alone
    made = pa.lib.StringBuilder()
    for s in text:
        made.append(unicodedata.normalize("NFKC", s.as_py()) if s.is_valid else None)
    return made.finish()


def nfkc(text: Column, odd: Column | None = None) -> Column:
    """NFKC; only rows that can change are handed to Python, the rest pass as NULL."""
    needed = (is_odd(text) if odd is None else odd) & text.rlike(_BEYOND_INERT)
    return F.coalesce(_nfkc_batch(F.when(needed, text)), text)


def _printable_share(data: Column) -> Column:
    view = F.decode(data, "ISO-8859-1")
    return F.length(F.regexp_replace(view, r"[^\x20-\x7E]", "")) / F.octet_length(data)


def decoded_base64(text: Column) -> Column:
    """Decoded printable base64 runs, newline-joined; '' when there is none.

    Decoded bytes that are not UTF-8 become U+FFFD, since Spark strings are text.
    """
    # A run holds no blank, so only words long enough are searched: cutting at blanks is several
    # times cheaper than a regex over all of the text.
    words = F.filter(F.split(text, " "), lambda w: F.length(w) >= BASE64_MIN_RUN)
    return let(F.array_join(words, " "), lambda long: F.when(long == "", "").otherwise(_decoded_runs(long)))


def _decoded_runs(text: Column) -> Column:
    # whole runs only, in fours; single characters in a class are one table look-up in Java
    letter = f"[{string.ascii_letters}{string.digits}+/=]"
    run = f"(?<!{letter})(?:{letter}{{4}}){{{BASE64_MIN_RUN // 4},}}+(?!{letter})"
    runs = F.regexp_extract_all(text, F.lit(run), F.lit(0))
    decoded = F.filter(
        F.transform(runs, lambda r: F.try_to_binary(r, F.lit("base64"))),
        lambda d: d.isNotNull() & (F.octet_length(d) > 0) & (_printable_share(d) >= BASE64_PRINTABLE),
    )

    return F.array_join(F.transform(decoded, lambda d: F.make_valid_utf8(d.cast("string"))), "\n")


def append_decoded_base64(text: Column) -> Column:
    return let(decoded_base64(text), lambda d: F.when(d == "", text).otherwise(F.concat(text, F.lit("\n"), d)))
