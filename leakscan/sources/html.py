"""Code blocks of web pages, with what they say about themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_BLOCK = r"(?is)<pre\b[^>]*>.*?</pre\s*>|<code\b[^>]*>.*?</code\s*>"


def explode_code_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Pieces of each page (key, block, in_code_fence, language_hint, content), code and other text in turn.

    A piece of code is a ``pre`` or ``code`` element; its hint is the language
    class of the ``code`` element in it.
    """
    between = F.split(F.col(html), _BLOCK, -1)
    code = F.regexp_extract_all(F.col(html), F.lit(_BLOCK), F.lit(0))
    both = F.flatten(F.zip_with(between, code, lambda text, block: F.array(
        F.struct(F.lit(False).alias("in_code_fence"), text.alias("content")),
        F.struct(F.lit(True).alias("in_code_fence"), block.alias("content")))))
    pieces = F.filter(both, lambda p: p["content"].isNotNull() & (F.trim(p["content"]) != ""))
    rows = pages.select(key, F.posexplode(pieces).alias("block", "p")).select(key, "block", "p.*")
    tag = F.regexp_extract("content", r"(?is)<code\b[^>]*?\bclass\s*=\s*[\"']([^\"']*)", 1)
    hint = F.regexp_extract(tag, r"(?:\A|\s)language-([^\s]+)", 1)
    return rows.select(key, "block", "in_code_fence", F.when(F.col("in_code_fence"), hint).otherwise("").alias("language_hint"), "content")
