"""One named query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from leakscan.llm import archive_sample, audit, bpe, copied, decontaminate, language, quality, repeats, sharding, simhash, tiff, token_count, turn_trie, warc
from leakscan.llm.common import table


def byte_vocabulary() -> tuple[list[bytes], str]:
    """Tokens by rank, and the pattern that splits a text before the merges; files are read on the driver only."""
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def op1_vector_bin_packing(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(table(spark, folder, "documents"), 16)


def op2_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.parse_records(archive_sample.archive(table(spark, folder, "pages")))
    return warc.resolve_revisits(records).select(
        "record_id", "url_key", F.unix_seconds("date").alias("date_seconds"), "outcome", "original_id", "payload_sha256", "payload_bytes",
        warc.header_lines(F.col("headers")).alias("header_lines"),
    )


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), *byte_vocabulary(), ["doc_id"])


def op4_tiff(spark: SparkSession, folder: str) -> DataFrame:
    return tiff.digests(table(spark, folder, "documents"))


def op5_compression_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, folder, "labels")))


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op7_repeated_windows(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents"))


def op8_cross_parsing_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.identify(docs, language.learn(docs))


def op9_whole_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = token_count.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return token_count.count_tokens(table(spark, folder, "documents"), vocabulary, ["doc_id"])


def op10_template_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_conversation_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.repaired(table(spark, folder, "conversations"))


def op12_countmin_windows(spark: SparkSession, folder: str) -> DataFrame:
    return copied.digests(table(spark, folder, "documents"))


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return turn_trie.conversation_nodes(table(spark, folder, "conversations"))


_OPERATORS = (
    op1_vector_bin_packing, op2_warc_revisits, op3_byte_bpe, op4_tiff, op5_compression_quality, op6_simhash, op7_repeated_windows,
    op8_cross_parsing_language, op9_whole_token_counts, op10_template_leaks,
    op11_conversation_audit, op12_countmin_windows, op13_conversation_trie,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {f.__name__: f for f in _OPERATORS} | {"pipeline": corpus_pipeline.token_ids}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_revisits": archive_sample.RESOLVED_SQL, "op10_template_leaks": decontaminate_sql(), "op11_conversation_audit": audit.SQL,
            "op12_countmin_windows": copied.SQL, "op13_conversation_trie": turn_trie.SQL}


def decontaminate_sql() -> str:
    """Template leaks on another engine, for items of at least a window's tokens and of any shorter size."""
    d, w = decontaminate, decontaminate.WINDOW
    mark = {c: f"chr({ord(c)})" for c in (d.NAME_MARK, d.UNIT_MARK)}

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def tokens(text: str) -> str:
        plain = f"replace(replace({text}, {mark[d.NAME_MARK]}, ' '), {mark[d.UNIT_MARK]}, ' ')"
        named = f"lower(regexp_replace({plain}, {quoted(d.NAME)}, '\\1' || {mark[d.NAME_MARK]} || '\\2', 'g'))"
        united = f"regexp_replace({named}, {quoted(d.UNIT)}, '\\1' || {mark[d.UNIT_MARK]} || '\\2\\3', 'g')"
        return f"regexp_extract_all({united}, {quoted(d.TOKEN)})"

    def template(x: str) -> str:
        return f"CASE WHEN {x} >= ':' THEN {x} WHEN {x} >= '0' THEN '<num>' WHEN {x} >= {mark[d.UNIT_MARK]} THEN '<unit>' ELSE '<name>' END"

    def windows(source: str, keys: str, size: str) -> str:
        return (f"SELECT {keys}, {size} AS size, unnest(range(1, len(tpl) - {size} + 2)) AS place, "
                f"unnest(list_transform(range(1, len(tpl) - {size} + 2), lambda i: array_to_string(tpl[i:i + {size} - 1], ' '))) AS w "
                f"FROM {source} WHERE len(tpl) >= {size} AND ({size} >= {d.SHORTEST} OR len(tpl) = {size})")

    return f"""
WITH items AS (
  SELECT item_id, tok, list_transform(tok, lambda x: {template('x')}) AS tpl FROM (SELECT item_id, {tokens('text')} AS tok FROM benchmark)
), texts AS (
  SELECT DISTINCT doc_id, text FROM documents
), docs AS (
  SELECT doc_id, text, tok, list_transform(tok, lambda x: {template('x')}) AS tpl FROM (SELECT doc_id, text, {tokens('text')} AS tok FROM texts)
), known AS (
  SELECT item_id, size, w, min(place) AS item_at FROM ({windows('(SELECT *, least(len(tpl), ' + str(w) + ') AS n FROM items)', 'item_id', 'n')})
  WHERE size > 0 GROUP BY ALL
), sizes AS (
  SELECT DISTINCT size AS n FROM known
), counted AS (
  SELECT *, count(*) OVER (PARTITION BY item_id) AS of_all FROM known
), hits AS (
  SELECT DISTINCT doc_id, text, item_id, place - item_at AS shift, item_at, of_all
  FROM ({windows('docs, sizes', 'doc_id, text', 'n')}) JOIN counted USING (size, w)
), lined AS (
  SELECT doc_id, text, item_id, shift, min(item_at) AS low, max(item_at) + {w} - 1 AS high, count(*) AS line FROM hits GROUP BY ALL
), valued AS (
  SELECT l.*, unnest(range(greatest(low, 1 - shift), high + 1)) AS i FROM lined l
), slots AS (
  SELECT v.doc_id, v.text, v.item_id, v.shift, t.tok[v.i] AS item_value, x.tok[v.i + v.shift] AS doc_value
  FROM valued v JOIN items t USING (item_id) JOIN docs x ON x.doc_id = v.doc_id AND x.text = v.text
  WHERE t.tok[v.i] < ':' AND t.tpl[v.i] = x.tpl[v.i + v.shift]
), checked AS (
  SELECT l.doc_id, l.text, l.item_id, l.shift, max(l.line) AS line, coalesce(bool_or(s.item_value <> s.doc_value), false) AS changed
  FROM lined l LEFT JOIN slots s USING (doc_id, text, item_id, shift) GROUP BY ALL
  HAVING count(DISTINCT s.item_value) = count(DISTINCT (s.item_value, s.doc_value)) FILTER (s.item_value IS NOT NULL)
), found AS (
  SELECT doc_id, text, item_id, count(DISTINCT item_at) AS n_windows, max(of_all) AS of_all, min(changed) AS changed, max(line) AS line
  FROM hits JOIN checked USING (doc_id, text, item_id, shift) GROUP BY ALL
)
SELECT doc_id, item_id, max(n_windows) AS n_windows, max(n_windows / of_all) AS coverage,
  max(CASE WHEN changed THEN 'reparameterised' ELSE 'verbatim' END) AS kind
FROM found WHERE n_windows / of_all >= {d.COVER} OR line + {w} - 1 >= {d.RUN} GROUP BY doc_id, item_id
"""
