"""The registered queries and the pipeline on small tables."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from compare import compare, duck
from samples import odd_table
from test_llm_dedup import plain_repeats
from test_llm_shingles import plain_kept

import corpus_pipeline
from leakscan.llm import bpe, queries

DATA = "/root/testdata/sf0.001"


class Registry:
    QUERIES, ORACLES = queries.queries(), queries.oracle_sql()


def test_every_operator_has_its_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in Registry.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in Registry.QUERIES and set(Registry.ORACLES) <= set(Registry.QUERIES)


@pytest.mark.parametrize("name", [n for n in Registry.QUERIES if n != "pipeline"])
def test_query(spark, name):
    assert compare(spark, duck(DATA), Registry, name, DATA) is None
    if name not in ("op2_warc_revisits", "op10_template_leaks", "op11_conversation_audit", "op13_conversation_trie"):
        docs = spark.read.parquet(f"{DATA}/documents.parquet")
        assert Registry.QUERIES[name](spark, DATA).count() == docs.count()


def staged(spark, docs, folder):
    """Every stage's rows, as lists."""
    made = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        made.append((docs.columns, docs.collect()))
        docs = spark.createDataFrame(made[-1][1], docs.schema)
    return made


def test_stages_keep_columns_and_clean_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    made = staged(spark, docs, DATA)
    assert [columns for columns, _ in made[:-1]] == [docs.columns] * 4
    counts = [docs.count(), *[len(rows) for _, rows in made]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0] and counts[4] == counts[5]
    texts = {r.doc_id: r.text for r in made[3][1]}
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})
    for r in made[4][1]:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert all(r.n_chars == len(r.text) for r in made[2][1])


def test_run_writes_and_rereads_its_stages(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() > 0


def test_stages_bear_odd_rows(spark):
    made = staged(spark, odd_table(spark), DATA)
    assert all(len(columns) for columns, _ in made)
    assert not any(r.text in (None, "") for r in made[0][1])


def test_the_rest_stands_without_the_subpackage():
    import subprocess
    import sys

    code = ("import sys; sys.modules['leakscan.llm'] = None; import __spark_entry__ as e; "
            "assert not any(n.startswith('op') for n in e.queries()) and 'v14_scan' in e.queries() and set(e.oracle_sql()) <= set(e.queries())")
    assert subprocess.run([sys.executable, "-c", code], cwd="/".join(__file__.split("/")[:-3]) or "/").returncode == 0


def plain_tokens(text):
    """Tokens and templates of a text, by plain code."""
    text = regex.sub(r"([\p{Ll}0-9,;:] )(\p{Lu}\p{Ll})", "\\1\x01\\2", text).lower()
    found = regex.findall("\x01?[\\p{L}\\p{M}]+|[0-9]+(?:[.,:][0-9]+)*", text)
    return [("<name>" if t[0] == "\x01" else "<num>" if t[0].isdigit() else t) for t in found]


def test_the_pipeline_beside_plain_code(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    made = staged(spark, docs, DATA)

    texts = {k: t for k, t in texts.items() if any(c.isalpha() for c in t)}
    assert {r.doc_id for r in made[0][1]} == set(texts)

    texts = {k: texts[k] for k in plain_kept(list(texts.items()))}
    assert {r.doc_id: r.text for r in made[1][1]} == texts

    keys = sorted(texts)
    plain = plain_repeats([texts[k].encode() for k in keys])
    got = {r.doc_id: r.text for r in made[2][1]}
    assert set(got) == set(keys)
    for k, (size, gone, _, digest) in zip(keys, plain):
        assert len(got[k].encode()) <= size - gone  # less where a cut went through a character
        assert gone or got[k] == texts[k]
        if len(got[k].encode()) == size - gone:
            assert hashlib.sha256(got[k].encode()).hexdigest() == digest

    items = {r.item_id: plain_tokens(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    leaked = set()
    for k, text in got.items():
        t = plain_tokens(text)
        mine = {tuple(t[i : i + 8]) for i in range(len(t) - 7)}
        for item in items.values():
            windows = {tuple(item[i : i + 8]) for i in range(len(item) - 7)}
            shifts = Counter(j - i for j in range(len(t) - 7) for i in range(len(item) - 7) if t[j : j + 8] == item[i : i + 8])
            if len(mine & windows) >= 0.3 * len(windows) or max(shifts.values(), default=0) + 7 >= 13:
                leaked.add(k)
    assert {r.doc_id for r in made[3][1]} == set(got) - leaked
    assert {r.doc_id for r in made[4][1]} == set(got) - leaked
