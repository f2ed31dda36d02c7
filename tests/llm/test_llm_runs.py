"""Long passages of long items are leaks, whatever part of the item they are."""

import random

import corpus_pipeline
from leakscan.llm import decontaminate as dec


def test_a_long_run_of_a_long_item_is_a_leak(spark, tmp_path):
    rnd = random.Random(13)

    def prose(n):
        return ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n)]

    item = prose(400)
    parts = {1: item[100:113], 2: item[100:112], 3: item[40:160], 4: [], 5: item[50:60] + prose(3) + item[300:310]}
    docs = [(k, " ".join([*prose(30), *part, *prose(30)])) for k, part in parts.items()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([("a", " ".join(item))], "item_id string, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.decontaminated(spark, df, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5]
    assert sorted((r.doc_id, r.n_windows) for r in dec.leaks(df, items).collect()) == [(1, 6), (3, 113)]
    assert dec.matches(df, items, run=None).count() == 0


def test_a_part_of_an_item_and_items_of_one_or_two_tokens(spark):
    rnd = random.Random(14)

    def prose(n):
        return ["".join(rnd.choice("klmnopqrst") for _ in range(7)) for _ in range(n)]

    item = prose(59)
    rows = [("a", " ".join(item)), ("b", "yes"), ("c", "about 12"), ("d", ""), ("e", None), ("f", "...")]
    items = spark.createDataFrame(rows, "item_id string, text string")
    docs = [(1, " ".join([*prose(40), *item[30:52], *prose(40)])), (2, "yes"), (3, "oh yes"), (4, "About 15."), (5, "it is about 12"), (6, ""), (7, None), (8, "Yes!")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in dec.leaks(df, items).collect()) == [(1, "a"), (2, "b"), (4, "c"), (8, "b")]
    assert sorted(r.doc_id for r in dec.without_leaks(df, items).collect()) == [3, 5, 6, 7]
