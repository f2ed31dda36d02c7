"""Language and quality models: exact parts beside brute force, whole models by held-out accuracy."""

import itertools
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import clashing, empty_table, odd_rows, odd_table

from leakscan.llm import language, quality
from leakscan.llm.common import training_split

DATA = "/root/testdata/sf0.01"


def test_the_automaton_knows_all_substrings_and_no_others():
    rnd = random.Random(1)
    for _ in range(150):
        symbols = [rnd.choice([0, 1, 2, 3]) for _ in range(rnd.randint(0, 25))]
        a = language.suffix_automaton(symbols)
        edges = {(s, c): t for s, c, t in np.frombuffer(a.edges, "<u4").reshape(-1, 3).tolist()}
        parts = "".join(map(str, symbols)).split("0")
        known = {p[i:j] for p in parts for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
        for n in range(1, 5):
            for word in itertools.product((1, 2, 3), repeat=n):
                state = 0
                for c in word:
                    state = edges.get((state, c), -1)
                    if state < 0:
                        break
                assert (state >= 0) == ("".join(map(str, word)) in known)


def plain_phrases(text, known, model):
    """Phrases of a text: each the longest stretch that occurs in ``known``, or one symbol."""
    symbols = language.Reader(model.letters).symbols(text)[0].tolist()
    phrases = 0
    for at in range(0, len(symbols), language.SEGMENT):
        part, i = symbols[at : at + language.SEGMENT], 0
        while i < len(part):
            n = 1
            while i + n < len(part) and occurs(part[i : i + n + 1], known):
                n += 1
            phrases += 1
            i += n
    return phrases, len(symbols)


def occurs(part, known):
    return any(known[i : i + len(part)] == part for i in range(len(known) - len(part) + 1)) and language.UNKNOWN not in part


def test_phrases_are_the_longest_matches():
    rnd = random.Random(2)
    samples = [("a", "".join(rnd.choice("abc d") for _ in range(200))), ("b", "".join(rnd.choice("bcé d") for _ in range(200)))]
    model = language.train(samples)
    texts = ["", "abc", "ab cab dd!! 77 é", "zzz ab", "".join(rnd.choice("abcdé ") for _ in range(1300)), "ÀB c", "1 2"]
    costs, letters = language.Parser(model).costs(texts)
    for k, (name, text) in enumerate(samples):
        known = [*language.Reader(model.letters).symbols(text)[0].tolist(), language.UNKNOWN]
        for t, cost in zip(texts, costs[:, k]):
            phrases, size = plain_phrases(t, known, model)
            assert cost == pytest.approx(phrases * math.log2(len(known)) / max(size, 1))
    assert letters.tolist() == [False, True, True, True, True, True, False]


def test_batches_do_not_change_a_prediction():
    rnd = random.Random(3)
    model = language.train([("x", "one two three four " * 20), ("y", "ein zwei drei vier " * 20)])
    texts = ["".join(rnd.choice("onetwzdri ") for _ in range(rnd.randint(0, 1500))) for _ in range(30)]
    parser = language.Parser(model)
    names, scores = parser.predict(texts)
    assert [(parser.predict([t])[0][0], parser.predict([t])[1][0]) for t in texts] == list(zip(names, scores))
    assert parser.predict([]) == ([], [])


def test_memory_does_not_grow_with_the_batch():
    model = language.train([("x", "one two three four " * 20), ("y", "ein zwei drei vier " * 20)])
    parser = language.Parser(model)
    texts = [f"{i} " + "one two three four " * 100 for i in range(4000)]
    tracemalloc.start()
    names, _ = parser.predict(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert names == ["x"] * 4000 and peak < 50e6


def test_parts_keep_every_text():
    texts = ["", "abc", "d" * 9, "", "ef", "g"]
    assert list(language.parts_of(texts, 4)) == [["", "abc"], ["d" * 9], ["", "ef", "g"]] and list(language.parts_of([], 4)) == []


def test_languages_of_the_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.learn(docs)
    rows = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in held} == {r.doc_id for r in docs.where(training_split(F.col("doc_id")) == 1).select("doc_id").collect()}


def test_language_of_odd_rows(spark):
    df = clashing(odd_table(spark)).drop("score")
    model = language.learn(df)
    got = language.identify(df, model).collect()
    texts = {r[0]: r[1] for r in odd_rows()}
    assert len(got) == len(odd_rows()) and set(model.languages) <= {"en", "fr"}
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (100, 101))
    assert all(r.lang_pred != "und" for r in got if texts.get(r.doc_id))
    kept = language.with_language(df, model)
    assert kept.columns == df.columns and kept.count() == sum(bool(r[1]) for r in odd_rows())
    nothing = language.learn(empty_table(spark))
    assert nothing.languages == () and {r.lang_pred for r in language.identify(df, nothing).collect()} == {"und"}
    assert language.identify(empty_table(spark), model).count() == 0


def test_held_out_and_label_columns_change_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(300)
    held = training_split(F.col("doc_id")) == 1
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))
    assert language.learn(docs) == language.learn(other)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    assert quality.learn(docs, labels) == quality.learn(docs, turned)


def test_quality_of_the_documents(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = quality.score(docs, quality.learn(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.9
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.85
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)


def test_quality_of_odd_rows(spark):
    df = clashing(odd_table(spark)).drop("score")
    rows = [(k, int(k % 3 == 0), 0) for k in range(40)] + [(3, 1, 0), (3, 0, 0), (None, 1, 0), (5, None, 0), (7, 9, 0), (102, 1, None)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for model in (quality.learn(df, labels), quality.learn(df, labels.limit(0)), quality.learn(empty_table(spark), labels)):
        got = quality.score(df, model).collect()
        assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
        same = {r.score for r in got if r.doc_id in (100, 101)}
        assert len(same) == 1
    assert quality.score(empty_table(spark), model).count() == 0


def test_the_whole_text_counts():
    rnd = random.Random(5)
    good = [(1, " ".join(rnd.choice(["river", "stone", "cloud", "meadow"]) for _ in range(150))) for _ in range(60)]
    bad = [(0, " ".join(rnd.choice(["buy!!!", "$$$", "click@@", "now%%%"]) for _ in range(150))) for _ in range(60)]
    model = quality.train(good + bad, 0.5, 4096)
    scorer = quality.Scorer(model)
    start = good[0][1][:1000]
    assert scorer.score(good[1][1]) > 0.5 > scorer.score(bad[1][1])
    assert scorer.score((start + " ") * 3 + bad[2][1] * 12) < scorer.score((start + " ") * 3 + good[2][1] * 12)


def test_scores_beside_plain_compression(spark):
    """Every document's score, from sizes that are taken here, without the module's scorer."""
    import zlib

    import zstandard

    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.learn(docs, labels)
    dictionaries = [zstandard.ZstdCompressionDict(d) for d in (model.good, model.bad)]

    def size(data, dictionary):
        total = 0
        for at in range(0, len(data), 2048):
            packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)
            total += len(packer.compress(data[at : at + 2048]))
        return total

    rows = {r.doc_id: r for r in quality.score(docs, model).collect()}
    some = docs.select("doc_id", "text").collect()
    assert len(rows) == len(some)
    for doc_id, text in some:
        data = (text or "").encode()
        x = (size(data, dictionaries[1]) - size(data, dictionaries[0])) / len(data) if data else 0.0
        want = 1 / (1 + math.exp(-(model.slope * x + model.base)))
        got = rows[doc_id]
        assert got.score == pytest.approx(want, abs=1e-12) and got.predicted == (got.score >= 0.5)
        assert got.held_out == (zlib.crc32(str(doc_id).encode()) % 3 == 1)


def test_the_curve_is_the_best_of_its_kind():
    """No slope and base nearby explain the labels better, both labels weighing the same."""
    rnd = np.random.default_rng(4)
    x = np.r_[rnd.normal(0.1, 0.05, 40), rnd.normal(-0.02, 0.05, 90)]
    y = np.r_[np.ones(40), np.zeros(90)]
    weight, scale = np.where(y == 1, 0.5 / 40, 0.5 / 90) * len(y), x.std()

    def loss(slope, base):
        p = 1 / (1 + np.exp(-(slope * x + base)))
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + 0.5 * (slope * scale) ** 2

    slope, base = quality._curve(x, y)
    for a, b in itertools.product((-0.02, 0, 0.02), repeat=2):
        assert loss(slope, base) <= loss(slope * (1 + a), base + b) + 1e-9
