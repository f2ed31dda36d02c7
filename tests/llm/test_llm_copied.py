"""Windows that an earlier document has, too, beside brute force."""

import hashlib
import random

import numpy as np
import pytest
from samples import clashing, empty_table, odd_rows, rows_of, words

from leakscan.llm import copied, countmin

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows, width=copied.WIDTH):
    """(doc_id, n_words, n_removed, digest) of each (doc_id, text)."""
    split = [(k, (t or "").encode().split()) for k, t in rows]
    least = {}
    for k, w in split:
        if k is not None:
            for i in range(len(w) - width + 1):
                window = tuple(w[i : i + width])
                least[window] = min(k, least.get(window, k))
    made = []
    for k, w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if k is not None and least[tuple(w[i : i + width])] < k:
                gone.update(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        made.append((k, hashlib.sha256(kept).hexdigest(), len(gone), len(w)))
    return sorted(made, key=repr)


def shared_rows(seed=3):
    rnd = random.Random(seed)
    passage, line = words(rnd, 70), words(rnd, 50)
    rows = [(r[0], r[1], *r[2:]) for r in odd_rows()]
    rows += [(1000 + i, " ".join([words(rnd, rnd.randint(0, 60)), passage, words(rnd, rnd.randint(0, 60))]), "en", "s", 1) for i in range(60)]
    rows += [(2000 + i, " ".join([line] * rnd.randint(1, 4) + [words(rnd, 5)]), "en", "s", 1) for i in range(10)]
    rows += [(3000 + i, passage[: rnd.randint(150, len(passage))], "en", "s", 1) for i in range(10)]
    rows += [(4000, "x " * 3000, "en", "s", 1), (4001, "x " * 49, "en", "s", 1), (4002, "x\t" * 50, "en", "s", 1), (4003, "\x85x " * 60, "en", "s", 1)]
    rows += [(1000, passage + " b", "en", "s", 1), (1000, passage + " c", "en", "s", 1), (None, passage, "en", "s", 1), (-5, line + " " + words(rnd, 3), "en", "s", 1)]
    rows += [(5000 + i, rows[-1][1], "en", "s", 1) for i in range(8)] + [rows[-1]] * 3
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_words_of_copied_windows_go(spark, monkeypatch, small):
    if small:  # a sketch that says "repeated" of nearly all, and several shards
        for name, value in (("LEAST", 6), ("MOST", 6), ("SHARD", 4), ("BUFFER", 50)):
            monkeypatch.setattr(countmin, name, value)
    rows = shared_rows()
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = copied.digests(df)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert rows_of(got.select("doc_id", "kept_sha256", "n_removed", "n_words")) == plain([r[:2] for r in rows])
    cut = copied.without_copied(df)
    assert cut.columns == df.columns and cut.count() == len(rows)
    whole = {r[0]: r[1] for r in rows if r[0] is not None and r[0] < 1000}
    assert all(r.text in (whole[r.doc_id], "") for r in cut.where("doc_id BETWEEN 5 AND 99").collect())


def test_empty_tables_and_tables_without_copies(spark):
    assert copied.digests(empty_table(spark)).count() == 0
    rnd = random.Random(1)
    df = spark.createDataFrame([(i, words(rnd, 80), "en", "s", 1) for i in range(5)], SCHEMA)
    assert copied.digests(df).where("n_removed > 0").count() == 0


def test_the_sketch_never_counts_too_low(spark):
    rnd = random.Random(2)
    texts = [words(rnd, 90) for _ in range(30)]
    both = texts + [" ".join(t.split()[10:80]) for t in texts[:15]]
    df = spark.createDataFrame([(t,) for t in both], "text string").repartition(4)
    for bits in (6, 20):
        over = countmin.sketch(df, copied.text_anchors, bits)
        seen = {}
        for t in both:
            for a in np.unique(copied.anchors(copied.word_hashes(t.encode().split()))):
                seen[int(a)] = seen.get(int(a), 0) + 1
        repeated = np.array([a for a, n in seen.items() if n > 1], "<u8")
        assert len(repeated) and countmin.estimated_repeated(repeated, over, bits).all()
    once = np.array([a for a, n in seen.items() if n == 1], "<u8")
    assert countmin.estimated_repeated(once, over, 20).mean() < 0.01


def test_equal_windows_have_equal_keys_and_anchors():
    rnd = random.Random(4)
    w = words(rnd, 300, "ab").encode().split()
    h = copied.word_hashes(w)
    a, k = copied.anchors(h), copied.window_keys(h)
    later = copied.word_hashes(w[37:])
    assert (a[37:] == copied.anchors(later)).all() and (k[37:] == copied.window_keys(later)).all()
    assert len({tuple(x) for x in k}) == len({tuple(w[i : i + 50]) for i in range(len(w) - 49)})
