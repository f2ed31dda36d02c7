"""Near-duplicates by five-word Jaccard similarity beside brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F
from samples import clashing, empty_table, odd_rows, odd_table, words
from test_llm_dedup import sets

import corpus_pipeline
from leakscan.llm import countmin, shingles, simhash

DATA = "/root/testdata/sf0.001"


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_kept(rows):
    """The least key of each group of (key, text), NULL only where there is no other."""
    known = [plain_set(t) for _, t in rows]
    near = [(i, i) for i in range(len(rows))]
    for i in range(len(rows)):
        for j in range(i):
            shared = len(known[i] & known[j])
            if known[i] == known[j] or shared >= 0.8 * (len(known[i]) + len(known[j]) - shared):
                near.append((i, j))
    root, least = sets(near), {}
    for i, (key, _) in enumerate(rows):
        r = root[i]
        if r not in least or least[r] is None or (key is not None and key < least[r]):
            least[r] = key
    return sorted(least.values(), key=repr)


def edited(rnd, base, edits):
    w = base.split()
    for _ in range(edits):
        w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
    return " ".join(w)


def near_rows(seed=5):
    rnd = random.Random(seed)
    rows, line = list(odd_rows()), words(rnd, 40)
    for b in range(6):
        base = words(rnd, rnd.choice([30, 120, 400]))
        rows += [(1000 + 100 * b + i, edited(rnd, base, rnd.randint(0, 12)), "en", "s", 1) for i in range(20)]
    rows += [(5000 + i, words(rnd, 20) + " " + line, "en", "s", 1) for i in range(30)]
    return rows


def test_prefixes_of_sets_alike_meet():
    rnd = np.random.default_rng(4)
    for _ in range(500):
        base = np.unique(rnd.integers(0, 1 << 63, rnd.integers(1, 60), dtype=np.uint64))
        other = np.unique(np.r_[base[rnd.random(len(base)) < 0.92], rnd.integers(0, 1 << 63, rnd.integers(0, 4), dtype=np.uint64)])
        last = np.sort(rnd.choice(base, rnd.integers(0, len(base) + 1), replace=False))
        over = rnd.integers(0, 256, (1, 8), dtype=np.uint8)  # a sketch of 64 counters that says "repeated" of what both hold
        for value in np.intersect1d(base, other):
            cell = int(countmin.cells_of(np.array([value]), 0, 6)[0])
            over[0, cell >> 3] |= 1 << (cell & 7)
        if len(other) and shingles.alike(base, other):
            assert len(np.intersect1d(shingles.prefix(base, over, 6, last), shingles.prefix(other, over, 6, last)))


def test_marks_differ_in_no_more_bits_than_shingles():
    rnd = np.random.default_rng(6)
    for _ in range(200):
        base = np.unique(rnd.integers(0, 1 << 63, rnd.integers(1, 900), dtype=np.uint64))
        other = base[rnd.random(len(base)) < rnd.random()]
        apart = int(np.bitwise_count(shingles.marks(base).view("<u8") ^ shingles.marks(other).view("<u8")).sum())
        assert apart <= len(np.setxor1d(base, other))


def test_one_row_of_each_group_alike_stays(spark, monkeypatch):
    rows = near_rows()
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4))
    want = plain_kept([r[:2] for r in rows])
    for slab, common in ((512, 4), (4, 1)):
        monkeypatch.setattr(shingles, "SLAB", slab)
        monkeypatch.setattr(shingles, "COMMON", common)
        monkeypatch.setattr(shingles, "SAMPLED", 1 if common == 1 else 16)
        kept = shingles.without_near_duplicates(df)
        assert kept.columns == df.columns
        assert sorted((r.doc_id for r in kept.collect()), key=repr) == want
    assert shingles.without_near_duplicates(empty_table(spark)).count() == 0
    assert sorted((r.doc_id for r in shingles.without_near_duplicates(odd_table(spark)).collect()), key=repr) == plain_kept([r[:2] for r in odd_rows()])


def test_fingerprints_within_the_radius_share_a_bucket(spark):
    rnd = random.Random(8)
    values = []
    for _ in range(60):
        base = rnd.getrandbits(64)
        other = base
        for bit in rnd.sample(range(64), rnd.randint(0, shingles.RADIUS)):
            other ^= 1 << bit
        values.append(tuple(int(v) - (1 << 64) if v >> 63 else v for v in (base, other)))
    made = spark.createDataFrame(values, "a long, b long").select(
        *[simhash.buckets(F.col(c), shingles.RADIUS, shingles.BLOCKS).alias(c) for c in "ab"]).collect()
    assert all(len(r.a) == 28 and any(x == y for x, y in zip(r.a, r.b)) for r in made)


def test_fingerprints_alone_link_what_lies_within_the_radius(spark, monkeypatch):
    rnd = random.Random(9)
    rows = []
    for b in range(12):
        base = words(rnd, 900)
        rows += [(10 * b, base), (10 * b + 1, edited(rnd, base, 2)), (10 * b + 2, words(rnd, 50))]

    def known(text):
        return shingles.shingle_set(text), simhash.majority(shingles.shingle_set(text)) % (1 << 64)

    near = {10 * b + 1 for b in range(12) if (known(rows[3 * b][1])[1] ^ known(rows[3 * b + 1][1])[1]).bit_count() <= shingles.RADIUS}
    assert len(near) > 5
    monkeypatch.setattr(shingles, "TURNS", 1)  # without the exact search after them
    kept = shingles.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {k for k, _ in rows} - {r.doc_id for r in kept.collect()} == near


def test_the_stage_beside_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.near_dedup(spark, docs, DATA)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == plain_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_prefixes_of_sets_alike_meet_where_the_sketch_has_some_hashes_only():
    rnd = np.random.default_rng(14)
    for _ in range(500):
        base = np.unique(rnd.integers(0, 1 << 64, rnd.integers(1, 60), dtype=np.uint64))
        other = np.unique(np.r_[base[rnd.random(len(base)) < 0.92], rnd.integers(0, 1 << 64, rnd.integers(0, 4), dtype=np.uint64)])
        last = np.sort(rnd.choice(base, rnd.integers(0, len(base) + 1), replace=False))
        over = rnd.integers(0, 256, (1, 8), dtype=np.uint8)
        share = rnd.random()
        for value in np.intersect1d(base, other):
            cell = int(countmin.cells_of(np.array([value]), 0, 6)[0])
            over[0, cell >> 3] |= 1 << (cell & 7)
        if len(other) and shingles.alike(base, other):
            (x, skipped), (y, left) = (shingles._first(s, over, 6, last, share) for s in (base, other))
            places = [skipped + int(np.flatnonzero(x == v)[0]) + left + int(np.flatnonzero(y == v)[0]) for v in np.intersect1d(x, y)]
            assert 9 * min(places) <= len(base) + len(other)
            assert shingles.signs_alike(shingles.sign(base), shingles.sign(other))


def test_signs_of_any_width_leave_out_nothing_alike():
    rnd = np.random.default_rng(16)
    for _ in range(200):
        base = np.unique(rnd.integers(0, 1 << 63, rnd.integers(200, 3000), dtype=np.uint64))
        other = base[rnd.random(len(base)) < rnd.choice([0.5, 0.8, 0.81, 0.95])]
        assert shingles.signs_alike(shingles.sign(base), shingles.sign(other)) or not shingles.alike(base, other)
    one, two = (np.unique(rnd.integers(0, 1 << 63, 2000, dtype=np.uint64)) for _ in range(2))
    assert not shingles.signs_alike(shingles.sign(one), shingles.sign(two))


def test_a_large_group_does_not_give_all_its_pairs(spark, monkeypatch):
    rnd = random.Random(12)
    base = words(rnd, 120)
    rows = [(i, edited(rnd, base, 1)) for i in range(150)]
    monkeypatch.setattr(shingles, "RADIUS", 0)  # few meet by their fingerprints
    made, pairs_of = [], shingles._pairs

    def counted(*args):
        made.append(pairs_of(*args))
        made[-1] = made[-1].count()
        return pairs_of(*args)

    monkeypatch.setattr(shingles, "_pairs", counted)
    kept = shingles.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == plain_kept(rows)
    assert 149 <= sum(made) < 150 * 149 / 4


def test_a_sketch_too_small_for_the_texts_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(countmin, "LEAST", 8)
    monkeypatch.setattr(countmin, "MOST", 8)
    rows = near_rows(7)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = shingles.without_near_duplicates(df)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == plain_kept([r[:2] for r in rows])


def test_every_set_is_looked_up_by_its_fingerprint(spark, monkeypatch):
    rnd = random.Random(13)
    rows = [(i, words(rnd, rnd.randint(1, 80))) for i in range(60)] + [(60, None), (61, "")]
    seen, buckets_of = [], shingles._by_fingerprint

    def listed(sets):
        seen.extend(sets.select("set", "fingerprint").collect())
        return buckets_of(sets)

    monkeypatch.setattr(shingles, "_by_fingerprint", listed)
    assert shingles.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() == 61
    assert len(seen) == 61 and all(r.fingerprint is not None for r in seen)


def test_every_pair_within_the_radius_is_confirmed(spark, monkeypatch):
    rnd = random.Random(15)
    rows = []
    for b in range(10):
        base = words(rnd, rnd.choice([80, 200, 500]))
        rows += [(100 * b + i, edited(rnd, base, rnd.choice([0, 1, 2, 4, 7]))) for i in range(15)]
    known = [shingles.shingle_set(t) for _, t in rows]
    prints = [simhash.majority(s) % (1 << 64) for s in known]
    near = [(i, j) for i in range(len(rows)) for j in range(i + 1)
            if (prints[i] ^ prints[j]).bit_count() <= shingles.RADIUS and shingles.alike(known[i], known[j])]
    root, least = sets(near), {}
    for i, (key, _) in enumerate(rows):
        least[root[i]] = min(key, least.get(root[i], key))
    monkeypatch.setattr(shingles, "TURNS", 1)  # without the exact search after them
    kept = shingles.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
