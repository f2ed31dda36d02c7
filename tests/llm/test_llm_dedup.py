"""Near-duplicate groups, repeated windows, components and shards beside brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from samples import clashing, empty_table, odd_rows, odd_table, rows_of, words

from leakscan.llm import repeats, sharding, simhash
from leakscan.llm.components import components


def sets(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_groups(rows):
    prints = [(k, plain_fingerprint(t or "")) for k, t, *_ in rows]
    values = sorted({f for _, f in prints})
    root = sets([(a, b) for i, a in enumerate(values) for b in values[i:] if (a ^ b).bit_count() <= 2])
    least = {}
    for k, f in prints:
        if k is not None:
            least[root[f]] = min(least.get(root[f], k), k)
    return sorted(((k, f"{f:016x}", least.get(root[f])) for k, f in prints), key=repr)


def test_fingerprint_hash_is_spark_s(spark):
    assert spark.sql("SELECT xxhash64('ab é cd') AS h").first().h % (1 << 64) == xxhash.xxh64_intdigest("ab é cd".encode(), 42)


def test_near_duplicates_of_odd_rows(spark):
    rnd = random.Random(6)
    base = words(rnd, 400)
    near = [(500 + i, base.replace(base.split()[i * 7], "zz", 1), "en", "s", 1) for i in range(30)]
    rows = odd_rows() + near + [(600, "ABC def\tGHI\x0bjkl", "en", "s", 1), (601, "abc DEF ghi\njkl", "en", "s", 1)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4))
    assert rows_of(simhash.near_duplicates(df)) == plain_groups([(k, t) for k, t, *_ in rows])
    assert simhash.near_duplicates(empty_table(spark)).count() == 0


def test_bit_slices_find_all_near_pairs():
    rnd = np.random.default_rng(7)
    seeds = rnd.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rnd.integers(0, 64, (300, 3), dtype=np.uint64)
    values = np.unique(np.concatenate([seeds, seeds[rnd.integers(0, 40, 300)] ^ flips[:, 0] ^ flips[:, 1] * rnd.integers(0, 2, 300, dtype=np.uint64)]))
    q, m = simhash.within_radius(values, simhash.bit_planes(values), len(values))
    want = {(i, j) for i in range(len(values)) for j in range(len(values)) if int(values[i] ^ values[j]).bit_count() <= 2}
    assert set(zip(q.tolist(), m.tolist())) == want
    hi, lo = simhash.tile_links(values.view(np.int64), None)
    links = sets([(int(a), int(b)) for a, b in zip(hi, lo)])
    truth = sets([(int(v), int(v)) for v in values.view(np.int64)] + [(int(values.view(np.int64)[a]), int(values.view(np.int64)[b])) for a, b in want])
    assert all(links.get(v, v) == truth[v] for v in truth)


def test_blocks_beyond_the_radius_are_left(monkeypatch):
    looked = []
    near_in = simhash._near_in
    monkeypatch.setattr(simhash, "_near_in", lambda ones, twos, over: looked.append(len(over)) or near_in(ones, twos, over))
    rnd = np.random.default_rng(14)
    values = np.sort(np.unique(rnd.integers(0, 1 << 63, 1000, dtype=np.uint64)))
    # alone in its tile, and beside others: no value meets itself, so all blocks are left
    links = simhash.tile_links(values.view(np.int64), None)
    assert len(links[0]) == 0
    starts = [i for i, n in enumerate(looked) if n == 256 * 16 or i == 0 or n > looked[i - 1]]
    for a, b in zip(starts, starts[1:]):
        assert b - a < 64 // simhash.LOOK and looked[b - 1] < looked[a] / 20  # few cells are left well before the last plane
    looked.clear()
    near = values.copy()
    near[700] = near[10] ^ np.uint64(5)
    q, m = simhash.within_radius(near[:256], simhash.bit_planes(near), len(near), np.arange(1, 257))
    assert (q.tolist(), m.tolist()) == ([10], [700]) and looked[-1] == 1  # one block of one query went through all planes


def test_crowded_buckets_are_cut_into_slabs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLAB", 8)
    rnd = random.Random(8)
    values = {rnd.getrandbits(64)}
    seed = next(iter(values))
    for _ in range(120):
        values.add(seed ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    signed = [v - (1 << 64) if v >> 63 else v for v in values] + list(range(5, 4000, 999))
    got = components(simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"))).collect()
    want = sets([(a, b) for i, a in enumerate(signed) for b in signed[i:] if ((a ^ b) % (1 << 64)).bit_count() <= 2])
    assert {r.hi: r.lo for r in got} == {a: b for a, b in want.items() if a != b}


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(9)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(7, 7), (300, 301), (301, 300)]
    pairs += [(rnd.randrange(1000, 1200), rnd.randrange(1000, 1200)) for _ in range(120)]
    got = components(spark.createDataFrame(pairs, "hi long, lo long"))
    assert {r.hi: r.lo for r in got.collect()} == {a: b for a, b in sets(pairs).items() if a != b}
    assert components(spark.createDataFrame([], "hi long, lo long")).count() == 0


def test_one_row_of_each_group_stays(spark):
    df = clashing(odd_table(spark))
    kept = simhash.without_near_duplicates(df)
    assert kept.columns == df.columns
    rows = [(k, t) for k, t, *_ in odd_rows()]
    prints = [plain_fingerprint(t or "") for _, t in rows]
    values = sorted(set(prints))
    root = sets([(a, b) for i, a in enumerate(values) for b in values[i:] if (a ^ b).bit_count() <= 2])
    least = {}
    for (key, _), value in zip(rows, prints):  # the least key of each group, NULL only where there is no other
        if root[value] not in least or least[root[value]] is None or (key is not None and key < least[root[value]]):
            least[root[value]] = key
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(least.values(), key=repr)


def plain_repeats(texts, window=200):
    count = collections.Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i : i + window] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[: len(t)]])
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_texts():
    rnd = random.Random(3)
    passages = [words(rnd, rnd.randint(30, 90)) for _ in range(5)]
    texts = ["", None, "a" * 199, "b" * 200, "c" * 201, "d" * 3000, "ab" * 700, "d" * 150 + "e" * 60, words(rnd, 1500)]
    for _ in range(80):
        p = list(rnd.choice(passages))
        if rnd.random() < 0.5:
            p[rnd.randrange(len(p))] = "#"
        texts.append(words(rnd, rnd.randint(0, 60)) + "".join(p)[rnd.randint(0, 60) : len(p) - rnd.randint(0, 60)] + words(rnd, rnd.randint(0, 60)))
    return texts + texts[-10:] + [texts[20]] * 7 + [""]


@pytest.mark.parametrize("group", [repeats.GROUP, 3])  # 3: every group is cut by offsets and shared bytes
def test_repeated_windows(spark, group):
    texts = repeat_texts()
    df = clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).drop("t1", "t2")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df, group=group).collect()}
    assert [got[i] for i in range(len(texts))] == plain_repeats([(t or "").encode() for t in texts])


def test_long_texts_are_looked_at_in_pieces(monkeypatch):
    rnd = random.Random(4)
    part = words(rnd, 80)
    data = (words(rnd, 300) + part + words(rnd, 300) + part + words(rnd, 100)).encode()
    monkeypatch.setattr(repeats, "PIECE", 500)
    rows = repeats.stretches(data)
    at, start, end = (rows[:, i].astype(int) for i in (2, 3, 4))
    assert start[0] == 0 and end[-1] == len(data)
    assert (start[1:] == end[:-1] - repeats.WINDOW + 1).all()  # every window belongs to one stretch
    assert ((start <= at) & (at + repeats.GRAM <= end)).all() and (end - start <= 2 * repeats.WINDOW - repeats.GRAM).all()


def test_radix_sort_finds_equal_windows():
    rnd = np.random.default_rng(2)
    data = np.concatenate([rnd.integers(0, 2, 900), np.tile(rnd.integers(0, 3, 260), 2)]).astype(np.uint8)
    starts = rnd.integers(0, len(data) - 200, 400)
    groups = rnd.integers(0, 2, 400)
    keys = [(g, data[s : s + 200].tobytes()) for s, g in zip(starts.tolist(), groups.tolist())]
    count = collections.Counter(keys)
    assert repeats.equal_windows(data, starts, groups).tolist() == [count[k] > 1 for k in keys]


def test_texts_without_repeats_keep_all_columns(spark):
    df = odd_table(spark)
    out = repeats.without_repeats(clashing(df).drop("t1", "t2"))
    assert out.columns == clashing(df).drop("t1", "t2").columns and out.count() == df.count()
    assert repeats.remove_repeats(empty_table(spark)).count() == 0 and repeats.without_repeats(empty_table(spark)).count() == 0


def test_shards_are_level_and_gapless(spark):
    rnd = random.Random(11)
    rows = odd_rows(2, 400) + [(1000 + i, "the same long text " * 5, "en", "s", 1) for i in range(600)]
    rows += [(5000 + i, words(rnd, rnd.randint(5, 50)), "en", "s", 1) for i in range(1500)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)).drop(
        "bytes", "group", "shard", "slot")
    got = sharding.assign_shards(df, 4).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(
        ((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, *_ in rows), key=repr)
    load, slots, where = collections.Counter(), collections.defaultdict(list), collections.defaultdict(collections.Counter)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[r.text_crc32][r.shard] += r.size
    assert set(load) == {0, 1, 2, 3} and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(sum(c.values()) for k, c in where.items() if len(c) == 1)
    assert max(load.values()) - min(load.values()) <= 0.15 * sum(load.values()) / 4 or largest > 0.15 * sum(load.values()) / 4
    copies = collections.Counter(r.text_crc32 for r in got)
    assert all(len(c) == 1 for k, c in where.items() if sum(c.values()) <= sum(load.values()) / 4 and copies[k] <= len(got) / 4)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    again = {(r.doc_id, r.text_crc32, r.slot): r.shard for r in sharding.assign_shards(df.repartition(7), 4).collect()}
    assert again == {(r.doc_id, r.text_crc32, r.slot): r.shard for r in got}
    assert sharding.assign_shards(empty_table(spark)).count() == 0


def test_only_what_no_shard_can_hold_is_cut():
    rnd = np.random.default_rng(12)
    for shards in (1, 3, 16):
        loads = rnd.pareto(1.0, (60, 3)) + 0.01
        loads[:4, 1] = 0
        loads[0] = loads.sum(axis=0) / 2  # half of all
        room = np.tile(loads.sum(axis=0) / shards, (shards, 1))
        left = room / room.sum(axis=0)
        for load, pieces in zip(loads / room.sum(axis=0), sharding.place_whole_or_cut(loads, room)):
            assert abs(sum(p for p, _ in pieces) - 1) < 1e-9 and len({s for _, s in pieces}) == len(pieces) <= shards
            holds = [(left[s] >= load - 1e-6).all() for s in range(shards)]
            assert len(pieces) == 1 or not any((left[s] >= load + 1e-6).all() for s in range(shards))
            if len(pieces) == 1 and any(holds):
                assert holds[pieces[0][1]]
            for part, s in pieces:
                left[s] -= load * part
    one = sharding.place_whole_or_cut(np.array([[4.0, 0, 1]]), np.array([[2.0, 0, 1], [3.0, 0, 1]]))[0]
    assert [(round(part, 9), shard) for part, shard in one] == [(0.75, 1), (0.25, 0)]


def test_copies_that_fit_a_shard_stay_together(spark):
    rnd = random.Random(13)
    rows = [(i, "copy one " * 20) for i in range(150)] + [(1000 + i, "copy two " * 20) for i in range(100)]
    rows += [(2000 + i, words(rnd, 30)) for i in range(600)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    shards_of, load = collections.defaultdict(set), collections.Counter()
    for r in got:
        shards_of[r.text_crc32].add(r.shard)
        load[r.shard] += r.size
    assert all(len(s) == 1 for s in shards_of.values()) and max(load.values()) - min(load.values()) < 0.02 * sum(load.values())


def test_a_group_goes_where_the_dot_product_is_highest():
    loads = np.array([[8.0, 1, 1], [1, 8, 1], [8, 1, 1], [1, 8, 1]])
    assert sharding.pack(loads, np.full((2, 3), 9.0)).tolist() in ([0, 1, 1, 0], [0, 1, 0, 1], [0, 0, 1, 1], [0, 1, 1, 0])
    one = sharding.pack(np.ones((8, 3)), np.array([[6.0, 6, 6], [2, 2, 2]]))
    assert collections.Counter(one.tolist()) == {0: 6, 1: 2}
