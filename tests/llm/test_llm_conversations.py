"""Audits and tries of conversations beside plain code."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from samples import rows_of, words

from leakscan.llm import audit, turn_trie

SCHEMA = "conv_id long, turn long, role string, text string"
CLASHES = ("conv", "n", "copy", "_salt", "_head", "block", "audit", "cost", "node", "depth", "id", "size", "at", "_task", "first")


def odd_conversations(seed=1, convs=25, longest=9):
    rnd = random.Random(seed)
    rows = []
    for c in range(convs):
        n = rnd.randint(1, longest)
        for t in range(n):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice([words(rnd, 4) + ".", words(rnd, 3) + "! \n", words(rnd, 2), "", " \t", None, "Yes.", "\u0085", "..?"])
            rows.append((c * 37, rnd.choice([t, t, t, None, 3 * t]), role, text))
        if c % 5 == 0:  # repeated rows, in one turn
            rows += [rows[-1]] * 3
    rows += [(None, t, "user", "Of no one.") for t in (None, 0, 1)] + [(100 + i, t, "user", f"Text {t}.") for i in range(40) for t in range(3)]
    rows += [(-7, 0, "user", "x" * 9000 + "."), (-7, 1, "assistant", None)]
    return rows


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES])


def key_of(row):
    return (row[0] is not None, row[0] or 0, row[1] is not None, row[1] or 0, row[2] or "", row[3] or "")


def spoilt(rows):
    """Each conversation's rows after damage, in order, as (turn, role, text)."""
    made = {}
    for conv, turn, role, text in rows:
        one = [" " if v is None else v for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{one[0]}:{one[1]}".encode()) % 20
        role = "user" if kind == 4 else one[2]
        text = "" if kind == 1 else re.sub("[.!?]", "", one[3]) if kind == 2 else one[3]
        made.setdefault(conv, []).extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    return {c: sorted(r, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, r in made.items()}


def faults_of(rows):
    seen, made = set(), []
    for _, role, text in rows:
        core = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "."
        seen.add((role, text))
        made.append(fault)
    return made


def plain_audit(rows):
    """Cost, letters and lines by a table over rows and states that keeps whole strings."""
    best = {"": (0, "", ())}

    def legal(q, r):
        return (q, r) in (("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u"))

    def inserted(best):
        best = dict(best)
        for _ in range(3):
            for q, (c, a, lines) in list(best.items()):
                for r, role in (("u", "user"), ("a", "assistant")):
                    if legal(q, r):
                        way = (c + 5, a + "I", (*lines, f"{role}:"))
                        best[r] = min(best.get(r, way), way)
        return best

    for (_, role, text), fault in zip(rows, faults_of(rows)):
        after = {}
        for q, (c, a, lines) in inserted(best).items():
            ways = [(q, (c + 2, a + "D", lines))]
            if fault not in "bd":
                extra = 5 * (fault == "t")
                if legal(q, role[:1]):
                    ways.append((role[:1], (c + extra, a + "K", (*lines, f"{role}:{text}"))))
                ways += [(r, (c + 1 + extra, a + "R", (*lines, f"{new}:{text}"))) for r, new in (("u", "user"), ("a", "assistant")) if legal(q, r)]
            for r, way in ways:
                after[r] = min(after.get(r, way), way)
        best = after
    best = inserted(best)
    return min(best[q] for q in ("", "a") if q in best)


def plain_report(rows):
    made = []
    for conv, own in spoilt(rows).items():
        faults = faults_of(own)
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        cost, letters, lines = plain_audit(own)
        made.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in "bdt"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(made, key=repr)


@pytest.mark.parametrize("block", [2048, 3])
def test_audits_beside_plain_code(spark, monkeypatch, block):
    monkeypatch.setattr(audit, "BLOCK", block)
    rows = odd_conversations(block, longest=9 if block > 3 else 40)
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert rows_of(audit.repaired(df)) == plain_report(rows)


def test_one_long_conversation_is_cut(spark, monkeypatch):
    monkeypatch.setattr(audit, "BLOCK", 16)
    rnd = random.Random(9)
    rows = [(1, t // 2, rnd.choice(["user", "assistant", "system"]), rnd.choice(["Yes.", "No", "", words(rnd, 3) + "."])) for t in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert rows_of(audit.repaired(df)) == plain_report(rows)
    assert rows_of(audit.repaired(df.where("false"))) == []


def every_way(initials, faults):
    """All ways, by trying each edit with up to two inserts in every gap."""
    gaps = [("I" * n,) for n in range(3)]
    options = []
    for i, f in zip(initials, faults):
        options += [gaps, [("D", "", 2)] + ([] if f in "bd" else [("K", i, 5 * (f == "t")), ("R", "", 1 + 5 * (f == "t"))])]
    best = None
    for way in itertools.product(*options, gaps):
        letters, roles, cost = "", "", 0
        for w in way:
            letters += w[0]
            for letter in w[0]:
                roles += "" if letter == "D" else w[1] if letter == "K" else ("a" if roles[-1:] == "u" else "u")
                cost += 5 if letter == "I" else 0
            cost += w[2] if len(w) > 2 else 0
        if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, letters) < best):
            best = cost, letters
    return best


def test_the_first_of_all_cheapest_ways():
    rnd = random.Random(3)
    for n in [1, 2, 3, 4] * 12:
        initials = "".join(rnd.choice("uasx") for _ in range(n))
        faults = "".join(rnd.choice("..tbd") for _ in range(n))
        want = every_way(initials, faults)
        for modulus in (audit.MODULUS, 3):  # collisions of hashes change nothing
            assert audit.put_together([audit.block_ways(initials, faults, modulus=modulus)], modulus) == want
            cut = rnd.randint(0, n)
            parts = [audit.block_ways(initials[a:b], faults[a:b], modulus=modulus) for a, b in ((0, cut), (cut, n))]
            assert audit.put_together(parts, modulus) == want


def test_ways_compare_as_their_letters():
    rnd = random.Random(5)
    for modulus in (audit.MODULUS, 2):
        ways = audit.Ways(modulus)
        for _ in range(300):
            ways.extend(rnd.randrange(len(ways.up)), rnd.choice(["D", "I", "K", "R", "KI", "KK", "K"]))
        spelled = [ways.spell(i) for i in range(len(ways.up))]
        for _ in range(3000):
            x, y = rnd.randrange(len(spelled)), rnd.randrange(len(spelled))
            assert ways.less(x, y) == (spelled[x] < spelled[y]), (spelled[x], spelled[y])


def plain_trie(rows):
    turns = {}
    for r in sorted((r for r in rows if r[0] is not None), key=key_of):
        turns.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        made[c] = turns.get(base, [])[:h] + own[h:]
    members = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1]) if path else 0
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(made[c]) == len(path))
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), children[path], leaves[path], saved[path],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("piece,held,chunk", [(64, 20_000, 8192), (2, 7, 2)])
def test_tries_beside_plain_code(spark, monkeypatch, piece, held, chunk):
    for name, value in (("PIECE", piece), ("HELD", held), ("CHUNK", chunk)):
        monkeypatch.setattr(turn_trie, name, value)
    rows = odd_conversations(7, 30, 12)
    rnd = random.Random(2)
    shared = [("user", words(rnd, 3)) for _ in range(10)]
    for c in range(5000, 5300):  # a hot first turn, and copies of whole conversations
        own = shared[: rnd.randint(6, 10)] + [("assistant", f"t{rnd.randrange(4)}")] * (c % 3)
        rows += [(c, t, role, text) for t, (role, text) in enumerate(own)]
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(6))
    got = turn_trie.conversation_nodes(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert rows_of(got) == plain_trie(rows)


def test_an_empty_table_has_no_nodes(spark):
    assert turn_trie.conversation_nodes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_tree_holds_its_keys_in_every_layout():
    rnd = random.Random(8)
    for many in (3, 10, 40, 256):
        keys = {bytes([rnd.randrange(many) if i % 4 == 0 else rnd.randrange(3) for i in range(16 * rnd.randint(0, 3))]) for _ in range(600)}
        root = None
        for k in keys:
            root = turn_trie.insert(root, k, k)
        found, stack, kinds = [], [root], set()
        while stack:
            node = stack.pop()
            found += [(e, node.key[: node.stop]) for e in node.ends]
            kinds.add((type(node.children).__name__, getattr(node.children, "room", 0)))
            stack += node.children.all()
            for child in node.children.all():
                assert node.children.get(child.key[child.start]) is child and child.start == node.stop
        assert sorted(a for a, _ in found) == sorted(keys) and all(a == b for a, b in found)
        assert (("Direct", 0) in kinds) == (many == 256) and ("Small", 4) in kinds
        for k in keys:  # each beginning once
            assert len({k[:i] for i in range(0, len(k) + 1, 16)}) == len(k) // 16 + 1
