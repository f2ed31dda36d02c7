"""Conversation structure repair: the cheapest edits that turn a damaged conversation into one of the wanted form.

Roles must read ``(s?(ua)+)?``: nothing, or a system turn if any and then user and
assistant in turn. Each row is kept, given the other role, or deleted, and empty
turns may be inserted. Of equally cheap ways the one whose letters (Keep, Rerole,
Delete, Insert) come first in ASCII is wanted.

Ways are linked nodes that share their beginnings. A node knows its ancestors 1, 2,
4, ... steps back and a rolling hash of its letters from the start, so where two
ways of equal cost part is found by halving; equal hashes are confirmed on the
letters unless both lead to the same node. No way is a beginning of another one of
equal cost to the same state, so the first letter that differs decides for good,
whatever follows.

That makes blocks of rows independent: each block of ``BLOCK`` rows gives the
cheapest way from every state to every state, and a conversation is put together
from those of its blocks. So a long conversation is shared by many tasks; only its
audit, which is one value of the result, and the digest of its repaired text, which
can only be taken in sequence, pass through one task, streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leakscan.llm.common import arrow_schema, numbered, written
from leakscan.llm.turn_trie import crc32_sql

BLOCK = 2048  # rows
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5  # costs; the last one for a truncated row that stays
BLANK, DUPLICATE, TRUNCATED, SOUND = "bdt."
START, SYSTEM, USER, ASSISTANT = range(4)  # by the last role
ENDS = (START, ASSISTANT)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
WANTED = {START: (USER, "user"), SYSTEM: (USER, "user"), ASSISTANT: (USER, "user"), USER: (ASSISTANT, "assistant")}  # what an inserted or changed turn must be
SPACE = " \t\n\x0b\x0c\r"
PAIRS = ("su", "ua", "au")
MODULUS, BASE = (1 << 61) - 1, 0x1D3A5C7E9B1F2E47 % ((1 << 61) - 1)
CACHED = 50_000  # blocks of one shape whose ways a task remembers


class Ways:
    """Linked ways. A node is a number; its label is a letter, or the letters of a block."""

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.up, self.depth, self.hash, self.label = [[]], [0], [0], [""]

    def extend(self, node: int, label: str) -> int:
        up, k = [node], 0
        while len(self.up[up[k]]) > k:
            up.append(self.up[up[k]][k])
            k += 1
        value = self.hash[node]
        for letter in label:
            value = (value * BASE + ord(letter)) % self.modulus
        self.up.append(up)
        self.depth.append(self.depth[node] + 1)
        self.hash.append(value)
        self.label.append(label)
        return len(self.up) - 1

    def ancestor(self, node: int, depth: int) -> int:
        steps, k = self.depth[node] - depth, 0
        while steps:
            if steps & 1:
                node = self.up[node][k]
            steps, k = steps >> 1, k + 1
        return node

    def spell(self, node: int, above: int = 0) -> str:
        """The letters of a way, from below depth ``above`` on."""
        labels = []
        while self.depth[node] > above:
            labels.append(self.label[node])
            node = self.up[node][0]
        return "".join(reversed(labels))

    def same(self, x: int, y: int) -> bool:
        """Whether two nodes of one depth have the same labels, by walking back to where they are one."""
        while x != y:
            if self.label[x] != self.label[y]:
                return False
            x, y = self.up[x][0], self.up[y][0]
        return True

    def less(self, x: int, y: int) -> bool:
        """Whether the letters of ``x`` come before those of ``y``."""
        if x == y:
            return False
        shared = min(self.depth[x], self.depth[y])
        a, b = self.ancestor(x, shared), self.ancestor(y, shared)
        if self.hash[a] == self.hash[b]:
            if not self.same(a, b):  # a collision
                return self.spell(x) < self.spell(y)
            return self.spell(x, shared) < self.spell(y, shared)
        # the least depth at which hashes differ
        for k in range(len(self.up[a]) - 1, -1, -1):
            if k < len(self.up[a]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                a, b = self.up[a][k], self.up[b][k]
        if not self.same(self.up[a][0], self.up[b][0]):  # a collision
            return self.spell(x) < self.spell(y)
        p, q = self.label[a], self.label[b]
        if p == q or p.startswith(q) or q.startswith(p):  # labels of several letters may go on into the next ones
            return self.spell(x, self.depth[a] - 1) < self.spell(y, self.depth[a] - 1)
        return p < q

    def better(self, best: dict, state: int, cost: int, node: int, label: str) -> None:
        """Take the way ``node`` and ``label`` to ``state`` if it is the best so far."""
        if state not in best or cost < best[state][0]:
            best[state] = cost, self.extend(node, label)
        elif cost == best[state][0]:
            way = self.extend(node, label)
            if self.less(way, best[state][1]):
                best[state] = cost, way


def _with_inserts(ways: Ways, best: dict) -> dict:
    for _ in range(2):  # from nothing to an assistant's turn takes two
        for state, (cost, node) in sorted(best.items()):
            ways.better(best, WANTED[state][0], cost + INSERT, node, "I")
    return best


def block_ways(initials: str, faults: str, starts: tuple[int, ...] = (START, SYSTEM, USER, ASSISTANT), modulus: int = MODULUS) -> list[tuple[int, int, int, str]]:
    """``(from, to, cost, letters)``: the best way through the rows for each pair of states.

    Inserts stand before a row; those at the very end belong to the conversation.
    """
    made = []
    for start in starts:
        ways = Ways(modulus)
        best = {start: (0, 0)}
        for initial, fault in zip(initials, faults):
            after: dict = {}
            extra = CUT if fault == TRUNCATED else 0
            for state, (cost, node) in _with_inserts(ways, best).items():
                ways.better(after, state, cost + DELETE, node, "D")
                if fault in (BLANK, DUPLICATE):
                    continue
                if (state, initial) in NEXT:
                    ways.better(after, NEXT[state, initial], cost + KEEP + extra, node, "K")
                ways.better(after, WANTED[state][0], cost + REROLE + extra, node, "R")
            best = after
        made += [(start, state, cost, ways.spell(node)) for state, (cost, node) in best.items()]
    return made


def put_together(blocks: list[list[tuple[int, int, int, str]]], modulus: int = MODULUS) -> tuple[int, str]:
    """Cost and letters of the best way through all blocks, from nothing to a full stop."""
    ways = Ways(modulus)
    best = {START: (0, 0)}
    for options in blocks:
        after: dict = {}
        for start, state, cost, letters in options:
            if start in best:
                ways.better(after, state, best[start][0] + cost, best[start][1], letters)
        best = after
    best = _with_inserts(ways, best)
    ends: dict = {}
    for state in ENDS:
        if state in best:
            ways.better(ends, START, *best[state], "")
    cost, node = ends[START]
    return cost, ways.spell(node)


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text and ``copy`` after damage by a checksum of conversation and turn; NULLs are one space.

    A dropped row stays, with ``copy`` NULL, so that its conversation is not lost.
    """
    kind = F.pmod(F.crc32(F.concat(_text(conv), F.lit(":"), _text(turn)).cast("binary")), F.lit(20))
    spoilt = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(_text(text), "[.!?]", "")).otherwise(_text(text))
    copies = F.when(kind == 0, F.array(F.lit(None).cast("int"))).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(_text(role)).alias("role"),
        spoilt.alias("text"), F.explode(copies).alias("copy"))


def _order() -> list[Column]:
    """Rows of one turn by role, then text."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.xxhash64("text")]


def _shapes(numbers: DataFrame) -> DataFrame:
    """A row for each block of each conversation: initials, faults and turns of its rows, in order."""
    repeats = numbers.where(F.col("copy").isNotNull() & (F.col("fault") != BLANK)).groupBy("conv", "digest").agg(
        F.min("n").alias("first"), F.count("*").alias("m")).where("m > 1").select(F.col("conv").alias("_conv"), F.col("digest").alias("_digest"), "first")
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))
    fault = F.when((F.col("fault") != BLANK) & (F.col("n") > F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    flagged = numbers.join(repeats, same, "left").withColumn("fault", fault)
    here = F.when(F.col("copy").isNotNull(), F.struct("n", "initial", "fault", "turn"))
    cut = flagged.groupBy("conv", F.floor(F.col("n") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(here)).alias("r"))
    return cut.select("conv", "block", F.array_join("r.initial", "").alias("initials"), F.array_join("r.fault", "").alias("faults"), F.col("r.turn").alias("turns"))


COUNTS = ("blank", "duplicate", "truncated", "illegal")
_WAYS = "array<struct<start: int, stop: int, cost: long, letters: string>>"


def _block_rows(shapes: DataFrame) -> DataFrame:
    """For each block its ways, counts, first and last initial and turn, and number of different turns."""
    conv = dict(shapes.dtypes)["conv"]
    made = f"conv {conv}, block long, ways {_WAYS}, counts array<long>, first string, last string, low long, high long, turns long"
    arrow = arrow_schema(shapes.sparkSession, made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            rows = []
            for initials, faults, turns in zip(*[c.to_pylist() for c in batch.columns[2:]]):
                shape = initials, faults
                if shape not in known:
                    if len(known) >= CACHED:
                        known.clear()
                    known[shape] = [dict(zip(("start", "stop", "cost", "letters"), w)) for w in block_ways(initials, faults)]
                counts = [faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)]
                counts.append(sum(initials[i : i + 2] not in PAIRS for i in range(len(initials) - 1)))
                there = [t for t in turns if t is not None]
                rows.append((known[shape], counts, initials[:1], initials[-1:], there[0] if there else None, there[-1] if there else None, len(set(there))))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(arrow)[2:])] if rows else [pa.array([], f.type) for f in list(arrow)[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(arrow.field(1).type), *columns], schema=arrow)

    return shapes.mapInArrow(run, made)


def _audits(blocks: DataFrame) -> DataFrame:
    """conv, gaps, the counts, cost and audit of each conversation."""
    conv = dict(blocks.dtypes)["conv"]
    made = f"conv {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    arrow = arrow_schema(blocks.sparkSession, made)

    def whole(held: list[tuple]) -> tuple:
        counts = [sum(c) for c in zip(*[b[3] for b in held])]
        last, high, turns = "", None, 0
        for _, _, _, _, first, end, low, top, n in held:
            counts[3] += bool(last and first) and last + first not in PAIRS
            last = end or last
            if n:
                turns += n - (low == high)
                high = top
        lows = [b[6] for b in held if b[6] is not None]
        gaps = high - min(lows) + 1 - turns if lows else 0
        cost, audit = put_together([[(w["start"], w["stop"], w["cost"], w["letters"]) for w in b[2]] for b in held])
        return held[0][0], gaps, *counts, cost, audit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            rows = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and held[0][0] != row[0]:
                    rows.append(whole(held))
                    held = []
                held.append(row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(whole(held)), arrow)], schema=arrow)

    return blocks.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(run, made)


class Repair:
    """Lines of a repaired conversation, from its audit and its rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _inserted(self) -> Iterator[str]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state, role = WANTED[self.state]
            self.at += 1
            yield f"{role}:"

    def row(self, role: str, text: str) -> Iterator[str]:
        yield from self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            self.state, role = WANTED[self.state]
        elif letter == "K":
            self.state = NEXT[self.state, role[:1]]
        if letter != "D":
            yield f"{role}:{text}"

    def rest(self) -> Iterator[str]:
        yield from self._inserted()


def _digests(audits: DataFrame, rows: DataFrame) -> DataFrame:
    """``audits`` with ``repaired_sha256``: each conversation's audit first, then its rows in order, streamed through a digest."""
    columns = audits.columns
    order = ["_turn_null", "turn", "role", "_head", "_hash"]
    texts = rows.where("copy IS NOT NULL").select(
        "conv", F.lit(1).alias("_kind"), F.col("turn").isNotNull().alias("_turn_null"), "turn", "role", F.substring("text", 1, 64).alias("_head"),
        F.xxhash64("text").alias("_hash"), "text", *[F.lit(None).cast(t).alias(c) for c, t in audits.dtypes if c != "conv"])
    heads = audits.select("conv", F.lit(0).alias("_kind"), *[F.lit(None).cast(dict(texts.dtypes)[c]).alias(c) for c in (*order, "text")], *columns[1:])
    both = heads.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "_kind", *order)
    source = both.select("_kind", "role", "text", *columns)
    from pyspark.sql.types import StructType

    schema = StructType([*audits.schema.fields]).add("repaired_sha256", "string")
    arrow = arrow_schema(audits.sparkSession, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, repair, digest, begun = None, None, None, False
        made: list[tuple] = []

        def take(lines: Iterator[str]) -> None:
            nonlocal begun
            for line in lines:
                digest.update(("\n" if begun else "").encode() + line.encode("utf-8", "surrogatepass"))
                begun = True

        def close() -> None:
            if head is not None:
                take(repair.rest())
                made.append((*head, digest.hexdigest()))

        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                for kind, role, text, *values in zip(*[c.to_pylist() for c in batch.slice(start, 1024).columns]):
                    if kind == 0:
                        close()
                        head, repair, digest, begun = values, Repair(values[-1]), hashlib.sha256(), False
                    else:
                        take(repair.row(role, text))
                if len(made) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)
                    made.clear()
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)

    return source.mapInArrow(run, schema)


def audit_rows(rows: DataFrame) -> DataFrame:
    """gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each ``conv``.

    ``rows`` has conv, turn, role, text, without NULL but in conv and turn, and
    ``copy``, NULL for a row that only names its conversation. Rows are taken by turn
    (NULL first), those of one turn by role and text. A role that begins with no
    known initial, the empty one too, cannot be kept. A conversation without rows
    gets zeros, no audit and the digest of nothing; rows without a conversation are one together.
    """
    core = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(core == "", BLANK).when(~F.right(core, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    first = F.substring("role", 1, 1)
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length("role"), F.lit(":"), "role", "text").cast("binary"), 256), 1, 32))
    narrow = rows.select(
        "conv", "turn", "copy", fault.alias("fault"), F.when(first == "", "-").otherwise(first).alias("initial"), digest.alias("digest"),
        *[c.alias(n) for c, n in zip(_order()[1:], ("role", "_head", "_hash"))], F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("_salt"))
    order = [F.col("turn").asc_nulls_first(), *[F.col(c) for c in ("role", "_head", "_hash", "_salt")]]
    numbers = numbered(narrow, "conv", order, "n", ["conv", "turn", "copy", "fault", "initial", "digest"])
    audits = written(_audits(_block_rows(_shapes(numbers))))
    return _digests(audits, rows)


def repaired(rows: DataFrame) -> DataFrame:
    """The audit of damaged conversations, by ``conv_id``."""
    made = audit_rows(damaged(rows))
    return made.select(F.col("conv").alias("conv_id"), "gaps", *COUNTS, "cost", "audit", "repaired_sha256")


def _sql() -> str:
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    moves = []  # every way to pass a row: state, initial wanted ('' any), fault class, next state, letters, cost, role given ('' its own)
    lead = {q: [(q, "", 0, "")] for q in range(4)}
    for q in range(4):
        state, letters, cost, lines = q, "", 0, ""
        for _ in range(2):
            state, role = WANTED[state]
            letters, cost, lines = letters + "I", cost + INSERT, lines + f"{role}:\n"
            lead[q].append((state, letters, cost, lines))
    for q, leads in lead.items():
        for state, letters, cost, lines in leads:
            moves.append((q, "", "any", state, letters + "D", cost + DELETE, lines, "gone"))
            for (s, initial), after in NEXT.items():
                if s == state:
                    moves.append((q, initial, "stay", after, letters + "K", cost + KEEP, lines, "own"))
            after, role = WANTED[state]
            moves.append((q, "", "stay", after, letters + "R", cost + REROLE, lines, role))
    quoted = ", ".join("(" + ", ".join(repr(v) if isinstance(v, int) else "'" + v.replace("\n", "' || chr(10) || '") + "'" for v in m) + ")" for m in moves)
    ends = ", ".join(f"({q}, '{letters}', {cost}, " + "'" + lines.replace("\n", "' || chr(10) || '") + "')" for q, leads in lead.items() for s, letters, cost, lines in leads if s in ENDS)
    return f"""
WITH RECURSIVE kinds AS (
  SELECT conv_id AS c, turn, coalesce(role, ' ') AS r0, coalesce(text, ' ') AS x0, {crc32_sql(key)} % 20 AS kind FROM conversations
), spoilt AS (
  SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE r0 END AS r, kind,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(x0, '[.!?]', '', 'g') ELSE x0 END AS x,
    unnest(range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, r, x, copy) AS i FROM spoilt
), faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(x, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY c, r, x ORDER BY i) > 1 THEN 'd'
    WHEN NOT regexp_matches(x, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '.' END AS f,
    lag(r[1:1]) OVER (PARTITION BY c ORDER BY i) || r[1:1] AS pair
  FROM placed
), moves(q, initial, class, after, letters, cost, lead, role) AS (VALUES {quoted}), ends(q, letters, cost, lines) AS (VALUES {ends}),
convs AS (SELECT DISTINCT c FROM kinds), ways AS (
  SELECT c, 0::BIGINT AS i, 0 AS q, {{'cost': 0::BIGINT, 'audit': '', 'lines': ''}} AS w FROM convs
  UNION ALL
  SELECT w.c, w.i + 1, m.after, min({{
    'cost': w.w.cost + m.cost + CASE WHEN f.f = 't' AND m.role <> 'gone' THEN {CUT} ELSE 0 END, 'audit': w.w.audit || m.letters,
    'lines': w.w.lines || m.lead || CASE m.role WHEN 'gone' THEN '' WHEN 'own' THEN f.r || ':' || f.x || chr(10) ELSE m.role || ':' || f.x || chr(10) END}})
  FROM ways w JOIN faulty f ON f.c IS NOT DISTINCT FROM w.c AND f.i = w.i + 1
  JOIN moves m ON m.q = w.q AND (m.class = 'any' OR f.f NOT IN ('b', 'd')) AND (m.initial = '' OR m.initial = f.r[1:1])
  GROUP BY w.c, w.i, m.after
), counted AS (
  SELECT c, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY c
), done AS (
  SELECT v.c, min({{'cost': w.w.cost + e.cost, 'audit': w.w.audit || e.letters, 'lines': w.w.lines || e.lines}}) AS w
  FROM convs v LEFT JOIN counted n ON n.c IS NOT DISTINCT FROM v.c
  JOIN ways w ON w.c IS NOT DISTINCT FROM v.c AND w.i = coalesce(n.n, 0) JOIN ends e ON e.q = w.q GROUP BY v.c
)
SELECT d.c AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, d.w.cost AS cost, d.w.audit AS audit, sha256(d.w.lines[:-2]) AS repaired_sha256
FROM done d LEFT JOIN counted n ON n.c IS NOT DISTINCT FROM d.c
"""


SQL = _sql()
