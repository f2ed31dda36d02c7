"""Prefix trie of conversations: one row for each distinct beginning of a conversation.

A turn is 16 bytes, the first half of a SHA-256 of its role and text, so a
conversation is a byte string and its beginnings are the places at multiples of 16.
Each task inserts conversations into an adaptive radix tree: a node has 4, 16, 48 or
256 places for children and grows as it needs them, and a path without branches is
one node. Only the depths that end a turn are given out, with what the task's
conversations add to them; sums over tasks make the nodes. A common first turn, or a
group of copies, thus costs one row for each task.

Sums over a subtree count every node below once. A node is owned by its smallest
member, and what a conversation owns is always a tail of its own path. So the texts
below a node are summed over its members in a first turn, and those of the different
nodes over their owners, by the same trees, in a second.

Conversations go in by pieces of ``PIECE`` turns: a piece hangs on a digest of the
pieces before it, so the length of a conversation does not matter to a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from leakscan.llm.common import arrow_schema, discard, numbered, written

ID = 16  # bytes of a turn
PIECE = 64  # turns that are inserted as one key
HELD = 20_000  # pieces that a task's tree takes before it is given out
CHUNK = 8192  # conversation ids that are joined to one text
FIRST = 5  # turns that a conversation may take from another, at most


class Small:
    """Up to 4 or 16 children, their bytes side by side."""

    __slots__ = ("bytes", "children", "room")

    def __init__(self, room: int, keys: bytes = b"", children: tuple = ()):
        self.bytes, self.children, self.room = bytearray(keys), list(children), room

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return None if at < 0 else self.children[at]

    def put(self, byte: int, child):
        at = self.bytes.find(byte)
        if at >= 0:
            self.children[at] = child
            return self
        if len(self.bytes) == self.room:
            larger = Small(16, self.bytes, self.children) if self.room == 4 else Indexed(self.bytes, self.children)
            return larger.put(byte, child)
        self.bytes.append(byte)
        self.children.append(child)
        return self

    def all(self) -> list:
        return self.children


class Indexed:
    """Up to 48 children, found by a table of their places."""

    __slots__ = ("places", "children")

    def __init__(self, keys: bytes, children: list):
        self.places, self.children = bytearray(256), list(children)
        for i, byte in enumerate(keys):
            self.places[byte] = i + 1

    def get(self, byte: int):
        at = self.places[byte]
        return self.children[at - 1] if at else None

    def put(self, byte: int, child):
        at = self.places[byte]
        if at:
            self.children[at - 1] = child
            return self
        if len(self.children) == 48:
            return Direct(self.places, self.children).put(byte, child)
        self.children.append(child)
        self.places[byte] = len(self.children)
        return self

    def all(self) -> list:
        return self.children


class Direct:
    """A place for each byte."""

    __slots__ = ("children",)

    def __init__(self, places: bytes, children: list):
        self.children = [children[at - 1] if at else None for at in places]

    def get(self, byte: int):
        return self.children[byte]

    def put(self, byte: int, child):
        self.children[byte] = child
        return self

    def all(self) -> list:
        return [c for c in self.children if c is not None]


class Node:
    """``start`` and ``stop``: the bytes of ``key`` that its path holds; ``ends``: what was inserted with just this key."""

    __slots__ = ("key", "start", "stop", "children", "ends")

    def __init__(self, key: bytes, start: int, stop: int):
        self.key, self.start, self.stop, self.children, self.ends = key, start, stop, Small(4), []


def _common(a: bytes, b: bytes, start: int, stop: int) -> int:
    """How far both agree from ``start`` on, up to ``stop``."""
    if a[start:stop] == b[start:stop]:
        return stop
    low, high = start, stop - 1
    while low < high:
        half = (low + high + 1) // 2
        low, high = (half, high) if a[start:half] == b[start:half] else (low, half - 1)
    return low


def insert(root: Node | None, key: bytes, item) -> Node:
    """The tree with one more key."""
    if root is None:
        root = Node(key, 0, len(key))
        root.ends.append(item)
        return root
    above, node = None, root
    while True:
        agreed = _common(node.key, key, node.start, min(node.stop, len(key)))
        if agreed < node.stop:  # the path forks, or ends, within the node
            fork = Node(node.key, node.start, agreed)
            node.start = agreed
            fork.children = fork.children.put(node.key[agreed], node)
            if above is None:
                root = fork
            else:
                above.children = above.children.put(fork.key[fork.start], fork)
            node = fork
        if agreed == len(key):
            node.ends.append(item)
            return root
        below = node.children.get(key[agreed])
        if below is None:
            below = Node(key, agreed, len(key))
            below.ends.append(item)
            node.children = node.children.put(key[agreed], below)
            return root
        above, node = node, below


def _node_id(context: bytes, key: bytes, turns: int, whole: bytes) -> bytes:
    """A beginning's digest: that of the piece's context and of its own turns in the piece; a full piece is the next one's context."""
    if turns == 0:
        return context
    if turns == PIECE:
        return whole
    return hashlib.blake2b(context + key[: turns * ID], digest_size=ID).digest()


class Piece:
    """A key's numbers: sizes of its turns, and those of what follows the piece."""

    __slots__ = ("conv", "sizes", "after", "whole", "own", "leaf")

    def __init__(self, conv, sizes, after, whole, own=None, leaf=0):
        self.conv, self.sizes, self.after, self.whole, self.own, self.leaf = conv, sizes, after, whole, own, leaf


def beginnings(root: Node, context: bytes, done: int, owned: bool) -> Iterator[tuple]:
    """``(id, depth, id of the parent, least conversation, how many, sizes)`` of each depth of a tree that ends a turn.

    ``done`` is the number of turns before the pieces. ``owned``: "how many" counts
    leaves, and sizes are those of turns from a conversation's first own one on.
    """
    # depth first without recursion; the numbers of a node are ready when its children are
    order, stack = [], [(root, None)]
    while stack:
        node, above = stack.pop()
        order.append((node, above))
        stack.extend((child, node) for child in node.children.all())
    sums: dict[int, list] = {}
    for node, above in reversed(order):
        least, count, total, own, some = sums.pop(id(node), [None, 0, 0, None, None])
        for p in node.ends:
            least = p.conv if least is None or p.conv < least else least
            own = p.own if own is None or (p.own is not None and p.own < own) else own
            count += p.leaf if owned else 1
            total += p.after
            some = p
        low = -1 if above is None and done == 0 else 0 if above is None else above.stop // ID
        turns = node.stop // ID
        for t in range(turns, low, -1):
            size = some.sizes[t - 1] if t else 0
            total += size * (int(own <= done + t) if owned else count)
            parent = _node_id(context, node.key, t - 1, some.whole) if t else None
            yield _node_id(context, node.key, t, some.whole), done + t, parent, least, count, total
        if above is not None:
            sofar = sums.setdefault(id(above), [None, 0, 0, None, None])
            sofar[0] = least if sofar[0] is None or least < sofar[0] else sofar[0]
            sofar[1] += count
            sofar[2] += total
            sofar[3] = own if sofar[3] is None or (own is not None and own < sofar[3]) else sofar[3]
            sofar[4] = some


def _trees(pieces: DataFrame, owned: bool) -> DataFrame:
    """What each task's trees give out; ``pieces`` are dealt so that like ones meet, wherever a group is cut."""
    made = "node binary, depth long, parent binary, conv long, n long, sizes long"
    arrow = arrow_schema(pieces.sparkSession, made)
    extra = ["own", "leaf"] if owned else []
    columns = ["conv", "piece", "ids", "sizes", "c0", "c1", "x0", "x1", "own_after" if owned else "after", *extra]

    def out(trees: dict) -> Iterator[pa.RecordBatch]:
        rows = []
        for (context, done), root in trees.items():
            rows.extend(beginnings(root, context, done, owned))
        for i in range(0, len(rows), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + (1 << 16)]), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict = {}
        held = 0
        for batch in batches:
            for conv, piece, ids, sizes, c0, c1, x0, x1, after, *more in zip(*[c.to_pylist() for c in batch.columns]):
                context, whole = (a.to_bytes(8, "big", signed=True) + b.to_bytes(8, "big", signed=True) for a, b in ((c0, c1), (x0, x1)))
                at = context, piece * PIECE
                trees[at] = insert(trees.get(at), b"".join(ids), Piece(conv, sizes, after, whole, *more))
                held += 1
                if held >= HELD:
                    yield from out(trees)
                    trees, held = {}, 0
        if held:
            yield from out(trees)

    dealt = pieces.select(*columns).repartitionByRange("c0", "c1", F.get("ids", F.lit(0)), "conv")
    return dealt.sortWithinPartitions("c0", "c1", F.get("ids", F.lit(0))).mapInArrow(run, made)


def pieces_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Conversations cut into pieces: conv, piece, ids, sizes, after, last, and digests of what is before and, with the piece, after.

    ``turns`` has conv, at (0, 1, ...), id and size; ``convs`` every conv, so that those without turns have a piece, too.
    """
    piece = F.floor(F.col("at") / PIECE).cast("int")
    cut = turns.groupBy("conv", piece.alias("piece")).agg(F.array_sort(F.collect_list(F.struct("at", "id", "size"))).alias("t"))
    none = convs.join(turns.where("at = 0").select("conv"), "conv", "left_anti")
    both = cut.select("conv", "piece", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes")).unionByName(
        none.select("conv", F.lit(0).alias("piece"), F.array().cast("array<binary>").alias("ids"), F.array().cast("array<long>").alias("sizes")))
    summed = both.withColumns({
        "d0": F.xxhash64("piece", "ids"), "d1": F.xxhash64(F.lit(1), "piece", "ids"),
        "here": F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)})
    order = Window.partitionBy("conv").orderBy("piece")
    before, sofar, later = (order.rowsBetween(a, b) for a, b in (
        (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0), (1, Window.unboundedFollowing)))
    zero = F.lit(0).cast("long")
    return summed.select(
        "conv", "piece", "ids", "sizes", "here",
        F.coalesce(F.bit_xor("d0").over(before), zero).alias("c0"), F.coalesce(F.bit_xor("d1").over(before), zero).alias("c1"),
        F.bit_xor("d0").over(sofar).alias("x0"), F.bit_xor("d1").over(sofar).alias("x1"),
        F.coalesce(F.sum("here").over(later), zero).alias("after"), F.lead("piece").over(order).isNull().alias("last"),
    )


def _endings(pieces: DataFrame) -> DataFrame:
    """``node`` and ``ends_sha256`` of the conversations that end there.

    Ids are joined to texts in range-dealt tasks; a digest then runs over a node's few texts, in order, with the digest as its state.
    """

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for ids, c0, c1, x0, x1 in zip(*[c.to_pylist() for c in batch.columns[1:]]):
                context, whole = (a.to_bytes(8, "big", signed=True) + b.to_bytes(8, "big", signed=True) for a, b in ((c0, c1), (x0, x1)))
                made.append(_node_id(context, b"".join(ids), len(ids), whole))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["conv", "node"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, made = None, [], []
        for batch in batches:
            for conv, at in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (at != node or len(held) == CHUNK):
                    made.append((node, held[0], ",".join(map(str, held))))
                    held = []
                node = at
                held.append(conv)
                if len(made) == 1024:
                    yield rows(made, (pa.binary(), pa.int64(), pa.string()), ("node", "first", "ids"))
                    made = []
        if held:
            made.append((node, held[0], ",".join(map(str, held))))
        if made:
            yield rows(made, (pa.binary(), pa.int64(), pa.string()), ("node", "first", "ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, made = None, None, []
        for batch in batches:
            for at, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if at != node:
                    if digest:
                        made.append((node, digest.hexdigest()))
                    node, digest = at, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
                if len(made) == 4096:
                    yield rows(made, (pa.binary(), pa.string()), ("node", "ends_sha256"))
                    made = []
        if digest:
            made.append((node, digest.hexdigest()))
            yield rows(made, (pa.binary(), pa.string()), ("node", "ends_sha256"))

    def rows(made: list, types: tuple, names: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=list(names))

    last = pieces.where("last").select("conv", "ids", "c0", "c1", "x0", "x1").mapInArrow(ends, "conv long, node binary")
    joined = last.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(texts, "node binary, first long, ids string")
    return joined.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digests, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie: node, depth, parent, conv (smallest member), parent_conv, n_convs, n_children, n_leaves, saved, ends_sha256.

    Arguments as in :func:`pieces_of`. ``saved`` sums, over the node and all below, the size of the last turn times the members but one.
    """
    pieces = written(pieces_of(turns, convs))
    nodes = written(_trees(pieces, False).groupBy("node").agg(
        F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("conv").alias("conv"),
        F.sum("n").alias("n_convs"), F.sum("sizes").alias("sizes")))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    shaped = written(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    owners = shaped.groupBy("conv").agg(F.min("depth").alias("own"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    place = F.col("piece") * PIECE
    own_here = F.aggregate(
        F.slice("sizes", F.greatest(F.lit(1), F.least(F.col("own") - place, F.lit(PIECE + 1))).cast("int"), PIECE), F.lit(0).cast("long"), lambda a, x: a + x)
    later = Window.partitionBy("conv").orderBy("piece").rowsBetween(1, Window.unboundedFollowing)
    owned = pieces.join(owners, "conv").withColumn("own_here", own_here).withColumn(
        "own_after", F.coalesce(F.sum("own_here").over(later), F.lit(0).cast("long")))
    below = _trees(owned, True).groupBy("node").agg(F.sum("n").alias("n_leaves"), F.sum("sizes").alias("different"))
    above = shaped.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv"))
    made = written(
        shaped.join(below, "node").join(_endings(pieces), "node", "left").join(above, "parent", "left").select(
            "node", "depth", "parent", "conv", "parent_conv", "n_convs", "n_children", "n_leaves", (F.col("sizes") - F.col("different")).alias("saved"),
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))
    discard(pieces, nodes, shaped)
    return made


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes for a role and a text."""
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * ID))


def rebuilt(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The turns (conv, at, id, size) of each conversation, put together with another one's first turns, and all conversations.

    Rows are ordered by turn (NULL first), those of one turn by role, then text.
    Rows without a conversation belong to none and are left out.
    """
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    narrow = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("_turn"), r.alias("_role"), F.substring(t, 1, 64).alias("_head"), F.xxhash64(t).alias("_hash"),
        turn_id(r, t).alias("id"), F.length(t).cast("long").alias("size"), F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("_salt"))
    order = [F.col("_turn").asc_nulls_first(), *[F.col(c) for c in ("_role", "_head", "_hash", "_salt")]]
    own = numbered(narrow, "conv", order, "n", ["conv", "id", "size"])
    taken = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(FIRST + 1)).cast("long")
    counts = own.groupBy("conv").agg(F.count("*").alias("m")).select("conv", "m", taken.alias("h"), (F.col("conv") - F.col("conv") % 100).alias("base"))
    bases = counts.select(F.col("conv").alias("base"), F.col("m").alias("base_m"))
    convs = written(counts.join(bases, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("base_m", F.lit(0))).alias("k")))
    kept = own.join(convs, "conv").where("n >= h").select("conv", (F.col("n") - F.col("h") + F.col("k")).alias("at"), "id", "size")
    starts = own.where((F.col("conv") % 100 == 0) & (F.col("n") < FIRST)).withColumnRenamed("conv", "base")
    lent = starts.join(convs, "base").where("n < h").select("conv", F.col("n").alias("at"), "id", "size")
    return kept.unionByName(lent), convs.select("conv")


def conversation_nodes(rows: DataFrame) -> DataFrame:
    """The trie of :func:`rebuilt` conversations, a row for each node, with conversations named by ``conv_id``."""
    return prefix_trie(*rebuilt(rows)).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), "ends_sha256")


def crc32_sql(text: str) -> str:
    """The CRC-32 of an ASCII text, bit by bit; -1 stands for a shift."""
    steps = ", ".join(["-1"] * 8)
    codes = f"flatten(list_transform(string_split({text}, ''), lambda c: [unicode(c)::BIGINT, {steps}]))"
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda a, x: CASE WHEN x = -1 THEN xor(a >> 1, (a & 1) * 3988292384) ELSE xor(a, x) END), 4294967295)"


SQL = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS n
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % 100 AS b, {crc32_sql('c::VARCHAR')} % {FIRST + 1} AS h FROM (SELECT DISTINCT c FROM t)
), turns AS (
  SELECT v.c, 0 AS part, n, r, x FROM convs v JOIN t ON t.c = v.b AND n < h
  UNION ALL SELECT c, 1, n, r, x FROM t JOIN convs USING (c) WHERE n >= h
), seqs AS (
  SELECT c, coalesce(list(len(r) || ':' || r || x ORDER BY part, n) FILTER (r IS NOT NULL), []) AS s,
    coalesce(list(len(x) ORDER BY part, n) FILTER (r IS NOT NULL), []) AS l
  FROM convs LEFT JOIN turns USING (c) GROUP BY c
), members AS (
  SELECT c, s, l, unnest(range(0, len(s) + 1)) AS d FROM seqs
), nodes AS (
  SELECT s[1:d] AS p, d, min(c) AS conv_id, count(*) AS n_convs, max(CASE WHEN d > 0 THEN l[d] ELSE 0 END) AS size,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(s) = d), '') AS ends
  FROM members GROUP BY p, d
), children AS (
  SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), paths AS (
  SELECT n.p, (coalesce(n_children, 0) = 0)::BIGINT AS leaf, (n_convs - 1) * size AS saved, unnest(range(0, d + 1)) AS a
  FROM nodes n LEFT JOIN children USING (p)
), sums AS (
  SELECT p[1:a] AS p, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM paths GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums USING (p) LEFT JOIN children USING (p) LEFT JOIN nodes u ON n.d > 0 AND u.p = n.p[1:n.d - 1]
"""
