"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

**Encoding.** Merging by rank has a local test: a row of tokens is what the
merges give for its bytes if, and only if, each two neighbours are what the
merges give for the bytes of these two (``Merges.adjacent``). So each prefix of
the input has exactly one last token, and reading a byte adds one step to one of
a few open chains of tokens: those whose rest may still grow into a token. A set
of open chains, less what all of them share, is a state of a deterministic
transducer; what they share is emitted. As no token is longer than the longest
of the vocabulary, output is at most that many bytes late. States and
transitions are made when first needed.

**Decoding** joins the bytes of the tokens and holds back an unfinished UTF-8
character at the end of a chunk, as a state machine over bytes tells it.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame, functions as F

from leakscan.llm.common import map_rows, once, whole

ROOT = 0
LIMITS = 250_000, 400_000  # pre-tokens and transitions that an encoder keeps
FEW = 50_000, 100_000  # the same beside other work in one session: about 60 MB less of a worker, for half as much time again


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank; ranks must run from 0 without gaps."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [tokens[r] for r in range(len(tokens))]


class Merges:
    """The merges behind a vocabulary: for each token the two tokens it is made of."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: r for r, t in enumerate(tokens)}
        single = [self.rank.get(bytes([b])) for b in range(256)]
        if None in single:
            raise ValueError("the vocabulary lacks single bytes")
        self.parts: list[tuple[int, int] | None] = [None] * len(tokens)
        self.made: dict[tuple[int, int], int] = {}
        for r, token in enumerate(tokens):
            if len(token) > 1:
                parts = self._merged(token, below=r)
                if len(parts) != 2:
                    raise ValueError(f"token {r} cannot be reached by merges")
                self.parts[r] = (parts[0], parts[1])
                self.made[self.parts[r]] = r

    def _merged(self, data: bytes, below: int) -> list[int]:
        """Merge the best pair, leftmost first, while its rank is under ``below``."""
        row, rank = [data[i : i + 1] for i in range(len(data))], self.rank
        while len(row) > 1:
            best, at = min((rank.get(row[i] + row[i + 1], below), i) for i in range(len(row) - 1))
            if best >= below:
                break
            row[at : at + 2] = [row[at] + row[at + 1]]
        return [rank[x] for x in row]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` side by side.

        Undoes the merges at the seam, latest first. A pair that could have
        merged before the undone one was made would have crossed the seam.
        """
        parts, made = self.parts, self.made
        bound = len(parts)
        while True:
            if made.get((left, right), bound) < bound:
                return False
            a, b = parts[left], parts[right]
            if a is None and b is None:
                return True
            # of two merges the one of higher rank came later; of equal ones the right one did
            if b is None or (a is not None and left > right):
                bound, left = left, a[1]
            else:
                bound, right = right + 1, b[0]


class Transducer:
    """Bytes in, packed ids out; see the module's text.

    A state is a row of open chains ``(node, last, pending)``: how the bytes read
    since may go on towards a token, the token before them, and the tokens not
    yet emitted; it is kept as the bytes of an array, which take least memory.
    ``limit`` bounds the transitions kept: those met first, which are the common
    ones. Where another one is needed, the rest of the pre-token is read without
    keeping any.
    """

    def __init__(self, merges: Merges, limit: int = 400_000):
        self.merges, self.limit = merges, limit
        branches: list[dict[int, int]] = [{}]
        token = [-1]
        for rank, word in enumerate(merges.tokens):
            node = ROOT
            for b in word:
                after = branches[node].get(b)
                if after is None:
                    after = branches[node][b] = len(token)
                    branches.append({})
                    token.append(-1)
                node = after
            token[node] = rank
        self.branches, self.token = branches, token
        self._pairs: dict[int, bool] = {}
        start = _state([(ROOT, -1, ())])
        self.states, self.numbers = [start], {start: 0}
        self.moves: dict[int, tuple[int, bytes]] = {}
        self.rest = [b""]

    def _adjacent(self, left: int, right: int) -> bool:
        key = left << 24 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > self.limit:
                self._pairs.clear()
            known = self._pairs[key] = left < 0 or self.merges.adjacent(left, right)
        return known

    def _advance(self, chains: Iterable[tuple], byte: int) -> tuple[list[tuple], tuple]:
        """The open chains after a byte, and the tokens that are certain now."""
        after, done, least = [], None, 1
        branches, tokens = self.branches, self.token
        for node, last, pending in chains:
            node = branches[node].get(byte)
            if node is None:
                continue
            token = tokens[node]
            if token >= 0 and done is None and self._adjacent(last, token):
                done = (ROOT, token, (*pending, token))
            if branches[node]:
                after.append((node, last, pending))
                least = min(least, len(pending))
        after.append(done)
        # all that every open chain has in common is certain
        first, shared = after[0][2], 0
        if least:
            for token in first:
                if any(len(c[2]) <= shared or c[2][shared] != token for c in after):
                    break
                shared += 1
        if shared:
            after = [(node, last, pending[shared:]) for node, last, pending in after]
        return after, first[:shared]

    def _move(self, state: int, byte: int) -> tuple[int, bytes]:
        chains, sure = self._advance(_chains(self.states[state]), byte)
        key = _state(chains)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.rest.append(packed(chains[-1][2]))
        move = self.moves[state << 8 | byte] = (number, packed(sure))
        return move

    def _unkept(self, state: int, data: bytes) -> Iterator[bytes]:
        chains = list(_chains(self.states[state]))
        for byte in data:
            chains, sure = self._advance(chains, byte)
            if sure:
                yield packed(sure)
        yield packed(chains[-1][2])

    def run(self, data: bytes) -> bytes:
        """The ids of one pre-token, as little-endian unsigned 32-bit integers."""
        state, out, moves = 0, [], self.moves
        for at, byte in enumerate(data):
            move = moves.get(state << 8 | byte)
            if move is None:
                if len(moves) >= self.limit:
                    out.extend(self._unkept(state, data[at:]))
                    return b"".join(out)
                move = self._move(state, byte)
            state = move[0]
            if move[1]:
                out.append(move[1])
        out.append(self.rest[state])
        return b"".join(out)


def _state(chains: list[tuple]) -> bytes:
    flat = array("i")
    for node, last, pending in chains:
        flat.extend((node, last, len(pending), *pending))
    return flat.tobytes()


def _chains(state: bytes) -> Iterator[tuple[int, int, tuple]]:
    flat, at = array("i", state), 0
    while at < len(flat):
        end = at + 3 + flat[at + 2]
        yield flat[at], flat[at + 1], tuple(flat[at + 3 : end])
        at = end


def packed(ids: Iterable[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


class Encoder(dict):
    """Ids of whole texts. As a dict it remembers the ids of up to ``limit`` pre-tokens."""

    def __init__(self, tokens: list[bytes], pattern: str, limit: int = LIMITS[0], moves: int = LIMITS[1]):
        super().__init__()
        self.machine = Transducer(Merges(tokens), moves)
        self.pattern, self.limit = regex.compile(pattern), limit

    def __missing__(self, piece: str) -> bytes:
        ids = self.machine.run(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > self.limit:
            self.clear()
        return b"".join(map(self.__getitem__, self.pattern.findall(text)))


def _utf8_table() -> np.ndarray:
    """Next state by state and byte. 0: between characters; 8: not UTF-8.

    1, 2, 3: so many continuation bytes to come; 4 to 7: as 2, 2, 3, 3 with a
    narrower range for the next byte (after E0, ED, F0, F4).
    """
    to = np.full((9, 256), 8, np.uint8)
    to[0, 0x00:0x80], to[0, 0xC2:0xE0], to[0, 0xE1:0xF0], to[0, 0xF1:0xF4] = 0, 1, 2, 3
    to[0, 0xE0], to[0, 0xED], to[0, 0xF0], to[0, 0xF4] = 4, 5, 6, 7
    to[1, 0x80:0xC0], to[2, 0x80:0xC0], to[3, 0x80:0xC0] = 0, 1, 2
    to[4, 0xA0:0xC0], to[5, 0x80:0xA0], to[6, 0x90:0xC0], to[7, 0x80:0x90] = 1, 1, 2, 2
    return to


UTF8 = _utf8_table().tolist()


class StreamDecoder:
    """Decodes ids chunk by chunk; each chunk ends between two characters."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.held = tokens, b""

    def feed(self, ids: Iterable[int]) -> bytes:
        data = self.held + b"".join(map(self.tokens.__getitem__, ids))
        start = len(data)
        for back in range(1, min(4, len(data)) + 1):  # the last character starts here or there is none unfinished
            if data[-back] & 0xC0 != 0x80:
                start = len(data) - back
                break
        state = 0
        for byte in data[start:]:
            state = UTF8[state][byte]
        cut = start if 0 < state < 8 else len(data)
        self.held = data[cut:]
        return data[:cut]

    def finish(self) -> bytes:
        held, self.held = self.held, b""
        return held


def decode_stream(tokens: list[bytes], packed_ids: bytes, chunk: int = 1 << 16) -> Iterator[bytes]:
    ids, decoder = np.frombuffer(packed_ids, "<u4"), StreamDecoder(tokens)
    for start in range(0, len(ids), chunk):
        yield decoder.feed(ids[start : start + chunk].tolist())
    yield decoder.finish()


def _encoder(joined: bytes, lengths: bytes, pattern: str, limits: tuple[int, int] = LIMITS) -> Encoder:
    return once(("encoder", joined, lengths, pattern, limits), lambda: Encoder(_cut(joined, lengths), pattern, *limits))


def _tokens(joined: bytes, lengths: bytes) -> list[bytes]:
    return once(("tokens", joined, lengths), lambda: _cut(joined, lengths))


def _cut(joined: bytes, lengths: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(lengths, "<u2"))
    return [joined[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _shipped(tokens: list[bytes]) -> tuple[bytes, bytes]:
    """A vocabulary in two strings, which travel with the tasks; executors need no file."""
    return b"".join(tokens), np.array([len(t) for t in tokens], "<u2").tobytes()


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``ids``: the whole text's ids, packed as little-endian unsigned 32-bit integers.

    NULL and empty texts give no ids. Other columns of ``docs`` are left out,
    so their names don't matter. No shuffle; a text is one row's work.
    """
    vocabulary = _shipped(tokens)

    def rows(*columns):
        encoder = _encoder(*vocabulary, pattern)
        return dict(zip(keep, columns)) | {"ids": [encoder.encode(t) for t in columns[-1]]}

    source = docs.select(*keep, whole(F.col(text)).alias("_text"))
    return map_rows(source, _ddl(docs, keep) + "ids binary", rows)


def decode(encoded: DataFrame, tokens: list[bytes], keep: list[str], ids: str = "ids") -> DataFrame:
    """The columns ``keep`` and ``decoded``, the bytes that the ids stand for; none for NULL ids."""
    vocabulary = _shipped(tokens)

    def rows(*columns):
        words = _tokens(*vocabulary)
        return dict(zip(keep, columns)) | {"decoded": [b"".join(decode_stream(words, x or b"")) for x in columns[-1]]}

    return map_rows(encoded.select(*keep, F.col(ids).alias("_ids")), _ddl(encoded, keep) + "decoded binary", rows)


def _ddl(df: DataFrame, keep: list[str]) -> str:
    types = dict(df.dtypes)
    return "".join(f"`{c}` {types[c]}, " for c in keep)


def round_trip(
    docs: DataFrame, tokens: list[bytes], pattern: str, keep: list[str], text: str = "text", limits: tuple[int, int] = LIMITS
) -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass: ``keep``, ``ids`` and ``decoded``; ``limits`` bear on memory and time only."""
    vocabulary = _shipped(tokens)

    def rows(*columns):
        encoder = _encoder(*vocabulary, pattern, limits)
        words = encoder.machine.merges.tokens
        ids = [encoder.encode(t) for t in columns[-1]]
        return dict(zip(keep, columns)) | {"ids": ids, "decoded": [b"".join(decode_stream(words, x)) for x in ids]}

    source = docs.select(*keep, whole(F.col(text)).alias("_text"))
    return map_rows(source, _ddl(docs, keep) + "ids binary, decoded binary", rows)


def digests(
    docs: DataFrame, tokens: list[bytes], pattern: str, keep: list[str], text: str = "text", with_ids: bool = False, limits: tuple[int, int] = LIMITS
) -> DataFrame:
    """``keep`` with n_tokens, ids_sha256 and decoded_sha256 of the ids and of what they decode to; ``ids`` too if asked for."""
    return round_trip(docs, tokens, pattern, keep, text, limits).select(
        *keep,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *(["ids"] if with_ids else []),
    )
