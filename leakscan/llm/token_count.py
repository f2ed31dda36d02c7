"""Token counts by a piece vocabulary, with a shortcut for whole tokens.

The vocabulary merges characters by score and spells what it lacks in bytes. No
piece holds a word mark after another character, nor two characters side by side
that no other piece has so, and no merge reaches over such a seam: a text falls
into pre-tokens that merge on their own. Offline, the merges are run once for
each piece: those that come out as one token are **proven**. A pre-token that is
proven counts 1 at once; only the rest is merged.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from leakscan.llm.bpe import _ddl
from leakscan.llm.common import map_rows, once, whole

MARK = "▁"  # stands for a space in pieces
NEVER = float("-inf")


@dataclass(frozen=True)
class Vocabulary:
    """What counting needs of a model: pieces in order of id, their scores, and which of them are ordinary."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]


def read_vocabulary(path: str) -> Vocabulary:
    """The ordinary pieces of a model file whose texts pass unchanged but for a word mark in front."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = " a  ①ﬁ "
    if model.normalize(probe) != (MARK + probe).replace(" ", MARK):
        raise ValueError("models that normalise texts are not supported")
    ids = [i for i in range(model.vocab_size()) if not (model.IsByte(i) or model.IsControl(i) or model.IsUnknown(i) or model.IsUnused(i))]
    return Vocabulary(tuple(model.id_to_piece(i) for i in ids), tuple(model.get_score(i) for i in ids))


class Merger:
    """Joins the neighbours whose piece scores highest, leftmost first, until none is a piece."""

    def __init__(self, vocabulary: Vocabulary):
        self.score = dict(zip(vocabulary.pieces, vocabulary.scores))

    def merged(self, word: str) -> list[str]:
        return self._short(list(word)) if len(word) <= 48 else self._long(word)

    def _short(self, row: list[str]) -> list[str]:
        score = self.score
        gains = [score.get(row[i] + row[i + 1], NEVER) for i in range(len(row) - 1)]
        while gains:
            best = max(gains)
            if best == NEVER:
                break
            i = gains.index(best)
            row[i : i + 2] = [row[i] + row[i + 1]]
            del gains[i]
            if i:
                gains[i - 1] = score.get(row[i - 1] + row[i], NEVER)
            if i < len(gains):
                gains[i] = score.get(row[i] + row[i + 1], NEVER)
        return row

    def _long(self, word: str) -> list[str]:
        """The same over a heap and linked neighbours, for words of any length."""
        score, n = self.score, len(word)
        part: list[str | None] = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < n:
                both = part[i] + part[after[i]]
                gain = score.get(both, NEVER)
                if gain > NEVER:
                    heapq.heappush(heap, (-gain, i, both))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if part[i] is None or after[i] >= n or part[i] + part[after[i]] != both:
                continue
            gone = after[i]
            part[i], part[gone], after[i] = both, None, after[gone]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in part if p is not None]

    def count(self, word: str) -> int:
        """Tokens of a pre-token; a character without a piece takes a token for each of its bytes."""
        return sum(1 if p in self.score else len(p.encode("utf-8", "surrogatepass")) for p in self.merged(word))


def prove(vocabulary: Vocabulary) -> frozenset[str]:
    """The pieces whose text, met as a pre-token, is one token."""
    merger = Merger(vocabulary)
    return frozenset(p for p in vocabulary.pieces if merger.merged(p) == [p])


def bonds(vocabulary: Vocabulary) -> frozenset[str]:
    """The pairs of characters that some piece has side by side.

    No merge reaches over any other pair, so a text falls apart there. Raises
    if a piece has a word mark after another character, as words would then not
    merge on their own.
    """
    pairs = frozenset(a + b for p in vocabulary.pieces for a, b in zip(p, p[1:]))
    if any(pair[1] == MARK != pair[0] for pair in pairs):
        raise ValueError("a piece reaches over a word mark")
    return pairs


class Counter(dict):
    """Token counts of whole texts.

    As a dict it holds, for words as they stand between single spaces (the word
    mark in front left out), the proven pieces and up to ``limit`` other words.
    """

    def __init__(self, vocabulary: Vocabulary, proven: frozenset[str], limit: int = 250_000):
        super().__init__()
        self.merger, self.proven, self.limit = Merger(vocabulary), proven, limit
        self.bonds = bonds(vocabulary)
        self.whole = {p[1:]: 1 for p in proven if p[0] == MARK}
        self.update(self.whole)
        self.parts: dict[str, int] = {}

    def _pieces(self, marked: str) -> int:
        """Tokens of a text with marks for spaces, part by part between the seams."""
        bonds, total, start = self.bonds, 0, 0
        for i in range(1, len(marked)):
            if marked[i - 1 : i + 1] not in bonds:
                total += self._part(marked[start:i])
                start = i
        return total + self._part(marked[start:])

    def _part(self, part: str) -> int:
        if part in self.proven:
            return 1
        n = self.parts.get(part)
        if n is None:
            n = self.merger.count(part)
            if len(part) <= 64:
                if len(self.parts) > self.limit:
                    self.parts.clear()
                self.parts[part] = n
        return n

    def __missing__(self, word: str) -> int:
        n = self._pieces(MARK + word)
        if len(word) <= 64:
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if len(self) > self.limit + len(self.whole):
            self.clear()
            self.update(self.whole)
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return self._pieces(MARK + text.replace(" ", MARK))  # runs of marks merge with each other
        return sum(map(self.__getitem__, text.split(" ")))


def _counter(vocabulary: Vocabulary, proven: frozenset[str]) -> Counter:
    return once(("counter", vocabulary.pieces, vocabulary.scores), lambda: Counter(vocabulary, proven))


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, keep: list[str], text: str = "text", limit: int = 4096) -> DataFrame:
    """The columns ``keep`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of each whole text.

    NULL counts as the empty text, which has no tokens. Other columns are left
    out. No shuffle; the proof is made on the driver, once, and travels along.
    """
    proven = prove(vocabulary)
    if {"n_bytes", "n_tokens", "over_limit"} & set(keep):
        raise ValueError("keep names a column that is added")

    def rows(*columns):
        counter = _counter(vocabulary, proven)
        return dict(zip(keep, columns)) | {
            "n_bytes": [len(t.encode()) for t in columns[-1]],
            "n_tokens": [counter.count(t) for t in columns[-1]],
        }

    source = docs.select(*keep, whole(F.col(text)).alias("_text"))
    counted = map_rows(source, _ddl(docs, keep) + "n_bytes long, n_tokens long", rows)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
