"""Language by cross-parsing: in whose text does a text find the longest pieces.

For each language a suffix automaton holds all substrings of some labelled text.
A text is parsed from left to right into phrases, each the longest match that
the automaton still accepts; the fewer phrases it needs, weighted by the bits
that name a place in the labelled text, the closer the language. Parsing starts
anew every ``SEGMENT`` characters, so many segments, of texts long and short, are
parsed at once, a character of each in a step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leakscan.llm.bpe import _ddl
from leakscan.llm.common import give_back, map_rows, once, training_split, whole
from leakscan.llm.learning import sample_texts

SEGMENT = 512
LANES = 2048  # segments parsed together
ROWS = 1024  # taken out of a batch at once
TOGETHER = 1 << 20  # characters of the texts that are read at once, or one text
DENSE = 120  # the commonest letters are looked up in a table, the others among sorted edges
UNKNOWN, SPACE = 0, 1  # a letter that no language has seen; a run of anything but letters
UNDETERMINED = "und"


@dataclass(frozen=True)
class Automaton:
    """Edges (from, symbol, to) of a suffix automaton over ``length`` symbols; state 0 is the start."""

    length: int
    states: int
    edges: bytes  # rows of three little-endian unsigned 32-bit integers


@dataclass(frozen=True)
class Model:
    letters: str  # symbol i + 2 is letter i; the commonest come first
    languages: tuple[str, ...]
    automata: tuple[Automaton, ...]


def suffix_automaton(symbols: list[int]) -> Automaton:
    """All substrings of ``symbols``, by the usual online construction; UNKNOWN breaks substrings."""
    after: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for symbol in symbols:
        if symbol == UNKNOWN:
            last = 0
            continue
        if symbol in after[last] and length[after[last][symbol]] == length[last] + 1:
            last = after[last][symbol]  # this substring is known from an earlier stretch
            continue
        new = len(after)
        after.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in after[at]:
            after[at][symbol] = new
            at = link[at]
        if at >= 0:
            old = after[at][symbol]
            if length[old] == length[at] + 1:
                link[new] = old
            else:
                copy = len(after)
                after.append(dict(after[old]))
                length.append(length[at] + 1)
                link.append(link[old])
                while at >= 0 and after[at].get(symbol) == old:
                    after[at][symbol] = copy
                    at = link[at]
                link[old] = copy
                if after[last].get(symbol) == copy:  # only where ``new`` could not be reached
                    last = copy
                    link[new] = copy
                    continue
                link[new] = copy
        last = new
    edges = np.array([(s, c, t) for s, out in enumerate(after) for c, t in out.items()], "<u4").reshape(-1, 3)
    return Automaton(len(symbols), len(after), edges.tobytes())


class Reader:
    """Texts to symbols: letters in lower case, and one SPACE for each run of other characters."""

    def __init__(self, letters: str):
        self.table = np.full(0x110000, SPACE, np.uint32)
        alphabetic = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.table[alphabetic] = UNKNOWN
        for i, letter in enumerate(letters):
            self.table[ord(letter)] = i + 2
        self.alphabetic = alphabetic

    def symbols(self, text: str) -> tuple[np.ndarray, bool]:
        """The symbols, and whether any letter is among the characters."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        found = self.table[points]
        keep = found != SPACE
        letters = bool(keep.any())
        keep[1:] |= found[:-1] != SPACE
        if len(keep):
            keep[0] = True
        return found[keep], letters


def parts_of(texts: list[str], most: int = TOGETHER) -> Iterator[list[str]]:
    """The texts in order, in lists of at most so many characters; a longer text is alone."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


class Parser:
    def __init__(self, model: Model):
        self.model, self.reader = model, Reader(model.letters)
        self.width = min(len(model.letters), DENSE) + 2
        self.tables, self.rare = [], []
        for a in model.automata:
            edges = np.frombuffer(a.edges, "<u4").reshape(-1, 3).astype(np.int64)
            table = np.full((a.states + 1) * self.width, -1, np.int32)  # from the last state nothing goes on
            dense = edges[edges[:, 1] < self.width]
            table[dense[:, 0] * self.width + dense[:, 1]] = dense[:, 2] * self.width
            self.tables.append(table)
            rare = edges[edges[:, 1] >= self.width]
            keys = rare[:, 0] * self.width << 32 | rare[:, 1]
            order = np.argsort(keys)
            self.rare.append((keys[order], (rare[order, 2] * self.width).astype(np.int32)))

    @staticmethod
    def rare_steps(edges: tuple[np.ndarray, np.ndarray], states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Where the symbols beyond the table lead; -1 where no edge goes on."""
        keys, to = edges
        if not len(keys):
            return np.full(len(symbols), -1, np.int32)
        wanted = states.astype(np.int64) << 32 | symbols
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, to[at], -1)

    def phrases(self, table: np.ndarray, edges: tuple[np.ndarray, np.ndarray], lanes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each segment; ``lanes`` has a row for each step, segments sorted from the longest.

        ``edges`` are those of symbols that the table has no column for.
        """
        every = np.arange(len(self.model.letters) + 2)
        first = np.concatenate([table[: self.width], self.rare_steps(edges, np.zeros(len(every) - self.width, np.int32), every[self.width :])])
        start = np.where(first < 0, len(table) - self.width, first)  # a symbol that begins no match is a phrase of its own
        count = np.ones(lanes.shape[1], np.int32)
        state = np.zeros(lanes.shape[1], np.int32)
        active = np.searchsorted(-lengths, -np.arange(len(lanes)), side="left")
        for step, row in enumerate(lanes):
            n = active[step]
            symbols, here = row[:n], state[:n]
            rare = np.flatnonzero(symbols >= self.width)
            if len(rare):
                to = table[here + np.where(symbols < self.width, symbols, UNKNOWN)]
                to[rare] = self.rare_steps(edges, here[rare], symbols[rare])
            else:
                to = table[here + symbols]
            ends = to < 0
            if step:
                count[:n] += ends
            state[:n] = np.where(ends, start[symbols], to)
        return count

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a symbol for each text and language, and whether a text has a letter."""
        made = [self._costs(part) for part in parts_of(texts)]
        if not made:
            return self._costs(texts)
        return np.concatenate([costs for costs, _ in made]), np.concatenate([letters for _, letters in made])

    def _costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        read = [self.reader.symbols(t) for t in texts]
        sizes = np.array([len(s) for s, _ in read], np.int64)
        parts = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        lengths = np.minimum(SEGMENT, sizes[owner] - nth * SEGMENT)
        flat = np.concatenate([s for s, _ in read]) if read else np.empty(0, np.uint32)
        begin = (np.cumsum(sizes) - sizes)[owner] + nth * SEGMENT
        order = np.argsort(-lengths, kind="stable")
        totals = np.zeros((len(texts), len(self.tables)))
        for at in range(0, len(order), LANES):
            part = order[at : at + LANES]
            size = lengths[part]
            steps = np.arange(size[0])
            lanes = flat[np.minimum(begin[part][None, :] + steps[:, None], len(flat) - 1)]
            for k, (table, edges) in enumerate(zip(self.tables, self.rare)):
                np.add.at(totals[:, k], owner[part], self.phrases(table, edges, lanes, size))
        bits = np.array([math.log2(max(2, a.length)) for a in self.model.automata])
        return totals * bits / np.maximum(sizes, 1)[:, None], np.array([letters for _, letters in read], bool)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language of least cost, and by what part of the next one's cost it is ahead."""
        costs, letters = self.costs(texts)
        names, scores = [], []
        for cost, has in zip(costs, letters):
            if not has or not len(cost):
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            best = int(cost.argmin())
            rest = np.delete(cost, best)
            names.append(self.model.languages[best])
            scores.append(float(1 - cost[best] / rest.min()) if len(rest) else 1.0)
        return names, scores


def train(samples: list[tuple[str, str]], symbols_each: int = 30_000) -> Model:
    """A model of (language, text) pairs; whole texts are taken until a language has ``symbols_each`` symbols."""
    seen: dict[str, int] = {}
    for _, text in samples:
        for c in text.lower():
            if c.isalpha():
                seen[c] = seen.get(c, 0) + 1
    letters = "".join(sorted(seen, key=lambda c: (-seen[c], c)))
    reader, languages, automata = Reader(letters), [], []
    for language in sorted({name for name, _ in samples}):
        joined: list[int] = []
        for name, text in samples:
            if name == language and len(joined) < symbols_each:
                joined += [*reader.symbols(text)[0].tolist(), UNKNOWN]
        if any(s > SPACE for s in joined):
            languages.append(language)
            automata.append(suffix_automaton(joined[:symbols_each]))
    return Model(letters, tuple(languages), tuple(automata))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", each: int = 60) -> Model:
    """A model from at most ``each`` texts of every language, none of them held out."""
    return train(sample_texts(docs, docs.where(training_split(F.col(key)) != 1).select(key, lang), key, text, lang, each))


def _parser(model: Model) -> Parser:
    return once(("language", model), lambda: Parser(model))


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, held_out, lang_pred and score for each row; only the whole text decides.

    Texts that are NULL or have no letter are "und" with a score of 0, as all
    are if nothing was learned. Other columns are left out.
    """

    def rows(keys, texts):
        names, scores = _parser(model).predict(texts)
        return {key: keys, "lang_pred": names, "score": scores}

    made = map_rows(docs.select(key, whole(F.col(text)).alias("_text")), _ddl(docs, [key]) + "lang_pred string, score double", rows, ROWS)
    return made.select(key, (training_split(F.col(key)) == 1).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is in a language, that is, not "und"."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                names, _ = _parser(model).predict([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array([n != UNDETERMINED for n in names], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
