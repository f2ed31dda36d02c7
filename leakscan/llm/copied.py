"""Substring dedup: words covered by windows that an earlier document has, too.

A window is 50 consecutive words. Four passes over the texts, all in Arrow batches:

1. Each task sketches its windows, and the sketches are merged: a count-min sketch
   whose counters stop at two, as only "more than one" matters. A window goes in by
   its anchor, the least hash of the 26 runs of 25 words within it. Equal windows
   have equal anchors, so the estimate never falls below the window's count, and
   one anchor serves a dozen windows in a row.
2. Anchors that the sketch estimates repeated leave the texts and are grouped, which
   drops those that only shared their counters.
3. Windows of the anchors that are left are grouped exactly, by 128 bits of all
   their words. The least document that starts one wins; any later one loses it.
4. Words under lost windows are cut out.

Texts that are copies as a whole are settled before step 2 by their hash, so a group
of copies costs one text. The merged sketch is broadcast; its size follows the bytes
of the texts up to ``countmin.MOST``. Beyond that more anchors pass step 1 than need to,
and step 2 pays for them; none is lost at any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from leakscan.llm import countmin
from leakscan.llm.common import arrow_schema, discard, small_batches, whole, written
from leakscan.llm.countmin import mixed

WIDTH = 50  # words of a window
ANCHOR = 25  # words of the runs that stand for windows in the sketch
BYTES_A_CELL = 8  # of text for a counter; an anchor comes about every 80 bytes
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space only


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each word, as two rows."""
    digests = b"".join(map(xxhash.xxh3_128_digest, words))
    return np.ascontiguousarray(np.frombuffer(digests, "<u8").reshape(-1, 2).T)


def run_hashes(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """A polynomial hash of each run of ``width`` words, whatever stands before it."""
    n = len(hashes)
    powers = np.cumprod(np.full(n, base, "<u8"))
    sums = np.concatenate([np.zeros(1, "<u8"), np.cumsum(hashes * powers)])
    inverse = np.cumprod(np.full(n - width + 1, pow(base, -1, 1 << 64), "<u8"))
    return mixed((sums[width:] - sums[:-width]) * inverse)


def anchors(hashes: np.ndarray) -> np.ndarray:
    """The anchor of each window of a text of at least ``WIDTH`` words."""
    runs = run_hashes(hashes[0], ANCHOR, _BASES[0])
    return np.lib.stride_tricks.sliding_window_view(runs, WIDTH - ANCHOR + 1).min(axis=1)


def text_anchors(text: str) -> np.ndarray:
    """The different anchors of a text's windows."""
    words = split_words(text)
    return np.unique(anchors(word_hashes(words))) if len(words) >= WIDTH else np.empty(0, "<u8")


def window_keys(hashes: np.ndarray) -> np.ndarray:
    """128 bits of each window, as two columns."""
    return np.stack([run_hashes(h, WIDTH, b) for h, b in zip(hashes, _BASES)], axis=1)


def _arrays(source: DataFrame, schema: str, rows, most: int = 1 << 16):
    """``rows(*values)`` of each row of ``source`` gives equally long lists or arrays, which are the rows of the result."""
    arrow = arrow_schema(source.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.Table.from_batches(held, schema=arrow).combine_chunks().to_batches()[0]

        for batch in batches:
            for values in zip(*batch.columns):
                made = rows(*[v.as_py() for v in values])
                if made is not None and len(made[-1]):
                    held.append(pa.RecordBatch.from_arrays([pa.array(m, f.type) for m, f in zip(made, arrow)], schema=arrow))
                    size += len(made[-1])
                if size >= most:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return source.mapInArrow(run, schema)


def _travelling(texts: DataFrame) -> DataFrame:
    """The last column, a text, as zstandard frames, a third of its size: what follows moves every text through a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                frames = [None if t is None else pack(t.encode("utf-8", "surrogatepass")) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(frames, pa.binary())], names=[*part.schema.names[:-1], "_frame"])

    return texts.mapInArrow(run, StructType([*texts.schema.fields[:-1]]).add("_frame", "binary"))


def copied_places(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id``, ``_h1``, ``_all`` and ``_places`` of the texts that lose words.

    ``_all``: every window is lost; else ``_places`` has for each lost window, as
    a sequence of words, the first word at which it starts. NULL keys are before and
    after nothing: such rows lose nothing and take nothing. Of texts under one key
    none is earlier.
    """
    of_text = whole(F.col(text))
    named = docs.select(F.col(key).alias("_id"), F.xxhash64(of_text).alias("_h1"), F.xxhash64(F.lit(1), of_text).alias("_h2"), of_text.alias("_text"))
    id_type = dict(named.dtypes)["_id"]
    known = named.where(F.col("_id").isNotNull())
    groups = written(known.groupBy("_h1", "_h2").agg(
        F.min("_id").alias("_first"), F.max("_id").alias("_latest"), F.max(F.octet_length("_text")).alias("_bytes")))
    size = groups.agg(F.sum("_bytes")).first()[0] or 0
    bits = countmin.bits_for(size // BYTES_A_CELL)
    over = docs.sparkSession.sparkContext.broadcast(countmin.sketch(known.select("_text"), text_anchors, bits))

    def repeated(i, h1, h2, text):
        keys = text_anchors(text)
        keys = keys[countmin.estimated_repeated(keys, over.value, bits)]
        return [i] * len(keys), [h1] * len(keys), [h2] * len(keys), keys.view("<i8")

    several = groups.where("_first < _latest")
    met = _arrays(known.select("_id", "_h1", "_h2", "_text"), f"_id {id_type}, _h1 long, _h2 long, anchor long", repeated)
    # of copies, only the first one's text goes on
    anchored = written(met.join(several.select("_h1", "_h2", "_first"), ["_h1", "_h2"], "left")
                       .where(F.col("_first").isNull() | (F.col("_id") == F.col("_first"))).select("_id", "_h1", "anchor"))
    crowded = anchored.groupBy("anchor").agg(F.min("_id").alias("low"), F.max("_id").alias("high")).where("low < high").select("anchor")
    shared = written(anchored.join(crowded, "anchor"))
    wanted = shared.groupBy("_id", "_h1").agg(F.collect_set("anchor").alias("_anchors"))

    def windows(i, h1, frame, wanted):
        hashes = word_hashes(zstandard.decompress(frame).split())
        at = np.flatnonzero(np.isin(anchors(hashes), np.array(wanted, "<i8").view("<u8")))
        keys = window_keys(hashes)[at].view("<i8")
        order = np.lexsort((at, keys[:, 1], keys[:, 0]))
        keys, at = keys[order], at[order]
        first = np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]
        keys, at = keys[first], at[first]
        return keys[:, 0], keys[:, 1], [i] * len(at), [h1] * len(at), at

    texts = _travelling(known.select("_id", "_h1", "_text")).join(wanted, ["_id", "_h1"])
    started = written(_arrays(texts, f"k0 long, k1 long, _id {id_type}, _h1 long, place int", windows))
    least = started.groupBy("k0", "k1").agg(F.min("_id").alias("low"), F.max("_id").alias("high")).where("low < high").select("k0", "k1", "low")
    lost = started.join(least, ["k0", "k1"]).where("_id > low")
    places = lost.groupBy("_id", "_h1").agg(F.collect_set("place").alias("_places")).withColumn("_all", F.lit(False))
    later = known.select("_id", "_h1", "_h2").join(several, ["_h1", "_h2"]).where("_id > _first")
    copies = later.select("_id", "_h1").distinct().select("_id", "_h1", F.lit(None).cast("array<int>").alias("_places"), F.lit(True).alias("_all"))
    made = written(places.unionByName(copies))
    discard(groups, anchored, shared, started)
    over.unpersist()
    return made


def covered(hashes: np.ndarray, places: list[int]) -> np.ndarray:
    """Whether each word of a text is under a window equal to one that starts at ``places``."""
    keys = window_keys(hashes)
    both = np.ascontiguousarray(keys).view([("a", "<u8"), ("b", "<u8")]).ravel()
    wanted = np.sort(both[np.array(places, np.int64)], order=("a", "b"))
    at = np.searchsorted(wanted["a"], both["a"])
    starts = np.zeros(len(both), bool)
    # a handful of different windows may share their first half; all of them are looked at
    for step in range(int(np.unique(wanted["a"], return_counts=True)[1].max())):
        here = np.minimum(at + step, len(wanted) - 1)
        starts |= both == wanted[here]
    edges = np.zeros(len(hashes[0]) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(starts), 1)
    np.add.at(edges, np.flatnonzero(starts) + WIDTH, -1)
    return np.cumsum(edges[:-1]) > 0


def remove_copied(docs: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """``_row`` (the columns ``keep``), ``n_words``, ``n_removed`` and ``kept``.

    A word goes if a window over it, judged on the whole input, also starts in a
    row of a smaller key. ``kept`` is a text as it is where it loses nothing, else
    the words left, with one space between; with ``digest``, the SHA-256 of the
    words left so joined, in either case. NULL and empty texts have no words.
    Repeated rows lose the same words.
    """
    with small_batches(docs.sparkSession):
        lost = copied_places(docs, key, text)
    named = docs.select(F.struct(*[docs[c] for c in keep]).alias("_row"), docs[key].alias("_id"), F.xxhash64(whole(docs[text])).alias("_h1"), docs[text].alias("_text"))
    joined = _travelling(named).join(lost, ["_id", "_h1"], "left").select("_row", "_frame", "_all", "_places")

    def cut(frame: bytes | None, everything: bool | None, places: list[int] | None) -> tuple[int, int, str | None]:
        if frame is None:
            return 0, 0, hashlib.sha256().hexdigest() if digest else None
        text = zstandard.decompress(frame)
        words = text.split()
        n, gone = len(words), 0
        if everything and n >= WIDTH:
            words, gone = [], n
        elif places:
            under = covered(word_hashes(words), places)
            words, gone = [w for w, u in zip(words, under) if not u], int(under.sum())
        if digest:
            return n, gone, hashlib.sha256(b" ".join(words)).hexdigest()
        return n, gone, (b" ".join(words) if gone else text).decode("utf-8", "surrogatepass")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                made = [cut(f.as_py(), a.as_py(), p.as_py()) for f, a, p in zip(*part.columns[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]],
                    names=["_row", "n_words", "n_removed", "kept"])

    schema = StructType([joined.schema["_row"]]).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return joined.mapInArrow(run, schema)


def without_copied(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all its columns, its texts without copied words; a text that loses none stays as it is."""
    made = remove_copied(docs, [c for c in docs.columns if c != text] or [key], key, text)
    return made.select(*[F.col("kept").alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_words``, ``n_removed`` and ``kept_sha256`` of each row."""
    return remove_copied(docs, [key], key, text, digest=True).select(
        F.col("_row")[key].alias(key), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


SQL = f"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, doc_id, unnest(range(1, len(w) - {WIDTH - 2})) AS p, unnest(list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: md5(array_to_string(w[i:i + {WIDTH - 1}], ' ')))) AS k
  FROM texts WHERE len(w) >= {WIDTH}
), least AS (
  SELECT k, min(doc_id) AS first FROM windows GROUP BY k HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(p, p + {WIDTH})) AS q FROM windows JOIN least USING (k) WHERE doc_id > first
), words AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM texts
), left_over AS (
  SELECT r, string_agg(word, ' ' ORDER BY q) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (r, q) GROUP BY r
)
SELECT t.doc_id, len(t.w) AS n_words, len(t.w) - coalesce(l.n, 0) AS n_removed, sha256(coalesce(l.kept, '')) AS kept_sha256
FROM texts t LEFT JOIN left_over l USING (r)
"""
