"""Quality by compression: which of two dictionaries packs a text better.

One zstandard dictionary is trained on good texts, one on bad ones. The text is
cut into blocks, so that a dictionary counts in all of it and not in its start
only, and each block is compressed with both. The difference of the sums over the text's
bytes is turned into a probability by a logistic curve that is fitted to texts
no dictionary has seen.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame, functions as F

from leakscan.llm.bpe import _ddl
from leakscan.llm.common import map_rows, once, training_split, whole
from leakscan.llm.learning import sample_texts

BLOCK = 2048
LEVEL = 3


@dataclass(frozen=True)
class Model:
    """Two dictionaries (empty: none could be trained) and the curve ``1 / (1 + exp(-(slope * x + base)))``."""

    good: bytes
    bad: bytes
    slope: float
    base: float


def _blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.packers = [
            zstandard.ZstdCompressor(
                level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            for d in (model.good, model.bad) if d
        ]

    def difference(self, text: str) -> float:
        """(size with the bad dictionary - size with the good one) / bytes; 0 for the empty text."""
        data = text.encode("utf-8", "surrogatepass")
        if not data or len(self.packers) < 2:
            return 0.0
        good, bad = (sum(len(p.compress(b)) for b in _blocks(data)) for p in self.packers)
        return (bad - good) / len(data)

    def score(self, text: str) -> float:
        z = self.model.slope * self.difference(text) + self.model.base
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and base of the logistic curve, both labels weighing the same, by Newton's method."""
    scale = x.std() or 1.0
    design = np.stack([x / scale, np.ones_like(x)], axis=1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ w))
        slope = design.T @ (weight * (p - y)) + np.array([1.0, 0.0]) * w  # a small pull to 0 keeps the slope finite
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1.0, 1e-9])
        w = w - np.linalg.solve(curve, slope)
    return float(w[0] / scale), float(w[1])


def train(samples: list[tuple[int, str]], share_good: float, dictionary_bytes: int = 1 << 16) -> Model:
    """A model of (label, text) pairs; ``share_good`` is the share of label 1 among all labelled rows.

    Texts take turns between the dictionaries and the curve. With too few texts
    for two dictionaries every score is ``share_good``.
    """
    texts = {label: [t.encode("utf-8", "surrogatepass") for y, t in samples if y == label] for label in (1, 0)}
    share = min(max(share_good, 1e-3), 1 - 1e-3)
    prior = math.log(share / (1 - share))
    try:
        made = {
            label: zstandard.train_dictionary(dictionary_bytes, [b for t in found[::2] for b in _blocks(t)], k=512, d=8).as_bytes()
            for label, found in texts.items()
        }
    except (zstandard.ZstdError, ValueError):
        return Model(b"", b"", 0.0, prior)
    scorer = Scorer(Model(made[1], made[0], 1.0, 0.0))
    rest = [(label, t.decode("utf-8", "surrogatepass")) for label, found in texts.items() for t in found[1::2]]
    if len({label for label, _ in rest}) < 2:
        return Model(b"", b"", 0.0, prior)
    slope, base = _curve(np.array([scorer.difference(t) for _, t in rest]), np.array([float(label) for label, _ in rest]))
    return Model(made[1], made[0], slope, base + prior)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", each: int = 900) -> Model:
    """A model from at most ``each`` labelled texts of either label, none of them held out."""
    usable = labels.where(F.col(label).isin(0, 1) & (training_split(F.col(key)) != 1)).select(key, label)
    counts = {r[0]: r[1] for r in usable.groupBy(label).count().collect()}
    total = sum(counts.values())
    samples = sample_texts(docs, usable, key, text, label, each) if total else []
    return train(samples, counts.get(1, 0) / total if total else 0.5)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, held_out, score and predicted for each row; only the whole text decides the score.

    NULL and empty texts get the score of a difference of 0. Other columns are left out.
    """

    def rows(keys, texts):
        scorer = once(("quality", model), lambda: Scorer(model))
        return {key: keys, "score": [scorer.score(t) for t in texts]}

    scored = map_rows(docs.select(key, whole(F.col(text)).alias("_text")), _ddl(docs, [key]) + "score double", rows)
    return scored.select(
        key, (training_split(F.col(key)) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
