"""Quality classifier: Bradley-Terry scores learnt from preference pairs.

A document labelled good is preferred to one labelled bad. With features ``f`` the chance
that ``a`` is preferred to ``b`` is ``sigmoid(w . (f(a) - f(b)))``; ``w`` minimises the
logistic loss over pairs. Scores are then cut at the quantile of the training scores that
tells the labels apart best, and shifted so that the cut is 0.5.

Only the labels of a bounded sample reach the driver; scoring reads whole texts in the scan,
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, sampled

#: Labelled rows the model is fitted on, at most (about).
TRAINING_ROWS = 20_000
#: Pairs in which each labelled row of the rarer label takes part.
PAIRS_PER_ROW = 8

# Characters that features count.
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
SYMBOLS = b"#*$%&<>=+_^~@\\"
BARS = b"|"
MARKS = b"!?"
STOPS = b".,;:"
FEATURES = (
    "log words", "word length", "repeated neighbours", "distinct words", "upper case", "digits", "symbols", "bars",
    "marks", "stops", "share of repeated lines", "words a line", "longest word",
)


def features(text: str | None) -> list[float]:
    """Numbers about one text, from the text alone; an empty text has its own values."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(raw)
    lines = [line for line in raw.split(b"\n") if line.strip()]

    def share(characters: bytes, of: int) -> float:
        return (size - len(raw.translate(None, characters))) / of

    return [
        float(np.log1p(n)),
        min(size / n, 30.0),
        sum(map(eq, words, islice(words, 1, None))) / n,
        len(set(words)) / n ** 0.8,
        share(UPPER, size),
        share(DIGITS, size),
        min(share(SYMBOLS, n), 2.0),
        min(share(BARS, n), 2.0),
        min(share(MARKS, n), 2.0),
        min(share(STOPS, n), 2.0),
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        float(np.log1p(max(map(len, words)))),
    ]


def _features(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def rows(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    return rows(text)


@dataclass(frozen=True)
class PairwiseModel:
    """Weights on standardised features; ``cut`` is the score at the chosen quantile."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    quantile: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Scores between 0 and 1; 0.5 and more is good."""
        strength = (np.clip((rows - self.mean) / self.scale, -8, 8)) @ self.weights - self.cut
        return 1 / (1 + np.exp(-np.clip(strength, -500, 500)))


def fit_pairs(rows: np.ndarray, labels: np.ndarray, seed: int = 7, steps: int = 400, decay: float = 1e-3) -> PairwiseModel:
    """Fit on feature rows with labels 0 and 1. With one label only, every text scores as that label."""
    mean = rows.mean(axis=0) if len(rows) else np.zeros(len(FEATURES))
    scale = rows.std(axis=0) + 1e-6 if len(rows) else np.ones(len(FEATURES))
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return PairwiseModel(mean, scale, np.zeros(rows.shape[1]), -1.0 if len(good) or not len(bad) else 1.0, 0.0)
    x = np.clip((rows - mean) / scale, -8, 8)
    draw = np.random.default_rng(seed)
    n = PAIRS_PER_ROW * min(len(good), len(bad))
    # The rarer label's rows appear equally often; the others are drawn.
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    first, second = np.tile(few, PAIRS_PER_ROW)[:n], draw.choice(many, n)
    difference = x[second] - x[first] if few is bad else x[first] - x[second]
    weights, velocity = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(steps):
        chance = 1 / (1 + np.exp(-np.clip(difference @ weights, -500, 500)))
        gradient = difference.T @ (chance - 1) / n + decay * weights
        velocity = 0.9 * velocity - 0.5 * gradient
        weights = weights + velocity
    strength = x @ weights
    cuts = np.quantile(strength, np.linspace(0, 1, 501))
    order = np.sort(strength[bad])
    kept = np.sort(strength[good])
    right = np.searchsorted(order, cuts, side="left") + len(kept) - np.searchsorted(kept, cuts, side="left")
    best = np.flatnonzero(right == right.max())
    at = best[len(best) // 2]
    return PairwiseModel(mean, scale, weights, float(cuts[at]), float(np.linspace(0, 1, 501)[at]))


def learn_quality(
    docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, doc_id: str = "doc_id", text: str = "text",
    label: str = "quality",
) -> PairwiseModel:
    """Learn from about ``rows`` labelled documents, picked by a hash of the id.

    Labels other than 0 and 1, null ids and null labels take no part. If an id is labelled
    twice, each labelled row counts.
    """
    chosen = sampled(
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(doc_id, F.col(label).alias("_label")),
        F.col(doc_id).cast("string"), rows,
    )
    # The ids are bounded by `rows`, so this side is small whatever the documents are.
    sample = docs.select(doc_id, text).join(F.broadcast(chosen), doc_id).select("_label", _features(F.col(text)).alias("_row"))
    found = sample.collect()
    x = np.array([r["_row"] for r in found], dtype=float).reshape(len(found), len(FEATURES))
    order = np.lexsort(x.T)
    return fit_pairs(x[order], np.array([r["_label"] for r in found], dtype=int)[order])


def quality_score(model: PairwiseModel):
    """A function on text columns giving scores; null and empty texts have a score too."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = np.array([features(t) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))
            yield pd.Series(model.scores(rows))

    return score


def score_documents(docs: DataFrame, model: PairwiseModel, text: str = "text", into: str = "score") -> DataFrame:
    """Every row with its score in column ``into``, which is replaced if there."""
    return docs.withColumn(into, quality_score(model)(F.col(text)))


def keep_good(docs: DataFrame, model: PairwiseModel, text: str = "text") -> DataFrame:
    """The rows whose text scores 0.5 or more, with the columns they had."""
    score = free_name(docs, "score")
    return score_documents(docs, model, text, score).where(F.col(score) >= 0.5).select(*(f"`{c}`" for c in docs.columns))


def training_part(doc_id: Column) -> Column:
    """Whether a document may be learnt from: two thirds, by CRC-32 of its id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1
