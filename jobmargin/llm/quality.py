"""Quality by a factorisation machine over hashed words and the structure of a text."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmargin.llm import labelled
from jobmargin.llm.common import query, table

MOST = (2000, 2000)      # labelled documents of label 0 and 1 to learn from, at most
WORD_BUCKETS = 1 << 16
RANK = 8
LEAST_DOCS = 3
STEP, DECAY, EPOCHS = 0.05, 1e-4, 8
BINS = 10                # of each statistic of a text
STATS = 11
FEATURES = WORD_BUCKETS + STATS * BINS
_REMEMBERED = 500_000

_bucket: dict[bytes, int] = {}


def _word(word: bytes) -> int:
    import xxhash

    bucket = xxhash.xxh32_intdigest(word) % WORD_BUCKETS
    if len(_bucket) < _REMEMBERED:
        _bucket[word] = bucket
    return bucket


def statistics(text: str, words: list[bytes], distinct: int) -> list[float]:
    """Structure of the text and what is known of it apart from its words, each as a number from 0 to 1."""
    data = text.encode("utf-8", "replace")
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=6) / max(1, len(data))
    lines = data.split(b"\n")
    n = max(1, len(words))
    return [
        *kinds[1:6],
        min(1.0, len(data) / n / 16),
        distinct / n,
        len(set(lines)) / len(lines),
        min(1.0, n / len(lines) / 64),
        min(1.0, math.log10(1 + len(data)) / 7),
        sum(a == b for a, b in zip(words, words[1:])) / n,
    ]


_KIND = np.zeros(256, np.int64)  # others, upper, lower, digit, mark, beyond ASCII
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 5
for _mark in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _KIND[_mark] = 4


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of the whole text: word counts by bucket, scaled to length one, and a bin of each statistic."""
    words = text.encode("utf-8", "replace").split()
    found = [_bucket.get(w) if w in _bucket else _word(w) for w in words]
    names, counts = np.unique(np.array(found, np.int64), return_counts=True)
    values = np.log1p(counts)
    values /= max(1e-9, np.sqrt(values @ values))
    stats = np.array(statistics(text, words, len(set(words))))
    bins = np.minimum((np.sqrt(stats) * BINS).astype(int), BINS - 1) + np.arange(STATS) * BINS
    return np.concatenate([names, WORD_BUCKETS + bins]), np.concatenate([values, np.ones(STATS) / np.sqrt(STATS)])


def packed(text: str) -> bytes:
    names, values = features(text)
    return names.astype("<i4").tobytes() + values.astype("<f4").tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(data) // 2
    return np.frombuffer(data, "<i4", half // 4), np.frombuffer(data, "<f4", half // 4, half)


class Model:
    """Intercept, weights and factors: log odds = w0 + w.x + sum over pairs i < j of (v_i . v_j) x_i x_j."""

    def __init__(self, intercept: float, weights: np.ndarray, factors: np.ndarray):
        self.intercept, self.weights, self.factors = intercept, weights, factors

    def log_odds(self, names: np.ndarray, values: np.ndarray) -> float:
        """Linear in the features: the pairs sum to half of (sum v x)^2 - sum (v x)^2."""
        vx = self.factors[names] * values[:, None]
        return self.intercept + self.weights[names] @ values + ((vx.sum(0) ** 2).sum() - (vx**2).sum()) / 2

    def __call__(self, texts: list[str]) -> np.ndarray:
        return labelled.logistic(np.array([self.log_odds(*features(t)) for t in texts], float))


def fit(rows: list[bytes], y: np.ndarray, share: float) -> Model:
    """Adaptive gradient steps over the sample; with one class or none to learn from, the share of label 1 for every text."""
    weights, factors = np.zeros(FEATURES), np.zeros((FEATURES, RANK))
    if len(y) == 0 or y.min() == y.max():
        return Model(float(np.log((share + 1e-3) / (1 - share + 1e-3))), weights, factors)
    docs = np.zeros(FEATURES)
    for row in rows:
        docs[unpacked(row)[0]] += 1
    known = docs >= LEAST_DOCS
    order = np.random.default_rng(23)
    factors[known] = order.normal(0, 0.05, (int(known.sum()), RANK))
    of_weights, of_factors, intercept, of_intercept = np.full(FEATURES, 1e-2), np.full((FEATURES, RANK), 1e-2), 0.0, 1e-2
    for _ in range(EPOCHS):
        for i in order.permutation(len(y)):
            names, values = unpacked(rows[i])
            use = known[names]
            names, values = names[use], values[use].astype(float)
            own = factors[names]
            vx = own * values[:, None]
            total = vx.sum(0)
            z = intercept + weights[names] @ values + ((total**2).sum() - (vx**2).sum()) / 2
            error = labelled.logistic(z) - y[i]
            slope = error * values + DECAY * weights[names]
            of_weights[names] += slope**2
            weights[names] -= STEP * slope / np.sqrt(of_weights[names])
            bend = error * values[:, None] * (total - vx) + DECAY * own
            of_factors[names] += bend**2
            factors[names] = own - STEP * bend / np.sqrt(of_factors[names])
            of_intercept += error**2
            intercept -= STEP * error / np.sqrt(of_intercept)
    return Model(intercept + labelled.prior_shift(share, y), weights, factors)


def score_quality(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = MOST) -> DataFrame:
    """The rows of `docs` with score, the probability of label 1 by the text alone (fits first: eager).

    Features are the words by hash and, as bins, statistics of the text's structure and its length.
    Learns from at most `most` labelled documents outside the held-out fold.  Null text counts as
    empty and an empty text is scored by its statistics; texts are read whole; repeated rows score alike.
    """
    rows, share = labelled.sample(docs, labels, "quality", most, packed)
    return labelled.scored(docs, fit(*labelled.collected(rows), share))


@query
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = score_quality(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    return found.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
