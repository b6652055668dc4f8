"""Toxicity by a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmargin.llm import labelled
from jobmargin.llm.common import query, table

THRESHOLD = 0.7
MOST = (3000, 1500)      # labelled documents of label 0 and 1 to learn from, at most
BITS = 18                # hash buckets: 2**BITS
SHORTEST, LONGEST = 3, 6  # bytes of an n-gram of the lower-cased text
FULL_RATE = 1 / 300      # occurrences a byte at which a feature counts fully
LEAST_DOCS = 3           # an n-gram in fewer sampled documents is no feature
LEAST_RATIO = 0.7        # nor is one nearly as common in either class, by its log-count ratio
SMOOTH, STEP, SPARSE, EPOCHS = 0.5, 1.0, 3.0, 6


def buckets(text: str) -> list[np.ndarray]:
    """Hash buckets of all n-grams of the whole text, a space on either side, by length."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint64)
    out, state = [], np.zeros(len(data), np.uint64)
    for n in range(1, min(LONGEST, len(data)) + 1):
        state = (state[:len(data) - n + 1] * np.uint64(0x100000001B3)) ^ (data[n - 1:] + np.uint64(1))
        if n >= SHORTEST:
            out.append(((state * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32))
    return out


def rates(found: np.ndarray, n_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and how fully each counts: its rate in the text, one at most."""
    names, counts = np.unique(found, return_counts=True)
    return names, np.minimum(1.0, counts / (n_bytes * FULL_RATE))


def _size(text: str) -> int:
    return len(text.lower().encode("utf-8", "replace")) + 2


def packed(text: str) -> bytes:
    grams = buckets(text)
    names, values = rates(np.concatenate(grams), _size(text)) if grams else (np.zeros(0, np.int32), np.zeros(0))
    return names.astype("<i4").tobytes() + values.astype("<f4").tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(data) // 2
    return np.frombuffer(data, "<i4", half // 4), np.frombuffer(data, "<f4", half // 4, half)


class Model:
    """Intercept and a weight for each bucket, most of them zero."""

    def __init__(self, intercept: float, weights: np.ndarray):
        self.intercept, self.weights, self.live = intercept, weights, weights != 0

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.intercept)
        for i, text in enumerate(texts):
            live = [own[self.live[own]] for own in buckets(text)]
            if live and sum(map(len, live)):
                names, values = rates(np.concatenate(live), _size(text))
                out[i] += self.weights[names] @ values
        return labelled.logistic(out)


def log_count_ratios(rows: DataFrame) -> np.ndarray:
    """Of each bucket, how much more it counts in documents of label 1 than of label 0; zero for those that are no features.

    Sums by bucket over all rows of the sample (y, x); the driver receives a row a bucket.
    """
    def count(batches):
        sums = np.zeros((1 << BITS, 3))
        labels = np.zeros(2)
        for batch in batches:
            for label, row in zip(batch["y"], batch["x"]):
                names, values = unpacked(row)
                sums[names, label] += values
                sums[names, 2] += 1
                labels[label] += 1
        seen = np.flatnonzero(sums[:, 2])
        yield pd.DataFrame({"bucket": np.r_[-1, seen], "zero": np.r_[labels[0], sums[seen, 0]], "one": np.r_[labels[1], sums[seen, 1]], "docs": np.r_[LEAST_DOCS, sums[seen, 2]]})

    counts = rows.select("y", "x").mapInPandas(count, "bucket long, zero double, one double, docs double")
    found = counts.groupBy("bucket").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"), F.sum("docs").alias("docs"))
    found = found.where(F.col("docs") >= LEAST_DOCS).toPandas()
    ratio = np.zeros(1 << BITS)
    of_class = found[found["bucket"] < 0]
    zeros, ones = of_class["zero"].sum(), of_class["one"].sum()
    found = found[found["bucket"] >= 0]
    value = np.log((found["one"] + SMOOTH) / (ones + 2 * SMOOTH)) - np.log((found["zero"] + SMOOTH) / (zeros + 2 * SMOOTH))
    ratio[found["bucket"]] = np.where(np.abs(value) < LEAST_RATIO, 0, value)
    return ratio


def scaled(rows: DataFrame, ratio: np.ndarray) -> DataFrame:
    """The sample with its features times their ratios, those without one left out."""
    sent = rows.sparkSession.sparkContext.broadcast(ratio)

    def scale(batches):
        for batch in batches:
            batch["x"] = [_scaled(row, sent.value) for row in batch["x"]]
            yield batch

    return rows.mapInPandas(scale, rows.schema)


def _scaled(row: bytes, ratio: np.ndarray) -> bytes:
    names, values = unpacked(row)
    use = ratio[names] != 0
    return names[use].tobytes() + (ratio[names[use]] * values[use]).astype("<f4").tobytes()


def fit(rows: list[bytes], y: np.ndarray, share: float, ratio: np.ndarray) -> Model:
    """Logistic regression on scaled features.

    Regularised-leader steps with an L1 term leave weights only where many documents agree.  With one class or
    none to learn from the score is the share of label 1 for every text.
    """
    if len(y) == 0 or y.min() == y.max():
        return Model(float(np.log((share + 1e-3) / (1 - share + 1e-3))), np.zeros(1 << BITS))
    lead, squares, intercept, of_intercept = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 1.0

    def weights(z, n):
        return np.where(np.abs(z) <= SPARSE, 0.0, (np.sign(z) * SPARSE - z) * STEP / (1 + np.sqrt(n)))

    kept = [unpacked(row) for row in rows]
    order = np.random.default_rng(17)
    for _ in range(EPOCHS):
        for i in order.permutation(len(y)):
            names, values = kept[i]
            z, n = lead[names], squares[names]
            w = weights(z, n)
            error = labelled.logistic(intercept + w @ values) - y[i]
            slope = error * values
            lead[names] = z + slope - (np.sqrt(n + slope**2) - np.sqrt(n)) / STEP * w
            squares[names] = n + slope**2
            of_intercept += error**2
            intercept -= 0.2 * error / np.sqrt(of_intercept)
    return Model(intercept + labelled.prior_shift(share, y), weights(lead, squares) * ratio)


def score_toxicity(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = MOST, name: str = "score") -> DataFrame:
    """The rows of `docs` with column `name`, the probability of label 1 by the text alone (fits first: eager).

    Learns from at most `most` labelled documents outside the held-out fold.  Null text counts as
    empty; an empty text has the intercept's score; texts are read whole; repeated rows score alike.
    """
    rows, share = labelled.sample(docs, labels, "toxic", most, packed)
    ratio = log_count_ratios(rows)
    return labelled.scored(docs, fit(*labelled.collected(scaled(rows, ratio)), share, ratio), name)


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    found = score_toxicity(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    return found.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
