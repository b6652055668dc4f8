"""Bounded samples of labelled documents to fit classifiers on, and their scores as queries return them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmargin.llm.common import fold, settle, stored, whole_text

FOLDS, HELD = 3, 1


def held_out(key: str = "doc_id") -> Column:
    return fold(key, FOLDS) == HELD


def sample(docs: DataFrame, labels: DataFrame, target: str, most: tuple[int, int], features: Callable[[str], bytes]) -> tuple[DataFrame, float]:
    """doc_id, y and features x of labelled rows to learn from, stored, and the share of y = 1 among all of them (eager).

    At most most[y] labelled documents of each class, the first ones by a hash of their id, are
    sent to the tasks and matched with `docs`; of rows that repeat one id a single one is taken,
    so there are at most sum(most) rows.  Held-out ids and null or other labels are not used.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & ~held_out())
    known = known.select("doc_id", F.col(target).cast("int").alias("y")).distinct()
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[y])
        chosen = part if chosen is None else chosen.union(part)

    def describe(batches):
        for batch in batches:
            batch["x"] = [features(t) for t in batch.pop("text")]
            yield batch

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "y"])
    found = texts.select("doc_id", "y", "text").mapInPandas(describe, f"doc_id {kind}, y int, x binary")
    return stored(found, "labelled-sample"), counts.get(1, 0) / max(1, sum(counts.values()))


def scored(docs: DataFrame, score: Callable[[list[str]], np.ndarray], name: str = "score") -> DataFrame:
    """The rows of `docs` with a double column `name` in place of one of that name; other columns stay in the JVM."""
    @F.pandas_udf("double")
    def apply(texts: pd.Series) -> pd.Series:
        found = pd.Series(score(list(texts)))
        settle()
        return found

    return docs.withColumn(name, apply(whole_text()))


def collected(rows: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """Features and y of a sample at the driver, in the order of ids."""
    found = rows.toPandas().sort_values(["doc_id", "y"])
    return [bytes(x) for x in found["x"]], found["y"].to_numpy(int)


def prior_shift(share: float, y: np.ndarray) -> float:
    """What to add to log odds learnt from a sample whose classes are mixed otherwise than all labelled rows."""
    if not 0 < share < 1 or not 0 < y.mean() < 1:
        return 0.0
    return float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))


def logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
