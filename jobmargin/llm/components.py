"""Connected components of link tables, with bounded rows a key per task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmargin.llm.common import stored


def _least(edges: DataFrame) -> DataFrame:
    """For each a, its least b; copies of a key meet before the exchange."""
    return edges.groupBy("a").agg(F.min("b").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node with the least node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = both.join(_least(both), "a").where(F.col("b") > F.col("a"))
    return joined.select(F.col("b").alias("a"), F.least("least", "a").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours with the least of them."""
    joined = edges.join(_least(edges), "a")
    moved = joined.where(F.col("b") > F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return joined.select("a", F.col("least").alias("b")).union(moved).distinct()


def _mark(edges: DataFrame) -> tuple:
    both = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(both)).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b: long): root is the least node it reaches (eager).

    Alternating large and small stars: the links of each component shrink to a star around
    its least node in a number of rounds that grows with the logarithm of its size.  Each
    round is written to the shared folder; the driver sees a count and a checksum only.
    Links to self, null ends and repeated links are left out.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a > b").distinct(), "links",
    )
    mark, before = _mark(edges), None
    while mark[0] and mark != before:
        edges = stored(_small_star(_large_star(edges)), "stars")
        mark, before = _mark(edges), mark
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many links as join what the links a-b join: from each value to the least it reaches."""
    values, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = ends[:len(a)], ends[len(a):], np.arange(len(values))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            moved = root != np.arange(len(values))
            return values[moved], values[root[moved]]
        root = new
