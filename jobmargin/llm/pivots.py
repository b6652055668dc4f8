"""Exact top-k inner products by elimination with a pivot table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmargin.llm.common import query, stored, table

K, SCALE, EVERY = 20, 64, 20
PIVOTS = 32              # vectors whose distances to all others are computed beforehand
PIVOT_SAMPLE = 4096      # rows, in key order of a hash, from which pivots are chosen
QUERY_BLOCK = 4096       # queries sent to the tasks at a time: the bound of what is broadcast
STRIPE = 2048            # candidates bounded at a time in a task
STEP = 64                # candidates of a query evaluated before the first look at the stopping rule; then twice as many
WIDEST = 1 << 24         # a larger component could leave the range of exact double sums


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64).reshape(len(vectors), -1)


def _exact(points: np.ndarray, greatest: float) -> np.ndarray:
    """The points as single-precision numbers where these add up whole numbers exactly."""
    return points.astype(np.float32) if points.shape[1] * greatest**2 < 1 << 24 else points


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (rows**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: each next pivot is the farthest from those chosen."""
    chosen, nearest = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        nearest = np.minimum(nearest, _distances(sample, sample[chosen[-1:]])[:, 0])
        chosen.append(int(nearest.argmax()))
    return sample[chosen]


class Best:
    """The k best (score, id) found so far for each query of a block; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.scores, self.ids = k, [np.empty(0)] * queries, [np.empty(0, np.int64)] * queries

    def floor(self, q: int) -> float:
        return self.scores[q][-1] if len(self.scores[q]) == self.k else -np.inf

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray, own_id: int) -> None:
        use = (scores >= self.floor(q)) & (ids != own_id)
        if not use.any():
            return
        scores, ids = scores[use], ids[use]
        scores, ids = np.r_[self.scores[q], scores], np.r_[self.ids[q], ids]
        keep = np.lexsort((ids, -scores))[:self.k]
        self.scores[q], self.ids[q] = scores[keep], ids[keep]


def eliminate(best: Best, ids, queries, to_query, own, rows, to_row) -> int:
    """Offer every row that can be among a query's best; returns how many products were computed.

    |d(q, p) - d(x, p)| never exceeds d(q, x) for any pivot p, so the greatest of these bounds q.x =
    (|q|^2 + |x|^2 - d(q, x)^2) / 2 from above.  Rows come in the order of that bound, and the first one
    strictly below the k-th best ends the search: later ones cannot enter, not even by a tie.
    """
    if not len(rows):
        return 0
    q2, x2 = (queries.astype(np.float64)**2).sum(1), (rows.astype(np.float64)**2).sum(1)
    slack = np.float32(1e-5 * (np.sqrt(q2.max()) + np.sqrt(x2.max())))  # above the rounding of single precision
    by_pivot, to_query = np.ascontiguousarray(to_row.T.astype(np.float32)), to_query.astype(np.float32)
    computed = 0
    for q in range(len(queries)):
        lower = np.abs(by_pivot - to_query[q, :, None]).max(0, initial=0) - slack
        upper = (q2[q] + x2 - np.maximum(lower, 0).astype(np.float64)**2) / 2 + 1e-3
        alive = np.flatnonzero(upper >= best.floor(q))
        order = alive[np.argsort(-upper[alive])]
        at, step = 0, STEP
        while at < len(order) and upper[order[at]] >= best.floor(q):
            now = order[at:at + step]
            best.offer(q, rows[now] @ queries[q], own[now], ids[q])
            computed += len(now)
            at, step = at + step, 2 * step
    return computed


def top_k(vectors: DataFrame, k: int = K, is_query: Column | None = None) -> DataFrame:
    """The k highest inner products of each query with all other rows: query_id, rank, vec_id, score (eager).

    `vectors` has vec_id and `vector`, an array of whole numbers; is_query marks queries (all
    rows if None).  Distances of every row to the pivots are computed once and stored beside
    it.  Queries go out in blocks of QUERY_BLOCK, a bound on what is broadcast; for each block the
    tasks bound, order and evaluate their own rows, and send k rows a query.  Blocks of queries
    against all rows is what the search asks for; no pair is formed outside a task.

    Rows with a null id or vector take no part.  Only vectors of equal length are compared.  A
    query never finds rows of its own id; a row that comes several times under one id with the same
    vector counts once.  Ties go to the smaller id.  No rows give no rows.  Components beyond
    2**24 are refused, as double sums would not be exact.
    """
    spark = vectors.sparkSession
    mark = F.lit(True) if is_query is None else F.coalesce(is_query, F.lit(False))
    rows = vectors.select("vec_id", "vector", mark.alias("is_query")).where("vec_id is not null and vector is not null").distinct()
    rows = rows.withColumn("dim", F.size("vector"))
    sample = rows.select("dim", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).collect()
    pivots = {dim: choose_pivots(np.array([r.vector for r in sample if r.dim == dim], np.float64).reshape(-1, dim), PIVOTS) for dim in {r.dim for r in sample}}

    def measure(batches):
        for batch in batches:
            batch["to_pivots"] = None
            for dim, own in batch.groupby("dim"):
                points = _matrix(own["vector"])
                if len(points) and dim and np.abs(points).max() > WIDEST:
                    raise ValueError("components beyond 2**24")
                known = pivots.get(dim, np.zeros((0, dim)))
                batch.loc[own.index, "to_pivots"] = pd.Series(list(_distances(points, known)), own.index, dtype=object)
            yield batch

    measured = stored(rows.mapInPandas(measure, "vec_id long, vector array<long>, is_query boolean, dim int, to_pivots array<double>"), "pivot-table")
    blocks = measured.where("is_query").groupBy("dim", F.lit(0).alias("_")).agg(F.count("*").alias("n")).collect()
    parts = []
    for dim, _, n in blocks:
        count = -(-n // QUERY_BLOCK)
        for block in range(count):
            own = F.pmod(F.xxhash64("vec_id"), F.lit(count)) == block
            asked = measured.where((F.col("dim") == dim) & F.col("is_query") & own).select("vec_id", "vector", "to_pivots").toPandas()
            if len(asked):
                parts.append(_one_block(measured.where(F.col("dim") == dim), asked, k))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_block(rows: DataFrame, asked: pd.DataFrame, k: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast((asked["vec_id"].to_numpy(), _matrix(asked["vector"]), _matrix(asked["to_pivots"])))

    def scan(batches):
        ids, queries, to_query = sent.value
        best = Best(len(ids), k)
        for batch in batches:
            for at in range(0, len(batch), STRIPE):
                part = batch.iloc[at:at + STRIPE]
                rows = _matrix(part["vector"])
                greatest = max(np.abs(rows).max(initial=0), np.abs(queries).max(initial=0))
                eliminate(best, ids, _exact(queries, greatest), to_query, part["vec_id"].to_numpy(), _exact(rows, greatest), _matrix(part["to_pivots"]))
        for q, own in enumerate(ids):
            if len(best.ids[q]):
                yield pd.DataFrame({"query_id": own, "vec_id": best.ids[q], "score": best.scores[q].astype(np.int64)})

    return rows.select("vec_id", "vector", "to_pivots").mapInPandas(scan, "query_id long, vec_id long, score long")


@query
def op6_pivot_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding").where(usable(F.col("embedding")))
    return top_k(rows.select("vec_id", whole_numbers(F.col("embedding")).alias("vector")), K, F.col("vec_id") % EVERY == 0)
