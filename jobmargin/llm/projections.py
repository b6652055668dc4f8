"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmargin.llm.common import query, stored, table
from jobmargin.llm.components import components, spanning
from jobmargin.llm.pivots import usable

COSINE = 0.93
PASSES = 12              # orders of the vectors, each by hashes of its own; at least, see `passes_for`
MISSED = 0.001           # share of the pairs just at the threshold that may stay outside every window
HASHES = 48              # random hyperplanes of a pass; their signs, concatenated, are the sort key
WINDOW = 24              # neighbours that a vector is compared with in each order
BLOCK = 2048             # vectors of one order compared in one group, beside WINDOW more
CORE_MARGIN = 1e-6       # radians kept from the bound within which links need no product
TILE = 512               # vectors of a component compared with as many others at a time


def _planes(passes: int, hashes: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, passes * hashes))


def _unit(vectors: pd.Series) -> np.ndarray:
    points = np.array(vectors.tolist(), np.float64).reshape(len(vectors), -1)
    points = points / np.abs(points).max(1, keepdims=True)  # squares of very large or small components stay finite
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """grp, vector, rep (least id) and copies, for each distinct usable vector under a label."""
    zero_free = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # -0.0 and 0.0 are one
    valid = vectors.where(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    valid = valid.select("vec_id", F.struct("label", F.size("embedding").alias("dim")).alias("grp"), zero_free.alias("vector"))
    valid = valid.where(F.exists("vector", lambda x: x != 0))
    return valid.groupBy("grp", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))


def passes_for(n: Column, cosine: float, least: int, window: int) -> Column:
    """Orders that a group of n vectors needs for all but MISSED of its pairs at the threshold to come within the window in one of them.

    One hash separates such a pair with probability angle / pi.  Vectors that agree in the first
    log2(n / window) hashes of an order are about a window, so a pair stands in it if none of those separates it.
    """
    together = F.pow(F.lit(1 - np.arccos(cosine) / np.pi), F.log2(F.greatest(n / window, F.lit(1.0))))
    return F.greatest(F.lit(least), F.when(together < 1, F.ceil(np.log(MISSED) / F.log1p(-together))).otherwise(least)).cast("int")


def projection_links(points: DataFrame, cosine: float, passes: int, window: int, seed: int = 11) -> DataFrame:
    """Verified links (a, b), enough of each block to join what they join, between neighbours in orders of points (grp, rep, vector) (eager).

    A group has `passes` orders, or more by its measured size (`passes_for`), so that recall does not fall as it grows.

    Each pass hashes every vector by the signs of its own random projections and sorts by group and
    the concatenated hashes.  The sort is a range partition whose key ends in the unique id, so
    no hash value, however frequent, fills a task.  Its row numbers cut the order into blocks; each
    block takes the next `window` rows as guests, and every row is compared with the `window` after it.
    """
    def hashed(batches):
        weights = 1 << np.arange(HASHES - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            for (_, n), own in batch.groupby([batch["vector"].str.len(), batch["passes"]]):
                unit = _unit(own["vector"])
                planes = _planes(n, HASHES, unit.shape[1], seed)
                for p in range(n):
                    codes = (unit @ planes[:, p * HASHES:(p + 1) * HASHES] > 0) @ weights
                    yield own.assign(pass_no=p, code=codes)[["pass_no", "grp_key", "code", "rep", "vector"]]

    sizes = points.groupBy("grp").agg(passes_for(F.count("*"), cosine, passes, window).alias("passes"))
    keyed = points.join(sizes, "grp").select(F.to_json("grp").alias("grp_key"), "rep", "vector", "passes")
    codes = keyed.mapInPandas(hashed, "pass_no int, grp_key string, code long, rep long, vector array<double>")
    order = ["pass_no", "grp_key", "code", "rep"]
    ordered = codes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ordered = stored(ordered, "projection-order").withColumn("part", F.shiftright("at", 33))
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    begins = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    numbered = ordered.join(begins, "part").withColumn("nth", F.col("begin") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    own = F.floor(F.col("nth") / BLOCK)
    blocks = F.when((F.col("nth") % BLOCK < window) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = numbered.select(F.explode(blocks).alias("block"), "nth", "pass_no", "grp_key", "rep", "vector")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("nth", ignore_index=True)
        group = pd.factorize(rows["pass_no"].astype(str) + rows["grp_key"])[0]
        mine, reps = rows["nth"].to_numpy() // BLOCK == rows["block"].to_numpy(), rows["rep"].to_numpy()
        unit = np.zeros((len(rows), int(rows["vector"].str.len().max())))
        for _, part in rows.groupby(rows["vector"].str.len()):
            own = _unit(part["vector"])
            unit[part.index, :own.shape[1]] = own
        found = []
        for step in range(1, min(window, len(rows) - 1) + 1):
            near = (np.einsum("ij,ij->i", unit[:-step], unit[step:]) >= cosine) & (group[:-step] == group[step:]) & mine[:-step]
            at = np.flatnonzero(near)
            found.append((reps[at], reps[at + step]))
        a, b = (np.concatenate([np.zeros(0, np.int64), *ends]) for ends in (zip(*found) if found else ((), ())))
        return pd.DataFrame(dict(zip("ab", spanning(a, b))))  # links are counted later, over whole components

    return dealt.groupBy("block").applyInPandas(compare, "a long, b long")


def count_links(members: DataFrame, cosine: float) -> DataFrame:
    """(rep, linked): for each member (root, grp, rep, vector, copies), the rows of its component linked to its vector (eager).

    Two vectors within half the threshold angle of the component's first vector are linked for certain
    (angles on a sphere add up), so the core of a component of near copies, however large, is a sum of
    copies.  Only vectors outside the core are compared, tile by tile, with their component.
    """
    half = np.arccos(cosine) / 2 - CORE_MARGIN
    first = members.where("rep = root").select("root", F.col("vector").alias("center"))
    dealt = members.join(first, "root")

    def place(batches):
        for batch in batches:
            angle = np.empty(len(batch))
            for _, own in batch.groupby(batch["vector"].str.len()):
                cos = np.einsum("ij,ij->i", _unit(own["vector"]), _unit(own["center"]))
                angle[own.index] = np.arccos(np.clip(cos, -1, 1))
            batch["core"] = angle <= half
            yield batch.drop(columns="center")

    placed = stored(
        dealt.select("root", "rep", "vector", "copies", "center").mapInPandas(
            place, "root long, rep long, vector array<double>, copies long, core boolean"), "projection-members",
    )
    cores = placed.where("core").groupBy("root").agg(F.sum("copies").alias("linked"))
    sure = placed.where("core").join(cores, "root").select("rep", (F.col("linked") - F.col("copies")).alias("linked"))

    fringe = placed.groupBy("root").agg(F.count("*").alias("n"), F.count_if(~F.col("core")).alias("n_out")).where("n_out > 0")
    tiled = placed.join(fringe, "root").withColumn("tile", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / TILE)))
    packed = tiled.groupBy("root", "tile").agg(F.collect_list(F.struct("rep", "vector", "copies", "core")).alias("rows"))
    packed = stored(packed, "projection-tiles")
    out = packed.select("root", F.col("tile").alias("tile_a"), F.filter("rows", lambda r: ~r["core"]).alias("a")).where("size(a) > 0")
    pairs = out.join(packed.select("root", F.col("tile").alias("tile_b"), F.col("rows").alias("b")), "root")

    def tile(batches):
        for batch in batches:
            for left, right in zip(batch["a"], batch["b"]):
                left, right = pd.DataFrame(list(left)), pd.DataFrame(list(right))
                near = (_unit(left["vector"]) @ _unit(right["vector"]).T >= cosine) & (left["rep"].to_numpy()[:, None] != right["rep"].to_numpy())
                yield pd.DataFrame({"rep": left["rep"], "linked": near @ right["copies"].to_numpy(np.int64)})
                core = right["core"].to_numpy(bool)  # a core vector has its links to those outside from here
                yield pd.DataFrame({"rep": right["rep"][core], "linked": left["copies"].to_numpy(np.int64) @ near[:, core]})

    seen = pairs.select("a", "b").mapInPandas(tile, "rep long, linked long")
    return sure.union(seen).groupBy("rep").agg(F.sum("linked").alias("linked"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (vec_id, embedding, label) (eager).

    Only equal, non-null labels and equal lengths are compared.  Equal vectors are one point, so
    copies need no window and are always linked.  The passes, at least `passes` and more for large labels, find
    links between different vectors; pairs that stay more than `window` apart in every order, about
    MISSED of those just at the threshold, are missed as links that join components, but inside a
    component each row's links are counted over the whole component.  Rows whose vector is null, empty, zero or not finite or whose
    label is null link with nothing; a null vec_id too, as its own null component.
    """
    rows = vectors.select("vec_id", "label", "embedding")
    points = stored(distinct_vectors(rows), "distinct-vectors")
    links = projection_links(points.select("grp", "rep", "vector"), cosine, passes, window)
    roots = stored(components(links).withColumnRenamed("node", "rep"), "projection-roots")
    linked = count_links(points.join(roots, "rep").select("root", "rep", "vector", "copies"), cosine)
    known = points.join(roots, "rep", "left").join(linked, "rep", "left").select(
        "grp", "vector", F.coalesce("root", "rep").alias("root"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    zero_free = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    keyed = rows.select("vec_id", F.when(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(),
                        F.struct("label", F.size("embedding").alias("dim"))).alias("grp"), zero_free.alias("vector"))
    joined = keyed.join(known, ["grp", "vector"], "left")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


@query
def op8_projection_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings"))
