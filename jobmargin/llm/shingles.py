"""Near copies of texts by SimHash fingerprints and by the similarity of their word shingles, for the stage of the pipeline."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmargin.llm.common import settle, stored, whole_text
from jobmargin.llm.components import components
from jobmargin.llm.simhash import near_duplicates

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 24, 4      # fingerprints of a text, and the minima each is made of: at 0.8 a pair shares none in 3 of a million cases
CHUNK = 256              # shingles permuted at a time

_ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD = np.random.default_rng(29).integers(0, 2**63, (BANDS * ROWS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(31).integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(values: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        values = (values ^ (values >> np.uint64(33))) * np.uint64(factor)
    return values ^ (values >> np.uint64(33))


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of all runs of SHINGLE words, of the whole text if it has fewer; none without words."""
    import xxhash

    words = [xxhash.xxh64_intdigest(w) for w in text.encode("utf-8", "replace").translate(_ASCII_LOWER).split()]
    if not words:
        return np.zeros(0, np.uint64)
    own = np.array(words, np.uint64)
    size = min(SHINGLE, len(own))
    runs = sum(_mixed(own[i:len(own) - size + 1 + i]) * _PLACES[i] for i in range(size))
    return np.unique(_mixed(runs))


def bands(shingles: np.ndarray) -> list[int]:
    """Fingerprints of a set: each from ROWS minima under orders of its own, so that two sets share one with probability similarity ** ROWS."""
    least = np.full(len(_ODD), np.uint64(2**64 - 1))
    for start in range(0, len(shingles), CHUNK):
        own = shingles[start:start + CHUNK]
        orders = (own ^ (own >> np.uint64(29))) * _ODD[:, :1]
        least = np.minimum(least, ((orders ^ (orders >> np.uint64(31))) * _ODD[:, 1:]).min(1))
    out = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + row)
    return out.view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def marked_texts(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), node (hash of its shingle set, zero without words) and its bands."""
    @F.pandas_udf("node long, bands array<long>")
    def mark(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        rows = []
        for text in texts:
            own = shingle_set(text)
            node = int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64)) if len(own) else 0
            rows.append((node, bands(own) if len(own) else []))
        settle()
        return pd.DataFrame(rows, columns=["node", "bands"])

    return docs.select("doc_id", F.xxhash64(whole_text()).alias("key"), mark(whole_text()).alias("m")).select("doc_id", "key", "m.*")


def _verified(pairs: DataFrame, docs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Of the pairs (a, b) of nodes, those whose shingle sets are `similar`; texts: a text's key for each node (eager)."""
    @F.pandas_udf("binary")
    def packed(column: pd.Series) -> pd.Series:
        out = pd.Series([shingle_set(t).tobytes() for t in column])
        settle()
        return out

    @F.pandas_udf("double")
    def compared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)], dtype=float)

    pairs = stored(pairs, "shingle-pairs")
    # Written, so that Spark knows their size: few of them go to the texts, and not all texts through a shuffle to them.
    used = stored(texts.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"), "shingle-texts")
    # A node has one key here, so copies of a text are the only repeats, and meet where the join by key has brought them.
    whole = docs.select(F.xxhash64(whole_text()).alias("key"), whole_text().alias("text")).join(used, "key").dropDuplicates(["key", "node"])
    sets = stored(whole.select("node", packed("text").alias("own")), "shingle-sets")
    both = pairs.join(sets.toDF("a", "own_a"), "a").join(sets.toDF("b", "own_b"), "b")
    return stored(both.where(compared("own_a", "own_b") >= similar).select("a", "b"), "shingle-links")


def _fingerprint_links(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(a, b): each node of a group that op5's operator finds, with the least node of it (eager)."""
    found = near_duplicates(docs).select("key", F.col("root").alias("print")).distinct()
    placed = stored(marked.select("key", "node").distinct().join(found, "key").select("node", "print").distinct(), "simhash-groups")
    least = placed.groupBy("print").agg(F.min("node").alias("a"))
    return placed.join(least, "print").where("node <> a").select("a", F.col("node").alias("b"))


def groups(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, key, root for each row: the group that it reaches by texts whose shingle sets have that Jaccard similarity (eager).

    Equal sets are one node.  op5's SimHash operator proposes first: each node of one of its groups is compared
    with the least of it.  Such texts can still differ in more bits than op5 allows, so nodes that share a
    band and are not joined yet are candidates too.  Each link is verified on the whole sets.  First the
    nodes of a band are compared with the least of them, so a set of near copies, however many, costs a
    comparison a row; what a band then still holds in several groups is compared pair by pair.
    Texts without words are one group.
    """
    marked = stored(marked_texts(docs), "shingle-marks")
    texts = marked.groupBy("node").agg(F.min("key").alias("key"))
    near = _verified(_fingerprint_links(docs, marked), docs, texts, similar)
    prints = components(near)
    nodes = marked.groupBy("node").agg(F.first("bands").alias("bands"))
    entries = nodes.select("node", F.posexplode("bands").alias("band", "mark"))
    least = entries.groupBy("band", "mark").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = stored(entries.join(least, ["band", "mark"]), "shingle-bands")
    stars = shared.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    for end in ("a", "b"):
        stars = stars.join(prints.toDF(end, f"root_{end}"), end, "left")
    apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    links = near.union(_verified(stars.where(apart).select("a", "b"), docs, texts, similar))

    roots = components(links)
    placed = shared.select("band", "mark", "node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("band", "mark").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band", "mark")
    left = stored(placed.join(several, ["band", "mark"]), "shingle-rest")
    right = left.select("band", "mark", *(F.col(c).alias(f"{c}2") for c in ("node", "root")))
    rest = left.join(right, ["band", "mark"]).where("node < node2 and root <> root2 and node <> least").select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()
    links = links.union(_verified(rest, docs, texts, similar))
    return marked.join(components(links), "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row of `docs` for each group of near copies, with its columns: the one with the least doc_id (nulls last; ties by text hash)."""
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("doc"), F.col("key").alias("key"))
    chosen = groups(docs, similar).groupBy("root").agg(F.min(place).alias("row")).select("row.*")
    # Ids without nulls, so that texts are shuffled once, for the join and for repeated rows.
    own, zero = ["_null", "_doc", "_key"], F.lit(0).cast(docs.schema["doc_id"].dataType)
    numbered = lambda df, doc, key: df.withColumns({"_null": F.col(doc).isNull(), "_doc": F.coalesce(F.col(doc), zero), "_key": key})
    chosen = numbered(chosen, "doc", F.col("key")).select(*own)
    return numbered(docs, "doc_id", F.xxhash64(whole_text())).join(chosen, own, "left_semi").dropDuplicates(own).select(*docs.columns)
