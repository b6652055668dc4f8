"""SimHash near-duplicates through a Gray-order hierarchical index."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmargin.llm.common import query, settle, stored, table, whole_text
from jobmargin.llm.components import components, spanning

SHINGLE, BITS, SEED = 4, 4, 42
LEAF, FAN = 1024, 8      # fingerprints of a stored group; members of each node inside it
SMALL = 16               # sorted runs up to this length are compared directly
FOUND = "a long, b long, part int, key long, block long, mask long, pattern long, members array<long>"

_ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the hashes of the text's word shingles; zero without words."""
    import xxhash

    words = text.encode().translate(_ASCII_LOWER).split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + shingle]), SEED) for i in range(max(1, len(words) - shingle + 1))]
    total = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        own = np.array(hashes[start:start + (1 << 14)], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(own, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, key (hash of the text) and fp, the fingerprint as a signed long; null text counts as empty."""
    @F.pandas_udf("long")
    def mark(texts: pd.Series) -> pd.Series:
        prints = pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))
        settle()
        return prints

    return docs.select("doc_id", F.xxhash64(whole_text()).alias("key"), mark(whole_text()).alias("fp"))


def gray_rank(column: Column) -> Column:
    """Place of a bit pattern in reflected Gray order, as a long that sorts like it."""
    for shift in (1, 2, 4, 8, 16, 32):
        column = column.bitwiseXOR(F.shiftrightunsigned(column, shift))
    return column.bitwiseXOR(F.lit(-(1 << 63)))


def top_masks(max_bits: int, extra: int = 2) -> list[int]:
    """Bit masks of the index's upper nodes: fingerprints within max_bits agree under at least one.

    The 64 bits fall into max_bits + extra runs; max_bits differences leave `extra` of them whole.
    """
    edges = np.linspace(0, 64, max_bits + extra + 1).round().astype(int)
    runs = [sum(1 << bit for bit in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(runs, extra)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _levels(members: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """From the members up: (mask, pattern) of the bits that each node's members share."""
    levels = [(np.full(len(members), np.uint64(2**64 - 1)), members)]
    while len(levels[-1][0]) > FAN:
        mask, pattern = levels[-1]
        at = np.arange(0, len(mask), FAN)
        ones, zeros = np.bitwise_and.reduceat(pattern & mask, at), np.bitwise_and.reduceat(~pattern & mask, at)
        levels.append((ones | zeros, ones))
    return levels


def search(left: np.ndarray, right: np.ndarray, max_bits: int, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of members within max_bits, both arrays in Gray order; `same`: one array, pairs i < j.

    From the top down, pairs of nodes whose shared patterns already differ in more bits are
    dropped with all that lies below them.
    """
    low, high = _levels(left), _levels(right)
    while len(low) < len(high):
        low.append(low[-1])
    while len(high) < len(low):
        high.append(high[-1])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(low[-1][0])), np.arange(len(high[-1][0])), indexing="ij"))
    for depth in range(len(low) - 1, -1, -1):
        (mask_a, pattern_a), (mask_b, pattern_b) = low[depth], high[depth]
        near = np.bitwise_count((pattern_a[a] ^ pattern_b[b]) & mask_a[a] & mask_b[b]) <= max_bits
        if same:
            near &= (a < b) if depth == 0 else (a <= b)
        a, b = a[near], b[near]
        if depth:
            steps_a, steps_b = _children(low, depth), _children(high, depth)
            a = (a[:, None, None] * steps_a + np.arange(steps_a)[:, None] + np.zeros(steps_b, int)).ravel()
            b = (b[:, None, None] * steps_b + np.zeros(steps_a, int)[:, None] + np.arange(steps_b)).ravel()
            inside = (a < len(low[depth - 1][0])) & (b < len(high[depth - 1][0]))
            a, b = a[inside], b[inside]
    return a, b


def _children(levels: list, depth: int) -> int:
    return 1 if levels[depth] is levels[depth - 1] else FAN


def _cut(max_bits: int):
    """Over rows (part, key, fp) in Gray order: links inside each stored group, and the groups whose key may go on elsewhere."""
    def cut(batches):
        held, opened = None, True
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            # all but the last key's rows are complete; of a long last key, full groups can go
            parts, keys = rows["part"].to_numpy(), rows["key"].to_numpy()
            turns = np.flatnonzero((parts[1:] != parts[:-1]) | (keys[1:] != keys[:-1])) + 1
            done = turns[-1] if len(turns) else 0
            if done:
                yield from groups(parts[:done], keys[:done], rows["fp"].to_numpy()[:done], opened, False)
                opened = False
            tail = len(rows) - done
            full = tail // LEAF * LEAF
            if full and tail > LEAF:
                yield from groups(parts[done:done + full], keys[done:done + full], rows["fp"].to_numpy()[done:done + full], True, True)
                opened = True
                done += full
            held = rows.iloc[done:]
        if held is not None and len(held):
            yield from groups(held["part"].to_numpy(), held["key"].to_numpy(), held["fp"].to_numpy(), True, True)

    def groups(parts, keys, fps, first_open, last_open):
        from pyspark import TaskContext

        marks = fps.view(np.uint64)
        turns = np.flatnonzero((parts[1:] != parts[:-1]) | (keys[1:] != keys[:-1])) + 1
        begins, ends = np.r_[0, turns], np.r_[turns, len(fps)]
        sizes = ends - begins
        run, from_a, from_b = np.repeat(np.arange(len(begins)), sizes), [], []
        little = sizes[run] <= SMALL
        for step in range(1, SMALL):
            near = np.flatnonzero((run[step:] == run[:-step]) & little[step:] & (np.bitwise_count(marks[step:] ^ marks[:-step]) <= max_bits))
            from_a.append(fps[near])
            from_b.append(fps[near + step])
        kept = []
        task = TaskContext.get().partitionId()
        for k in np.flatnonzero((sizes > SMALL) | np.isin(np.arange(len(begins)), [0] * first_open + [len(begins) - 1] * last_open)):
            several = sizes[k] > LEAF
            for begin in range(begins[k], ends[k], LEAF):
                own = fps[begin:min(begin + LEAF, ends[k])]
                if sizes[k] > SMALL:
                    a, b = search(own.view(np.uint64), own.view(np.uint64), max_bits, same=True)
                    a, b = spanning(own[a], own[b])
                    from_a.append(a)
                    from_b.append(b)
                if several or (k == 0 and first_open) or (k == len(begins) - 1 and last_open):
                    count[0] += 1
                    mask, pattern = _shared(own.view(np.uint64))
                    kept.append((parts[k], keys[k], (task << 32) + count[0], mask, pattern, own))
        out = pd.DataFrame({"a": np.concatenate(from_a), "b": np.concatenate(from_b)}, dtype="Int64")
        for name in ("part", "key", "block", "mask", "pattern"):
            out[name] = pd.array([None] * len(out), "Int64")
        out["members"] = None
        nodes = pd.DataFrame(kept, columns=["part", "key", "block", "mask", "pattern", "members"])
        nodes.insert(0, "a", pd.array([None] * len(nodes), "Int64"))
        nodes.insert(1, "b", pd.array([None] * len(nodes), "Int64"))
        yield out
        yield nodes

    count = [0]
    return cut


def _shared(marks: np.ndarray) -> tuple[int, int]:
    ones, zeros = np.bitwise_and.reduce(marks), np.bitwise_and.reduce(~marks)
    return _signed(int(ones | zeros)), _signed(int(ones))


def links(fingerprints: DataFrame, max_bits: int = BITS) -> DataFrame:
    """(a, b): enough links to join all distinct fingerprints `fp` that lie within max_bits, chain by chain (eager).

    Upper nodes of the index are the fingerprints' bits under one of top_masks: by the pigeonhole
    principle every pair within max_bits meets below one of them.  Below, fingerprints lie in
    Gray order, range-partitioned with the rank itself as part of the key, so that a node with
    many members spreads over tasks.  They are cut into groups of LEAF with the mask and
    pattern of their shared bits; a node's groups are searched in themselves and, where their
    patterns differ in at most max_bits, with each other.  No pair is lost at any size.
    """
    tables = F.array(*(F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key")) for i, mask in enumerate(top_masks(max_bits))))
    entries = fingerprints.select("fp", F.explode(tables).alias("t")).select("t.part", "t.key", "fp")
    ordered = (
        entries.withColumn("rank", gray_rank(F.col("fp")))
        .repartitionByRange("part", "key", "rank").sortWithinPartitions("part", "key", "rank")
    )
    found = stored(ordered.select("part", "key", "fp").mapInPandas(_cut(max_bits), FOUND), "gray-index")
    inner = found.where("a is not null").select("a", "b")
    nodes = found.where("members is not null").select("part", "key", "block", "mask", "pattern", "members")
    other = nodes.select("part", "key", *(F.col(c).alias(f"{c}2") for c in ("block", "mask", "pattern", "members")))
    differ = F.col("pattern").bitwiseXOR(F.col("pattern2")).bitwiseAND(F.col("mask")).bitwiseAND(F.col("mask2"))
    pairs = nodes.join(other, ["part", "key"]).where((F.col("block") < F.col("block2")) & (F.bit_count(differ) <= max_bits))

    def across(batches):
        for batch in batches:
            for left, right in zip(batch["members"], batch["members2"]):
                a, b = search(left.view(np.uint64), right.view(np.uint64), max_bits)
                a, b = spanning(left[a], right[b])
                yield pd.DataFrame({"a": a, "b": b})

    return inner.union(pairs.select("members", "members2").mapInPandas(across, "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = BITS) -> DataFrame:
    """doc_id, key, fp, root, component_id for each row: its group, and the least doc_id that its fingerprint reaches by links (eager).

    Rows with equal fingerprints are one node, so copies cost nothing beyond their row.  A row
    whose doc_id is null is linked like others but names no component; a component of such
    rows only has a null id.  Texts without words share the fingerprint zero.
    """
    marked = stored(with_fingerprint(docs, shingle), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), max_bits))
    nodes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    nodes = stored(nodes, "simhash-nodes")
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.select("fp", "root").join(least, "root")
    return marked.join(named, "fp").select("doc_id", "key", "fp", "root", "component_id")


@query
def op5_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
