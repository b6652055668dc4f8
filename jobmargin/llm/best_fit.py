"""Best-fit packing of token sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobmargin.llm import words
from jobmargin.llm.common import query, settle, stored, table, whole_text

CAPACITY = 1024
END = 2  # id after each document
PIECE = "piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """Open bins by remaining capacity, under a segment tree that finds the tightest one that still fits.

    Bins of equal remaining capacity are interchangeable and kept as ranges of bin numbers, so the
    tree has a leaf for each capacity, not for each bin.
    """

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.filled = [False] * (2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int, filled: bool) -> None:
        node = self.leaves + room
        self.filled[node] = filled
        while node > 1:
            node //= 2
            self.filled[node] = self.filled[2 * node] or self.filled[2 * node + 1]

    def add(self, room: int, first: int, bins: int) -> None:
        if room:
            self.ranges[room].append((first, bins))
            self._mark(room, True)

    def take(self, room: int) -> tuple[int, int]:
        taken = self.ranges[room].pop()
        self._mark(room, bool(self.ranges[room]))
        return taken

    def tightest(self, size: int) -> int | None:
        """Smallest remaining capacity of an open bin that is at least `size`."""
        node = self.leaves + size
        if self.filled[node]:
            return size
        while node > 1:
            if node % 2 == 0 and self.filled[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.filled[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def plan_bins(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over a histogram of sizes: steps (size, rank, bins, per_bin, first_bin, offset).

    Items of one size go one after another into the tightest open bin, exactly as if placed
    singly; a bin that takes one takes as many as fit, for it is then the tightest.  A step puts
    the items ranked rank.. of a size into bins first_bin.., per_bin to each, from `offset` on.
    The work depends on the capacity, not on the number of items.
    """
    open_bins, steps, opened = OpenBins(capacity), [], 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            room = open_bins.tightest(size)
            if room is None:
                room = capacity
                first, bins = opened, max(1, left // (capacity // size))
                opened += bins
            else:
                first, bins = open_bins.take(room)
            per_bin = min(room // size, left)
            used = min(bins, left // per_bin)
            if used < bins:
                open_bins.add(room, first + used, bins - used)
            open_bins.add(room - per_bin * size, first, used)
            steps.append((size, rank, used, per_bin, first, capacity - room))
            rank, left = rank + used * per_bin, left - used * per_bin
    return np.array(steps, np.int64).reshape(-1, 6)


def pack(items: DataFrame, capacity: int = CAPACITY, size: str = "length") -> DataFrame:
    """The rows of `items` with sequence_id and offset: bins of `capacity`, by global best-fit decreasing (eager).

    Sizes must lie in 1..capacity (an error otherwise, null included).  Items of equal size are
    interchangeable, so only their ranks matter: each task numbers its own items of a size,
    and the counts by (size, task) give where its numbers begin.  The driver sees the
    histogram of sizes, at most `capacity` rows, and every item takes part.
    Ties and repeated rows are items like any other; no items give no rows.
    """
    schema = T.StructType([*items.schema.fields, T.StructField("_task", T.LongType()), T.StructField("_nth", T.LongType())])

    def number(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            column = batch.column(size)
            sizes = column.to_numpy(zero_copy_only=False)
            if column.null_count or not ((sizes >= 1) & (sizes <= capacity)).all():
                raise ValueError(f"sizes must be from 1 to {capacity}")
            order = np.argsort(sizes, kind="stable")
            counts = np.bincount(sizes.astype(np.int64), minlength=capacity + 1)
            nth = np.empty(len(sizes), np.int64)
            nth[order] = np.arange(len(sizes)) - np.repeat(np.cumsum(counts) - counts, counts)
            nth += seen[sizes.astype(np.int64)]
            seen += counts
            yield with_columns(batch, {"_task": np.full(len(nth), task), "_nth": nth})

    numbered = stored(items.mapInArrow(number, schema), "packing-items")
    by_task = numbered.groupBy(size, "_task").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(size).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    begins = by_task.select(size, "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    counts = {row[0]: row[1] for row in numbered.groupBy(size).count().collect()}
    steps = plan_bins(counts, capacity)
    starts = steps[:, 0] * -(1 << 48) + steps[:, 1]  # ascending: sizes fall, ranks rise

    def place(batches):
        for batch in batches:
            rank, sizes = batch.column("_rank").to_numpy(), batch.column(size).to_numpy().astype(np.int64)
            at = np.searchsorted(starts, sizes * -(1 << 48) + rank, side="right") - 1
            _, first_rank, _, per_bin, first_bin, offset = steps[at].T if len(at) else np.zeros((6, 0), np.int64)
            nth = rank - first_rank
            yield with_columns(batch.drop_columns(["_rank"]), {"sequence_id": first_bin + nth // per_bin, "offset": offset + nth % per_bin * sizes})

    out = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    ranked = numbered.join(begins, [size, "_task"]).select(*items.columns, (F.col("_nth") + F.col("_begin")).alias("_rank"))
    return ranked.mapInArrow(place, out)


def with_columns(batch: pa.RecordBatch, added: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The batch with long columns added; its own stay as they are."""
    return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, pa.int64()) for v in added.values())], [*batch.schema.names, *added])


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first of several may be shorter than `capacity`."""
    first = n_tokens % capacity or capacity
    return [(0, first), *((start, capacity) for start in range(first, n_tokens, capacity))]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A null text counts as empty and is one piece with the end id only; repeated rows stay.  doc_id passes through as it is, whatever its type.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        encoder = words.encoder(tokenizer)
        for batch in batches:
            ids, counts = encoder.batch(batch.column("text"))
            whole = np.full(len(ids) + len(counts), END, "<u4")
            whole[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
            ends = np.cumsum(counts + 1)
            rows = [(text, end - n, k, *own) for text, (end, n) in enumerate(zip(ends.tolist(), (counts + 1).tolist()))
                    for k, own in enumerate(cut(n, capacity))]
            text, begin, piece, start, length = np.array(rows, np.int64).reshape(-1, 5).T
            at = begin + start
            crc = [zlib.crc32(whole[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            columns = [batch.column("doc_id").take(pa.array(text)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(whole)), pa.int32()), pa.array(whole.view(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:5 + with_ids])
            del ids, whole, rows, columns
            settle()

    texts = docs.select("doc_id", whole_text().alias("text"))
    return texts.mapInArrow(encode, f"doc_id {kind}, {PIECE}" + ", ids array<int>" * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with ids as training sequences: sequence_id, ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(token_pieces(docs, tokenizer or words.default_path(), capacity), capacity)


@query
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))
