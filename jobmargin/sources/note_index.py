"""An inverted index of field notes on shared storage: written, added to, searched and compacted.

    postings/generation=g/bucket=b    token, block, notes: the ids of one block's notes that hold the token
    notes/generation=g/segment=s      the notes themselves, with their block
    commits/generation=g              written last; a generation without it does not count

A note's block is the leading bits of its id's hash, as many as leave some BLOCK notes in each, so
a token in every note has many short posting lists and not one long one.  Lists of several
tokens can only meet in a block that all of them have.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from math import ceil, log2

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobmargin.functions.text import tokens
from jobmargin.session import PARTITIONS, parts_by_input, written_step

BUCKETS = 64           # folders that tokens are hashed to
SEGMENTS = 6           # leading bits of a block that make the folder of its notes
BLOCK = 4096           # notes of a block, on average
SHARE = 2 << 20        # bytes of notes for each partition of a shuffle at most
COMMITS = "bits int, first int, n_notes bigint, columns string, generation int"
POSTINGS = "token string, block bigint, notes array<string>, generation int, bucket int"


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _commits(spark: SparkSession, path: str) -> list:
    """One small row for each generation since the beginning."""
    try:
        return spark.read.schema(COMMITS).parquet(f"{path}/commits").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _live(spark: SparkSession, path: str) -> list:
    """The commits of generations that no compaction has replaced, in order."""
    commits = _commits(spark, path)
    if not commits:
        raise ValueError(f"No note index at {path}.")
    first = max(row.first for row in commits)
    return sorted((row for row in commits if row.generation >= first), key=lambda row: row.generation)


def live_generations(spark: SparkSession, path: str) -> list[int]:
    return [row.generation for row in _live(spark, path)]


def _read_notes(spark: SparkSession, path: str) -> DataFrame:
    live = _live(spark, path)
    places = "block bigint, generation int, segment int"
    schema = T.StructType([*T.StructType.fromJson(json.loads(live[0].columns)), *T.StructType.fromDDL(places)])
    return spark.read.schema(schema).parquet(f"{path}/notes").where(F.col("generation").isin([row.generation for row in live]))


def _read_postings(spark: SparkSession, path: str) -> DataFrame:
    live = live_generations(spark, path)
    return spark.read.schema(POSTINGS).parquet(f"{path}/postings").where(F.col("generation").isin(live))


def indexed_notes(spark: SparkSession, path: str) -> DataFrame:
    """The notes that the index holds."""
    return _read_notes(spark, path).drop("block", "generation", "segment")


def _write_generation(notes: DataFrame, path: str, generation: int, first: int, block: int) -> None:
    """Notes are written by block, postings are made of the written notes: neither the work behind `notes` nor their texts are shuffled again for them.

    Words are dealt once, by bucket and, in a large index, slices of its blocks: lists are made where they are written, in
    few files, and a token in every note is spread over tasks and files.
    """
    spark, n_notes = notes.sparkSession, notes.count()
    bits = max(0, ceil(log2(max(1, n_notes) / block)))
    place = F.shiftrightunsigned(F.xxhash64("note_id"), 64 - bits) if bits else F.lit(0).cast("bigint")
    keyed = notes.where(F.col("note_id").isNotNull()).withColumn("block", place)
    segment = F.shiftright("block", max(0, bits - SEGMENTS)).cast("int")
    stored = keyed.withColumn("segment", segment).repartitionByRange("block", "note_id").sortWithinPartitions("block", "note_id")
    with written_step(spark, parts_by_input(notes, SHARE)):
        stored.write.mode("overwrite").partitionBy("segment").parquet(f"{path}/notes/generation={generation}")
    places = T.StructType.fromDDL("note_id string, content string, block bigint")
    written = spark.read.schema(places).parquet(f"{path}/notes/generation={generation}")
    tasks = max(parts_by_input(written, SHARE), int(spark.conf.get(PARTITIONS)))
    place = {"bucket": _bucket(F.col("token")), "slice": F.pmod("block", F.lit(-(-tasks // BUCKETS)))}
    lists = (
        written.select("note_id", "block", F.explode(tokens("content")).alias("token"))
        .withColumns(place).repartition(tasks, *place)
        .groupBy(*place, "token", "block").agg(F.sort_array(F.collect_set("note_id")).alias("notes"))
        .sortWithinPartitions("bucket", "token", "block").drop("slice")
    )
    with written_step(spark):
        lists.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/generation={generation}")
    row = spark.range(1).select(
        F.lit(bits).alias("bits"), F.lit(first).alias("first"), F.lit(n_notes).cast("bigint").alias("n_notes"),
        F.lit(notes.schema.json()).alias("columns"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/generation={generation}")


def write_note_index(notes: DataFrame, path: str, block: int = BLOCK) -> None:
    """A new index of `notes` (note_id, content and any other columns, the same in later additions); notes without id are left out.

    An interrupted writing leaves nothing that counts and may be run again.
    """
    _write_generation(notes, path, 0, 0, block)


def add_notes(notes: DataFrame, path: str, block: int = BLOCK) -> None:
    """Add notes as a generation of their own; ids that the index has stay as they are, so adding twice changes nothing."""
    spark = notes.sparkSession
    known = _read_notes(spark, path).select("note_id")
    last = max(row.generation for row in _commits(spark, path))
    first = live_generations(spark, path)[0]
    fresh = notes.join(known, "note_id", "left_anti").select(*notes.columns)
    _write_generation(fresh, path, last + 1, first, block)


def compact(spark: SparkSession, path: str, block: int = BLOCK) -> None:
    """Write all live generations as one, with blocks for its size; readers change over with its commit."""
    last = max(row.generation for row in _commits(spark, path))
    _write_generation(indexed_notes(spark, path), path, last + 1, last + 1, block)


def postings(spark: SparkSession, path: str, words: Iterable[str]) -> DataFrame:
    """Posting lists of the given tokens, from the folders of their buckets alone."""
    wanted = sorted(set(words))
    buckets = F.col("bucket").isin([_bucket(F.lit(w)) for w in wanted])   # constants, so folders are chosen before reading
    return _read_postings(spark, path).where(buckets & F.col("token").isin(wanted))


def matching_ids(spark: SparkSession, path: str, words: Iterable[str]) -> DataFrame:
    """(generation, block, note_id) of the notes that hold every token.

    Blocks that lack one of the tokens are skipped before any list is read for intersection.  The
    lists of a block are as many as the tokens and hold its notes only.
    """
    wanted = sorted(set(words))
    lists = postings(spark, path, wanted)
    place = ["generation", "block"]
    if len(wanted) > 1:
        common = lists.groupBy(*place).agg(F.count(F.lit(1)).alias("n_tokens")).where(F.col("n_tokens") == len(wanted))
        lists = lists.join(common, place, "left_semi")
    met = lists.groupBy(*place).agg(F.collect_list("notes").alias("lists"))
    both = F.aggregate(F.slice("lists", 2, max(1, len(wanted))), F.col("lists")[0], F.array_intersect)
    return met.select(*place, F.explode(both).alias("note_id"))


def search(spark: SparkSession, path: str, words: Iterable[str]) -> DataFrame:
    """The indexed notes that hold every token, all columns."""
    found = matching_ids(spark, path, words)
    return _read_notes(spark, path).join(found, ["generation", "block", "note_id"]).drop("block", "generation", "segment")


def token_counts(spark: SparkSession, path: str) -> DataFrame:
    """(token, n_notes) of the whole index."""
    lists = _read_postings(spark, path)
    return lists.groupBy("token").agg(F.sum(F.size("notes").cast("bigint")).alias("n_notes"))
