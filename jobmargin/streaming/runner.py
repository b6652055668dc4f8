"""Run a stream over what is available and read its result as a table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobmargin.session import DEFAULTS, settings, shared_folder
from jobmargin.streaming.store import KeyedStore

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
CLOSING = "spark.sql.streaming.noDataMicroBatches.enabled"
COUNTED = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"


def run_updates(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Write each micro-batch's changed (or appended) rows below ``path/batch_id=N`` and stop when caught up; returns the ended query.

    A batch that is run again after a failure overwrites its own folder.
    """
    def write_batch(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write_batch)
        .start()
    )
    query.awaitTermination()
    return query


def latest_state(updates: DataFrame, keys: Iterable[str]) -> DataFrame:
    """The last written row per key; older batches' rows drop out before the exchange."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))
    return (
        updates.withColumn("recency", F.row_number().over(newest))
        .where(F.col("recency") == 1)
        .drop("recency", "batch_id")
    )


def follow(stream: DataFrame, store: KeyedStore, checkpoint: str) -> None:
    """Keep a table up to date with a stream's changed rows until it has caught up.

    State is kept in RocksDB, which keyed processors need; the session's own setting is put back.
    """
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, DEFAULTS[PROVIDER])
    try:
        query = (
            stream.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(store.upsert)
            .start()
        )
    finally:
        spark.conf.set(PROVIDER, before)
    query.awaitTermination()


def result_of(stream: DataFrame, keys: Iterable[str], purpose: str) -> DataFrame:
    """Run a stream to the end of the available input and return its final rows, one a key, merged on disk."""
    path = shared_folder(stream.sparkSession, purpose)
    store = KeyedStore(stream.sparkSession, f"{path}/rows", stream.schema, list(keys))
    follow(stream, store, f"{path}/checkpoint")
    store.compact()
    return store.read()


def appended(stream: DataFrame, purpose: str, closing: bool = True) -> DataFrame:
    """Run a stream in append mode to the end of the available input and return all its rows.

    The closing batch without input emits what the last watermark ends; a stream that emits every row at once, as an inner
    join does, needs none, since the state it would free ends with the run.  State is in RocksDB, and its rows are not counted:
    that reads each key before it is written.
    """
    path = shared_folder(stream.sparkSession, purpose)
    with settings(stream.sparkSession, {PROVIDER: DEFAULTS[PROVIDER], COUNTED: "false"} | ({} if closing else {CLOSING: "false"})):
        run_updates(stream, f"{path}/rows", f"{path}/checkpoint", "append")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows").select(*stream.columns)
