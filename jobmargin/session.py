"""Session settings the library expects, and the shared scratch folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Mapping
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for the plans in this package.  AQE converts joins on the
# measured size of a side, coalesces small shuffle partitions and splits skewed
# ones; the RocksDB store keeps streaming state off the JVM heap.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

LOCAL_FOLDER = "/tmp/jobmargin-checkpoints"
PARTITIONS = "spark.sql.shuffle.partitions"
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "jobmargin", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS applied; keyword settings win (dots written as '__')."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    overrides = {key.replace("__", "."): value for key, value in conf.items()}
    for key, value in {**DEFAULTS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the folder every executor can reach.

    The cluster names that folder in ``spark.checkpoint.dir``; LOCAL_FOLDER is for
    sessions in one process that leave it unset.
    """
    return f"{_scratch(spark)}/{purpose}-{uuid.uuid4().hex}"


def _scratch(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
        root = LOCAL_FOLDER
    return f"{root.rstrip('/')}/jobmargin/{spark.sparkContext.applicationId}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder; frames that read it end with it."""
    delete_path(spark, _scratch(spark))


def delete_path(spark: SparkSession, name: str) -> None:
    """Delete a folder of whatever file system its name belongs to; a missing one is no error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parts_by_input(df: DataFrame, share: int) -> int:
    """Partitions of `share` bytes each for the files that a frame reads; 0 where it reads none.

    For exchanges whose rows widen afterwards: Spark sizes partitions by what it shuffles, compressed.
    """
    hadoop = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    names = map(df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path, df.inputFiles())
    return -(-sum(path.getFileSystem(hadoop).getFileStatus(path).getLen() for path in names) // share)


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for what starts within; the session's own are put back."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def written_step(spark: SparkSession, parts: int = 0, advisory: str | None = None) -> AbstractContextManager[None]:
    """Settings for a step that is written before the next begins: its shuffle files are deleted when it ends.

    Shuffles get `parts` partitions where the session's own number is less, as rows of a large input would
    spill in few; AQE joins small ones, up to `advisory` bytes if given.
    """
    now = {PARTITIONS: str(max(parts, int(spark.conf.get(PARTITIONS)))), FREED: "true"} | ({ADVISORY: advisory} if advisory else {})
    return settings(spark, now)


def send_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write a small derived table to the shared folder once and read it back.

    For frames that a plan uses several times: the work behind them runs once, and the
    written copy outlives lost executors.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
