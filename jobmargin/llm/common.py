"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmargin.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(key: str, parts: int) -> Column:
    """crc32 of the key's text modulo `parts`; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The frame, written once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
USUAL, SMALL = "67108864b", "8388608b"  # of what goes to a Python worker at a time: Spark's setting, and ours


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started, and get texts in small batches unless the session says how large."""
    if spark.conf.get(BATCH) == USUAL:
        spark.conf.set(BATCH, SMALL)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def settle() -> None:
    """Give the memory of finished batches back to the machine: Python workers live on from stage to stage."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):   # another C library
        pass


def query(function):
    """A registered query: f(spark, folder) with this package importable on the workers."""
    @functools.wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        importable(spark)
        return function(spark, folder)

    return run
