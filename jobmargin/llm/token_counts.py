"""Token counts through a digest cache."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmargin.llm import words
from jobmargin.llm.common import query, table, whole_text
from jobmargin.session import shared_folder

LIMIT = 512
CACHE = "tokenizer string, digest string, n_tokens long"


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Stored (digest, n_tokens) of one tokenizer version; no rows where nothing is stored yet.

    Two writers may have stored the same digest; it comes once.
    """
    try:
        stored = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE)
    return stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def fill_cache(texts: DataFrame, tokenizer: str, cache: str, text: str = "text") -> None:
    """Encode each distinct text that the cache lacks, once, and append the counts.

    Copies meet before the exchange (each task sends a digest once), so a text that a third
    of all rows hold is a few rows.  The append is one job: executors may be lost during it.
    """
    digest = words.version(tokenizer)

    @F.arrow_udf("bigint")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(words.encoder(tokenizer).batch(batch)[1])

    known = read_cache(texts.sparkSession, cache, digest)
    misses = (
        texts.select(whole_text(text).alias("text"))
        .select(F.sha2("text", 256).alias("digest"), "text")
        .dropDuplicates(["digest"])
        .join(known, "digest", "left_anti")
    )
    counted = misses.select("digest", n_tokens("text").alias("n_tokens"))
    counted.select(F.lit(digest).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, text: str = "text") -> DataFrame:
    """The rows of `docs` with text_digest, n_bytes (UTF-8) and n_tokens; fills the cache first (eager).

    The normalised content is the text itself, null as empty: any further change would change
    the count.  Null and empty texts have no bytes and no tokens; repeated rows stay; other
    columns pass through, columns of the three names are replaced.
    """
    fill_cache(docs, tokenizer, cache, text)
    counts = read_cache(docs.sparkSession, cache, words.version(tokenizer))
    keyed = docs.withColumns({
        "text_digest": F.sha2(whole_text(text), 256), "n_bytes": F.octet_length(whole_text(text)).cast("long"),
    })
    counts = counts.withColumnRenamed("digest", "text_digest")
    return keyed.drop("n_tokens").join(counts, "text_digest")


@query
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = count_tokens(docs, words.default_path(), shared_folder(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
