"""A training corpus from `documents`: the stages that filter, deduplicate, mix and pack it.

Each stage keeps the columns of its input but the last, which returns the packed pieces.  Null and empty
texts pass the filters (one of them stays among near-duplicates) and are packed as end ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmargin.llm import best_fit, lines, mixing, shingles, toxicity
from jobmargin.llm.common import importable, stored, table

#: Four fifths of what is left, each document at most once; weights by language, sources alike.
MIXTURE = mixing.Target(percent=80, max_epochs=1, weights={"lang": {"en": 6, "de": 2, "fr": 2, "es": 1}})


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    importable(spark)
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), name="_toxicity")
    return scored.where(F.col("_toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def delete_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more that stand earlier; n_chars follows the text."""
    shorter = lines.delete_repeats(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        shorter = shorter.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return shorter.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: texts that op5's SimHash operator proposes, or a band beyond its bits, with 0.8 or
    more of their five-word shingles in common, and what these join."""
    importable(spark)
    return shingles.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen to MIXTURE."""
    return mixing.mix(docs, MIXTURE).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    importable(spark)
    return best_fit.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", delete_passages),
    ("simhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs


query = run
ORACLE_SQL = None  # trained and token-level stages: tests/llm/test_pipeline.py holds them against plain Python


def statement() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
