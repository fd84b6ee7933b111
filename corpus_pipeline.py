"""A corpus from raw documents: quality, near copies, test items, secrets, and a mix of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadweave.llm._kit import Scratch
from roadweave.llm.decontaminate import decontaminated
from roadweave.llm.minhash_dedup import one_of_each
from roadweave.llm.mixing import mix_sources
from roadweave.llm.quality import of_quality
from roadweave.llm.secrets import redacted

#: Where this setting names a path, secrets found by earlier runs are read from there and new ones added.
LEDGER = "roadweave.secrets.ledger"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose quality is predicted as 1, each by its own text; null and empty texts are scored as such."""
    return of_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the smallest doc_id, null last.

    Two texts of one doc_id are two documents; of repeated rows (doc_id and text) one stays; null and empty texts are no
    copies of each other.
    """
    return one_of_each(docs)


def test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text holds a benchmark item, whole or edited; null and empty texts hold none."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts by a mark and counts n_chars anew; keeps every row."""
    return redacted(docs, spark.conf.get(LEDGER, None))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes from each row; a null text gives none, null sources are one source."""
    return mix_sources(docs, weights=(5, 2, 1), most=3, block_words=16).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("quality classifier", quality), ("minhash near-dedup", near_copies), ("benchmark decontamination", test_items), ("secret scans", secrets), ("mixing sources", mixing)]

#: A discriminant and signatures have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
