"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracle import ORACLE_SQL  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    mixed = mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3, block_words=16)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import link_vectors

    return link_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify_quality

    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeated_strings

    return remove_repeated_strings(table(spark, sf_dir, "documents"), width=200)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeated_windows

    return remove_repeated_windows(table(spark, sf_dir, "documents"), window=20)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), least=0.8).drop("key")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import BASE, joined, scan_and_keep

    found = scan_and_keep(table(spark, sf_dir, "documents"), path=None)  # every blob is new to a ledger of the query's own
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), "piece_bpe_32k.model", limit=4096)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=0.5)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine

    marred = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", marred), F.col("id") % 100 == 0)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import canonical_turns, format_turns, read_back

    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, said, said)], "conv_id long, prompt string, completion string")  # told by its layout
    turns = canonical_turns(table(spark, sf_dir, "conversations")).unionByName(canonical_turns(more))
    return read_back(format_turns(turns))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit_filters

    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_source_mixing, op2_toxicity, op3_embedding_dedup, op4_quality, op5_suffix_dedup, op6_substring_dedup, op7_minhash_dedup, op8_secret_scans, op9_token_counts, op10_decontamination, op11_hard_negatives, op12_chat_format, op13_filter_audit)}
