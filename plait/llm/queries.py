"""The queries of this package and, where SQL can express them, what DuckDB finds for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.llm import jaccard, lines, media, mixing, oracle, packing, quality, sharding, substrings, tokenfile, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(_documents(spark, sf_dir), drop_emptied=False)
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), [1.0] * 40, [1.0] * 41)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(_documents(spark, sf_dir))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_documents(spark, sf_dir))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_ids(_documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_pack": op1_pack, "op2_mix": op2_mix, "op3_lines": op3_lines, "op4_jaccard": op4_jaccard, "op5_shard": op5_shard, "op6_substrings": op6_substrings, "op7_media": op7_media, "op8_token_ids": op8_token_ids, "op9_toxicity": op9_toxicity, "op10_quality": op10_quality}
#: None for op1, op7, op8 and op9 (tokenizers, stored bytes, a trained model) and op5 (a hash that DuckDB lacks): tests hold these against brute force.
ORACLE: dict[str, str] = {"op2_mix": oracle.MIX, "op3_lines": oracle.LINES, "op4_jaccard": oracle.JACCARD, "op6_substrings": oracle.SUBSTRINGS, "op10_quality": oracle.QUALITY}
