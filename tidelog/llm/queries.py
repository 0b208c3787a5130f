"""The training-data queries op1 to op10 and the pipeline, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import chat, decontam, embedding_lsh, licenses, mixing, quality, sharding, simhash, suffix, toxicity
from tidelog.llm.common import read_table
from tidelog.llm.oracles import ORACLE_SQL

SHARDS = 24


def op1_tiling_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "tiles", "covered", "coverage", F.to_json("spans").alias("spans"))


def op2_bwt_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.repeats(read_table(spark, sf_dir, "documents"), width=50)
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(chat.exchanges(read_table(spark, sf_dir, "conversations")), chat.REPLY_TOOL).withColumnRenamed("conv", "conv_id")


def op7_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs)).withColumnRenamed("id", "doc_id")


def op9_nb_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    got = toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))
    return got.select(F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=4, reach=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    put = sharding.shard(docs, sharding.uniform_tree(SHARDS), sharding.uniform_tree(SHARDS + 1))
    return put.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_pstable_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_lsh.near_vectors(read_table(spark, sf_dir, "embeddings"), threshold=0.95)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tiling_decontamination": op1_tiling_decontamination,
    "op2_bwt_substring_dedup": op2_bwt_substring_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_simhash_vptree": op4_simhash_vptree,
    "op5_tool_call_linking": op5_tool_call_linking,
    "op6_hash_tree_sharding": op6_hash_tree_sharding,
    "op7_weak_label_quality": op7_weak_label_quality,
    "op8_source_mixing": op8_source_mixing,
    "op9_nb_toxicity": op9_nb_toxicity,
    "op10_pstable_lsh": op10_pstable_lsh,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
