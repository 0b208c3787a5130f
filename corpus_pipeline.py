"""The corpus pipeline: quality, near-duplicates, benchmark leaks, source mixing, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontam, mixing, neartext, quality, sharding
from tidelog.llm.common import read_table, written
from tidelog.shipping import ship

SHARDS = 24


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer keeps.

    Rows and columns as they came. Texts that are null, empty or without words go; long texts are scored whole; equal
    texts, repeated rows among them, fare alike; a score at the threshold stays; an empty table gives no rows.
    """
    ship(spark)
    return quality.kept(docs, quality.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id.

    Columns as they came. Similarity of 0.8 links, a tie too; long texts are shingled whole; texts without words, null or
    empty, are one group; rows that repeat an id come out once; a null id comes out only for a group that has no other;
    an empty table gives no rows.
    """
    ship(spark)
    return neartext.deduplicated(docs, words=5, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Rows and columns as they came. Null and empty texts contain nothing; long texts are read whole; coverage of 0.8 is
    containing, a tie too; repeated rows fare alike; null or empty items match nothing; an empty table gives no rows, an
    empty benchmark all.
    """
    ship(spark)
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one of each source may be cut to its budget's last word.

    Columns as they came, whatever their names. Texts without words, null or empty, are never taken; null sources are a
    source; null ids share a key; ties and repeated rows fall by id, size and checksum; an empty table gives no rows.
    """
    return mixing.mixed_rows(docs)


def tree_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot.

    size, text_crc32, law, shard and slot are added and replace columns of these names. Null ids share a key; null texts
    have no bytes; repeated rows have slots of their own; long texts do not matter; an empty table gives no rows.
    """
    return sharding.shard(docs, sharding.uniform_tree(SHARDS)).drop("grown_shard")


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("sharding", tree_sharding),
]

#: The quality and near-duplicate stages cannot be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = written(docs)
    return docs
