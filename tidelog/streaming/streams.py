"""Streaming forms: sizes as writes arrive, maps kept up to date, bandwidth windows, recent messages, file copies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidelog.operators.extents import RECENT, joined, mapped, settled, spans_of, tiled


def running_eof(log: DataFrame) -> DataFrame:
    """Each file's end so far; it only grows, so late records need no care. For update or complete mode."""
    return log.groupBy("file_id").agg(F.max(F.expr("logical_offset + length")).alias("eof"), F.sum("length").alias("backing_bytes"))


def newest_by_offset(log: DataFrame) -> DataFrame:
    """The newest record at each offset, whatever the order of arrival."""
    return log.groupBy("file_id", "logical_offset").agg(F.max(F.struct("end_us", "begin_us", "pid", "seq", "length")).alias("w")).select("file_id", "logical_offset", "w.*")


def bandwidth_windows(trace: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Bytes and records by tumbling window of their begin; records over `late` behind are dropped, which bounds state."""
    timed = trace.withColumn("begin_at", F.timestamp_micros("begin_us")).withWatermark("begin_at", late)
    return timed.groupBy(F.window("begin_at", width)).agg(F.sum("length").alias("bytes"), F.count("*").alias("records")).select(F.col("window.start").alias("start"), "bytes", "records")


def recent_messages(messages: DataFrame, keep: int = 8) -> DataFrame:
    """The last `keep` texts of each facility (facility, at, text), sent whenever they change. A ring in state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring = list(state.get[0]) if state.exists else []
        for pdf in batches:
            ring += [f"{at}\t{text}" for at, text in zip(pdf["at"], pdf["text"], strict=True)]
        ring = sorted(ring, key=lambda x: int(x.split("\t", 1)[0]))[-keep:]
        state.update((ring,))
        yield pd.DataFrame({"facility": [key[0]], "texts": [[x.split("\t", 1)[1] for x in ring]]})

    return messages.groupBy("facility").applyInPandasWithState(step, "facility string, texts array<string>", "ring array<string>", "update", GroupStateTimeout.NoTimeout)


def _pieces(spark: SparkSession, path: str, schema: StructType, before: int | None) -> DataFrame:
    """The pieces of each (file, tile) as the last batch that touched it left them, of batches before a number."""
    kept = spark.read.schema(schema).parquet(f"{path}/pieces")
    kept = kept if before is None else kept.where(F.col("version") < before)
    last = kept.groupBy("bucket", "file_id", "tile").agg(F.max("version").alias("version"))
    return kept.join(last, ["bucket", "file_id", "tile", "version"], "left_semi")


def _piece_schema(kind: str) -> StructType:
    return StructType.fromDDL(f"file_id {kind}, tile long, lo long, hi long, base long, physical_offset long, end_us long, begin_us long, pid long, seq long, version int, bucket int")


def maintained_map(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest-wins map of a streamed log under path, and each file's end, which empty records move too.

    A batch touches the (file, tile) cells of its records only: it resolves them with the pieces that are there, and
    writes those cells anew under its number (pieces/version=<batch>, ends/version=<batch>). A batch that runs again
    overwrites its own version, so results are exactly-once. read_map() and read_ends() find the newest versions.
    Old versions of cells stay until somebody drops those that no cell is newest in.
    """
    schema = _piece_schema(log.schema["file_id"].dataType.simpleString())
    columns = [c for c in schema.names if c not in ("version", "bucket")]

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        parts = tiled(spans_of(batch)).select(*columns)
        if number:
            touched = parts.select("file_id", "tile").distinct().withColumn("bucket", _bucket())
            old = _pieces(spark, path, schema, number).join(touched, ["bucket", "file_id", "tile"], "left_semi")
            parts = parts.unionByName(old.select(*columns))
        whole = settled(parts, "file_id", RECENT).withColumn("bucket", _bucket())
        whole.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/pieces/version={number}")
        running_eof(batch).select("file_id", "eof").write.mode("overwrite").parquet(f"{path}/ends/version={number}")

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _bucket() -> Column:
    return F.pmod(F.hash("file_id", "tile"), F.lit(64))


def read_map(spark: SparkSession, path: str, batch: int | None = None, kind: str = "string") -> DataFrame:
    """The map that maintained_map() keeps, as of a batch or now. kind is the type of file ids."""
    found = _pieces(spark, path, _piece_schema(kind), None if batch is None else batch + 1)
    return mapped(joined(found, "file_id", RECENT, ("pid", "seq")))


def read_ends(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, eof) of the files in a maintained map."""
    return spark.read.parquet(f"{path}/ends").groupBy("file_id").agg(F.max("eof").alias("eof"))


def copied_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Copy what lands in a folder to another, once each."""
    return spark.readStream.schema(schema).parquet(source).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
