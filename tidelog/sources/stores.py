"""A store of written bytes: a data log and an index log for each writer, as Parquet."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.extents import file_stats, physical_offsets, range_query, resolve

#: Bytes of a cell of a data log, inside which reads look for the row that holds them.
CELL = 1 << 20
DATA = "file_id string, pid long, seq long, logical_offset long, length long, physical_offset long, data binary"
INDEX = "file_id string, pid long, seq long, logical_offset long, length long, physical_offset long, begin_us long, end_us long"


def _there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def write(requests: DataFrame, path: str) -> None:
    """Append writes (file_id, pid, seq, logical_offset, data) to the store: their bytes first, then index records.

    A writer's bytes follow those it has in the store, its seq too (within a call seq orders its writes, from 0 on). Begin
    and end of a record are the times before and after the call's bytes were appended. If a call fails between the two
    appends, its bytes stay unreferenced and the next ones follow them, so no record ever points at other bytes. A null
    data is empty, and an empty write counts for the end of file alone. Two calls may run at once if they share no writer.
    """
    spark, began = requests.sparkSession, time.time_ns() // 1000
    rows = requests.selectExpr("cast(file_id as string)", "cast(pid as bigint)", "cast(seq as bigint)", "cast(logical_offset as bigint)", "coalesce(data, X'') as data").withColumn("length", F.octet_length("data").cast("long"))
    placed = physical_offsets(rows)
    if _there(spark, f"{path}/data"):
        tails = spark.read.schema(DATA).parquet(f"{path}/data").groupBy("file_id", "pid").agg(F.max(F.col("physical_offset") + F.col("length")).alias("_tail"), (F.max("seq") + 1).alias("_next"))
        placed = placed.join(tails, ["file_id", "pid"], "left")
        placed = placed.withColumn("physical_offset", F.expr("physical_offset + coalesce(_tail, 0L)")).withColumn("seq", F.expr("seq + coalesce(_next, 0L)"))
    part = f"{path}/data/batch={uuid.uuid4().hex}"
    placed.select("file_id", "pid", "seq", "logical_offset", "length", "physical_offset", "data").write.parquet(part)
    ended = time.time_ns() // 1000
    # the records are read back from what was written, without the bytes
    made = spark.read.schema(DATA).parquet(part).select("file_id", "pid", "seq", "logical_offset", "length", "physical_offset")
    made.withColumn("begin_us", F.lit(began)).withColumn("end_us", F.lit(ended)).write.mode("append").parquet(f"{path}/index")


def index(spark: SparkSession, path: str) -> DataFrame:
    """The write log of a store."""
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read(spark: SparkSession, path: str, probes: DataFrame) -> DataFrame:
    """(probe_id, logical_offset, length, hole, data): the pieces that each probe (probe_id, file_id, offset, length)
    reads, up to the end of file; the data of a hole is null, and reads as zeros.

    A piece lies in one row of its data log. The row is found without its bytes, by a window over a cell of the log; the
    bytes then come by an equality join.
    """
    log, data = index(spark, path), spark.read.schema(DATA).parquet(f"{path}/data")
    found = range_query(resolve(log), probes, stats=file_stats(log))
    cells = f"explode(sequence(physical_offset div {CELL}, (physical_offset + length - 1) div {CELL})) as cell"
    starts = data.where("length > 0").selectExpr("file_id", "pid", "physical_offset as start", cells)
    starts = starts.selectExpr("file_id", "pid", "cell", f"greatest(start, cell * {CELL}) as at", "0 as kind", "start", "cast(null as struct<probe_id:bigint,logical_offset:bigint,length:bigint>) as piece")
    asked = found.where("not hole").selectExpr(
        "file_id", "pid", f"chunk_offset div {CELL} as cell", "chunk_offset as at", "1 as kind", "cast(null as bigint) as start", "struct(cast(probe_id as bigint) as probe_id, logical_offset, length) as piece"
    )
    both = starts.unionByName(asked).selectExpr("*", "last(start, true) over (partition by file_id, pid, cell order by at, kind rows between unbounded preceding and current row) as held")
    wanted = both.where("kind = 1").selectExpr("file_id", "pid", "held as physical_offset", "at", "piece")
    bytes_of = data.where("length > 0").select("file_id", "pid", "physical_offset", "data")
    got = wanted.join(bytes_of, ["file_id", "pid", "physical_offset"]).selectExpr(
        "piece.probe_id", "piece.logical_offset", "piece.length", "false as hole", "substring(data, cast(at - physical_offset + 1 as int), cast(piece.length as int)) as data"
    )
    gaps = found.where("hole").selectExpr("cast(probe_id as bigint) as probe_id", "logical_offset", "length", "true as hole", "cast(null as binary) as data")
    return got.unionByName(gaps)
