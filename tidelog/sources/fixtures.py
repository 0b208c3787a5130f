"""Logs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _us(column: str) -> str:
    return f"unix_micros(cast({column} as timestamp))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_write_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write records without the physical offsets."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_type as file_id", "user_id as pid", "event_id as seq", "event_id * 7919 % 1000003 as logical_offset",
        "1 + cast(floor(value * 10) as bigint) as length", f"{_us('ts')} as begin_us", f"{_us('ts')} + 1 + event_id % 997 as end_us",
    )


def trace_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id as pid", "event_id as seq", "event_id * 4096 as logical_offset", "1 + cast(floor(value * 1000) as bigint) as length",
        f"{_us('ts')} as begin_us", f"{_us('ts')} + (1 + event_id % 997) * 60000000 as end_us",
    )


def name_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderpriority as dir_id", "o_orderkey % 8 as did", "o_orderkey * 32 as rec_off", "o_orderkey as seq", f"{_us('o_orderdate')} + o_orderkey as ts_us",
        "case when o_orderkey % 10 < 4 then 1 when o_orderkey % 10 < 7 then 3 when o_orderkey % 10 = 7 then 5 when o_orderkey % 10 = 8 then 2 else 4 end as op",
        "concat('f', cast(o_custkey % 500 as string)) as name", "case when o_orderkey % 10 = 9 then concat('f', cast((o_custkey + 1) % 500 as string)) end as name_to",
    )


def small_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small-file records; seq numbers all rows of lineitem in one order, by range-partitioned counting."""
    from tidelog.operators.ranks import global_rank

    keyed = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    ranked = global_rank(keyed, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"], "seq")
    return ranked.selectExpr(
        "l_suppkey % 8 as did", "l_orderkey % 200 as fid", "seq", "l_partkey * 64 % 65536 as off",
        "case when seq % 41 = 0 then 0 else cast(l_quantity as bigint) * 16 end as length", f"{_us('l_shipdate')} + seq as ts_us",
        "case when seq % 41 = 0 then -1 else seq * 1024 end as physical_offset",
    )


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('c', cast(o_custkey % 300 as string)) as file_id", "concat('host', cast(o_orderkey % 40 as string)) as host",
        "cast(floor(o_totalprice * 100) as bigint) as last_offset", "cast(floor(o_totalprice * 130) as bigint) as total_bytes", f"{_us('o_orderdate')} as close_us",
    )


def open_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 13 = 0").selectExpr("concat('c', cast(c_custkey % 300 as string)) as file_id", "concat('host', cast(c_custkey % 40 as string)) as host", "c_custkey % 97 as pid").distinct()


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_type as op", "event_id as seq", "cast(floor(value * 1000) as bigint) as elapsed_us", "cast(floor(value * 4096) as bigint) as bytes", "case when event_type = 'error' then 1 else 0 end as is_error"
    )
