"""Queries of the driver contract on logs derived from its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import scalar
from tidelog.operators import extents, names, stat, trace
from tidelog.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
TRUNCATE_AT, GROW_TO, GROWN_TO = 500_000, 2_000_000, 1_000_600


def write_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extents.physical_offsets(fx.raw_write_log(spark, sf_dir))


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extents.resolve(write_log(spark, sf_dir))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe for each event."""
    return fx.table(spark, sf_dir, "events").selectExpr("event_id as probe_id", "event_type as file_id", "event_id * 104729 % 1010000 as offset", "1 + event_id % 5000 as length")


def file_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extents.file_stats(fx.raw_write_log(spark, sf_dir))


def host_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs by (file, host): orders as writes, of hosts that close facts know or not."""
    return fx.table(spark, sf_dir, "orders").selectExpr(
        "concat('c', cast(o_custkey % 300 as string)) as file_id", "concat('host', cast(o_orderkey % 43 as string)) as host", "o_orderkey * 512 as logical_offset", "1 + o_orderkey % 9000 as length", "unix_micros(cast(o_orderdate as timestamp)) as end_us"
    )


def merge_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = write_log(spark, sf_dir)
    return extents.merge(log.where("pid % 2 = 0"), log.where("pid % 2 = 1"))


def linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Current names and a small index that their (fid, did) pairs point into."""
    log = fx.name_log(spark, sf_dir)
    opened = log.where("op = 3").selectExpr("dir_id", "did", "rec_off as fid", "seq", "seq % 7 * 100 as off", "100 + seq % 50 as length", "ts_us", "seq * 10 as physical_offset")
    return names.replay(log), opened


def parse_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stat.parse_meta_names(stat.meta_names(fx.meta(spark, sf_dir)))


def index_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fx.table(spark, sf_dir, "orders").selectExpr("concat('hostdir.', o_orderkey % 32, '/dropping.index.', 1000000 + o_orderkey, '.', o_custkey, '.n', o_custkey % 9, '.cluster.', o_orderkey % 97) as name")
    return stat.parse_index_names(made)


def open_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fx.open_handles(spark, sf_dir).selectExpr("concat('open.', host, '.site.', pid) as name").distinct()
    return stat.parse_open_names(made)


def summary_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fx.table(spark, sf_dir, "orders").selectExpr("concat('SZ:', o_orderkey * 4096, '.BL:', o_orderkey * 8, '.OT:', 1000 + o_custkey, '.CT:', 1001 + o_custkey + o_orderkey % 50, '.BW:1.5.IN:MPI.NP:', 1 + o_custkey % 64, '.HO:n', o_custkey % 9, '.site.UI:', o_custkey % 7, '.PA:_a_b') as name")
    return stat.parse_summaries(made)


def hash_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = fx.meta(spark, sf_dir).select("host").distinct()
    return hosts.select("host", scalar.string_hash(F.col("host")).cast("string").alias("hash"), scalar.bucket_of(F.col("host"), 32).alias("hostdir"))


def human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = fx.meta(spark, sf_dir).groupBy("file_id").agg(F.sum("total_bytes").alias("bytes"))
    return sized.select("file_id", "bytes", F.round(scalar.human_value(F.col("bytes")), 4).alias("value"), scalar.human_unit(F.col("bytes")).alias("unit"), scalar.decimal_exponent(F.col("bytes")).alias("exponent"))


def rank_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = spark.range(1000).withColumnRenamed("id", "rank")
    return ranks.select("rank", *[scalar.rank_group(F.col("rank"), 1000, g).cast("long").alias(f"of_{g}") for g in (7, 32, 300)])


def packed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fx.name_log(spark, sf_dir).select("seq", scalar.pack_time(F.col("ts_us")).alias("packed"))
    return made.select("seq", "packed", scalar.packed_seconds(F.col("packed")).alias("seconds"), scalar.packed_micros(F.col("packed")).cast("long").alias("micros"))


def clean_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "concat(case when c_custkey % 2 = 0 then '/' else '' end, 'a', c_custkey % 5, case when c_custkey % 3 = 0 then '//./' else '/' end, 'b', c_custkey, case when c_custkey % 4 = 0 then '/../c' else '/' end) as path")
    return made.select("id", scalar.clean_path(F.col("path")).alias("clean"), scalar.flat_path(scalar.clean_path(F.col("path"))).alias("flat"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of levels 0x10000 (a debug stream) to 0x400000 (errors)."""
    return fx.table(spark, sf_dir, "events").selectExpr("event_id", "event_type as facility", "shiftleft(65536, cast(event_id % 7 as int)) as level")


def log_messages(spark: SparkSession, sf_dir: str, default: int | None = None) -> DataFrame:
    masks = spark.range(1).selectExpr("explode(map('click', 1048576L, 'error', 327680L, 'view', 4194304L)) as (facility, mask)")
    return trace.log_filter(messages(spark, sf_dir), masks, default)


def message_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of six fields or, now and then, of fewer, or without a date."""
    return fx.table(spark, sf_dir, "events").selectExpr(
        "event_id", "case when event_id % 11 = 0 then concat('12:00 host', event_id % 9, '.site tag') when event_id % 13 = 0 then concat('x host.site tag ', event_type, ' INFO  gone ', event_id)"
        " else concat('12:', event_id % 60, '  host', event_id % 9, '.site.org tag', event_id % 3, ' ', event_type, ' WARN text of  ', event_id) end as value"
    )


def formatted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.formatted(trace.messages(message_lines(spark, sf_dir).select("value")), "dHtflm")


def mounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = fx.table(spark, sf_dir, "customer").selectExpr("concat('/mnt/m', c_custkey % 4, '/d', c_custkey % 3, '/f', c_custkey) as path")
    known = spark.range(1).selectExpr("explode(map('/mnt/m0', 'b0', '/mnt/m0/d1', 'b01', '/mnt/m1', 'b1', '/mnt/m2/d2', 'b22')) as (mount, backend)")
    return stat.mount_of(paths, known)


def links_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Metalinks on thirteen backends to five others, and the four of those that are known."""
    links = fx.table(spark, sf_dir, "customer").selectExpr("concat('/mnt/b', c_custkey % 13, '/dir/l', c_custkey) as path", "concat(length(concat('/mnt/b', c_custkey % 13)), '/store/v', c_custkey % 5) as text")
    return links, spark.range(4).selectExpr("concat('/store/v', id) as backend")


def metalinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stat.resolve_metalinks(*links_of(spark, sf_dir))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index and data logs below two backends, some of them behind metalinks whose folders are elsewhere or gone."""
    made = fx.table(spark, sf_dir, "orders")
    plain = made.selectExpr("concat('/mnt/b', o_custkey % 13, '/dir/d', o_custkey, '/dropping.', case when o_orderkey % 3 = 0 then 'index' when o_orderkey % 3 = 1 then 'data' else 'meta' end, '.', o_orderkey) as path")
    shadow = made.where("o_custkey % 2 = 0").selectExpr("concat('/store/v', o_custkey % 5, '/dir/l', o_custkey, '/dropping.data.', o_orderkey) as path")
    links, backends = links_of(spark, sf_dir)
    roots = spark.range(2).selectExpr("concat('/mnt/b', id * 5) as root")
    return stat.collect_contents(plain.union(shadow), links, backends, roots, ("dropping.index.", "dropping.data."))


def grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of files after each is grown to where only some of them end before."""
    log = extents.grown(write_log(spark, sf_dir), GROWN_TO)
    return extents.file_stats(log).selectExpr("file_id", "eof", "records")


def small_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey as probe_id", "o_orderkey % 210 as fid", "o_orderkey * 104729 % 70000 as off")
    return names.small_lookup(fx.small_index(spark, sf_dir), asked)


def dropping_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fx.table(spark, sf_dir, "orders").selectExpr("concat('/burst/hostdir.', o_orderkey % 32, case when o_orderkey % 5 = 0 then '/dropping.meta.' when o_orderkey % 2 = 0 then '/dropping.index.' else '/dropping.data.' end, o_orderkey, '.n.', o_custkey % 9) as path")
    return stat.writer_droppings(made, 7)


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current names with their (fid, did) pairs, in order, as text."""
    return names.replay(fx.name_log(spark, sf_dir)).selectExpr("dir_id", "name", "mtime_us", "array_join(transform(opens, x -> concat(x.fid, ':', x.did)), ' ') as opens")


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fx.table(spark, sf_dir, "orders").selectExpr("concat('c', cast(o_custkey % 300 as string)) as file_id", "case when o_orderkey % 3 = 0 then 'index' else 'data' end as kind", "cast(floor(o_totalprice) as bigint) as size")
    return stat.container_sizes(files)


def hostdirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fx.table(spark, sf_dir, "orders").selectExpr("concat('c', cast(o_custkey % 30 as string)) as file_id", "o_orderkey * o_custkey % 32 as hostdir")
    return stat.hostdirs(made)


def data_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extents.range_query(resolved(spark, sf_dir), probes(spark, sf_dir), stats=file_ends(spark, sf_dir))
    chunks = fx.table(spark, sf_dir, "events").selectExpr("event_type as file_id", "user_id as pid", "concat('/store/', event_type, '/dropping.data.', user_id) as data_path").distinct()
    return extents.data_paths(found, chunks).select("probe_id", "logical_offset", "length", "hole", "chunk_offset", "data_path")


def handle_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    handles = fx.table(spark, sf_dir, "orders").selectExpr("concat('c', cast(o_custkey % 300 as string)) as file_id", "case when o_orderkey % 4 = 0 then 'w' else 'r' end as mode", "o_orderkey * 10 as bytes")
    return stat.users(handles)


def xattrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many attributes a file has, and one looked up."""
    kept = fx.table(spark, sf_dir, "customer").selectExpr("concat('c', cast(c_custkey % 300 as string)) as file_id", "concat('user.k', c_custkey % 3) as k", "c_name as v")
    return stat.xattrs(kept).selectExpr("file_id", "cast(size(attributes) as bigint) as attrs", "attributes['user.k1'] as k1")


def lazy_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = stat.sums(fx.meta(spark, sf_dir)).select("file_id", "size")
    live = host_logs(spark, sf_dir).selectExpr("file_id", "logical_offset * 20 + length as eof")
    return stat.lazy_size(stored, live)


def _log(function: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: function(write_log(spark, sf_dir))


def _raw(function: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: function(fx.raw_write_log(spark, sf_dir))


def _map(function: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: function(resolved(spark, sf_dir))


def _trace(function: Callable[..., DataFrame], **how) -> Query:
    return lambda spark, sf_dir: function(fx.trace_log(spark, sf_dir), **how)


def trace_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one row of the bounds. Its sum is a bigint, as in the SQL, where it fits one, and else the operator's decimal
    (the SQL then fails)."""
    found = trace.bounds(fx.trace_log(spark, sf_dir))
    row = found.first()
    if row["sum_end_us"] is None or -(1 << 63) <= row["sum_end_us"] < 1 << 63:
        return spark.createDataFrame([row], found.schema).withColumn("sum_end_us", F.col("sum_end_us").cast("long"))
    return spark.createDataFrame([row], found.schema)


QUERIES: dict[str, Query] = {
    "resolve_extents": resolved,
    "merge_logs": merge_logs,
    "physical_offset": lambda s, d: write_log(s, d).select("file_id", "pid", "seq", "length", "physical_offset"),
    "file_stats": _raw(extents.file_stats),
    "uniform_restart": _log(lambda x: extents.only_writer(x, 7)),
    "holes": _map(extents.holes),
    "coalesce": _map(extents.coalesce),
    "contiguous_writes": _log(extents.contiguous_writes),
    "overlaps": _raw(extents.overlaps),
    "range_query": lambda s, d: extents.range_query(resolved(s, d), probes(s, d), stats=file_ends(s, d)),
    "read_tasks": lambda s, d: extents.read_tasks(extents.range_query(resolved(s, d), probes(s, d), stats=file_ends(s, d))),
    "stab_lookup": lambda s, d: extents.stab_lookup(resolved(s, d), probes(s, d), stats=file_ends(s, d)),
    "truncate_extents": _map(lambda x: extents.truncate(x, TRUNCATE_AT)),
    "data_paths": data_paths,
    "rewritten_log": _log(lambda x: extents.rewritten(x, TRUNCATE_AT)),
    "grown_log": grown,
    "truncate_grow": _raw(lambda x: extents.resized_eof(extents.file_stats(x), GROW_TO)),
    "stat_closed": lambda s, d: stat.stat_closed(fx.meta(s, d), fx.open_handles(s, d)),
    "stat_size": lambda s, d: stat.stat(fx.meta(s, d), fx.open_handles(s, d), host_logs(s, d)),
    "lazy_size": lazy_sizes,
    "open_hosts": lambda s, d: stat.open_hosts(fx.open_handles(s, d)),
    "truncate_meta": lambda s, d: stat.truncate_meta(fx.meta(s, d), 10_000_000),
    "parse_names": parse_names,
    "parse_index_names": index_names,
    "parse_open_names": open_names,
    "parse_summaries": summary_names,
    "container_sizes": containers,
    "handle_users": handle_users,
    "xattrs": xattrs,
    "hostdirs": hostdirs,
    "metalinks": metalinks,
    "mounts": mounts,
    "collect_contents": contents,
    "writer_droppings": dropping_names,
    "list_prefixed": lambda s, d: stat.list_names(fx.name_log(s, d), ("f1x", "f42x")),
    "list_names": lambda s, d: stat.list_names(fx.name_log(s, d)),
    "replay_names_simple": lambda s, d: names.replay_simple(fx.name_log(s, d)),
    "replay_names": replayed,
    "merge_name_logs": lambda s, d: names.merged(fx.name_log(s, d)).select("dir_id", "did", "seq", "ts_us", "op", "name"),
    "name_index": lambda s, d: names.index_of_names(*linked(s, d)),
    "truncate_clip": lambda s, d: names.truncate_clip(fx.small_index(s, d)),
    "small_extents": lambda s, d: names.small_extents(fx.small_index(s, d)),
    "small_lookup": small_lookups,
    "small_size": lambda s, d: names.small_size(fx.small_index(s, d)),
    "trace_projection": _trace(trace.projection),
    "trace_bounds": trace_bounds,
    "trace_rejects": _trace(trace.rejects),
    "writer_end": _trace(trace.writer_end),
    "writer_spans": _trace(trace.writer_spans),
    "writer_stats": _trace(trace.writer_stats),
    "stragglers": _trace(trace.straggler_counts),
    "straggler_rows": lambda s, d: trace.straggler_rows(fx.trace_log(s, d)).select("pid", "seq", "side"),
    "bandwidth_bins": _trace(trace.bandwidth_bins),
    "bandwidth_fractional": _trace(trace.bandwidth_bins, fractional=True),
    "bin_times": _trace(trace.bin_times),
    "ios_running": _trace(trace.ios_running),
    "ios_finished": _trace(trace.ios_finished),
    "size_histogram": _trace(trace.size_histogram),
    "size_histogram_serial": _trace(trace.size_histogram, serial=True),
    "downsample": _trace(trace.downsample),
    "op_stats": lambda s, d: trace.op_stats(fx.ops(s, d)),
    "log_filter": log_messages,
    "log_filter_default": lambda s, d: log_messages(s, d, 2097152),
    "parse_messages": lambda s, d: trace.messages(message_lines(s, d).select("value")),
    "format_messages": formatted_messages,
    "trace_report": _trace(trace.report),
    "offset_triples": _trace(trace.offset_triples),
    "time_triples": _trace(trace.time_triples),
    "hash_bucket": hash_bucket,
    "human_size": human_size,
    "rank_groups": rank_groups,
    "packed_times": packed_times,
    "clean_paths": clean_paths,
}
