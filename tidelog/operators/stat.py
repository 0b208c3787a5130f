"""File metadata: sizes from close-time facts and logs, open handles, names that carry facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import scalar


def sums(meta: DataFrame) -> DataFrame:
    """Size, blocks of 512 bytes and last close for each file."""
    return meta.groupBy("file_id").agg(F.max("last_offset").alias("size"), F.sum(F.expr("(total_bytes + 511) div 512")).alias("blocks"), F.max(F.expr("close_us div 1000000")).alias("mtime_s"))


def stat_closed(meta: DataFrame, handles: DataFrame) -> DataFrame:
    """Sums over facts of hosts that have no handle open on the file."""
    return sums(meta.join(handles.select("file_id", "host").distinct(), ["file_id", "host"], "left_anti"))


def rescanned(logs: DataFrame, meta: DataFrame, handles: DataFrame) -> DataFrame:
    """Logs (file_id, host, ...) to read again: their host has the file open, or left no facts."""
    return logs.join(handles.select("file_id", "host").distinct().withColumn("_open", F.lit(True)), ["file_id", "host"], "left").join(meta.select("file_id", "host").distinct().withColumn("_meta", F.lit(True)), ["file_id", "host"], "left").where("_open is not null or _meta is null").drop("_open", "_meta")


def stat(meta: DataFrame, handles: DataFrame, logs: DataFrame) -> DataFrame:
    """stat_closed with the ends and bytes of rescanned logs (file_id, host, logical_offset, length, end_us)."""
    closed = stat_closed(meta, handles)
    live = rescanned(logs, meta, handles).groupBy("file_id", "host").agg(F.max(F.expr("logical_offset + length")).alias("e"), F.sum("length").alias("b"), F.max(F.expr("end_us div 1000000")).alias("t"))
    again = live.groupBy("file_id").agg(F.max("e").alias("size"), F.sum(F.expr("(b + 511) div 512")).alias("blocks"), F.max("t").alias("mtime_s"))
    return closed.union(again).groupBy("file_id").agg(F.max("size").alias("size"), F.sum("blocks").alias("blocks"), F.max("mtime_s").alias("mtime_s"))


def lazy_size(stored: DataFrame, handles_eof: DataFrame) -> DataFrame:
    """The larger of the stored size and what open handles have written."""
    live = handles_eof.groupBy("file_id").agg(F.max("eof").alias("live"))
    return stored.join(live, "file_id", "left").selectExpr("file_id", "greatest(size, coalesce(live, 0)) as size")


def open_hosts(handles: DataFrame) -> DataFrame:
    return handles.groupBy("file_id").agg(F.countDistinct("host").alias("hosts"), F.count("*").alias("handles"))


def truncate_meta(meta: DataFrame, size: int) -> DataFrame:
    """Facts of files cut to `size`: larger offsets become it, and so do the bytes of their rows."""
    over = F.col("last_offset") > size
    return meta.withColumn("total_bytes", F.when(over, F.lit(size)).otherwise(F.col("total_bytes")).cast("long")).withColumn("last_offset", F.least("last_offset", F.lit(size)).cast("long"))


def meta_names(meta: DataFrame) -> DataFrame:
    return meta.selectExpr("concat_ws('.', last_offset, total_bytes, close_us div 1000000, close_us % 1000000, concat(host, '.site')) as name")


def parse_meta_names(names: DataFrame) -> DataFrame:
    """Facts from names of the form last_offset.total_bytes.sec.usec.host."""
    part = lambda k: scalar.name_part(F.col("name"), scalar.META_NAME, k)
    good = names.where(F.col("name").rlike(scalar.META_NAME))
    return good.select("name", part(1).cast("long").alias("last_offset"), part(2).cast("long").alias("total_bytes"), (part(3).cast("long") * 1_000_000 + part(4).cast("long")).alias("close_us"), part(5).alias("host"))


def parse_open_names(names: DataFrame) -> DataFrame:
    good = names.where(F.col("name").rlike(scalar.OPEN_NAME))
    return good.select("name", scalar.name_part(F.col("name"), scalar.OPEN_NAME, 1).alias("host"), scalar.name_part(F.col("name"), scalar.OPEN_NAME, 2).cast("long").alias("pid"))


def parse_index_names(names: DataFrame) -> DataFrame:
    """(timestamp_us, host, pid, data_name) of index log names."""
    part = lambda k: scalar.name_part(F.col("name"), scalar.INDEX_NAME, k)
    good = names.where(F.col("name").rlike(scalar.INDEX_NAME))
    return good.select("name", (part(1).cast("long") * 1_000_000 + part(2).cast("long")).alias("timestamp_us"), part(3).alias("host"), part(4).cast("long").alias("pid"), F.regexp_replace("name", r"dropping\.index\.", "dropping.data.").alias("data_name"))


def parse_summaries(names: DataFrame) -> DataFrame:
    """Tagged facts of a global summary name, and MiB/s from its own size and times."""
    part = lambda k: scalar.name_part(F.col("name"), scalar.SUMMARY_NAME, k)
    good = names.where(F.col("name").rlike(scalar.SUMMARY_NAME))
    span = F.greatest(part(4).cast("long") - part(3).cast("long"), F.lit(1))
    return good.select(
        part(1).cast("long").alias("size"), part(2).cast("long").alias("bytes"), part(3).cast("long").alias("open_s"), part(4).cast("long").alias("close_s"), part(6).alias("interface"), part(7).cast("int").alias("nproc"),
        part(8).alias("host"), part(9).cast("int").alias("uid"), part(10).alias("path"), (part(1).cast("double") / span / F.lit(1048576.0)).alias("mib_s"),
    )


def container_sizes(files: DataFrame, record_bytes: int = 48) -> DataFrame:
    """Bytes of data and index files (kind, size) of each container, and the records that the index bytes hold."""
    return files.groupBy("file_id").agg(
        F.sum(F.expr("case when kind = 'data' then size else 0 end")).alias("data_bytes"), F.sum(F.expr("case when kind = 'index' then size else 0 end")).alias("index_bytes"), F.sum(F.expr(f"case when kind = 'index' then size div {record_bytes} else 0 end")).alias("records")
    )


def hostdirs(names: DataFrame) -> DataFrame:
    """How many directories hold logs, and which, from parsed log names (file_id, hostdir)."""
    return names.groupBy("file_id").agg(F.countDistinct("hostdir").alias("hostdirs"), F.sort_array(F.collect_set("hostdir")).alias("ids"))


def users(handles: DataFrame) -> DataFrame:
    """Readers, writers and bytes of each file from its handles (file_id, mode, bytes)."""
    return handles.groupBy("file_id").agg(F.count(F.expr("case when mode = 'r' then 1 end")).alias("readers"), F.count(F.expr("case when mode = 'w' then 1 end")).alias("writers"), F.sum("bytes").alias("bytes"))


def resolve_metalinks(links: DataFrame, backends: DataFrame) -> DataFrame:
    """(path, target) of links (path, text): the text's number is how many bytes of the path to strip, the rest names the
    backend (backends: backend) whose path goes in front. Without a
    number nothing is stripped. Other texts, and backends that are not known, give no row."""
    part = lambda k: scalar.name_part(F.col("text"), scalar.METALINK, k)
    parsed = links.where(F.col("text").rlike(scalar.METALINK)).select("path", F.when(part(1) == "", F.lit(0)).otherwise(part(1).try_cast("int")).alias("strip"), part(2).alias("backend"))
    return parsed.join(backends.select("backend").distinct(), "backend").selectExpr("path", "concat(backend, '/', decode(substring(encode(path, 'utf-8'), strip + 1), 'utf-8')) as target")


def under(entries: DataFrame, folders: DataFrame) -> DataFrame:
    """Entries (path, ...) below the folders (folder, ...), with the folder's columns. Joins on each path's own prefixes."""
    parts = F.split("path", "/+")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return entries.where("path like '%/%'").withColumn("folder", F.explode(above)).join(folders.withColumn("folder", F.regexp_replace(F.regexp_replace("folder", "/+", "/"), "(?<=.)/$", "")), "folder")


def collect_contents(entries: DataFrame, links: DataFrame, backends: DataFrame, roots: DataFrame, prefixes: tuple[str, ...] = (), hops: int = 2) -> DataFrame:
    """(root, path): the files (entries: path) below each root folder (roots: root) and below what its metalinks
    (links: path, text) lead to, `hops` links deep; a link to a folder that is not there adds nothing. With prefixes,
    only files whose names pass them."""
    folders = roots.selectExpr("root", "root as folder")
    found, resolved = under(entries, folders), resolve_metalinks(links, backends)
    for _ in range(hops):
        folders = under(resolved, folders).selectExpr("root", "target as folder").distinct()
        found = found.unionByName(under(entries, folders))
    out = found.select("root", "path").distinct()
    return out.where(passes(F.substring_index("path", "/", -1), prefixes)) if prefixes else out


def passes(name: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether a name passes a listing's filters. The last byte of a filter is not compared."""
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(name, F.lit(p[:-1]))
    return out


def writer_droppings(names: DataFrame, pid: int) -> DataFrame:
    """The names (path) of one writer's index and data logs, which a burst transfer moves."""
    name = F.substring_index("path", "/", -1)
    return names.where(passes(name, ("dropping.index.", "dropping.data.")) & (scalar.name_part(name, r"\.(\d+)$", 1) == str(pid)))


def mount_of(paths: DataFrame, mounts: DataFrame) -> DataFrame:
    """(path, mount, backend): the longest mount that a path lies under. Joins on the path's own prefixes, not on pairs."""
    parts = F.split("path", "/")
    prefixes = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("mount"))
    best = prefixes.join(mounts, "mount").groupBy("path").agg(F.max_by(F.struct("mount", "backend"), F.length("mount")).alias("m"))
    return best.select("path", "m.mount", "m.backend")


def list_names(listings: DataFrame, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Distinct names over all backends (dir_id, name); with prefixes, those that pass one of them."""
    kept = listings.where(passes(F.col("name"), prefixes)) if prefixes else listings
    return kept.select("dir_id", "name").distinct()


def xattrs(kept: DataFrame) -> DataFrame:
    """(file_id, attributes): a map of each file's attributes from (file_id, k, v); of several values the greatest."""
    last = kept.groupBy("file_id", "k").agg(F.max("v").alias("v"))
    return last.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("attributes"))
