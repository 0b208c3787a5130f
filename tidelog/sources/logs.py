"""Readers and writers of log files: fixed binary records, name records, text traces, flattened maps."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.scalar import INDEX_NAME
from tidelog.operators import trace as traces
from tidelog.operators.extents import contiguous_writes, resolve
from tidelog.operators.names import RENAME
from tidelog.operators.stat import writer_droppings

# Layouts of records on disk, little-endian.
WRITE_RECORD = np.dtype([("logical_offset", "<i8"), ("physical_offset", "<i8"), ("length", "<i8"), ("begin", "<f8"), ("end", "<f8"), ("pid", "<i4"), ("pad", "<i4")])
SMALL_RECORD = np.dtype([("fid", "<i8"), ("off", "<i8"), ("length", "<i8"), ("ts", "<i8"), ("physical_offset", "<i8")])
NAME_HEADER = np.dtype([("length", "<u4"), ("op", "<u4"), ("ts", "<i8")])
TRACE_FIELDS = ("id", "io", "offset", "length", "begin", "end", "tail")
TRACE_KINDS = ("long", "string", "long", "long", "double", "double", "long")
TRIPLES = {"q": np.dtype([("id", "<i8"), ("beg", "<i8"), ("end", "<i8")]), "d": np.dtype([("id", "<f8"), ("beg", "<f8"), ("end", "<f8")])}
SECTION_MARK = "#" * 26
SECTIONS = ("head", "bandwidth", "running", "finished", "sizes")

SPLIT_OVER, SPLIT_BYTES = 1 << 28, 1 << 27  # bytes of a file read in splits, and of a split
GLOB = re.compile(r"([\\*?\[\]{}])")


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, content) of the files under a folder whose names match; a folder that is gone is left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("ignoreMissingFiles", "true")
    return reader.load(path).select("path", "content")


def fixed_records(spark: SparkSession, path: str, pattern: str, layout: np.dtype, large: int = SPLIT_OVER, split: int = SPLIT_BYTES) -> DataFrame:
    """(path, at, content): the files under a folder in pieces, at being the number of a piece's first record.

    Smaller files come whole, many to a task. Files of `large` bytes or more are read in splits, a record a row, if they
    hold whole records only and no comma or pattern sign is in their path; others come whole, which fails above 2 GB.
    The driver lists large files alone: their number is bounded by the bytes there are.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("ignoreMissingFiles", "true")
    listed, size = reader.load(path), layout.itemsize
    parts, cut = [listed.where(F.col("length") < large)], []
    rest = []
    for row in listed.where(F.col("length") >= large).select("path", "length").toLocalIterator():
        plain = row["length"] % size == 0 and "," not in row["path"] and not GLOB.search(row["path"])
        (cut if plain else rest).append(row["path"])
    if rest:
        parts.append(spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load([GLOB.sub(r"\\\1", p) for p in rest]))
    out = None
    for part in parts:
        own = part.select("path", F.lit(0).cast("long").alias("at"), "content")
        out = own if out is None else out.unionByName(own)
    if cut:
        jvm = spark.sparkContext._jvm
        conf = jvm.org.apache.hadoop.conf.Configuration(spark.sparkContext._jsc.hadoopConfiguration())
        conf.set("mapreduce.input.fileinputformat.split.maxsize", str(split))
        made = spark.sparkContext._jsc.sc().binaryRecords(",".join(cut), size, conf)
        rows = DataFrame(spark._jsparkSession.createDataset(made, jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)
        # a task reads one split, which begins at a record
        within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        first = F.expr(f"input_file_block_start() div {size}")
        out = out.unionByName(rows.select(F.input_file_name().alias("path"), (first + within).alias("at"), F.col("value").alias("content")))
    return out


def unpacked(pdf: pd.DataFrame, layout: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paths, numbers and records of pieces of fixed_records; a partial last record is left out."""
    counts = pdf["content"].map(len).to_numpy(np.int64) // layout.itemsize
    records = np.frombuffer(b"".join(c[: n * layout.itemsize] for c, n in zip(pdf["content"], counts, strict=True)), layout)
    shift = pdf["at"].to_numpy(np.int64) - (np.cumsum(counts) - counts)
    return np.repeat(pdf["path"].to_numpy(), counts), np.arange(len(records)) + np.repeat(shift, counts), records


def read_write_logs(spark: SparkSession, path: str, pattern: str = "dropping.index.*", large: int = SPLIT_OVER, split: int = SPLIT_BYTES) -> DataFrame:
    """Write records of index logs, with their host, and seq: the record's place in its log. A partial last record is
    left out. Logs of `large` bytes or more are read in splits."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            paths, at, r = unpacked(pdf, WRITE_RECORD)
            yield pd.DataFrame(
                {"path": paths, "pid": r["pid"].astype(np.int64), "seq": at, "logical_offset": r["logical_offset"], "physical_offset": r["physical_offset"], "length": r["length"],
                 "begin_us": np.rint(r["begin"] * 1e6).astype(np.int64), "end_us": np.rint(r["end"] * 1e6).astype(np.int64)}
            )

    pieces = fixed_records(spark, path, pattern, WRITE_RECORD, large, split)
    rows = pieces.mapInPandas(decode, "path string, pid long, seq long, logical_offset long, physical_offset long, length long, begin_us long, end_us long")
    return rows.withColumn("host", F.regexp_extract("path", INDEX_NAME, 3)).withColumn("file_id", F.regexp_extract("path", r"([^/]+)/[^/]+/dropping\.index\.[^/]+$", 1))


def encode_write_log(rows: list[tuple[int, int, int, float, float, int]]) -> bytes:
    """Records (logical, physical, length, begin, end, pid) as an index log's bytes."""
    out = np.zeros(len(rows), WRITE_RECORD)
    for k, row in enumerate(rows):
        out[k] = (*row, 0)
    return out.tobytes()


def encode_small_log(rows: list[tuple[int, int, int, int, int]]) -> bytes:
    """Records (fid, off, length, micros, physical_offset) as a small-file index log's bytes. A truncate has length 0
    and physical offset -1."""
    out = np.zeros(len(rows), SMALL_RECORD)
    for k, (fid, off, length, micros, physical) in enumerate(rows):
        out[k] = (fid, off, length, (micros // 1_000_000 << 32) + micros % 1_000_000, physical)
    return out.tobytes()


def read_small_logs(spark: SparkSession, path: str, pattern: str = "dropping.small.*", fids: tuple[int, ...] | None = None, large: int = SPLIT_OVER, split: int = SPLIT_BYTES) -> DataFrame:
    """Small-file records with did, the number at the end of their log's name; ts is packed seconds and microseconds.
    With fids, records of other files are skipped while logs are decoded; seq counts them all. Logs of `large` bytes or
    more are read in splits."""
    wanted = None if fids is None else np.array(fids, np.int64)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            paths, at, r = unpacked(pdf, SMALL_RECORD)
            keep = slice(None) if wanted is None else np.isin(r["fid"], wanted)
            yield pd.DataFrame({"path": paths[keep], "seq": at[keep], **{c: r[c][keep] for c in SMALL_RECORD.names}})

    rows = fixed_records(spark, path, pattern, SMALL_RECORD, large, split).mapInPandas(decode, "path string, seq long, fid long, off long, length long, ts long, physical_offset long")
    return rows.withColumn("did", F.regexp_extract("path", r"(\d+)$", 1).cast("long")).withColumn("ts_us", F.shiftright("ts", 32) * 1_000_000 + F.col("ts").bitwiseAND(F.lit(0xFFFFFFFF))).drop("ts")


def read_name_logs(spark: SparkSession, path: str, pattern: str = "dropping.name.*") -> DataFrame:
    """Name records: rec_off is a record's place in bytes, did its log's number, name_to a rename's target (null if the
    record has none)."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                at = 0
                while at + NAME_HEADER.itemsize <= len(content):
                    head = np.frombuffer(content, NAME_HEADER, 1, at)[0]
                    size = int(head["length"])
                    if size < NAME_HEADER.itemsize or at + size > len(content):
                        break
                    texts = [t.decode("utf-8", "replace") for t in bytes(content[at + NAME_HEADER.itemsize : at + size]).split(b"\0")]
                    target = texts[1] if int(head["op"]) == RENAME and len(texts) > 1 else ""
                    rows.append((name, at, int(head["op"]), int(head["ts"]), texts[0], target or None))
                    at += size
            yield pd.DataFrame(rows, columns=["path", "rec_off", "op", "ts", "name", "name_to"])

    rows = files(spark, path, pattern).mapInPandas(decode, "path string, rec_off long, op int, ts long, name string, name_to string")
    return rows.withColumn("did", F.regexp_extract("path", r"(\d+)$", 1).cast("long")).withColumn("seq", F.col("rec_off")).withColumn("ts_us", F.shiftright("ts", 32) * 1_000_000 + F.col("ts").bitwiseAND(F.lit(0xFFFFFFFF))).drop("ts")


def encode_name(op: int, micros: int, *names: str) -> bytes:
    """One name record, padded to 4 bytes."""
    body = b"".join(n.encode() + b"\0" for n in names)
    body += b"\0" * (-len(body) % 4)
    head = np.zeros(1, NAME_HEADER)
    head[0] = (NAME_HEADER.itemsize + len(body), op, (micros // 1_000_000 << 32) + micros % 1_000_000)
    return head.tobytes() + body


def _trace_rows(lines: DataFrame, most: int) -> DataFrame:
    """Rows of seven fields, or up to `most` of which the first seven count; any other form fails the read."""
    cut = lines.withColumn("f", F.split(F.trim("value"), r"\s+"))
    good = F.when(F.size("f").between(len(TRACE_FIELDS), most), F.col("f")).otherwise(F.raise_error(F.concat(F.lit("not seven fields: "), F.col("value"))))
    parts = cut.withColumn("f", good)
    return parts.select(*[F.col(c) for c in lines.columns if c != "value"], *[F.col("f")[k].cast(t).alias(n) for k, (n, t) in enumerate(zip(TRACE_FIELDS, TRACE_KINDS, strict=True))])


def read_text_trace(spark: SparkSession, path: str) -> DataFrame:
    """Trace rows of text files: lines of seven fields; # starts a comment line, and any other form fails the read."""
    return _trace_rows(spark.read.text(path).where("trim(value) <> '' and not ltrim(value) like '#%'"), len(TRACE_FIELDS))


def read_serial_trace(spark: SparkSession, path: str) -> DataFrame:
    """Trace rows of dumps with a header section, with the writer's pid.

    The header's lines name the slot and the data log of each writer ("# slot path", the path ends in the pid); a line
    of column names ends it. Rows give the slot as id. A slot that the header does not name has a null pid.
    """
    lines = spark.read.text(path).withColumn("file", F.input_file_name()).where("trim(value) <> ''")
    cut = F.split(F.trim("value"), r"\s+")
    slots = lines.where(F.col("value").startswith("#") & F.col("value").contains("data") & (F.size(cut) >= 3)).select(F.col("file").alias("f"), cut[1].cast("long").alias("slot"), F.regexp_extract(cut[2], r"(\d*)$", 1).cast("long").alias("pid"))
    rows = _trace_rows(lines.where(~F.col("value").startswith("#") & ~F.ltrim("value").startswith("ID ")), len(TRACE_FIELDS) + 1)
    return rows.join(slots.distinct(), (F.col("file") == F.col("f")) & (F.col("id") == F.col("slot")), "left").drop("file", "f", "slot")


def write_report(trace: DataFrame, path: str, bins: int = traces.BINS) -> None:
    """The report of a trace as one text: sections between marks, a value a line, of bounded size whatever the trace."""
    order = F.when(F.col("section") == "head", 0)
    for k, name in enumerate(SECTIONS[1:], 1):
        order = order.when(F.col("section") == name, k)
    real = F.col("section").isin("head", "bandwidth")
    value = F.when(real, F.format_string("%.6f", "value")).otherwise(F.col("value").cast("long").cast("string"))
    head = F.when(F.col("idx").isin(0, 4, 5), F.col("value").cast("long").cast("string")).otherwise(value)
    own = traces.report(trace, bins).select(order.alias("k"), "idx", F.when(F.col("section") == "head", head).otherwise(value).alias("v"))
    whole = own.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("v")).select("k", F.expr("array_join(v.v, case when k = 0 then ' ' else '\\n' end)").alias("v"))
    text = whole.agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("v")).select(F.array_join("v.v", f"\n{SECTION_MARK}\n").alias("value"))
    text.coalesce(1).write.text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(section, idx, value) of a report's text, as trace.report() has them."""
    parts = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", f"{SECTION_MARK}\n")).alias("k", "v"))
    cells = parts.select("k", F.posexplode(F.filter(F.split(F.trim("v"), r"\s+"), lambda x: x != "")).alias("idx", "value"))
    return cells.select(F.element_at(F.array(*[F.lit(n) for n in SECTIONS]), F.col("k") + 1).alias("section"), "idx", F.col("value").cast("double").alias("value"))


def bin_starts(report: DataFrame) -> DataFrame:
    """(idx, start_s): when each bin of a report starts, in seconds after the first begin."""
    head = report.where("section = 'head'").groupBy().agg(F.max(F.expr("case when idx = 3 then value end")).alias("width"))  # one row
    return report.where("section = 'bandwidth'").crossJoin(F.broadcast(head)).selectExpr("idx", "idx * width as start_s")


def encode_triples(rows: list[tuple], kind: str = "q") -> bytes:
    """Triples (id, beg, end) of longs (q) or doubles (d) as a binary file's bytes."""
    out = np.zeros(len(rows), TRIPLES[kind])
    for k, row in enumerate(rows):
        out[k] = row
    return out.tobytes()


def read_triples(spark: SparkSession, path: str, kind: str = "q", pattern: str = "*") -> DataFrame:
    """(id, beg, end) of binary files of 24-byte records; records of zeros alone are places never written."""
    layout, column = TRIPLES[kind], "long" if kind == "q" else "double"

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            r = unpacked(pdf, layout)[2]
            r = r[(r["id"] != 0) | (r["beg"] != 0) | (r["end"] != 0)]
            yield pd.DataFrame({c: r[c] for c in layout.names})

    return fixed_records(spark, path, pattern, layout).mapInPandas(decode, ", ".join(f"{c} {column}" for c in layout.names))


def transfer(spark: SparkSession, source: str, target: str, pid: int) -> list[str]:
    """Copy one writer's index and data logs from a burst store's folder to another, and say which. The files of one
    writer are few; their bytes go from store to store through Hadoop's file systems."""
    names = writer_droppings(files(spark, source, "*").select("path"), pid)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    made, place = [], jvm.org.apache.hadoop.fs.Path
    root = place(source).getFileSystem(conf).makeQualified(place(source)).toUri().getPath()
    for row in names.toLocalIterator():
        own = place(row["path"])
        out = place(f"{target}/{own.toUri().getPath()[len(root) :].lstrip('/')}")
        jvm.org.apache.hadoop.fs.FileUtil.copy(own.getFileSystem(conf), own, out.getFileSystem(conf), out, False, True, conf)
        made.append(out.toUri().getPath())
    return sorted(made)


def append_log(log: DataFrame, path: str, extend: bool = False) -> None:
    """Append write records as Parquet; with extend, records that go on where their writer's last one ended are one."""
    if extend:
        keep = log.groupBy("file_id", "pid", "logical_offset", "begin_us").agg(F.min("seq").alias("seq"))
        log = contiguous_writes(log).drop("records").join(keep, ["file_id", "pid", "logical_offset", "begin_us"]).select(*log.columns)
    log.write.mode("append").parquet(path)


def flatten(log: DataFrame, path: str) -> None:
    """Write a log's newest-wins map, by file; readers then need no logs."""
    resolve(log).repartition("file_id", (F.col("logical_offset") / F.lit(1 << 30)).cast("long")).sortWithinPartitions("file_id", "logical_offset").write.mode("overwrite").parquet(path)


def populated(spark: SparkSession, flat: str, log: DataFrame) -> DataFrame:
    """The flattened map if it is there, else that of the logs."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(flat)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.parquet(flat) if there else resolve(log)
