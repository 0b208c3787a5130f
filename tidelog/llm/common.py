"""Helpers shared by the training-data operators: tables, shared storage, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of bytes that are neither a space nor one of the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Where that is unset, a local folder is made, once a session, if all runs on one machine; on a cluster it is an error,
    since each executor would write to a disk of its own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tidelog-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The session's own folder in the shared one, where written() puts its tables."""
    return f"{shared_dir(spark)}/tidelog/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete all tables that this session has written, once the results that read them are no longer wanted."""
    dropped(spark, run_dir(spark))


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows of df written as a table in the shared folder and read back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table that written() made, through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns with any names can do no harm."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as no column of df has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def maybe_in(df: DataFrame, column: str, keys: DataFrame, flag: str, most_bits: int = 1 << 26) -> DataFrame:
    """df with a boolean column `flag`: false where the column's value surely is not among keys (one column).

    A bit for each hash of a key, in words of 64: at most most_bits / 64 rows of 16 bytes, which is what is broadcast,
    whatever the input. With far more keys than bits it is true everywhere, and only saves nothing.
    """
    key = keys.columns[0]
    bits = min(most_bits, 1 << max(16, int(16 * keys.count()).bit_length()))
    word, place, mask = unused(df, "_word"), unused(df, "_place"), unused(df, "_mask")
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    marks = keys.select(at(F.col(f"`{key}`")).alias("h")).groupBy(F.floor(F.col("h") / F.lit(64)).cast("long").alias(word)).agg(F.expr("bit_or(shiftleft(1L, cast(h % 64 as int)))").alias(mask))
    hashed = df.withColumn(place, at(F.col(f"`{column}`"))).withColumn(word, F.floor(F.col(place) / F.lit(64)).cast("long"))
    found = hashed.join(F.broadcast(marks), word, "left")
    return found.withColumn(flag, F.coalesce(F.getbit(F.col(mask), (F.col(place) % 64).cast("int")) == 1, F.lit(False))).drop(word, place, mask)


def batches_by_bytes(batches: Iterator[pd.DataFrame], column: str, most: int = 2 << 20) -> Iterator[pd.DataFrame]:
    """The same rows in frames of about `most` bytes of the column (of strings or bytes), one row at least."""
    for pdf in batches:
        sizes = pdf[column].map(lambda x: 1 + (len(x) if x is not None and x == x else 0)).to_numpy(np.int64)
        if not len(sizes):
            continue
        part = (np.cumsum(sizes) - sizes) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
            yield pdf.iloc[lo:hi]


def sliced(batch: pa.RecordBatch, at: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `most` bytes of the column at that place, one row at least."""
    sizes = np.array([len(x) if x else 1 for x in batch.column(at).to_pylist()], np.int64)
    if not len(sizes):
        return
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True):
        yield batch.slice(lo, hi - lo)


def utf8(x: object) -> bytes:
    """A text as bytes; null is empty."""
    return x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b""


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept for the last size."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64)))) for b in (_BASE, _INVERSE))
    return _POWERS[size]


class Hashes:
    """Hashes of any stretch of a byte array, equal for equal stretches."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _powers(len(data))
        self.run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * up[: len(data)], dtype=np.uint64, out=self.run[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.run[stop] - self.run[start]) * self.down[start]

    def grams(self, size: int) -> np.ndarray:
        """A scrambled hash of every stretch of that size."""
        n = len(self.run) - size
        h = (self.run[size:] - self.run[:n]) * self.down[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h


class Forest:
    """Union-find over hashable values; the root of a tree is its least value."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up, top = self.up, x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up.setdefault(a, a)
        self.up[b] = a
        return True


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable over undirected edges (a, b), for every node that an edge names.

    Alternating large-star and small-star rounds. Each round's edges are written to the shared folder, so that
    lineage stays short and a lost executor costs that round only. Stars replace cliques: the edge count never grows
    beyond the input's. Least neighbours are aggregated map-side and written too, so that the join of a node's edges with
    its least neighbour is one of two shuffles alone, which adaptive execution splits where a hub is hot.
    """
    spark, paths = edges.sparkSession, []

    def star(e: DataFrame, small: bool) -> DataFrame:
        """Each node's larger (large-star) or smaller neighbours and itself (small-star) hang on its least neighbour."""
        way = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        if not small:
            way = way.union(way.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, path = written(way.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        paths.append(path)
        hung = way.join(least, "u")
        if small:
            out = hung.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.where("u != m").select(F.col("u").alias("a"), F.col("m").alias("b")))
        else:
            out = hung.where("v > u and v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.distinct()

    now, path = written(only(edges, a, b).toDF("a", "b").where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes, _ = written(now.select("a").union(now.select("b")).distinct().toDF("node"))
    mark = None
    while True:
        nxt, new_path = written(star(star(now, False), True))
        seen = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        for old in (path, *paths):
            dropped(spark, old)
        now, path = nxt, new_path
        paths.clear()
        if mark == (seen["n"], seen["h"]):
            break
        mark = (seen["n"], seen["h"])
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("least")), "node", "left").select("node", F.coalesce("least", "node").alias("component"))


def hex_fraction(key: Column) -> Column:
    """A number inside (0, 1) that the md5 of a string decides."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
