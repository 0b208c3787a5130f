"""Name logs replayed into current state, and small-file extents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.extents import TILE, joined, stab_lookup, swept

# Operations of the name log.
CREATE, DELETE, OPEN, RENAME, UTIME = 1, 2, 3, 4, 5


def merged(log: DataFrame) -> DataFrame:
    """Records of all logs in time order; ties by log, then record."""
    return log.orderBy("ts_us", "did", "seq")


def replay_simple(log: DataFrame) -> DataFrame:
    """Names that stand after creates and deletes alone: those whose last such record is a create."""
    last = log.where(f"op in ({CREATE}, {DELETE})").groupBy("dir_id", "name").agg(F.max(F.struct("ts_us", "did", "seq", "op")).alias("l"))
    return last.where(f"l.op = {CREATE}").select("dir_id", "name", F.col("l.ts_us").alias("created_us"))


def rename_groups(log: DataFrame, rounds: int = 3) -> DataFrame:
    """(dir_id, name, root, chained): for each name in a rename, the least name within `rounds` renames of it.

    Names that renames connect have one root, unless some are further apart: all of these are marked as chained.
    """
    renamed = log.where(f"op = {RENAME}").select("dir_id", F.col("name").alias("a"), F.col("name_to").alias("b")).distinct()
    way = renamed.selectExpr("dir_id", "inline(array(struct(a as u, b as v), struct(b as u, a as v), struct(a as u, a as v), struct(b as u, b as v)))")
    roots = way.groupBy("dir_id", "u").agg(F.min("v").alias("root"))
    for _ in range(rounds - 1):
        roots = way.join(roots.withColumnRenamed("u", "v"), ["dir_id", "v"]).groupBy("dir_id", "u").agg(F.min("root").alias("root"))
    both = way.join(roots, ["dir_id", "u"]).join(roots.selectExpr("dir_id", "u as v", "root as other"), ["dir_id", "v"])
    parted = both.where("root <> other").select("dir_id", "root").distinct().withColumn("chained", F.lit(True))
    return roots.join(parted, ["dir_id", "root"], "left").selectExpr("dir_id", "u as name", "root", "coalesce(chained, false) as chained")


def replay(log: DataFrame, records: int = 1 << 16) -> DataFrame:
    """(dir_id, name, mtime_us, opens): the names that stand after all records, each with its (fid, did) pairs.

    Records act in the order (ts_us, did, seq): CREATE adds an absent name; OPEN adds a (rec_off, did) pair and sets the
    time; UTIME sets it; DELETE takes a name away; RENAME moves a row over any row at its target. Records of absent names
    do nothing. Renames tie names, so a fold is needed: names that few renames connect fold together, in groups of about
    `records` records over all directories; those of longer chains fold in one group a directory.
    """
    count = log.groupBy().agg(F.expr(f"1 + count(*) div {records}").alias("_parts"))  # one row
    tied = log.join(rename_groups(log), ["dir_id", "name"], "left").crossJoin(F.broadcast(count))
    grouped = tied.withColumn("_part", F.expr("case when chained then concat('d', dir_id) else concat('n', pmod(xxhash64(dir_id, coalesce(root, name)), _parts)) end"))
    schema = f"dir_id {log.schema['dir_id'].dataType.simpleString()}, name string, mtime_us long, opens array<struct<fid:long,did:long>>"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: dict[tuple, list] = {}
        pdf = pdf.sort_values(["ts_us", "did", "seq"], kind="stable")
        for op, folder, name, target, ts, fid, did in zip(*(pdf[c] for c in ("op", "dir_id", "name", "name_to", "ts_us", "rec_off", "did")), strict=True):
            own = folder, name
            if op == CREATE:
                rows.setdefault(own, [ts, []])
            elif own not in rows:
                continue
            elif op == OPEN:
                rows[own][0] = ts
                rows[own][1].append({"fid": fid, "did": did})
            elif op == UTIME:
                rows[own][0] = ts
            elif op == DELETE:
                del rows[own]
            elif op == RENAME:
                rows[folder, target] = rows.pop(own)
        return pd.DataFrame([(*own, t, o) for own, (t, o) in rows.items()], columns=["dir_id", "name", "mtime_us", "opens"])

    return grouped.select("_part", "op", "dir_id", "name", "name_to", "ts_us", "rec_off", "did", "seq").groupBy("_part").applyInPandas(fold, schema)


def index_of_names(current: DataFrame, index: DataFrame) -> DataFrame:
    """Small-index records of the files that current names point at, by (dir_id, did, fid), with the name."""
    pairs = current.select("dir_id", "name", F.explode("opens").alias("o")).select("dir_id", "name", F.col("o.fid").alias("fid"), F.col("o.did").alias("did"))
    return index.join(pairs, ["dir_id", "did", "fid"])


def cuts(index: DataFrame, key: str = "fid") -> DataFrame:
    """Writes with the least offset that a later truncate of their file cut at (null: none), and the truncates so too.

    Windows are over some 70 minutes of a file; a small table of each such bucket's least cut carries back in time.
    """
    cut = "case when physical_offset = -1 then off end"
    marked = index.withColumn("_b", F.shiftright("ts_us", 32))
    least = marked.groupBy(key, "_b").agg(F.min(F.expr(cut)).alias("m"))
    later = least.selectExpr(f"{key} as _k", "_b as _kb", f"min(m) over (partition by {key} order by _b desc rows between unbounded preceding and 1 preceding) as _later")
    # newest first, so that the frame grows with the rows instead of being scanned anew for each
    inner = marked.selectExpr("*", f"min({cut}) over (partition by {key}, _b order by ts_us desc, did desc, seq desc rows between unbounded preceding and 1 preceding) as _own")
    both = inner.join(later, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_kb")))
    return both.withColumn("later_cut", F.least("_own", "_later")).drop("_b", "_k", "_kb", "_own", "_later")


def truncate_clip(index: DataFrame) -> DataFrame:
    """Writes cut to what later truncates leave of them; nothing left, no row."""
    return cuts(index).where("physical_offset <> -1 and length > 0").selectExpr("*", "least(off + length, coalesce(later_cut, off + length)) - off as kept").where("kept > 0").drop("length", "later_cut").withColumnRenamed("kept", "length")


def small_extents(index: DataFrame, tile: int = TILE) -> DataFrame:
    """Newest-wins map of small files: (fid, off, length, did, seq, physical_offset), time order, truncates applied."""
    recent = ("ts_us", "did", "seq")
    spans = truncate_clip(index).selectExpr("fid", "off as lo", "off + length as hi", "off as base", "physical_offset", *recent)
    whole = joined(swept(spans, "fid", recent, tile), "fid", recent, ("did", "seq"))
    return whole.selectExpr("fid", "lo as off", "hi - lo as length", "did", "seq", "physical_offset + lo - base as physical_offset")


def small_size(index: DataFrame) -> DataFrame:
    """File sizes: the furthest end of what is left of writes, or truncate that no later one went below."""
    seen = cuts(index)
    ends = seen.selectExpr(
        "fid", "case when physical_offset = -1 then case when later_cut is null or later_cut >= off then off end when length > 0 and least(off + length, coalesce(later_cut, off + length)) > off then least(off + length, coalesce(later_cut, off + length)) end as e"
    )
    return ends.groupBy("fid").agg(F.coalesce(F.max("e"), F.lit(0)).cast("long").alias("size"))


def small_lookup(index: DataFrame, probes: DataFrame) -> DataFrame:
    """What holds the byte at each probe (probe_id, fid, off): (probe_id, fid, off, did, physical_offset, length).

    The newest write over it and how far its data goes on; in a hole did and physical_offset are -1 and length leads to
    the next data or, behind the last data, to the end of file; from the end of file on length is 0. Truncates count by
    what they leave, never as data.
    """
    held = small_extents(index).selectExpr("fid as file_id", "off as logical_offset", "length", "did as pid", "physical_offset")
    ends = small_size(index).join(held.groupBy(F.col("file_id").alias("fid")).agg(F.sum("length").alias("b")), "fid", "left").selectExpr("fid as file_id", "size as eof", "coalesce(b, 0L) as backing_bytes")
    found = stab_lookup(held, probes.selectExpr("probe_id", "fid as file_id", "off as offset"), stats=ends)
    return found.selectExpr("probe_id", "file_id as fid", "offset as off", "coalesce(pid, -1L) as did", "coalesce(chunk_offset, -1L) as physical_offset", "coalesce(run, 0L) as length")
