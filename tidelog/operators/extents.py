"""Extents: resolution of overlapping write records, queries over the result, truncation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ranks import prefix_sum, prefix_sums, runs
from tidelog.operators.sweep import folded, thinned
from tidelog.shipping import ship

#: Bytes of a tile: records meet only inside tiles of a file.
TILE = 1 << 18
#: Levels of cells, as powers of two: an extent lies in cells of the least level that is not shorter than it.
LEVELS = (12, 16, 20, 24, 28, 32)
#: Newest first: later end, then later begin, then higher writer, then later record.
RECENT = ("end_us", "begin_us", "pid", "seq")


def physical_offsets(log: DataFrame) -> DataFrame:
    """log with the bytes that its writer wrote before each record."""
    return prefix_sum(log.withColumn("_run", F.floor(F.col("seq") / F.lit(1 << 16))), ["file_id", "pid"], "_run", ["seq"], "length", "physical_offset").drop("_run")


def tiled(df: DataFrame, lo: str = "lo", hi: str = "hi", tile: int = TILE) -> DataFrame:
    """df with a row for each tile that [lo, hi) meets, lo and hi cut to the tile."""
    first, last = F.floor(F.col(lo) / F.lit(tile)), F.floor((F.col(hi) - 1) / F.lit(tile))
    cut = df.withColumn("tile", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return cut.withColumn(lo, F.greatest(F.col(lo), F.col("tile") * F.lit(tile))).withColumn(hi, F.least(F.col(hi), (F.col("tile") + 1) * F.lit(tile)))


def islands(df: DataFrame, keys: list[str], follows: str, order: str = "lo") -> DataFrame:
    """df with island: a number that rises, within keys and by order, wherever `follows` (of the row before) fails.
    The window is over one record's pieces or one probe's finds; ranks.runs is for groups that grow."""
    part = f"(partition by {', '.join(keys)} order by {order})"
    marked = df.selectExpr("*", f"case when {follows.format(w=part)} then 0 else 1 end as _new")
    return marked.selectExpr("*", f"sum(_new) over (partition by {', '.join(keys)} order by {order} rows between unbounded preceding and current row) as island").drop("_new")


def settled(parts: DataFrame, key: str, recent: tuple[str, ...]) -> DataFrame:
    """The stretches that each of the parts (key, tile, lo, hi, base, physical_offset, recency columns) owns in its tile.
    One shuffle by (key, tile), after batches are reduced where many records share a tile."""
    ship(parts.sparkSession)
    keys, order = [key, "tile"], (*recent, "base", "physical_offset")
    few = parts.mapInPandas(thinned(keys, order), parts.schema)
    return few.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(folded(keys, order), parts.schema)


def swept(spans: DataFrame, key: str, recent: tuple[str, ...], tile: int = TILE) -> DataFrame:
    """The stretches that each of the spans (key, lo, hi, ...) owns, cut at tiles, with the tile."""
    return settled(tiled(spans, tile=tile), key, recent)


def joined(pieces: DataFrame, key: str, recent: tuple[str, ...], record: tuple[str, ...]) -> DataFrame:
    """Pieces of one record that touch put together, by a window over that record alone: (key, lo, hi, ...)."""
    ran = islands(pieces, [key, *record], "lag(hi) over {w} = lo")
    return ran.groupBy(key, *recent, "island", "base", "physical_offset").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def spans_of(log: DataFrame) -> DataFrame:
    return log.where("length > 0").selectExpr("file_id", "logical_offset as lo", "logical_offset + length as hi", "logical_offset as base", "physical_offset", *RECENT)


def mapped(whole: DataFrame) -> DataFrame:
    """Joined pieces in the columns of a map."""
    return whole.selectExpr("file_id", "lo as logical_offset", "hi - lo as length", "pid", "seq", "physical_offset + lo - base as physical_offset", "begin_us", "end_us")


def resolve(log: DataFrame, tile: int = TILE) -> DataFrame:
    """The newest-wins map of a write log: pieces of records that no newer record covers, each as long as it can be.

    Columns file_id, logical_offset, length, pid, seq, physical_offset, begin_us, end_us. Zero-length records count for
    the end of file only and own nothing. Tiles are swept in n log n steps however many records share one.
    """
    return mapped(joined(swept(spans_of(log), "file_id", RECENT, tile), "file_id", RECENT, ("pid", "seq")))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The map of two logs together."""
    return resolve(a.unionByName(b))


def neighbours(df: DataFrame, tile: int = TILE) -> DataFrame:
    """Non-overlapping extents with next_offset, the start of the file's next extent, and prev_end, the end of the last.

    Windows run inside tiles; a small table of each tile's first start and last end carries over between tiles.
    """
    keyed = df.withColumn("tile", F.floor(F.col("logical_offset") / F.lit(tile)).cast("long"))
    ends = keyed.groupBy("file_id", "tile").agg(F.min("logical_offset").alias("first"), F.max(F.struct("logical_offset", F.expr("logical_offset + length"))).alias("last"))
    around = ends.selectExpr("file_id as f", "tile as t", "lead(first) over (partition by file_id order by tile) as after", "lag(last.col2) over (partition by file_id order by tile) as before")
    w = "(partition by file_id, tile order by logical_offset, length)"
    inner = keyed.selectExpr("*", f"lead(logical_offset) over {w} as n", f"lag(logical_offset + length) over {w} as p")
    joined = inner.join(around, (F.col("file_id") == F.col("f")) & (F.col("tile") == F.col("t")))
    return joined.selectExpr(*[f"`{c}`" for c in df.columns], "coalesce(n, after) as next_offset", "coalesce(p, before) as prev_end")


def holes(extents: DataFrame) -> DataFrame:
    """(file_id, hole_offset, hole_length): gaps between extents, and before a file's first."""
    return completed(extents).where("hole").selectExpr("file_id", "logical_offset as hole_offset", "length as hole_length")


def coalesce(extents: DataFrame) -> DataFrame:
    """Extents joined where one follows another in the file and in its writer's data.

    A chain is the run of pieces of one writer with the same distance between file and data; windows are over 64 MB of a
    chain, and small tables carry over.
    """
    chains = extents.selectExpr("*", "logical_offset - physical_offset as _d", f"logical_offset div {1 << 26} as _b")
    ran = runs(chains, ["file_id", "pid", "_d"], "_b", ["logical_offset"], {"_stop": "logical_offset + length"}, "_stop = logical_offset")
    return ran.groupBy("file_id", "pid", "_d", "island").agg(
        F.min("logical_offset").alias("logical_offset"), F.sum("length").alias("length"), F.min("physical_offset").alias("physical_offset"), F.min("begin_us").alias("begin_us"), F.max("end_us").alias("end_us"), F.count("*").alias("pieces")
    ).drop("_d", "island")


def contiguous_writes(log: DataFrame) -> DataFrame:
    """Write-time extension: a writer's record that starts where its last one ended prolongs it, whatever its data."""
    cut = log.withColumn("_b", F.expr("seq div 65536"))
    ran = runs(cut, ["file_id", "pid"], "_b", ["seq"], {"_stop": "logical_offset + length"}, "_stop = logical_offset")
    return ran.groupBy("file_id", "pid", "island").agg(
        F.min("logical_offset").alias("logical_offset"), F.sum("length").alias("length"), F.min("physical_offset").alias("physical_offset"), F.min("begin_us").alias("begin_us"), F.max("end_us").alias("end_us"), F.count("*").alias("records")
    ).drop("island")


def file_stats(log: DataFrame) -> DataFrame:
    """End of file (empty records count) and bytes written (overwritten ones too) for each file."""
    return log.groupBy("file_id").agg(F.max(F.expr("logical_offset + length")).alias("eof"), F.sum("length").alias("backing_bytes"), F.count("*").alias("records"))


def completed(extents: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Extents with holes as rows (hole true), up to the end of file if file_stats() are given. One pass over extents."""
    near = neighbours(extents)
    if stats is not None:
        near = near.join(stats.select("file_id", "eof"), "file_id", "left").withColumn("next_offset", F.coalesce("next_offset", "eof"))
    data = "named_struct('hole', false, 'logical_offset', logical_offset, 'length', length, 'pid', pid, 'physical_offset', physical_offset)"
    gap = "named_struct('hole', true, 'logical_offset', {}, 'length', {}, 'pid', cast(null as bigint), 'physical_offset', cast(null as bigint))"
    after = gap.format("logical_offset + length", "coalesce(next_offset - logical_offset - length, 0L)")
    first = gap.format("0L", "case when prev_end is null then logical_offset else 0L end")
    rows = near.selectExpr("file_id", f"explode(filter(array({data}, {after}, {first}), x -> x.length > 0)) as x").select("file_id", "x.*")
    if stats is None:
        return rows
    empty = stats.where("backing_bytes = 0 and eof > 0")
    return rows.union(empty.selectExpr("file_id", "true", "0L", "eof", "cast(null as bigint)", "cast(null as bigint)"))


def celled(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """df with a row for each cell (level, cell) that [lo, hi) lies in: cells of the level of its length, two at most."""
    level = f"case {' '.join(f'when {hi} - {lo} <= {1 << k}L then {k}' for k in LEVELS[:-1])} else {LEVELS[-1]} end"
    return df.selectExpr("*", f"{level} as level").selectExpr("*", f"explode(sequence(shiftright({lo}, level), shiftright({hi} - 1, level))) as cell")


def range_query(extents: DataFrame, probes: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """What each probe (probe_id, file_id, offset, length) reads: records in order, holes included, up to the end of
    file if file_stats() are given.

    Columns probe_id, file_id, hole, logical_offset, length, pid, chunk_offset, last_record. Extents with holes lie in
    cells of about their own length, and a probe asks the cells of every level that it meets. Extents do not overlap, so
    few of them share a cell, and a probe is compared with little more than it finds; a find counts in the first cell
    that both are in.
    """
    cells = celled(completed(extents, stats).selectExpr("*", "logical_offset as lo", "logical_offset + length as hi"), "lo", "hi")
    asked = probes.where("length > 0").selectExpr("probe_id", "file_id", "offset as plo", "offset + length as phi", f"explode(array({', '.join(map(str, LEVELS))})) as level")
    asked = asked.selectExpr("*", "explode(sequence(shiftright(plo, level), shiftright(phi - 1, level))) as cell")
    met = cells.join(asked, ["file_id", "level", "cell"]).where("lo < phi and plo < hi and cell = shiftright(greatest(lo, plo), level)")
    return met.selectExpr(
        "probe_id", "file_id", "hole", "greatest(lo, plo) as logical_offset", "least(hi, phi) - greatest(lo, plo) as length", "pid", "physical_offset + greatest(lo, plo) - lo as chunk_offset",
        "lead(lo) over (partition by probe_id order by lo) is null as last_record",
    )


def read_tasks(found: DataFrame) -> DataFrame:
    """Range-query records whose data follow one another in the same writer's log, as one read each; holes join too."""
    part = ["probe_id", "file_id"]
    follows = "lag(logical_offset + length) over {w} = logical_offset and lag(hole) over {w} = hole and (hole or (lag(pid) over {w} = pid and lag(chunk_offset + length) over {w} = chunk_offset))"
    ran = islands(found, part, follows, "logical_offset")
    return ran.groupBy(*part, "island").agg(F.first("hole").alias("hole"), F.min("logical_offset").alias("logical_offset"), F.sum("length").alias("length"), F.min("pid").alias("pid"), F.min("chunk_offset").alias("chunk_offset"), F.count("*").alias("records")).drop("island")


def data_paths(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Range-query records with the data file (file_id, pid, data_path) that holds their bytes; holes have none."""
    return found.join(chunks, ["file_id", "pid"], "left").select(*found.columns, "data_path")


def rewritten(log: DataFrame, size: int) -> DataFrame:
    """A log's records after its file is cut to `size`, in the order of their begin, for a rewrite of the log."""
    return truncate(log, size).orderBy("begin_us", "pid", "seq")


def stab_lookup(extents: DataFrame, probes: DataFrame, tile: int = TILE, stats: DataFrame | None = None) -> DataFrame:
    """What holds the byte at each probe (probe_id, file_id, offset): data, hole or eof, and how far it goes on.

    Columns probe_id, file_id, offset, state, pid, chunk_offset, run. An as-of match inside tiles: probes and the pieces
    of extents are sorted together, and each probe takes the last piece before it if that covers it.
    """
    cells = tiled(completed(extents, stats).selectExpr("file_id", "hole", "pid", "physical_offset", "logical_offset", "logical_offset + length as stop", "logical_offset as lo", "logical_offset + length as hi"), tile=tile)
    piece = cells.selectExpr("file_id", "tile", "lo as at", "0 as kind", "cast(null as bigint) as probe_id", "struct(hole, pid, physical_offset, logical_offset, stop, hi) as c")
    asked = probes.selectExpr("file_id", f"cast(floor(offset / {tile}) as bigint) as tile", "offset as at", "1 as kind", "probe_id", "cast(null as struct<hole: boolean, pid: bigint, physical_offset: bigint, logical_offset: bigint, stop: bigint, hi: bigint>) as c")
    seen = piece.union(asked).selectExpr("*", "last(c, true) over (partition by file_id, tile order by at, kind rows between unbounded preceding and current row) as l").where("kind = 1")
    hit = "l is not null and at < l.hi"
    return seen.selectExpr(
        "probe_id", "file_id", "at as offset", f"case when {hit} then case when l.hole then 'hole' else 'data' end else 'eof' end as state",
        f"case when {hit} then l.pid end as pid", f"case when {hit} then l.physical_offset + at - l.logical_offset end as chunk_offset", f"case when {hit} then l.stop - at end as run",
    )


def truncate(extents: DataFrame, size: int) -> DataFrame:
    """Extents of files cut to `size` bytes: those from there on go, the one across it is cut."""
    return extents.where(F.col("logical_offset") < size).withColumn("length", F.least("length", F.lit(size) - F.col("logical_offset")))


def resized_eof(stats: DataFrame, size: int) -> DataFrame:
    """End of file after a file is cut or grown to `size`: growing is an empty record there."""
    return stats.select("file_id", F.lit(size).cast("long").alias("eof"), (F.col("eof") < size).alias("grown"))


def only_writer(log: DataFrame, pid: int) -> DataFrame:
    """The map of one writer's records alone; ranges of others read as holes."""
    return resolve(log.where(F.col("pid") == pid))


def grown(log: DataFrame, size: int) -> DataFrame:
    """log with an empty record at `size` for each file that ends before it, which moves the end of file there. Its
    writer is -1; it is the file's newest record and its seq follows the file's last."""
    short = log.groupBy("file_id").agg(F.max(F.expr("logical_offset + length")).alias("eof"), F.max("seq").alias("seq"), F.max("end_us").alias("t")).where(F.col("eof") < size)
    made = short.select("file_id", F.lit(-1).cast("long").alias("pid"), (F.col("seq") + 1).alias("seq"), F.lit(size).cast("long").alias("logical_offset"), F.lit(0).cast("long").alias("physical_offset"), F.lit(0).cast("long").alias("length"), F.col("t").alias("begin_us"), F.col("t").alias("end_us"))
    return log.select(*made.columns).union(made)


def overlaps(log: DataFrame) -> DataFrame:
    """Per record, how many others of its file it shares bytes with.

    Those are the records that start before its end, less those that end by its start, and itself: two ranks in the
    order of all starts and ends, so no pair is ever formed.
    """
    real = log.where("length > 0").selectExpr("file_id", "seq", "logical_offset as lo", "logical_offset + length as hi")
    # at the same byte, ends and what asks for starts come first
    ends = real.selectExpr("file_id", "seq", "explode(array(struct(lo as at, 1 as late), struct(hi as at, 0 as late))) as e").selectExpr("file_id", "seq", "e.at", "e.late", f"e.at div {TILE} as _b")
    ranked = prefix_sums(ends, ["file_id"], "_b", ["at", "late"], {"starts": "cast(late as bigint)", "stops": "1L - late"})
    return ranked.groupBy("file_id", "seq").agg(F.sum(F.expr("case when late = 0 then starts - 1 else - stops end")).cast("long").alias("overlapping"))
