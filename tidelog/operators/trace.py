"""I/O trace analytics: bounds, writer statistics, time bins, size histogram, outliers, thinning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.scalar import log2_bucket, log2_bucket_serial
from tidelog.operators.ranks import prefix_sum

BINS, SIZE_BUCKETS = 500, 51
# Fixed value: the least message level that is no debug stream.
INFO = 0x00100000


def valid(trace: DataFrame) -> DataFrame:
    """Records that end after they begin; the others cannot be binned."""
    return trace.where("begin_us < end_us")


def rejects(trace: DataFrame) -> DataFrame:
    return trace.agg(F.sum(F.expr("case when begin_us < end_us then 0 else 1 end")).alias("rejected"), F.count("*").alias("records"))


def projection(trace: DataFrame) -> DataFrame:
    """Trace rows with the last byte that each touches."""
    return trace.selectExpr("pid as id", "seq", "logical_offset as offset", "length", "begin_us", "end_us", "logical_offset + length - 1 as tail")


def bounds(trace: DataFrame) -> DataFrame:
    """First begin, last end, and the sum and count of the writers' last ends. The sum is an exact decimal: of times since
    1970, a long holds no more than about 5,000 writers'."""
    ends = trace.groupBy("pid").agg(F.min("begin_us").alias("b"), F.max("end_us").alias("e"))
    return ends.agg(F.min("b").alias("min_begin_us"), F.max("e").alias("max_end_us"), F.sum(F.expr("cast(e as decimal(28, 0))")).alias("sum_end_us"), F.count("*").alias("writers"))


def writer_end(trace: DataFrame) -> DataFrame:
    return trace.groupBy("pid").agg(F.max("end_us").alias("end_us"))


def offset_triples(trace: DataFrame) -> DataFrame:
    """(id, beg, end): every record's writer with its first and last byte, as the report's binary files hold them."""
    return trace.selectExpr("pid as id", "logical_offset as beg", "logical_offset + length - 1 as end")


def time_triples(trace: DataFrame, k: float = 1.0, few: int = 16) -> DataFrame:
    """(id, beg, end) in seconds of the records of outlying writers; of all, if there are `few` writers or less."""
    sides = writer_end(trace).crossJoin(F.broadcast(trace.agg(F.countDistinct("pid").alias("n")))).where(f"n <= {few}").select("pid").unionByName(stragglers(trace, k, few).select("pid")).distinct()
    return trace.join(sides, "pid", "left_semi").selectExpr("cast(pid as double) as id", "begin_us / 1e6D as beg", "end_us / 1e6D as end")


def report(trace: DataFrame, bins: int = BINS) -> DataFrame:
    """(section, idx, value): the sections of a trace's report. head has the number of bins, the first begin, the mean
    last end, a bin's width (seconds), and how many writers end late and early; then bandwidths, records in flight and
    finished by bin, and the size histogram."""
    own = bounds(trace).crossJoin(F.broadcast(straggler_counts(trace)))  # a row each
    head = own.selectExpr(f"posexplode(array({bins}D, min_begin_us / 1e6D, cast(sum_end_us as double) / writers / 1e6D, (max_end_us - min_begin_us) / {bins} / 1e6D, cast(above as double), cast(below as double))) as (idx, value)")
    parts = [("bandwidth", bandwidth_bins(trace, bins), "bin", "mib_s"), ("running", ios_running(trace, bins), "bin", "running"), ("finished", ios_finished(trace, bins), "bin", "finished"), ("sizes", size_histogram(trace), "bucket", "records")]
    out = head.selectExpr("'head' as section", "idx", "value")
    for name, found, at, value in parts:
        out = out.union(found.selectExpr(f"'{name}'", f"cast({at} as int)", f"cast({value} as double)"))
    return out


def writer_spans(trace: DataFrame) -> DataFrame:
    """Each writer's first begin and last end in seconds after the trace's first begin."""
    start = trace.agg(F.min("begin_us").alias("z"))
    own = trace.groupBy("pid").agg(F.min("begin_us").alias("b"), F.max("end_us").alias("e"))
    return own.crossJoin(F.broadcast(start)).selectExpr("pid", "(b - z) / 1e6D as begin_s", "(e - z) / 1e6D as end_s")  # one row


def writer_stats(trace: DataFrame) -> DataFrame:
    """Mean and population deviation of the writers' last ends, in seconds after the first begin."""
    start = trace.agg(F.min("begin_us").alias("z"))
    rel = writer_end(trace).crossJoin(F.broadcast(start)).selectExpr("(end_us - z) / 1e6D as x")  # one row each way
    return rel.agg(F.count("*").alias("writers"), F.round(F.avg("x"), 6).alias("mean_end_s"), F.round(F.stddev_pop("x"), 6).alias("stddev_end_s"))


def stragglers(trace: DataFrame, k: float = 1.0, few: int = 16) -> DataFrame:
    """Writers whose last end is k deviations above or below the mean; with `few` writers or less, past the mean alone."""
    stats = writer_end(trace).agg(F.avg("end_us").alias("m"), F.stddev_pop("end_us").alias("s"), F.count("*").alias("n"))
    near = writer_end(trace).crossJoin(F.broadcast(stats)).withColumn("w", F.when(F.col("n") <= few, F.lit(0.0)).otherwise(F.lit(float(k)) * F.col("s")))
    side = F.when(F.col("end_us") > F.col("m") + F.col("w"), "above").when(F.col("end_us") < F.col("m") - F.col("w"), "below")
    return near.select("pid", "end_us", side.alias("side")).where("side is not null")


def straggler_counts(trace: DataFrame, k: float = 1.0, few: int = 16) -> DataFrame:
    return stragglers(trace, k, few).agg(F.count(F.expr("case when side = 'above' then 1 end")).alias("above"), F.count(F.expr("case when side = 'below' then 1 end")).alias("below"))


def straggler_rows(trace: DataFrame, k: float = 1.0, few: int = 16) -> DataFrame:
    """The trace rows of outlying writers."""
    return trace.join(stragglers(trace, k, few).select("pid", "side"), "pid")


def spread(trace: DataFrame, bins: int = BINS) -> DataFrame:
    """Valid records with the bin that they start in and how many bins their duration spans, as integers.

    bin = (begin - min) * bins div (max - min); spanned = ceil(duration * bins / (max - min)), whatever the alignment.
    """
    span = valid(trace).agg(F.min("begin_us").alias("z"), F.expr("greatest(max(end_us) - min(begin_us), 1L)").alias("span"))
    return valid(trace).crossJoin(F.broadcast(span)).selectExpr(
        "*", f"(begin_us - z) * {bins} div span as first_bin", f"((end_us - begin_us) * {bins} + span - 1) div span as spanned"
    )


def dense(found: DataFrame, bins: int, name: str = "bin") -> DataFrame:
    """found with a row for every bin; absent numbers are 0."""
    every = found.sparkSession.range(bins).withColumnRenamed("id", name)
    out = every.join(found, name, "left")
    return out.select(name, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in found.columns if c != name])


def bandwidth_bins(trace: DataFrame, bins: int = BINS, fractional: bool = False) -> DataFrame:
    """MiB/s that the records over each bin add up to; bins past the end count in the last one. fractional: weighted by
    the part of a bin that a duration leaves.

    A record's rate is the same in all its bins, so it is added where it starts and taken off behind where it ends, as
    exact decimals, and a running sum over the bins does the rest: two rows a record, whatever it spans.
    """
    rate = "length / ((end_us - begin_us) / 1e6D) / 1048576D"
    if fractional:
        rate += f" * (((end_us - begin_us) * {bins} % span) / cast(span as double))"
    last = f"{bins - 1}L"
    marked = spread(trace, bins).selectExpr(f"cast({rate} as decimal(38, 18)) as r", f"least(first_bin, {last}) as a", f"least(first_bin + spanned - 1, {last}) + 1 as z")
    steps = marked.selectExpr("explode(array(struct(a as bin, r as d), struct(z as bin, -r as d))) as m").selectExpr("m.bin", "m.d").where(f"bin < {bins}")
    sums = dense(steps.groupBy("bin").agg(F.sum("d").alias("d")), bins)
    return sums.selectExpr("bin", "cast(round(cast(sum(d) over (order by bin) as double), 4) as double) as mib_s")


def bin_times(trace: DataFrame, bins: int = BINS) -> DataFrame:
    """Each bin's start in seconds, after the first begin and since the epoch."""
    span = valid(trace).agg(F.min("begin_us").alias("z"), F.expr("max(end_us) - min(begin_us)").alias("span"))
    return trace.sparkSession.range(bins).withColumnRenamed("id", "bin").crossJoin(F.broadcast(span)).selectExpr("bin", f"round(bin * span / {bins} / 1e6D, 3) as relative_s", f"round((z + bin * span / {bins}) / 1e6D, 3) as absolute_s")


def ios_running(trace: DataFrame, bins: int = BINS) -> DataFrame:
    """Records in flight: each counts in all bins it covers but the last. Starts and stops are summed, not exploded."""
    marks = spread(trace, bins).where("spanned > 1").selectExpr(f"explode(array(struct(least(first_bin, {bins}L) as bin, 1L as d), struct(least(first_bin + spanned - 1, {bins}L) as bin, -1L as d))) as m").selectExpr("m.bin", "m.d")
    return dense(marks.where(f"bin < {bins}").groupBy("bin").agg(F.sum("d").alias("d")), bins).selectExpr("bin", "sum(d) over (order by bin) as running")


def ios_finished(trace: DataFrame, bins: int = BINS) -> DataFrame:
    """Records finished in each bin (the last one they cover), and in all bins before it."""
    done = spread(trace, bins).selectExpr(f"least(first_bin + spanned - 1, {bins - 1}L) as bin").groupBy("bin").agg(F.count("*").alias("finished"))
    return dense(done, bins).selectExpr("bin", "finished", "coalesce(sum(finished) over (order by bin rows between unbounded preceding and 1 preceding), 0L) as finished_before")


def size_histogram(trace: DataFrame, serial: bool = False) -> DataFrame:
    """Records for each power of two of the length; the last bucket is open. serial: the variant with limits at 2^k + 1."""
    bucket = log2_bucket_serial(F.col("length"), SIZE_BUCKETS - 1) if serial else log2_bucket(F.col("length"), SIZE_BUCKETS - 1)
    counts = trace.groupBy(bucket.cast("long").alias("bucket")).agg(F.count("*").alias("records"))
    return dense(counts, SIZE_BUCKETS, "bucket")


def downsample(trace: DataFrame, per_writer: int = 100, most: int = 65536) -> DataFrame:
    """Every 2^k-th row by (pid, begin, seq), with k the fewest halvings after which no more than per_writer rows a
    writer, and `most` in all, are left."""
    n = trace.agg(F.count("*").alias("n"), F.countDistinct("pid").alias("w"))
    limit = f"least({per_writer} * w, {most})"
    step = n.selectExpr("n", f"filter(transform(sequence(0, 62), k -> shiftleft(1L, k)), s -> (n + s - 1) div s <= {limit})[0] as step")
    # a bucket is 70 minutes of a writer, so that a busy writer is more than one task's
    ranked = prefix_sum(trace.withColumn("_b", F.struct("pid", F.shiftright("begin_us", 32))), [], "_b", ["begin_us", "seq"], "1L", "before")
    return ranked.crossJoin(F.broadcast(step)).where("before % step = 0").select(*trace.columns)


def op_stats(ops: DataFrame) -> DataFrame:
    """Calls, errors, time and KB (floored a call) for each operation, and a row of totals with op null."""
    sums = ops.rollup("op").agg(F.count("*").alias("calls"), F.sum("is_error").alias("errors"), F.sum("elapsed_us").alias("us"), F.sum(F.floor(F.col("bytes") / F.lit(1024)).cast("long")).alias("kb"))
    return sums.selectExpr(
        "op", "calls", "errors", "round(us / 1e6D, 6) as seconds", "kb", "case when us > 0 then round(calls / (us / 1e6D), 6) end as ops_per_s", "case when us > 0 then round(kb / (us / 1e6D) / 1024D, 6) end as mib_per_s"
    )


def log_filter(logs: DataFrame, masks: DataFrame, default: int | None = None) -> DataFrame:
    """Messages (facility, level, ...) that their facility's mask lets through; facilities without one have the default,
    or are left out without that. Levels of DEBUG and under are bits of debug streams: any bit of the mask lets them
    through. Others have to reach the mask."""
    both = logs.join(masks, "facility", "inner" if default is None else "left")
    mask = F.col("mask") if default is None else F.coalesce("mask", F.lit(default).cast("long"))
    level = F.col("level")
    return both.where(F.when(level >= INFO, level >= mask).otherwise(level.cast("long").bitwiseAND(mask.cast("long")) != 0)).drop("mask")


def messages(lines: DataFrame) -> DataFrame:
    """Log lines (value) as date, host, short_host, tag, facility, level, message, and error: parse for lines of fewer
    than six fields, invalid for lines that do not start with a digit (their fields are still taken), else null."""
    f = F.split("value", " +", 6)
    whole = (F.size(f) == 6) & (F.element_at(f, -1) != "")
    take = lambda k: F.when(whole, f[k])
    made = lines.select("value", *[take(k).alias(n) for k, n in enumerate(("date", "host", "tag", "facility", "level", "message"))], F.when(~F.col("value").rlike("^[0-9]"), "invalid").when(~whole, "parse").alias("error"))
    return made.withColumn("short_host", F.substring_index("host", ".", 1))


def formatted(parsed: DataFrame, fmt: str) -> DataFrame:
    """A line a message: the fields that the letters of fmt name, joined by blanks. d date, h host, H host without its
    domain, t tag, f facility, l level, m message, s source (column source, if there); other letters give nothing."""
    names = {"d": "date", "h": "host", "H": "short_host", "t": "tag", "f": "facility", "l": "level", "m": "message"} | ({"s": "source"} if "source" in parsed.columns else {})
    pieces = [F.coalesce(F.col(names[c]), F.lit("")) if c in names else F.lit("") for c in fmt]
    mark = F.when(F.col("error") == "invalid", F.concat(F.lit("INVALID-MSG: "), "value")).when(F.col("error") == "parse", F.concat(F.lit("PARSE-ERR: "), "value")).otherwise(F.lit(""))
    return parsed.select(F.concat(mark, F.concat_ws(" ", *pieces)).alias("line"))
