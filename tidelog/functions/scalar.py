"""Scalar functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_64 = 1 << 64


def string_hash(text: Column) -> Column:
    """h = c + h * 65599 modulo 2^64 over the characters of an ASCII text, as DECIMAL(20,0).

    A step's product stays below 2^81, which DECIMAL(38,0) holds exactly.
    """
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("decimal(38,0)"))
    step = lambda h, c: ((h * F.lit(65599).cast("decimal(6,0)") + c).cast("decimal(38,0)") % F.lit(str(TWO_64)).cast("decimal(20,0)")).cast("decimal(38,0)")
    return F.aggregate(codes, F.lit(0).cast("decimal(38,0)"), step).cast("decimal(20,0)")


def bucket_of(text: Column, count: int) -> Column:
    """Which of `count` directories or backends a name is placed in."""
    return (string_hash(text) % F.lit(count)).cast("int")


def log2_bucket(size: Column, most: int = 50) -> Column:
    """floor(log2 size), 0 below 2, `most` at the top; exact on integers."""
    return F.least(F.when(size < 2, F.lit(0)).otherwise(F.length(F.bin(size)) - 1), F.lit(most)).cast("int")


def log2_bucket_serial(size: Column, most: int = 50) -> Column:
    """The variant that halves while the size is over 2."""
    third = F.floor(size / F.lit(3)).cast("long")
    return F.least(F.when(size < 3, F.lit(0)).otherwise(F.length(F.bin(third))), F.lit(most)).cast("int")


def human_value(size: Column) -> Column:
    """Size divided by 1024 as often as it stays 1024 or more, five times at most."""
    out = size.cast("double")
    for k in range(1, 6):
        out = F.when(size >= 1024**k, size.cast("double") / F.lit(float(1024**k))).otherwise(out)
    return out


def human_unit(size: Column) -> Column:
    out = F.lit("B")
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        out = F.when(size >= 1024**k, F.lit(unit)).otherwise(out)
    return out


def decimal_exponent(value: Column) -> Column:
    """Digits before the point, less one, of a number of 1 or more; 0 below."""
    return F.when(value < 1, F.lit(0)).otherwise(F.length(F.floor(value).cast("long").cast("string")) - 1).cast("int")


def blocks(size: Column, unit: int = 512) -> Column:
    """Blocks that hold so many bytes, by integer arithmetic."""
    return ((size + F.lit(unit - 1)) - (size + F.lit(unit - 1)) % F.lit(unit)).cast("long") / F.lit(unit)


def packed_seconds(stamp: Column) -> Column:
    return F.shiftright(stamp, 32)


def packed_micros(stamp: Column) -> Column:
    return stamp.bitwiseAND(F.lit(0xFFFFFFFF))


def pack_time(micros: Column) -> Column:
    """Seconds in the upper and microseconds in the lower half of 64 bits; keeps order, not differences."""
    return F.shiftleft(F.floor(micros / F.lit(1_000_000)).cast("long"), 32) + micros % F.lit(1_000_000)


def flat_path(path: Column) -> Column:
    return F.translate(path, "/", "_")


def clean_path(path: Column) -> Column:
    """A path without repeated slashes, dot parts, or parts that ".." takes back; "." if nothing is left."""
    rooted = F.startswith(path, F.lit("/"))
    parts = F.filter(F.split(path, "/+"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        parts, none, lambda out, p: F.when(p != "..", F.concat(out, F.array(p))).when((F.size(out) > 0) & (F.element_at(out, -1) != ".."), F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(rooted, out).otherwise(F.concat(out, F.array(p)))
    )
    text = F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))
    return F.when(text == "", F.lit(".")).otherwise(text)


def rank_group(rank: Column, ranks: int, groups: int) -> Column:
    """The group of a rank when `ranks` are cut into `groups` runs, the first of which get one more if need be."""
    each, more = divmod(ranks, groups)
    cut = more * (each + 1)
    late = F.lit(more) + F.floor((rank - F.lit(cut)) / F.lit(max(each, 1)))
    return F.when(rank < cut, F.floor(rank / F.lit(each + 1))).otherwise(late).cast("int")


def name_part(name: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(name, pattern, group)


# Forms of file names that carry facts. Hosts may contain dots.
META_NAME = r"^(\d+)\.(\d+)\.(\d+)\.(\d+)\.(.+)$"
OPEN_NAME = r"^open\.(.+)\.(\d+)$"
INDEX_NAME = r"dropping\.index\.(\d+)\.(\d+)\.(.+)\.(\d+)$"
SUMMARY_NAME = r"SZ:(\d+)\.BL:(\d+)\.OT:(\d+)\.CT:(\d+)\.BW:([\d.]+)\.IN:(\w+)\.NP:(\d+)\.HO:(.+)\.UI:(\d+)\.PA:(.+)$"
METALINK = r"^(\d*)(\D.*)$"
