"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import hex_fraction


@dataclass(frozen=True)
class Leaf:
    """A shard of the tree: its number, where it stands, and its share of the rows."""

    shard: int
    region: str
    rack: str
    weight: float = 1.0


def uniform_tree(shards: int, regions: int = 2, racks: int = 3, each: int = 4) -> list[Leaf]:
    """Equal shards: the first regions x racks x each fill a regular tree, each later one opens a region of its own.

    A shard that is added so changes the weight of no subtree that had rows, and takes rows only into itself.
    """
    full = regions * racks * each
    return [
        Leaf(i, f"g{i // (racks * each)}", f"k{i // each % racks}") if i < full else Leaf(i, f"x{i - full}", "k0")
        for i in range(shards)
    ]


def _drawn(key: Column, names: list[tuple[str, float]]) -> Column:
    """The place in names whose weighted draw wins: -ln(hash)/weight is exponential, so the least is won by weight."""
    draws = [F.struct((-F.ln(hex_fraction(F.concat(key, F.lit(f":{name}")))) / F.lit(float(w))).alias("d"), F.lit(i).alias("i")) for i, (name, w) in enumerate(names)]
    return draws[0]["i"] if len(draws) == 1 else F.array_min(F.array(*draws))["i"]


def place(key: Column, tree: list[Leaf]) -> Column:
    """The shard of a key: a weighted draw among regions, then among the winner's racks, then among that one's shards.

    A draw depends on the key, the node's path and the node's weight alone, so rows move only into or out of (and
    inside) subtrees whose weights change. Leaves of weight 0 get nothing.
    """

    def descend(leaves: list[Leaf], levels: tuple[str, ...], path: str) -> Column:
        groups: dict[str, list[Leaf]] = {}
        for x in leaves:
            groups.setdefault(str(getattr(x, levels[0])), []).append(x)
        items = [(f"{path}/{name}", own) for name, own in sorted(groups.items(), key=lambda kv: kv[1][0].shard)]
        below = [descend(own, levels[1:], name) if levels[1:] else F.lit(own[0].shard) for name, own in items]
        if len(items) == 1:
            return below[0]
        won = _drawn(key, [(name, sum(x.weight for x in own)) for name, own in items])
        if not levels[1:]:
            return F.element_at(F.array(*below), won + 1)
        out = None
        for i, x in enumerate(below):
            out = F.when(won == i, x) if out is None else out.when(won == i, x)
        return out

    live = [x for x in tree if x.weight > 0]
    if not live:
        raise ValueError("no shard has any weight")
    return descend(live, ("region", "rack", "shard"), "")


#: What shard() adds to a document.
MADE = ("size", "text_crc32", "law", "shard", "grown_shard", "slot")


def shard(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with size, text_crc32, law, shard, grown_shard and slot, which replace columns of these names in any case.

    law is always "key": the id and the tree decide. size: UTF-8 bytes of the text (null: none) plus 8. slot numbers a
    shard's rows from 0 without gaps, in the order of (md5 bucket of the id, id, size, checksum): rows are counted by
    (shard, bucket of 4096), the counts' prefix sums place each bucket, and a window numbers the rows inside one, so no
    task holds a shard. Null ids share one key, are dealt like any other key, and come first in their bucket; repeated
    rows get slots of their own; texts have no effect on the shard, whatever their length; an empty table gives no rows.
    """
    own, whole = (f"_shard_c{docs.columns.index(c)}" for c in (id_col, text_col))
    key = F.coalesce(F.col(own).cast("string"), F.lit("null"))
    text = F.coalesce(F.col(whole), F.lit(""))
    put = docs.toDF(*[f"_shard_c{i}" for i in range(len(docs.columns))]).select(
        "*",
        (F.octet_length(text).cast("long") + F.lit(8).cast("long")).alias("_shard_size"),
        F.crc32(text.cast("binary")).cast("long").alias("_shard_crc"),
        place(key, tree).cast("int").alias("_shard_n"),
        (place(key, grown) if grown else F.lit(None)).cast("int").alias("_shard_grown"),
        F.substring(F.md5(key.cast("binary")), 1, 3).alias("_shard_bucket"),
    )
    counts = put.groupBy("_shard_n", "_shard_bucket").agg(F.count("*").alias("n"))
    starts = counts.selectExpr("_shard_n as _shard_s", "_shard_bucket as _shard_b", "sum(n) over (partition by _shard_n order by _shard_bucket rows between unbounded preceding and current row) - n as _shard_start")
    ranked = put.selectExpr("*", f"row_number() over (partition by _shard_n, _shard_bucket order by {own}, _shard_size, _shard_crc) as _shard_r")
    joined = ranked.join(starts, (F.col("_shard_n") == F.col("_shard_s")) & (F.col("_shard_bucket") == F.col("_shard_b")))
    made = (F.col("_shard_size"), F.col("_shard_crc"), F.lit("key"), F.col("_shard_n"), F.col("_shard_grown"), (F.col("_shard_start") + F.col("_shard_r") - F.lit(1)).cast("long"))
    return joined.select(*[F.col(f"_shard_c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in MADE], *[x.alias(n) for n, x in zip(MADE, made, strict=True)])
