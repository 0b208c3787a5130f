"""Running sums, ranks and runs that no single task has to hold a whole group for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _matched(inner: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """inner with the columns of a small table of one row for each value of keys, whose keys are named _k0, _k1, ..."""
    return inner.join(small, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]).drop(*[f"_k{i}" for i in range(len(keys))])


def prefix_sums(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """df with, for each name in values, the sum of its expression over the rows of the group before, by (bucket, order).

    Buckets follow the order: all rows of a lesser bucket come first. Bucket totals are prefix-summed as a small table,
    and a window inside a bucket does the rest, so a group of any size is dealt over as many tasks as it has buckets.
    """
    keys, names = [*group, bucket], list(values)
    totals = df.groupBy(*keys).agg(*[F.sum(F.expr(values[n])).alias(f"_t{i}") for i, n in enumerate(names)])
    part = f"partition by {', '.join(group)}" if group else ""
    before = totals.selectExpr(
        *[f"{k} as _k{i}" for i, k in enumerate(keys)], *[f"sum(_t{i}) over ({part} order by {bucket} rows between unbounded preceding and current row) - _t{i} as _before{i}" for i in range(len(names))]
    )
    inside = f"(partition by {', '.join(keys)} order by {', '.join(order)} rows between unbounded preceding and 1 preceding)"
    inner = df.selectExpr("*", *[f"coalesce(sum({values[n]}) over {inside}, 0) as _inner{i}" for i, n in enumerate(names)])
    both = _matched(inner, before, keys)
    return both.selectExpr(*[f"`{c}`" for c in df.columns], *[f"cast(_before{i} + _inner{i} as bigint) as {n}" for i, n in enumerate(names)])


def prefix_sum(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """prefix_sums of one value."""
    return prefix_sums(df, group, bucket, order, {name: value})


def previous(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """df with, for each name in values, its expression on the group's row before, by (bucket, order); null on the first.

    Windows run inside buckets; a small table of each bucket's last row carries over to the next.
    """
    keys, names = [*group, bucket], list(values)
    last = df.groupBy(*keys).agg(F.max(F.struct(*[F.expr(o).alias(f"o{i}") for i, o in enumerate(order)], F.struct(*[F.expr(values[n]).alias(n) for n in names]).alias("v"))).alias("_l"))
    carried = last.selectExpr(*[f"{k} as _k{i}" for i, k in enumerate(keys)], f"lag(_l.v) over (partition by {', '.join(group)} order by {bucket}) as _carried")
    made = ", ".join(f"'{n}', {values[n]}" for n in names)
    inner = df.selectExpr("*", f"lag(named_struct({made})) over (partition by {', '.join(keys)} order by {', '.join(order)}) as _own")
    both = _matched(inner, carried, keys).withColumn("_was", F.coalesce("_own", "_carried"))
    return both.selectExpr(*[f"`{c}`" for c in df.columns], *[f"_was.{n} as {n}" for n in names])


def runs(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str], values: Mapping[str, str], follows: str) -> DataFrame:
    """df with island: a number that rises, within the group and by (bucket, order), wherever `follows` fails. follows
    may name the row's columns and those of `values`, which are of the row before."""
    marked = previous(df, group, bucket, order, values).withColumn("_new", F.expr(f"case when {follows} then 0L else 1L end"))
    return prefix_sum(marked, group, bucket, order, "_new", "island").withColumn("island", F.col("island") + F.col("_new")).drop("_new", *values)


def global_rank(df: DataFrame, order: Sequence[str], name: str, tile: int = 4096) -> DataFrame:
    """df with the rank, from 1, of each row by the order; the first order column is an integer, and is cut into tiles."""
    tiled = df.withColumn("_tile", F.floor(F.col(order[0]) / F.lit(tile)))
    return prefix_sum(tiled, [], "_tile", order, "1L", name).withColumn(name, F.col(name) + F.lit(1)).drop("_tile")
