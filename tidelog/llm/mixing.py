"""Mixing sources to target weights: hash order inside a source, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import WORD

#: Weights by the sources' order, repeating.
WEIGHTS = (3, 1, 2)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row a source.

    Sources weigh by code-point order, null last. Together they take `share` of all sizes; none takes over `most` times
    its own size: what that leaves is shared again by weight among the others. Sorted by size over weight, those that
    reach their limit come first, so one pass of running sums finds the level that is left for the rest.
    """
    values = ", ".join(f"{float(w)!r}D" for w in weights)
    view = sizes.selectExpr("source", "source_size", f"element_at(array({values}), cast((row_number() over (order by source is null, source) - 1) % {len(weights)} as int) + 1) as w")
    return (
        view.selectExpr("*", f"{most!r}D * source_size as top", f"sum(source_size) over () * {share!r}D as total", "sum(w) over () as all_w")
        .selectExpr(
            "*",
            "coalesce(sum(top) over (order by top / w, source is null, source rows between unbounded preceding and 1 preceding), 0D) as before",
            "coalesce(sum(w) over (order by top / w, source is null, source rows between unbounded preceding and 1 preceding), 0D) as before_w",
        )
        .selectExpr("*", "(total - before) / (all_w - before_w) as level")
        # the first source that stays under its limit fixes the level for the rest; later rows' levels are no higher
        .selectExpr("*", "max(case when level * w <= top then level end) over () as rest")
        .selectExpr("source", "source_size", "case when rest is null then top else least(top, rest * w) end as target")
    )


#: What mix() adds to a document.
MADE = ("size", "source_size", "target", "taken")


def _planned(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs with its columns by place (_mix_c0, ...), so that no name of theirs can clash, and _mix_ columns of MADE."""
    at = {name: f"_mix_c{docs.columns.index(name)}" for name in (id_col, text_col, source_col)}
    own, text, source = F.col(at[id_col]), F.col(at[text_col]), F.col(at[source_col])
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(own.cast("string"), F.lit("null"))).cast("binary"))
    named = docs.toDF(*[f"_mix_c{i}" for i in range(len(docs.columns))]).select(
        "*",
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("_mix_size"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("_mix_source"),
        key.alias("_mix_key"),
        F.substring(key, 1, 3).alias("_mix_range"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("_mix_crc"),
    )
    ranges = named.groupBy("_mix_source", "_mix_range").agg(F.sum("_mix_size").alias("n"))
    # a tag in place of the source keeps null sources apart and lets the join reuse the window's partitioning
    tagged = ranges.groupBy("_mix_source").agg(F.sum("n").alias("source_size"))
    sizes = tagged.select(F.when(F.col("_mix_source") != "n", F.expr("substring(_mix_source, 2)")).alias("source"), "source_size")
    goals = targets(sizes, weights, share, most).select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("tag"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"))
    starts = ranges.selectExpr("_mix_source as _mix_s", "_mix_range as _mix_r", "sum(n) over (partition by _mix_source order by _mix_range rows between unbounded preceding and current row) - n as _mix_start")
    plan = starts.join(goals, F.col("_mix_s") == F.col("tag")).select("_mix_s", "_mix_r", "_mix_start", "_mix_source_size", "_mix_target")
    run = named.selectExpr("*", f"sum(_mix_size) over (partition by _mix_source, _mix_range order by _mix_key, {at[id_col]}, _mix_size, _mix_crc rows between unbounded preceding and current row) - _mix_size as _mix_before")
    both = run.join(plan, (F.col("_mix_source") == F.col("_mix_s")) & (F.col("_mix_range") == F.col("_mix_r")))
    whole, size = F.col("_mix_source_size"), F.col("_mix_size")
    budget, before = F.floor(F.col("_mix_target") + F.lit(1e-6)).cast("long"), F.col("_mix_start") + F.col("_mix_before")
    epochs = F.when(whole > 0, F.expr("cast(floor(_mix_target + 1e-6D) as bigint) div _mix_source_size")).otherwise(F.lit(0))
    return both.withColumn("_mix_taken", (epochs * size + F.greatest(F.lit(0), F.least(size, budget - epochs * whole - before))).cast("long"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with size (words), source_size, target and taken (words that the mix takes, repeats counted).

    A source's documents are put in the order of a hash of their id, cut into 4096 hash ranges; range totals and their
    prefix sums are small tables, and a window inside a range finishes each document's prefix sum, so a source of any
    share is dealt over many tasks. A source takes whole epochs while its target lasts, then documents in hash order up
    to the exact word. Null texts and texts without words have size 0 and take 0; null sources are one source, last;
    null ids share a key; ties fall by (id, size, checksum), and repeated rows count each; texts of any length are
    counted whole; an empty table gives no rows. Columns of docs that have the result's names, in any case, are replaced.
    """
    got = _planned(docs, weights, share, most, seed, id_col, text_col, source_col)
    return got.select(*[F.col(f"_mix_c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in MADE], *[F.col(f"_mix_{c}").alias(c) for c in MADE])


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: a document once for each whole epoch, and the one that a budget cuts shortened to its
    first words, joined by single spaces.

    The columns of docs and no others, as they are but for a cut text and the n_chars of one, if that column is there.
    Documents without words, null texts among them, are never taken; null ids and sources, ties, repeated rows and empty
    tables are as in mix().
    """
    got, kinds = _planned(docs, weights, share, most, seed, id_col, text_col, source_col), docs.schema
    whole = F.expr("case when _mix_size > 0 then _mix_taken div _mix_size else 0 end")
    rest = F.expr("case when _mix_size > 0 then _mix_taken % _mix_size else 0 end")
    parts = got.withColumn("_mix_part", F.explode(F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))))
    text = f"_mix_c{docs.columns.index(text_col)}"
    cut = parts.withColumn("_mix_cut", F.expr(f"case when _mix_part >= 0 then array_join(slice(regexp_extract_all({text}, r'{WORD}', 0), 1, cast(_mix_part as int)), ' ') end"))

    def column(i: int, name: str) -> Column:
        kept = F.col(f"_mix_c{i}")
        made = F.col("_mix_cut") if name == text_col else F.length("_mix_cut").cast(kinds[name].dataType) if name == "n_chars" else None
        return (kept if made is None else F.when(F.col("_mix_part") < 0, kept).otherwise(made)).alias(name)

    return cut.select(*[column(i, c) for i, c in enumerate(docs.columns)])
