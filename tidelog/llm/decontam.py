"""Benchmark decontamination by greedy string tiling with Karp-Rabin matching."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import batches_by_bytes, maybe_in, only, sliced, unused, written

#: Characters that tokens lose.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Benchmark text that one pass over the documents carries, in bytes at most, unless one item alone has more.
BLOCK_BYTES = 8 << 20
_MIX = 0x9E3779B97F4A7C15


def tokens(text: object) -> list[bytes]:
    """Words of the lower-cased text without ASCII punctuation; null has none."""
    return text.lower().encode("utf-8", "surrogatepass").translate(None, PUNCTUATION).split() if isinstance(text, str) else []


def hashed_windows(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of `size` token ids."""
    n = len(ids) - size + 1
    out, power = np.zeros(max(n, 0), np.uint64), 1
    for k in range(size if n > 0 else 0):
        out += (ids[k : k + n].astype(np.uint64) + np.uint64(1)) * np.uint64(power)
        power = power * _MIX % (1 << 64)
    return out


def matches(text: np.ndarray, item: np.ndarray, least: int, most: int = 1 << 22) -> list[tuple[int, int, int]]:
    """(-length, place in item, place in text) of every match of `least` tokens or more that goes on on neither side.

    Karp-Rabin: rolling hashes of all windows of `least` tokens of either list meet, equal hashes are compared token by
    token, and windows that follow one another on both sides are one match. Windows of the item are taken in turns of at
    most `most` meetings. Negative ids match nothing.
    """
    h, g = hashed_windows(text, least), hashed_windows(item, least)
    order = np.argsort(h, kind="stable")
    lo, hi = np.searchsorted(h[order], g, "left"), np.searchsorted(h[order], g, "right")
    ends, parts, at = np.cumsum(hi - lo), [], 0
    while at < len(g):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        n = (hi - lo)[at:to]
        p = np.repeat(np.arange(at, to), n)
        t = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at:to], n)]
        for k in range(least):
            same = (text[t + k] == item[p + k]) & (item[p + k] >= 0)
            p, t = p[same], t[same]
        key = np.lexsort((p, t - p))
        p, t = p[key], t[key]
        new = np.ones(len(p), bool)
        new[1:] = (np.diff(p) != 1) | (np.diff(t - p) != 0)
        first = np.flatnonzero(new)
        parts.append((p[first], t[first], np.diff(np.append(first, len(p)))))
        at = to
    if not parts:
        return []
    p, t, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    key = np.lexsort((p, t - p))  # a match that two turns cut is one again
    p, t, n = p[key], t[key], n[key]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1] + n[:-1]) | (np.diff(t - p) != 0)
    first = np.flatnonzero(new)
    total = np.add.reduceat(n, first) if len(first) else n
    return list(zip((1 - least - total).tolist(), p[first].tolist(), t[first].tolist(), strict=True))


def tile(text: list[int], item: list[int], least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in text, place in item, length) of the two token lists, none overlapping another, `least` or longer.

    The longest match is marked, again and again; what earlier tiles leave of a match is a match of its own. Equal
    lengths are marked by place in the item, then in the text. Negative ids match nothing.
    """
    if len(text) < least or len(item) < least:
        return []
    used_t, used_p, out = np.zeros(len(text), bool), np.zeros(len(item), bool), []
    heap = matches(np.array(text, np.int64), np.array(item, np.int64), least)
    heapify(heap)
    while heap:
        n, p, t = heappop(heap)
        n = -n
        used = used_p[p : p + n] | used_t[t : t + n]
        if used.any():
            edge = np.flatnonzero(np.diff(np.concatenate(([True], used, [True])).astype(np.int8)))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a >= least:
                    heappush(heap, (a - b, p + a, t + a))
            continue
        used_p[p : p + n], used_t[t : t + n] = True, True
        out.append((t, p, n))
    return out


@dataclass
class Bench:
    """A block of benchmark items: token ids, and for each seed length the seeds' hashes and where they occur."""

    ids: list
    items: list[list[int]]
    vocabulary: dict[bytes, int]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @staticmethod
    def of(rows: list[tuple[object, object]], least: int) -> Bench:
        vocabulary: dict[bytes, int] = {}
        kept = [(i, w) for i, t in rows if (w := tokens(t))]
        out = Bench([i for i, _ in kept], [[vocabulary.setdefault(x, len(vocabulary)) for x in w] for _, w in kept], vocabulary)
        by: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for k, w in enumerate(out.items):
            h = hashed_windows(np.array(w), min(least, len(w)))
            by.setdefault(min(least, len(w)), []).append((h, np.full(len(h), k)))
        for size, parts in by.items():
            h, k = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((k, h))
            out.seeds[size] = (h[order], k[order], np.unique(h))
        return out

    def found(self, text: object, least: int, threshold: float) -> list[tuple[int, int, int, float, list]]:
        """(item's place, tiles, covered tokens, coverage, spans) of the items that a text covers to the threshold."""
        words = tokens(text)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        out = []
        for size, (hashes, items, distinct) in self.seeds.items():
            if len(ids) < size or not len(distinct):
                continue
            known = ids >= 0
            run = known[: len(ids) - size + 1].copy()
            for k in range(1, size):
                run &= known[k : len(ids) - size + 1 + k]
            at = np.flatnonzero(run)
            if not len(at):
                continue
            h = np.zeros(len(at), np.uint64)
            power = 1
            for k in range(size):
                h += (ids[at + k].astype(np.uint64) + np.uint64(1)) * np.uint64(power)
                power = power * _MIX % (1 << 64)
            hit = distinct[np.minimum(np.searchsorted(distinct, h), len(distinct) - 1)] == h
            at, h = at[hit], h[hit]
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            pairs = np.unique(np.concatenate([np.stack((items[a:b], np.full(b - a, p)), 1) for a, b, p in zip(lo, hi, at, strict=True)]), axis=0) if len(at) else np.zeros((0, 2), np.int64)
            for k in np.unique(pairs[:, 0]):
                item = self.items[k]
                starts = pairs[pairs[:, 0] == k, 1]
                # the text's tokens that the item's seeds cover; gaps part them
                here = np.unique((starts[:, None] + np.arange(size)[None, :]).ravel())
                gaps = np.flatnonzero(np.diff(here) > 1) + 1
                part, place = np.insert(ids[here], gaps, -1).tolist(), np.insert(here, gaps, -1).tolist()
                there = set(part)
                if sum(x in there for x in item) < threshold * len(item) - 1e-9:
                    continue
                tiles = tile(part, item, size)
                covered = sum(n for _, _, n in tiles)
                if covered >= threshold * len(item) - 1e-9:
                    out.append((int(k), len(tiles), covered, covered / len(item), sorted((place[t], p, n) for t, p, n in tiles)))
        return out


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return only(benchmark, id_col, text_col).toDF("id", "text").where("text is not null").distinct()


def block_count(benchmark: DataFrame, id_col: str, text_col: str) -> int:
    size = _items(benchmark, id_col, text_col).agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0))).first()[0]
    return max(1, -(-size // BLOCK_BYTES))


def blocks(benchmark: DataFrame, least: int, id_col: str, text_col: str) -> Iterator[tuple[Bench, bool]]:
    """The benchmark in blocks of about BLOCK_BYTES, each small enough to hand to every task, whatever the whole is; and
    whether a block is the last."""
    items, count = _items(benchmark, id_col, text_col), block_count(benchmark, id_col, text_col)
    for k in range(count):
        own = items if count == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k)
        rows = sorted(own.collect(), key=lambda r: (str(r[0]), r[1]))  # BLOCK_BYTES of text, by the count above
        yield Bench.of([(r[0], r[1]) for r in rows], least), k == count - 1


def _passes(docs: DataFrame, benchmark: DataFrame, least: int, item_col: str, item_text: str, one: Callable[[Broadcast], DataFrame]) -> DataFrame | None:
    """What one(block) gives for each block of the benchmark, together. A single block is left lazy; of several each is a
    job of its own whose rows are written, and its broadcast is gone before the next is made."""
    out = None
    for bench, last in blocks(benchmark, least, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(bench)
        if out is None and last:
            return one(shared)
        got, _ = written(one(shared))
        shared.destroy()
        out = got if out is None else out.union(got)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, tiles, covered, coverage, spans) for each document and item that it contains.

    coverage is the share of the item's tokens under non-overlapping tiles of `least` tokens or more, in any order, and
    `threshold` or more is listed; an item of fewer tokens needs all of them in a row. spans are (first token in the
    document, first token in the item, tokens). Items without tokens, and null texts on either side, match nothing;
    equal (item id, text) rows of the benchmark count once; null ids and repeated documents come back each; texts of any
    length are read whole; ties between tiles go by place in the item, then in the text; other columns are not read; with
    an empty table on either side there are no rows. Each block of the benchmark is one pass over the documents, without
    a shuffle.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    texts = only(docs, id_col, text_col).toDF("id", "text")

    def one(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches_by_bytes(batches, "text", 4 << 20):
                rows = [(i, shared.value.ids[k], n, covered, share, spans) for i, t in zip(pdf["id"], pdf["text"], strict=True) for k, n, covered, share, spans in shared.value.found(t, least, threshold)]
                if rows:
                    yield pd.DataFrame(rows, columns=["id", "item", "tiles", "covered", "coverage", "spans"])

        return texts.mapInPandas(run, f"id {kind}, item {item_kind}, tiles int, covered int, coverage double, spans array<struct<doc_token:int,item_token:int,tokens:int>>")

    return _passes(docs, benchmark, least, item_col, item_text, one)


def clean(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.8, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that contain no item of the benchmark, all columns as they are, whatever their names.

    Nulls, long texts, ties, repeated rows and empty tables are as in contaminated(): a null text contains nothing, equal
    texts fare alike, and without any benchmark all rows stay. With one block of the benchmark this is a filter; with
    several, each block's pass over the texts writes 128-bit hashes of those that contain an item of it, and rows whose
    text is among them go; a small filter keeps most rows out of that join.
    """
    at, blocks_left = docs.columns.index(text_col), []

    def hashes(column: Column) -> list[Column]:
        return [F.xxhash64(column), F.xxhash64(F.lit(1), column)]

    def one(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in sliced(batch, at, 4 << 20):
                    yield part.filter(pa.array([not shared.value.found(t, least, threshold) for t in part.column(at).to_pylist()], pa.bool_()))

        def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches_by_bytes(batches, "text", 4 << 20):
                yield pdf.loc[[bool(shared.value.found(t, least, threshold)) for t in pdf["text"]], ["a", "b"]]

        if len(blocks_left) == 1:
            return docs.mapInArrow(run, docs.schema)
        text = F.col(f"`{text_col}`")
        return docs.select(text.alias("text"), *[h.alias(n) for h, n in zip(hashes(text), "ab", strict=True)]).where("text is not null").mapInPandas(mark, "a long, b long").distinct()

    blocks_left += range(block_count(benchmark, item_col, item_text))
    got = _passes(docs, benchmark, least, item_col, item_text, one)
    if len(blocks_left) == 1:
        return got
    gone, _ = written(got.distinct())
    first, second, flag = unused(docs, "_first"), unused(docs, "_second"), unused(docs, "_flag")
    text = F.col(f"`{text_col}`")
    keyed = maybe_in(docs.withColumn(first, hashes(text)[0]).withColumn(second, hashes(text)[1]), first, gone.select("a"), flag)
    hit = keyed.where(flag).join(gone, (F.col(first) == F.col("a")) & (F.col(second) == F.col("b")), "left_anti")
    return keyed.where(~F.col(flag)).union(hit).drop(first, second, flag)
