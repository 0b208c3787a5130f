"""Newest-wins sweeps in Arrow batches: which of the records over a tile owns each byte.

Reduction is associative: the winners of a union are the winners among the parts' winners. So batches are reduced before
they are shuffled where many records share a tile, and a tile that any share of all records overwrites is folded batch
by batch, in memory that its winners bound and not its records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd

#: Records of a tile that are held before they are reduced; records of a tile in a batch from which the batch is reduced.
HELD, DENSE = 1 << 17, 64


def owners(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, rank) of the maximal stretches that one record owns; of the records over a byte the highest rank does.

    Records meet within groups only. The ends of all records cut their groups into segments, which are the leaves of a
    binary tree; a record marks the few nodes that its segments make up, and marks are pushed down to the leaves.
    """
    n = len(lo)
    g, p = np.concatenate((group, group)), np.concatenate((lo, hi))
    order = np.lexsort((p, g))
    g, p = g[order], p[order]
    new = np.ones(2 * n, bool)
    new[1:] = (g[1:] != g[:-1]) | (p[1:] != p[:-1])
    place = np.empty(2 * n, np.int64)
    place[order] = np.cumsum(new) - 1
    points, m = p[new], int(new.sum())
    size = 1 << max(1, int(m - 1).bit_length())
    mark = np.full(2 * size, -1, np.int64)
    a, b, own = place[:n] + size, place[n:] + size, rank
    while len(a):
        odd = (a & 1).astype(bool)
        np.maximum.at(mark, a[odd], own[odd])
        a = a + odd
        odd = (b & 1).astype(bool)
        b = b - odd
        np.maximum.at(mark, b[odd], own[odd])
        live = a < b
        a, b, own = a[live] >> 1, b[live] >> 1, own[live]
    k = 1
    while k < size:
        mark[2 * k : 4 * k] = np.maximum(mark[2 * k : 4 * k], np.repeat(mark[k : 2 * k], 2))
        k *= 2
    won = mark[size : size + m]
    first = np.flatnonzero(np.concatenate(([True], won[1:] != won[:-1])))
    last = np.append(first[1:], m)
    kept = won[first] >= 0
    return points[first[kept]], points[np.minimum(last[kept], m - 1)], won[first[kept]]


def numbered(pdf: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """A number for each row's values of keys, equal for equal values; nulls are a value."""
    out = np.zeros(len(pdf), np.int64)
    for k in keys:
        codes, found = pd.factorize(pdf[k], use_na_sentinel=False)
        out = pd.factorize(out * (len(found) + 1) + codes)[0].astype(np.int64)
    return out


def reduced(pdf: pd.DataFrame, keys: Sequence[str], recent: Sequence[str]) -> pd.DataFrame:
    """The rows' winning stretches: the same columns, with lo and hi of what a row owns, once for each stretch."""
    if len(pdf) < 2:
        return pdf
    order = np.lexsort([pdf[c].to_numpy() for c in reversed(list(recent))])
    rank = np.empty(len(pdf), np.int64)
    rank[order] = np.arange(len(pdf))
    lo, hi, who = owners(numbered(pdf, keys), pdf["lo"].to_numpy(np.int64), pdf["hi"].to_numpy(np.int64), rank)
    return pdf.take(order[who]).assign(lo=lo, hi=hi)


def thinned(keys: Sequence[str], recent: Sequence[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Batches in which tiles that many records share are reduced, for the side before a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                code = numbered(pdf, keys)
                dense = np.bincount(code)[code] >= DENSE
                yield pd.concat((reduced(pdf[dense], keys, recent), pdf[~dense])) if dense.any() else pdf

    return run


def folded(keys: Sequence[str], recent: Sequence[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Winners of each tile, from batches sorted by keys. A tile's rows may run over any number of batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, most = [], 0, HELD
        for pdf in batches:
            if not len(pdf):
                continue
            if held:
                pdf = pd.concat((held[-1].iloc[-1:], pdf))  # a row of the held tile tells whether it goes on
            code = numbered(pdf, keys)
            edge = np.flatnonzero(np.diff(code)) + 1
            begin = 1 if held else 0
            if held and len(edge):
                held.append(pdf.iloc[begin : edge[0]])
                yield reduced(pd.concat(held), keys, recent)
                held, size, most, begin = [], 0, HELD, int(edge[0])
            tail = max(begin, int(edge[-1]) if len(edge) else 0)
            if tail > begin:
                yield reduced(pdf.iloc[begin:tail], keys, recent)
            if tail < len(pdf):
                held.append(pdf.iloc[tail:])
                size += len(pdf) - tail
            if size > most:
                held = [reduced(pd.concat(held), keys, recent)]
                size = len(held[0])
                most = max(HELD, 2 * size)
        if held:
            yield reduced(pd.concat(held), keys, recent)

    return run
