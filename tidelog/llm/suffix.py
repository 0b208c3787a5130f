"""Exact substring dedup: collection Burrows-Wheeler transforms and common prefixes, built column by column.

Every window of `width` bytes belongs to a piece: a run of windows of one document with the same anchor, the least hash
of the `gram`-byte strings inside a window. Equal windows have equal anchors, so whatever repeats meets in the bucket of
its anchor. Anchors that one document alone has are dropped first; the pieces of the others go to their buckets, where
one symbol of every piece is inserted a round, from the last to the first, and the transform and the common prefixes of
the collection are updated. Suffixes with `width` symbols in common are equal windows.

Equal windows have equal second, third, ... least hashes too, so an anchor with very many contexts is split by those:
among tasks if very many chunks have it, and inside a task until each transform is small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Hashes, only, utf8, written

#: Windows a piece has at most, and bytes of text that anchors are computed for at once.
MOST, SLICE = 32, 1 << 17
LAST = np.iinfo(np.int64).max
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    parts = [np.array([len(arrays)] + [len(a) for a in arrays], np.int64).tobytes(), b"".join(a.dtype.char.encode() for a in arrays)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts + [np.ascontiguousarray(a).tobytes() for a in arrays]))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(bytes(blob))
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    kinds, at, out = raw[8 + 8 * n : 8 + 9 * n].decode(), 8 + 9 * n, []
    for kind, size in zip(kinds, sizes.tolist(), strict=True):
        out.append(np.frombuffer(raw, np.dtype(kind), size, at))
        at += size * np.dtype(kind).itemsize
    return out


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n, step, m = len(h) - width + 1, 1, h
    while step * 2 <= width:
        m = np.minimum(m[: len(m) - step], m[step:])
        step *= 2
    return np.minimum(m[:n], m[width - step : width - step + n])


def ranked(grams: np.ndarray, at: np.ndarray, inner: int, rank: int) -> np.ndarray:
    """The hash of that rank (0: the least) among the `inner` gram hashes from each place on."""
    out = np.empty(len(at), np.uint64)
    for lo in range(0, len(at), 1 << 15):
        own = grams[at[lo : lo + (1 << 15), None] + np.arange(inner)]
        out[lo : lo + (1 << 15)] = np.partition(own, rank, axis=1)[:, rank]
    return out


def expanded(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whose) of every window of runs of windows."""
    who = np.repeat(np.arange(len(start)), count)
    return np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count) + start[who], who


@dataclass
class Pieces:
    start: np.ndarray  # of the first window, in the chunk
    count: np.ndarray  # windows
    anchor: np.ndarray
    check: np.ndarray  # a hash of the piece's bytes
    doc: np.ndarray


class Chunk:
    """The documents of one chunk, sorted by id and text, as one byte array."""

    def __init__(self, blobs: Iterator[bytes], width: int, gram: int) -> None:
        self.width, self.gram = width, gram
        ids, nulls, texts = [], [], []
        for blob in blobs:
            i, null, sizes, data = unpack(blob)
            ids.append(i), nulls.append(null)
            raw, ends = data.tobytes(), np.cumsum(sizes)
            texts += [raw[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        ids, nulls = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, nulls))
        order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
        self.ids, self.nulls = ids[order], nulls[order].astype(bool)
        texts = [texts[k] for k in order]
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.sizes)
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    def pieces(self, wanted: np.ndarray | None = None, key=None, hot: np.ndarray | None = None) -> Pieces:
        """All pieces, or those whose key(anchor) is in the sorted array wanted. Those whose key is in the sorted array
        hot are split by their windows' second least hash, which then is a part of the anchor."""
        out, width = [], self.width
        if wanted is not None:  # most anchors fail at a table of their low bits
            likely, low = np.zeros(1 << 22, bool), np.uint64((1 << 22) - 1)
            likely[wanted & low] = True
        begins = self.ends - self.sizes
        for lo in range(0, len(self.data), SLICE):  # slices overlap by a window
            hi = min(lo + SLICE, len(self.data))
            data = self.data[lo : min(len(self.data), hi + width - 1)]
            if len(data) < width:
                continue
            hashes = Hashes(data)
            grams = hashes.grams(self.gram)
            m = least_of(grams, width - self.gram + 1)[: hi - lo]
            at = np.arange(lo, lo + len(m))
            d0, d1 = np.searchsorted(self.ends, [lo, lo + len(m) - 1], "right")
            stop = np.repeat(self.ends[d0 : d1 + 1], np.minimum(self.ends[d0 : d1 + 1], lo + len(m)) - np.maximum(begins[d0 : d1 + 1], lo))
            valid = at + width <= stop
            new = valid.copy()
            new[1:] &= ~valid[:-1] | (m[1:] != m[:-1])
            begin = np.flatnonzero(new)
            if not len(begin):
                continue
            bad = np.append(np.flatnonzero(~valid), len(m))
            count = np.minimum(np.append(begin[1:], len(m)), bad[np.searchsorted(bad, begin)]) - begin
            anchor = m[begin]
            if wanted is not None:
                hit = np.flatnonzero(likely[anchor & low])
                k = key(anchor[hit])
                hit = hit[wanted[np.minimum(np.searchsorted(wanted, k), len(wanted) - 1)] == k] if len(wanted) else hit[:0]
                begin, count, anchor = begin[hit], count[hit], anchor[hit]
                if hot is not None and len(hot) and len(hit):
                    k = key(anchor)
                    many = hot[np.minimum(np.searchsorted(hot, k), len(hot) - 1)] == k
                    at, who = expanded(begin[many], count[many])
                    second = ranked(grams, at, width - self.gram + 1, 1)
                    first = np.ones(len(at), bool)
                    first[1:] = (who[1:] != who[:-1]) | (second[1:] != second[:-1])
                    cut = np.flatnonzero(first)
                    mixed = anchor[many][who[cut]] ^ (second[cut] * _MIX | np.uint64(1))
                    begin, count, anchor = (np.concatenate(x) for x in ((begin[~many], at[cut]), (count[~many], np.diff(np.append(cut, len(at)))), (anchor[~many], mixed)))
                    order = np.argsort(begin, kind="stable")
                    begin, count, anchor = begin[order], count[order], anchor[order]
            parts = -(-count // MOST)
            inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            begin, count, anchor = np.repeat(begin, parts) + inner * MOST, np.minimum(MOST, np.repeat(count, parts) - inner * MOST), np.repeat(anchor, parts)
            out.append((begin + lo, count, anchor, hashes.of(begin, begin + count + width - 1) if wanted is not None else anchor))
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        start, count, anchor, check = (np.concatenate(x) for x in zip(*out, strict=True)) if out else empty
        return Pieces(start, count, anchor, check, np.searchsorted(self.ends, start, "right"))

    def distinct(self, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """The first piece (by document, then place) of each group of equal pieces, and each piece's group.

        Hashes group them, and a comparison of all bytes confirms each; a piece that fails it is a group of its own.
        """
        order = np.lexsort((p.start, p.check, p.count, p.anchor))
        same = np.zeros(len(order), bool)
        if len(order):
            a, b = order[1:], order[:-1]
            same[1:] = (p.anchor[a] == p.anchor[b]) & (p.check[a] == p.check[b]) & (p.count[a] == p.count[b])
            lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
            for lo in range(0, len(order), 1 << 16):
                rows = np.flatnonzero(same[lo : lo + (1 << 16)]) + lo
                if len(rows):
                    size = p.count[order[rows]] + self.width - 1
                    inside = np.arange(int(size.max()))
                    x, y = (np.where(inside < size[:, None], self.data[np.minimum(p.start[k][:, None] + inside, len(self.data) - 1)], 0) for k in (order[rows], lead[rows]))
                    same[rows[(x != y).any(axis=1)]] = False
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(~same) - 1
        return order[~same], group


def keys(buckets: int):
    """Of an anchor: its bucket in the upper and 32 of its bits in the lower half."""
    return lambda anchor: ((anchor >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(32) | (anchor & np.uint64(0xFFFFFFFF))


class RangeLeast:
    """Least values of ranges of a uint8 array: tables for ranges up to 64, and tables over blocks of 64."""

    LEVEL = np.frexp(np.arange(1 << 16).astype(np.float64))[1] - 1  # floor(log2)

    def __init__(self, x: np.ndarray) -> None:
        self.small, self.x = self.levels(x, 7), x
        self.blocks: np.ndarray | None = None

    @staticmethod
    def levels(x: np.ndarray, most: int) -> np.ndarray:
        """Row k: the least of the 2^k values from each place on."""
        out = np.empty((most, len(x)), np.uint8)
        out[0] = x
        for k in range(1, most):
            half = min(1 << (k - 1), len(x))
            np.minimum(out[k - 1, : len(x) - half], out[k - 1, half:], out=out[k, : len(x) - half])
            out[k, len(x) - half :] = out[k - 1, len(x) - half :]
        return out

    def pick(self, table: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least of [lo, hi], both included."""
        level = self.LEVEL[hi - lo + 1]
        row = level * table.shape[1]
        flat = table.ravel()
        return np.minimum(flat[row + lo], flat[row + hi + 1 - (1 << level)])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        far = np.flatnonzero(hi - lo >= 64)
        if not len(far):
            return self.pick(self.small, lo, hi)
        out = self.pick(self.small, lo, np.minimum(hi, lo + 63))
        if self.blocks is None:
            blocks = np.concatenate((self.x, np.full(-len(self.x) % 64, 255, np.uint8))).reshape(-1, 64).min(axis=1)
            self.blocks = self.levels(blocks, max(1, int(len(blocks)).bit_length()))
        lo, hi = lo[far], hi[far]
        a, b = (lo >> 6) + 1, hi >> 6  # whole blocks between
        ends = np.minimum(out[far], self.pick(self.small, b << 6, hi))
        mid = np.flatnonzero(a < b)
        if len(mid):
            ends[mid] = np.minimum(ends[mid], self.pick(self.blocks, a[mid], b[mid] - 1))
        out[far] = ends
        return out


@dataclass
class Collection:
    """The transform of a collection of strings: the symbol before each sorted suffix, 0 for none, and the length that
    a suffix has in common with the one before it. The empty suffixes of all strings come first, in their order."""

    bwt: np.ndarray
    lcp: np.ndarray
    strings: int

    @staticmethod
    def build(symbols: np.ndarray, sizes: np.ndarray) -> Collection:
        """Of strings in rows, right-aligned, of 16-bit symbols from 1 on and of fewer than 255 symbols.

        Round j writes the j-th symbol from the end of every string before its suffix of length j - 1, and inserts the
        suffix of length j where the order of the transform puts it. Both files are read and written once a round, front
        to back. Common prefixes change at new suffixes and behind them only: one more than the least between the two
        suffixes that they prolong.
        """
        m, longest = symbols.shape
        both = np.zeros(m, np.uint32)  # symbol in the lower, common prefix in the upper half
        place, who = np.arange(m), np.arange(m)
        for j in range(1, longest + 1):
            live = sizes[who] >= j
            place, who = place[live], who[live]
            both[place] |= symbols[who, longest - j]
            bwt, lcp = both.astype(np.uint16), (both >> np.uint32(16)).astype(np.uint8)
            order = np.argsort(bwt, kind="stable")
            order = order[len(bwt) - np.count_nonzero(bwt) :]
            fresh = np.zeros(len(bwt), bool)
            fresh[place] = True
            new = np.flatnonzero(fresh[order])
            who = who[np.searchsorted(place, order[new])]
            place = new + m
            old = np.ones(m + len(order), bool)
            old[place] = False
            grown = np.zeros(m + len(order), np.uint32)
            grown[old] = both
            # new suffixes, and those behind them that are not new
            behind = new[:-1][np.diff(new) > 1] + 1 if len(new) else new
            if len(new) and new[-1] + 1 < len(order):
                behind = np.append(behind, new[-1] + 1)
            k = np.concatenate((new[1:] if len(new) and new[0] == 0 else new, behind))
            a, b = order[k - 1], order[k]
            common = np.zeros(len(k), np.uint32)
            equal = np.flatnonzero(bwt[a] == bwt[b])
            common[equal] = RangeLeast(lcp).of(a[equal] + 1, b[equal]).astype(np.uint32) + 1
            grown[m + k] = grown[m + k] & np.uint32(0xFFFF) | common << np.uint32(16)
            both = grown
        return Collection(both.astype(np.uint16), (both >> np.uint32(16)).astype(np.uint8), m)

    def rows(self, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, strings, rows of their suffixes of that length), from length 1 on: a walk by the last-first map."""
        order = np.argsort(self.bwt, kind="stable")
        first = len(order) - np.count_nonzero(self.bwt)
        back = np.zeros(len(order), np.int64)
        back[order[first:]] = np.arange(len(order) - first) + self.strings
        who, at = np.arange(self.strings), np.arange(self.strings)
        for length in range(1, int(sizes.max(initial=0)) + 1):
            live = sizes[who] >= length
            who, at = who[live], back[at[live]]
            yield length, who, at


def least_documents(texts: list[bytes], docs: np.ndarray, width: int) -> np.ndarray:
    """(text, window): the least document that has a window's bytes, for distinct texts and the least document of each.

    A symbol is two bytes if the width is even, which halves the rounds: a text is then two strings, from its first and
    from its second byte on, and each of its windows is a suffix's head in one of them.
    """
    unit = 2 - width % 2
    strings = [t[f : f + (len(t) - f) // unit * unit] for f in range(unit) for t in texts]
    sizes = np.fromiter(map(len, strings), np.int64, len(strings)) // unit
    longest = int(sizes.max())
    flat = np.frombuffer(b"".join(t.rjust(longest * unit, b"\0") for t in strings), np.uint8 if unit == 1 else np.dtype("<u2"))
    symbols = flat.reshape(len(strings), longest).astype(np.uint16) + np.uint16(1)
    found = Collection.build(symbols, sizes)
    group = np.cumsum(found.lcp < width // unit) - 1
    best = np.full(int(group[-1]) + 1, LAST)
    windows = [(length, who, group[at]) for length, who, at in found.rows(sizes) if length * unit >= width]
    for _, who, g in windows:
        np.minimum.at(best, g, docs[who % len(texts)])
    out = np.full((len(texts), MOST), LAST)
    for length, who, g in windows:
        out[who % len(texts), who // len(texts) + (sizes[who] - length) * unit] = best[g]
    return out


def by_anchor(texts: list[bytes], docs: np.ndarray, home: np.ndarray, width: int, gram: int, most: int, rank: int = 1) -> np.ndarray:
    """least_documents() of texts that can only match where home is equal.

    Transforms are built over whole homes of about `most` texts together. The windows of a home with more are split by
    their least hash of the next rank, which equal windows have in common, and so on while there is one.
    """
    order = np.argsort(home, kind="stable")
    edge = np.concatenate(([0], np.flatnonzero(np.diff(home[order])) + 1, [len(order)]))
    best, at = np.full((len(texts), MOST), LAST), 0
    while at < len(edge) - 1:
        to = max(at + 1, int(np.searchsorted(edge, edge[at] + most, "right")) - 1)
        own = order[edge[at] : edge[to]]
        if len(own) > most and rank <= width - gram:
            best[own] = _split([texts[k] for k in own], docs[own], width, gram, most, rank)
        else:
            best[own] = least_documents([texts[k] for k in own], docs[own], width)
        at = to
    return best


def _split(texts: list[bytes], docs: np.ndarray, width: int, gram: int, most: int, rank: int) -> np.ndarray:
    """by_anchor() of texts with one home, by the hash of that rank in each window."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    start, count = np.cumsum(sizes) - sizes, sizes - width + 1
    raw = b"".join(texts)
    at, who = expanded(start, count)
    hashed = ranked(Hashes(np.frombuffer(raw, np.uint8)).grams(gram), at, width - gram + 1, rank)
    first = np.ones(len(at), bool)
    first[1:] = (who[1:] != who[:-1]) | (hashed[1:] != hashed[:-1])
    cut = np.flatnonzero(first)
    size, begin, owner = np.diff(np.append(cut, len(at))), at[cut], who[cut]
    number: dict[bytes, int] = {}
    which = np.fromiter((number.setdefault(raw[a : a + n + width - 1], len(number)) for a, n in zip(begin.tolist(), size.tolist(), strict=True)), np.int64, len(cut))
    low, home = np.full(len(number), LAST), np.empty(len(number), np.uint64)
    np.minimum.at(low, which, docs[owner])
    home[which] = hashed[cut]
    found = by_anchor(list(number), low, home, width, gram, most, rank + 1)
    out = np.full((len(texts), MOST), LAST)
    inside, run = expanded(np.zeros(len(cut), np.int64), size)
    out[owner[run], begin[run] - start[owner[run]] + inside] = found[which[run], inside]
    return out


def repeats(docs: DataFrame, width: int = 50, gram: int = 24, chunk_bytes: int = 8 << 20, bucket_pieces: int = 2048, hot_chunks: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, kept, spans): a document's bytes without those that repeat an earlier document, and where they were.

    A byte goes if some string of `width` bytes over it also starts in a document with a smaller id; strings are judged
    on the input, and never cross documents. kept is binary (cuts may split a character), spans are (start, length) of
    the maximal removed runs in bytes. Null texts are empty; null ids come after all others; rows of one id are no
    copies of each other; repeated rows come back each; an empty table gives no rows. Ids are longs.

    Documents are dealt by hash into chunks of about chunk_bytes, which a task holds one at a time, so raise it with the
    executors' memory when there are very many chunks. Anchors go to buckets as 32-bit numbers; false matches among them
    cost work only. Per chunk each distinct piece is sent once, with the least of its documents, so a passage that any
    share of all documents has is a piece a chunk. An anchor that hot_chunks chunks have is split by the windows' second
    least hash, so that its contexts are dealt over tasks. A task takes its distinct pieces in parts of about
    bucket_pieces by anchor, and splits an anchor with more; the transform of a part lives in memory, rewritten front to
    back a round. Shuffles have as many partitions as chunks, buckets or groups of parts, so that what a task reads does
    not grow with the input. Ties, long texts and other columns: every byte of every text is read, of equal strings the
    least document keeps its own, and only the two columns are read.
    """
    texts = only(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    per_window = (width - gram + 2) / 2
    buckets = max(1, int(total / per_window * 4 // chunk_bytes))
    groups = max(1, int(total / per_window * (width + per_window) // (2 * chunk_bytes)))
    key = keys(buckets)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for c, own in pdf.groupby("chunk"):
                raw = [utf8(t) for t in own["text"]]
                null = own["id"].isna().to_numpy()
                rows.append((c, pack(own["id"].fillna(LAST).to_numpy(np.int64), null.astype(np.uint8), np.fromiter(map(len, raw), np.int64, len(raw)), np.frombuffer(b"".join(raw), np.uint8))))
            yield pd.DataFrame(rows, columns=["chunk", "blob"])

    dealt = texts.select("id", "text", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).alias("chunk")).mapInPandas(gather, "chunk long, blob binary")

    def anchors(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(pdf["blob"], width, gram)
        p = chunk.pieces()
        k = key(p.anchor)
        order = np.argsort(k, kind="stable")  # pieces stand by document already
        k, d = k[order], chunk.ids[p.doc][order]
        new = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        stop = np.append(at[1:], len(k))
        several = d[at] != d[stop - 1] if len(k) else np.zeros(0, bool)
        k = k[at]
        bucket = (k >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = []
        for b, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            if hi > lo:
                low = (k[lo:hi] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                rows.append((b, int(pdf["chunk"].iloc[0]), pack(np.diff(low, prepend=np.uint32(0)), np.packbits(several[lo:hi]))))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "blob"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        low, several, which = [], [], []
        for c, blob in enumerate(pdf["blob"]):
            step, bits = unpack(blob)
            low.append(np.cumsum(step, dtype=np.uint32))
            several.append(np.unpackbits(bits)[: len(step)].astype(bool))
            which.append(np.full(len(step), c, np.int32))
        low, several, which = map(np.concatenate, (low, several, which))
        order = np.argsort(low, kind="stable")
        low, several, which = low[order], several[order], which[order]
        same = low[1:] == low[:-1]
        several[1:] |= same
        several[:-1] |= same
        edge = np.concatenate(([0], np.flatnonzero(~same) + 1, [len(low)]))
        hot = np.repeat(np.diff(edge) >= hot_chunks, np.diff(edge))
        low, which, hot = low[several], which[several], hot[several]
        order = np.argsort(which, kind="stable")
        low, which, hot = low[order], which[order], hot[order]
        cut = np.searchsorted(which, np.arange(len(pdf) + 1))
        rows = [(int(c), int(b), pack(np.diff(low[lo:hi], prepend=np.uint32(0)), np.packbits(hot[lo:hi]))) for c, b, lo, hi in zip(pdf["chunk"], pdf["bucket"], cut[:-1].tolist(), cut[1:].tolist(), strict=True) if hi > lo]
        return pd.DataFrame(rows, columns=["chunk", "bucket", "blob"])

    by_chunk, by_bucket, by_part = (min(20_000, 2 * k) for k in (chunks, buckets, groups))
    found = dealt.repartition(by_chunk, "chunk").groupBy("chunk").applyInPandas(anchors, "bucket long, chunk long, blob binary")
    shared, _ = written(found.repartition(by_bucket, "bucket").groupBy("bucket").applyInPandas(meet, "chunk long, bucket long, blob binary"))

    def wanted(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The keys of a chunk's anchors that other documents have too, and those of the hot ones, both sorted."""
        parts, many = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for b, blob in zip(pdf["bucket"], pdf["blob"], strict=True):
            step, bits = unpack(blob)
            parts.append(np.cumsum(step, dtype=np.uint32).astype(np.uint64) | np.uint64(b) << np.uint64(32))
            many.append(parts[-1][np.unpackbits(bits)[: len(step)].astype(bool)])
        return np.sort(np.concatenate(parts)), np.sort(np.concatenate(many))

    def send(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"part": [], "chunk": [], "blob": []})
        chunk = Chunk(left["blob"], width, gram)
        keyed, many = wanted(right)
        p = chunk.pieces(keyed, key, many)
        lead, _ = chunk.distinct(p)
        part = (p.anchor[lead] >> np.uint64(8)) % np.uint64(groups)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(groups + 1, dtype=np.uint64))
        rows, raw = [], chunk.data.tobytes()
        for g, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            if hi > lo:
                local = order[lo:hi]
                k = lead[local]
                size = p.count[k] + width - 1
                text = b"".join([raw[a : a + s] for a, s in zip(p.start[k].tolist(), size.tolist(), strict=True)])
                rows.append((g, int(left["chunk"].iloc[0]), pack(local.astype(np.uint32), p.anchor[k], chunk.ids[p.doc[k]], size.astype(np.uint8), np.frombuffer(text, np.uint8))))
        return pd.DataFrame(rows, columns=["part", "chunk", "blob"])

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        local, anchor, doc, size, text, source, out, bits = [], [], [], [], [], [], [], []
        for c, blob in enumerate(pdf["blob"]):
            a, b, d, s, t = unpack(blob)
            local.append(a), anchor.append(b), doc.append(d), size.append(s.astype(np.int64)), text.append(t.tobytes()), source.append(np.full(len(a), c))
        local, anchor, doc, size, source = map(np.concatenate, (local, anchor, doc, size, source))
        raw, stop = b"".join(text), np.cumsum(size)
        start = stop - size
        number: dict[bytes, int] = {}
        which = np.fromiter((number.setdefault(raw[a:b], len(number)) for a, b in zip(start.tolist(), stop.tolist(), strict=True)), np.int64, len(start))
        texts = list(number)
        low, home = np.full(len(texts), LAST), np.empty(len(texts), np.uint64)
        np.minimum.at(low, which, doc)
        home[which] = anchor
        best = by_anchor(texts, low, home, width, gram, bucket_pieces)
        for lo in range(0, len(which), 1 << 16):
            flags = best[which[lo : lo + (1 << 16)]] < doc[lo : lo + (1 << 16), None]
            some = np.flatnonzero(flags.any(axis=1))
            out.append(some + lo)
            bits.append(np.packbits(flags[some], axis=1, bitorder="little").view(np.uint32).ravel())
        at, bits = np.concatenate(out), np.concatenate(bits)
        order = np.argsort(source[at], kind="stable")
        at, bits = at[order], bits[order]
        cut = np.searchsorted(source[at], np.arange(len(pdf) + 1))
        rows = [(int(c), -1, pack(local[at[a:b]], bits[a:b])) for c, a, b in zip(pdf["chunk"], cut[:-1].tolist(), cut[1:].tolist(), strict=True) if b > a]
        return pd.DataFrame(rows, columns=["chunk", "bucket", "blob"])

    sent = dealt.repartition(by_chunk, "chunk").groupBy("chunk").cogroup(shared.repartition(by_chunk, "chunk").groupBy("chunk")).applyInPandas(send, "part long, chunk long, blob binary")
    answers = sent.repartition(by_part, "part").groupBy("part").applyInPandas(resolve, "chunk long, bucket long, blob binary")

    def cut(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"id": [], "n_bytes": [], "kept": [], "spans": []})
        chunk = Chunk(left["blob"], width, gram)
        size = len(chunk.data)
        starts = np.zeros(size + 1, bool)
        if len(right):
            keyed, many = wanted(right[right["bucket"] >= 0])
            p = chunk.pieces(keyed, key, many)
            lead, group = chunk.distinct(p)
            mask = np.zeros(len(lead), np.uint32)
            for blob in right.loc[right["bucket"] < 0, "blob"]:
                local, bits = unpack(blob)
                mask[local] = bits
            # an equal piece of a smaller document, or what the other chunks say of the least one
            own = np.where(chunk.ids[p.doc] > chunk.ids[p.doc[lead]][group], np.uint32(0xFFFFFFFF), mask[group]) if len(lead) else np.zeros(0, np.uint32)
            for w in range(MOST):
                hit = (own >> np.uint32(w) & np.uint32(1)).astype(bool) & (w < p.count)
                starts[p.start[hit] + w] = True
        run = np.cumsum(starts[:size], dtype=np.int64)
        run[width:] -= run[:-width].copy() if size > width else 0
        gone = run > 0
        rows = []
        for i, null, a, b in zip(chunk.ids.tolist(), chunk.nulls.tolist(), (chunk.ends - chunk.sizes).tolist(), chunk.ends.tolist(), strict=True):
            g = gone[a:b]
            if g.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([False], g, [False])).astype(np.int8)))
                spans = [{"start": int(s), "length": int(e - s)} for s, e in zip(edge[::2], edge[1::2], strict=True)]
                kept = chunk.data[a:b][~g].tobytes()
            else:
                spans, kept = [], chunk.data[a:b].tobytes()
            rows.append((None if null else i, b - a, kept, spans))
        out = pd.DataFrame(rows, columns=["id", "n_bytes", "kept", "spans"])
        out["id"] = pd.array([r[0] for r in rows], dtype="Int64")
        return out

    return dealt.repartition(by_chunk, "chunk").groupBy("chunk").cogroup(shared.union(answers).repartition(by_chunk, "chunk").groupBy("chunk")).applyInPandas(cut, "id long, n_bytes long, kept binary, spans array<struct<start:long,length:long>>")
