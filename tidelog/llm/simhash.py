"""SimHash near-duplicates: fingerprints, a sharded vantage-point tree over Hamming space, components of links."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import batches_by_bytes, connected_components, only, utf8, written

#: Fingerprints meant for a leaf of the tree's top; its leaves at most; fingerprints a leaf in the sample that shapes it,
#: and in all at least. The sample is so at most EACH * LEAVES longs, 2 MB.
PER_LEAF, LEAVES, EACH, SAMPLE = 4096, 1 << 14, 16, 4096


def fingerprint(text: object, words: int = 5, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 without words, and the whole of a shorter text.

    Words are runs of non-blank bytes of the text with A-Z lower-cased; a bit is set if over half the shingles' XXH64
    hashes have it.
    """
    parts = utf8(text).lower().split()
    if not parts:
        return 0
    whole = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(whole, seed)
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(whole[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)])
    n, total = len(starts), np.zeros(64, np.int64)
    for lo in range(0, n, 255 * 64):
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8, min(n - lo, 255 * 64) * 8, lo * 8)).reshape(-1, 64)
        for at in range(0, len(bits), 255):
            total += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long. Null texts are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches_by_bytes(batches, "text"):
            fps = np.array([fingerprint(t, words) for t in pdf["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": pdf["id"], "fp": fps})

    kind = docs.schema[id_col].dataType.simpleString()
    return only(docs, id_col, text_col).toDF("id", "text").mapInPandas(run, f"id {kind}, fp long")


@dataclass
class Node:
    """A vantage point and the distance up to which fingerprints go to the near side; or a leaf's number."""

    leaf: int = -1
    point: np.uint64 = np.uint64(0)
    radius: int = 0
    near: Node | None = None
    far: Node | None = None


def distances(fps: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ point).astype(np.int16)


def best_vantage(fps: np.ndarray, tries: int = 12) -> tuple[np.uint64, int] | None:
    """Of a few fingerprints, the one whose median ball splits the others most evenly, and that ball's radius."""
    best, found = 0, None
    for point in fps[:: max(1, len(fps) // tries)][:tries]:
        d = distances(fps, point)
        for radius in (int(np.median(d)), int(np.median(d)) - 1):
            near = int((d <= radius).sum())
            if min(near, len(fps) - near) > best:
                best, found = min(near, len(fps) - near), (point, radius)
    return found


def build(sample: np.ndarray, leaves: int) -> tuple[Node, list[int]]:
    """A tree of that many leaves at most, and how many of the sample each leaf holds."""
    held: list[int] = []

    def grow(fps: np.ndarray, parts: int) -> Node:
        cut = best_vantage(fps) if parts > 1 and len(fps) > 1 else None
        if cut is None:
            held.append(len(fps))
            return Node(leaf=len(held) - 1)
        near = distances(fps, cut[0]) <= cut[1]
        return Node(-1, cut[0], cut[1], grow(fps[near], parts // 2), grow(fps[~near], parts - parts // 2))

    return grow(sample, leaves), held


def route(node: Node, fps: np.ndarray, reach: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Each fingerprint's home leaf, and for each leaf the fingerprints whose ball of that reach may touch it.

    By the triangle inequality a ball with distance d from the vantage point misses the near side if d - reach is over
    its radius, and the far side if d + reach is not.
    """
    home, touched = np.empty(len(fps), np.int32), []

    def visit(at: Node, inside: np.ndarray, asking: np.ndarray) -> None:
        if at.leaf >= 0:
            home[inside] = at.leaf
            touched.append((at.leaf, asking))
            return
        d = distances(fps[inside], at.point)
        q = distances(fps[asking], at.point)
        visit(at.near, inside[d <= at.radius], asking[q - reach <= at.radius])
        visit(at.far, inside[d > at.radius], asking[q + reach > at.radius])

    rows = np.arange(len(fps))
    visit(node, rows, rows)
    return home, touched


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for links a-b, without the least nodes themselves."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for k in (i, j, label[i], label[j]):
            np.minimum.at(new, k, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def close_pairs(homes: np.ndarray, asking: np.ndarray, reach: int, tile: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Links between asking and homes at `reach` differing bits or fewer, reduced to stars. A local vantage-point tree."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def shrink() -> None:
        nonlocal kept, count
        if kept:
            kept = [stars(np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept]))]
            count = len(kept[0][0])

    def visit(h: np.ndarray, q: np.ndarray, depth: int) -> None:
        nonlocal count
        if not len(h) or not len(q):
            return
        cut = best_vantage(h, 4) if depth and len(h) > 512 and len(h) * len(q) > tile else None
        if cut is not None:
            dh, dq = distances(h, cut[0]), distances(q, cut[0])
            visit(h[dh <= cut[1]], q[dq - reach <= cut[1]], depth - 1)
            visit(h[dh > cut[1]], q[dq + reach > cut[1]], depth - 1)
            return
        step = max(1, (1 << 19) // len(h))
        for lo in range(0, len(q), step):
            x, y = np.nonzero(np.bitwise_count(q[lo : lo + step, None] ^ h[None, :]) <= reach)
            a, b = q[lo + x], h[y]
            own = a != b
            if own.any():
                kept.append((a[own], b[own]))
                count += int(own.sum())
                if count > 1 << 20:
                    shrink()

    visit(homes, asking, 24)
    shrink()
    return kept[0] if kept else (homes[:0], homes[:0])


def links(fps: DataFrame, reach: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that join all that are `reach` bits apart or fewer.

    The driver shapes a tree whose leaves grow in number with the fingerprints, up to LEAVES, from a bounded sample that
    a hash chooses. Every fingerprint goes to its home leaf and, as a query, to each later leaf that its ball overlaps,
    packed many to a row. Leaves that the sample shows to be crowded, or to be asked by many, are cut into blocks on
    either side, and each pair of blocks is a task, so no task holds more than about 2 PER_LEAF homes and 16 PER_LEAF
    queries. It searches them with a local tree and gives stars of what it links, so no task gives more rows than it has
    fingerprints, and no link between different fingerprints is lost.
    """
    n = fps.count()
    leaves = min(LEAVES, 1 << max(0, int(np.ceil(np.log2(max(1, n / PER_LEAF))))))
    few = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(max(SAMPLE, EACH * leaves)).collect()], np.int64).view(np.uint64)
    tree, held = build(few, leaves)
    home, touched = route(tree, few, reach)
    each = n / max(1, len(few))
    blocks = [max(1, round(each * k / (2 * PER_LEAF))) for k in held]
    askers = [max(1, round(each * int((home[asking] <= leaf).sum()) / (16 * PER_LEAF))) for leaf, asking in sorted(touched, key=lambda x: x[0])]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            home, touched = route(tree, x, reach)
            mixed, rows = x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33), []
            for leaf, asking in touched:
                own, queries = asking[home[asking] == leaf], asking[home[asking] <= leaf]
                block, side = mixed[own] % np.uint64(blocks[leaf]), mixed[queries] % np.uint64(askers[leaf])
                homes = [x[own[block == k]].tobytes() for k in range(blocks[leaf])]
                asks = [x[queries[side == j]].tobytes() for j in range(askers[leaf])]
                rows += [(leaf << 40 | k << 20 | j, h, q) for k, h in enumerate(homes) for j, q in enumerate(asks) if h or q]
            yield pd.DataFrame(rows, columns=["shard", "homes", "asking"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        homes, asking = (np.frombuffer(b"".join(pdf[c]), np.uint64) for c in ("homes", "asking"))
        a, b = close_pairs(homes, asking, reach)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return fps.select("fp").mapInPandas(deal, "shard long, homes binary, asking binary").groupBy("shard").applyInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, reach: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): fingerprint and the least id among the documents that links of `reach` bits reach.

    Equal fingerprints count as linked and are searched once; a text without words, null or empty, has fingerprint 0 and
    links like any other; texts of any length are shingled whole; a bit that exactly half the shingles have is 0; a null
    id is never a component's name unless all its ids are null; repeated rows come back as often as they came; other
    columns are not read; an empty table gives no rows.
    """
    marked, _ = written(fingerprints(docs, words, id_col, text_col))
    groups, _ = written(marked.groupBy("fp").agg(F.min("id").alias("least")))
    parts = connected_components(links(groups, reach)).withColumnRenamed("node", "fp")
    named = groups.join(parts, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("top"))
    whole, _ = written(named.groupBy("top").agg(F.min("least").alias("component")))
    names, _ = written(named.join(whole, "top").select("fp", "component"))
    return marked.join(names, "fp").select("id", "fp", "component")
