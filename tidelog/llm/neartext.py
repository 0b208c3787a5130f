"""Near-duplicate texts at a shingle similarity: vantage-point trees over SimHashes, and exact checks of shingle sets.

The top of the tree has one vantage point, the empty document: in the Hamming metric of shingle sets a document of s
shingles is s away from it, and of two sets of Jaccard similarity t the smaller has at least t times the larger's
shingles. So rings of sizes in the ratio t are the shards, and each overlaps itself and the next only. Inside a pair of
shards, vantage points among the 256-bit SimHashes cut both sides by Hamming distance, and a branch is pruned where the
triangle bound keeps its fingerprints further apart than similar sets ever are. What is left is compared, and whole
shingle sets decide. Fingerprints of unlike texts are all about 128 bits apart, and those of similar sets may be 80, so
balls around a vantage point separate groups of copies from the rest, but not the rest from itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Forest, batches_by_bytes, connected_components, maybe_in, only, unused, utf8, written

PRINTS = ["p", "q", "r", "s"]
#: Most differing bits of a candidate in the first 128 and in all 256 bits, for sets of under SMALL shingles and others.
#: Of the pairs of similarity 0.8 and more, those of 4 and 5 shingles differ most, in 0.1875 of the bits, others in up to
#: 0.1612 (ties of even sets count as 0). By exact binomial sums, bits taken as independent, both bounds together are passed by
#: no more than 1.3e-9 of the pairs; the bounds are for that similarity.
SMALL, FIRST, ALL = 6, (53, 49), (89, 80)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: object, words: int) -> np.ndarray:
    """A hash of each run of `words` words, repeats included; of the whole text if it is shorter; none without words."""
    parts = utf8(text).lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    whole, digest = b" ".join(parts), xxhash.xxh64_digest
    if len(parts) <= words:
        return np.frombuffer(digest(whole), ">u8").astype(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - words + 1]
    return np.frombuffer(b"".join([digest(whole[a:b]) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)]), ">u8").astype(np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * _MIX
    return h ^ h >> np.uint64(29)


def majorities(own: np.ndarray) -> np.ndarray:
    """The SimHash: the bits that over half the hashes have, of four hashes made of each."""
    if not len(own):
        return np.zeros(len(PRINTS), np.uint64)
    made = [own]
    for _ in PRINTS[1:]:
        made.append(mixed(made[-1]))
    every, total = np.stack(made, axis=1), np.zeros(64 * len(PRINTS), np.int64)
    for lo in range(0, len(own), 255):
        total += np.unpackbits(every[lo : lo + 255].view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(own)).view(np.uint64)


def prints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, t, key, p, q, r, s, size): hashes of the text and of its shingle set, the set's SimHash in longs and its size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches_by_bytes(batches, "text"):
            rows = []
            for text in pdf["text"]:
                own = np.unique(shingle_hashes(text, words))
                other = mixed(own)
                key = np.array([own.sum(dtype=np.uint64), other.sum(dtype=np.uint64)]).tobytes() + len(own).to_bytes(4, "little")
                rows.append((key, majorities(own), len(own)))
            bits = np.stack([r[1] for r in rows], axis=1).view(np.int64)
            yield pd.DataFrame({"id": pdf["id"], "t": pdf["t"], "key": [r[0] for r in rows], **dict(zip(PRINTS, bits, strict=True)), "size": [r[2] for r in rows]})

    return only(docs, id_col, text_col).toDF("id", "text").withColumn("t", F.xxhash64("text")).mapInPandas(run, "id long, t long, key binary, p long, q long, r long, s long, size int")


def tasks(shell: np.ndarray, block: np.ndarray, blocks: dict[int, int]) -> Iterator[tuple[str, int, np.ndarray]]:
    """(task, side, rows): every pair of blocks of a shell, and of a shell and the next, is a task."""
    for k in np.unique(shell):
        for i in np.unique(block[shell == k]):
            rows = np.flatnonzero((shell == k) & (block == i))
            for j in range(blocks.get(int(k), 1)):
                yield f"{k}:{min(i, j)}:{k}:{max(i, j)}", int(i > j), rows
            for j in range(blocks.get(int(k) + 1, 0)):
                yield f"{k}:{i}:{k + 1}:{j}", 0, rows
            for j in range(blocks.get(int(k) - 1, 0)):
                yield f"{k - 1}:{j}:{k}:{i}", 1, rows


def candidates(bits: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the left and right lists whose fingerprints are near and whose sizes allow the similarity.

    Rows are of unequal sets, so sets of equal sizes share a shingle less than they have at most.
    """
    step, (p, q) = max(1, (1 << 19) // max(1, len(right))), bits[:2]
    first, every = (np.where(size < SMALL, *most).astype(np.uint16) for most in (FIRST, ALL))
    for lo in range(0, len(left), step):
        own = left[lo : lo + step]
        apart = np.bitwise_count(p[own, None] ^ p[None, right])
        apart += np.bitwise_count(q[own, None] ^ q[None, right])
        x, y = np.nonzero(apart <= first[own, None])
        a, b = own[x], right[y]
        most = np.minimum(size[a], size[b]) - (size[a] == size[b])
        fit = (most >= similarity * (size[a] + size[b] - most) - 1e-9) & (a != b)
        a, b = a[fit], b[fit]
        near = np.bitwise_count(bits[:, a] ^ bits[:, b]).sum(axis=0, dtype=np.uint16) <= every[a]
        yield a[near], b[near]


def distances(bits: np.ndarray, rows: np.ndarray, point: int) -> np.ndarray:
    """Differing bits of the rows' fingerprints and one row's."""
    return np.bitwise_count(bits[:, rows] ^ bits[:, point][:, None]).sum(axis=0, dtype=np.int16)


def best_ball(bits: np.ndarray, left: np.ndarray, right: np.ndarray, reach: int, tries: int = 4) -> tuple[float, np.ndarray, np.ndarray, int] | None:
    """(pairs left, distances of either side, radius) of the vantage point and radius, of a few rows and all radii, that
    leave the fewest pairs to compare; None if there is nothing to choose."""
    best, radii = None, np.arange(64 * len(bits))
    for point in left[:: max(1, len(left) // tries)][:tries]:
        dl, dr = distances(bits, left, point), distances(bits, right, point)
        sl, sr = np.sort(dl), np.sort(dr)
        near = np.searchsorted(sl, radii, "right")
        work = near * np.searchsorted(sr, radii + reach, "right") + (len(left) - near) * (len(right) - np.searchsorted(sr, radii - reach, "right"))
        k = int(work.argmin())
        if best is None or work[k] < best[0]:
            best = (float(work[k]), dl, dr, int(radii[k]))
    return best


def near_pairs(bits: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float, least: int = 1 << 21, seen: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """candidates() of the left and right rows, found by a vantage-point tree.

    A left row is on one side of a ball; by the triangle inequality a right row's partners are outside the ball if it is
    further from the vantage point than radius and reach together, and inside if it is nearer than radius less reach, so
    right rows whose reach overlaps the boundary go both ways. Cuts that would prune under a thirtieth of the pairs
    are not made. seen collects how many pairs each leaf compares.
    """
    if not len(left) or not len(right):
        return
    if len(left) * len(right) > least:
        reach = ALL[0] if size[left].min() < SMALL else ALL[1]
        work, dl, dr, radius = best_ball(bits, left, right, reach)
        if work < (1 - 1 / 30) * len(left) * len(right):
            near = dl <= radius
            yield from near_pairs(bits, size, left[near], right[dr - reach <= radius], similarity, least, seen)
            yield from near_pairs(bits, size, left[~near], right[dr + reach > radius], similarity, least, seen)
            return
    if seen is not None:
        seen.append(len(left) * len(right))
    yield from candidates(bits, size, left, right, similarity)


def sides(task: str, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k, i, l, j = task.split(":")
    every = np.arange(len(side))
    return (every, every) if (k, i) == (l, j) else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))


def groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, block: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component, t, lead): the least id among the documents that links of that similarity or more reach.

    t is a hash of the text, lead the least one in the component, which tells components apart that have no id or the
    same least id, where one id has several texts. Similarity is Jaccard over sets of word shingles (32-bit hashes in
    the exact check); texts of equal sets are one class, texts without words, null or empty, too. Every pair of classes
    that the sizes allow is searched by fingerprint, in blocks; the classes that have a candidate bring their shingle
    sets to a second round of blocks, where a pair is checked unless links found there already join it. Tasks give
    stars, never pairs. Texts of any length are shingled whole; a tie at the similarity links; a component of null ids
    only has none for a name; repeated rows come back each; other columns are not read; an empty table gives no rows.
    """
    base = 1 / similarity
    marked, _ = written(prints(docs, words, id_col, text_col))
    classes, _ = written(
        marked.groupBy("key", *PRINTS, "size").agg(F.min("id").alias("least"), F.min("t").alias("t")).withColumn("node", F.monotonically_increasing_id())
        .withColumn("shell", F.when(F.col("size") > 0, F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(base)))).otherwise(F.lit(-2)).cast("int"))
    )

    def plan(rows: DataFrame, each: int) -> dict[int, int]:
        """Blocks of each shell; there are under a hundred shells, whatever the input."""
        return {r["shell"]: -(-r["count"] // each) for r in rows.groupBy("shell").count().collect()}

    def block_of(node: np.ndarray, shell: np.ndarray, blocks: dict[int, int]) -> np.ndarray:
        return (mixed(node.view(np.uint64)) >> np.uint64(33)).astype(np.int64) % np.array([blocks.get(int(k), 1) for k in shell], np.int64)

    blocks = plan(classes, block)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            node, bits = pdf["node"].to_numpy(np.int64), pdf[PRINTS].to_numpy(np.int64).T
            size, shell = pdf["size"].to_numpy(np.int64), pdf["shell"].to_numpy(np.int64)
            out = [(t, s, np.stack((node[r], *bits[:, r], size[r])).tobytes()) for t, s, r in tasks(shell, block_of(node, shell, blocks), blocks)]
            yield pd.DataFrame(out, columns=["task", "side", "rows"])

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, np.int64).reshape(2 + len(PRINTS), -1) for x in pdf["rows"]]
        side = np.repeat(pdf["side"].to_numpy(), [x.shape[1] for x in parts])
        node, *bits, size = np.concatenate(parts, axis=1)
        found = np.zeros(len(node), bool)
        left, right = sides(pdf["task"].iloc[0], side)
        for a, b in near_pairs(np.stack(bits).view(np.uint64), size, left, right, similarity):
            found[a] = found[b] = True
        return pd.DataFrame({"node": node[found]})

    some = classes.mapInPandas(deal, "task string, side int, rows binary").groupBy("task").applyInPandas(scan, "node long").distinct()
    picked, _ = written(classes.join(some, "node", "left_semi"))
    texts = only(docs, text_col).toDF("text").withColumn("t", F.xxhash64("text"))
    wanted = picked.select("t", "node", *PRINTS, "size", "shell")
    sent = maybe_in(texts, "t", wanted.select("t"), "_hit").where("_hit").drop("_hit").dropDuplicates(["t"]).join(wanted, "t")
    small = plan(picked, block // 2)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches_by_bytes(batches, "text"):
            sets = [np.unique(np.unique(shingle_hashes(t, words)).astype(np.uint32)).tobytes() for t in pdf["text"]]
            node, shell = pdf["node"].to_numpy(np.int64), pdf["shell"].to_numpy(np.int64)
            for t, s, r in tasks(shell, block_of(node, shell, small), small):
                yield pd.DataFrame({"task": t, "side": s, "node": node[r], **{c: pdf[c].to_numpy()[r] for c in PRINTS}, "size": pdf["size"].to_numpy()[r], "own": [sets[k] for k in r]})

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["node", "side"])
        node, size = pdf["node"].to_numpy(), pdf["size"].to_numpy(np.int64)
        sets, tree = [np.frombuffer(x, np.uint32) for x in pdf["own"]], Forest()
        left, right = sides(pdf["task"].iloc[0], pdf["side"].to_numpy())
        bits = np.stack([pdf[c].to_numpy(np.int64) for c in PRINTS]).view(np.uint64)
        linked: set[int] = set()
        for a, b in near_pairs(bits, size, left, right, similarity):
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                x, y = int(node[i]), int(node[j])
                if x == y or tree.root(x) == tree.root(y):
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                    tree.join(x, y)
                    linked |= {x, y}
        pairs = [(x, r) for x in linked if (r := tree.root(x)) != x]
        return pd.DataFrame(pairs, columns=["a", "b"])

    edges = sent.mapInPandas(spread, "task string, side int, node long, p long, q long, r long, s long, size int, own binary").groupBy("task").applyInPandas(check, "a long, b long")
    parts = connected_components(edges)
    joined = classes.select("key", *PRINTS[:2], "node", "least", "t").join(parts, "node", "left").withColumnRenamed("component", "top")
    alone = joined.where("top is null").select("key", *PRINTS[:2], F.col("least").alias("component"), F.col("t").alias("lead"))
    named = joined.where("top is not null")
    whole, _ = written(named.groupBy("top").agg(F.min("least").alias("component"), F.min("t").alias("lead")))
    names, _ = written(alone.union(named.join(whole, "top").select("key", *PRINTS[:2], "component", "lead")))
    return marked.join(names, ["key", *PRINTS[:2]]).select("id", "component", "t", "lead")


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of each component: that of the least id; each id once.

    An id with several texts stands for one of them: one whose component it is the least id of, if there is one, and
    of several that of the least hash; the components of its other texts go on to their next id. A component that no id
    stands for keeps the row with a null id that has the least hash, if it has any. Ids that no row loses and no row
    repeats pass a small filter and are not shuffled; the rest are joined.
    """
    found, _ = written(groups(docs, words, similarity, id_col=id_col, text_col=text_col))
    first = F.col("id") == F.col("component")
    own, lead = F.when(first, F.col("t")), F.when(first, F.col("lead"))
    ids = found.where("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.coalesce(F.min(own), F.min("t")).alias("t"), F.coalesce(F.min_by(lead, own), F.min_by("lead", "t")).alias("lead"))
    ids, _ = written(ids)
    firsts, _ = written(ids.groupBy("lead").agg(F.min("id").alias("id"), F.min_by("t", "id").alias("t")))
    odd = ids.select("id", "n").join(firsts.select("id", F.lit(True).alias("first")), "id", "left").where("n > 1 or first is null")
    flag, leader, hashed = unused(docs, "_odd"), unused(docs, "_leader"), unused(docs, "_hashed")
    split = maybe_in(docs, id_col, odd.select("id"), flag)
    key, text = F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`"))
    stay = firsts.select(F.col("id").alias(leader), F.col("t").alias(hashed))
    joined = split.where(F.col(flag) & key.isNotNull()).join(stay, (key == F.col(leader)) & (text == F.col(hashed)), "left_semi").dropDuplicates([id_col])
    alone = found.where("id is null").groupBy("lead").agg(F.min("t").alias(leader)).join(firsts.select("lead"), "lead", "left_anti")
    nameless = split.where(key.isNull()).join(alone.select(leader), text == F.col(leader), "left_semi").dropDuplicates([text_col])
    return split.where(~F.col(flag) & key.isNotNull()).union(joined).union(nameless).drop(flag)
