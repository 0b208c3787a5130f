"""Near-duplicate vectors by p-stable (Gaussian) Euclidean hashing in several tables and exact cosine checks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import connected_components, only, written
from tidelog.llm.simhash import stars


def collide(width: float, distance: float) -> float:
    """The chance that a quantised Gaussian projection puts two vectors at that distance into one cell."""
    x = width / distance
    return math.erf(x / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


@dataclass(frozen=True)
class Plan:
    """Projections a table, tables and cell width."""

    projections: int
    tables: int
    width: float
    seed: int = 7

    @staticmethod
    def for_rows(n: int, threshold: float = 0.95, recall: float = 0.999, width: float = 2.0, crowd: int = 48) -> Plan:
        """As many projections as leave about `crowd` unrelated vectors in a bucket, and as many tables as find a pair
        just at the threshold with chance `recall`; both grow with the logarithm of n or slower than n."""
        near, far = collide(width, math.sqrt(2 - 2 * threshold)), collide(width, math.sqrt(2))
        k = max(6, math.ceil(math.log(max(n, 2) / crowd) / -math.log(far)))
        return Plan(k, math.ceil(math.log(1 - recall) / math.log(1 - near**k)), width)

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """(n, tables) bucket codes of unit vectors, as 32-bit hashes of their cells."""
        rng = np.random.default_rng([self.seed, unit.shape[1]])
        total = self.projections * self.tables
        lines, shifts = rng.standard_normal((unit.shape[1], total)), rng.random(total) * self.width
        mix = rng.integers(1, 2**63, total, dtype=np.uint64) | np.uint64(1)
        out = np.empty((len(unit), self.tables), np.int32)
        for lo in range(0, len(unit), 2048):
            cells = np.floor((unit[lo : lo + 2048] @ lines + shifts) / self.width).astype(np.int64).view(np.uint64)
            sums = ((cells + np.uint64(0x632BE59BD9B4E019)) * mix).reshape(len(cells), self.tables, -1).sum(axis=2, dtype=np.uint64)
            out[lo : lo + 2048] = (sums >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return out


def near_vectors(vectors: DataFrame, threshold: float = 0.95, block: int = 512, plan: Plan | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component, kept), a row for each row of vectors, whatever its length and however often its id comes.

    Vectors link at a cosine of `threshold` or more, in double precision; those that are null, empty, zero or hold null
    or non-finite components link with nothing. Bitwise equal vectors are one class with a count and link with each
    other. Classes meet in hash buckets (plan, or one that grows with their number); a bucket of more than `block`
    members is cut into blocks, and pairs of blocks meet in tasks of their own, so that any bucket is compared whole in
    bounded memory. A pair counts in the first table where it meets. Links come back as counts and stars, never as
    pairs. Classes are numbered, and numbers turn into ids at the end only, so an id with several vectors stands for each
    of them. Vectors of different lengths never link; a null id forms no link with others and is its own component;
    repeated rows are copies of each other; a tie at the threshold links; other columns are not read; an empty table
    gives no rows.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            packed = []
            for v in pdf["v"]:
                x = None if v is None else np.array([np.nan if y is None else y for y in v] if getattr(v, "dtype", None) == object or isinstance(v, list) else v, np.float64)
                with np.errstate(over="ignore"):
                    ok = x is not None and len(x) and np.isfinite(x).all() and 0 < float(np.sqrt((x * x).sum())) < np.inf
                packed.append(x.tobytes() if ok else None)
            yield pd.DataFrame({"id": pdf["id"], "v": pd.Series(packed, dtype=object)})

    ids = vectors.schema[id_col].dataType.simpleString()
    all_rows, _ = written(only(vectors, id_col, vec_col).toDF("id", "v").mapInPandas(pack, f"id {ids}, v binary"))
    classes, _ = written(all_rows.where("v is not null and id is not null").groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("m")).withColumn("node", F.monotonically_increasing_id()))
    count = classes.count()
    use = plan or Plan.for_rows(count, threshold)
    shared = max(64, count * use.tables // 8192)  # tasks that the small buckets are dealt over

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lengths = pdf["v"].map(len).to_numpy(np.int64)
            for length in np.unique(lengths):
                own = pdf[lengths == length]
                x = np.frombuffer(b"".join(own["v"]), np.float64).reshape(len(own), -1)
                codes = use.codes(x / np.sqrt((x * x).sum(axis=1))[:, None])
                yield pd.DataFrame({"node": own["node"], "m": own["m"], "v": own["v"], "codes": [c.tobytes() for c in codes], "h": list(codes)})

    coded, _ = written(classes.mapInPandas(code, "node long, m long, v binary, codes binary, h array<int>"))
    keys = coded.select("node", F.octet_length("v").alias("len"), F.posexplode("h").alias("t", "h"))
    crowds = keys.groupBy("t", "h", "len").agg(F.count("*").alias("c")).where("c > 1")
    cells = (
        keys.join(crowds, ["t", "h", "len"])
        .withColumn("parts", F.expr(f"cast((c + {block - 1}) div {block} as int)"))
        .withColumn("part", F.pmod(F.hash("node"), F.col("parts")))
        .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
        .select("node", "t", "h", "len", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
        .withColumn("cell", F.when(F.col("j") == 0, F.concat(F.lit("p"), F.pmod(F.hash("t", "h", "len"), F.lit(shared)))).otherwise(F.concat_ws(":", "t", "h", "len", "i", "j")))
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, n = [], [], []
        for (t, _, _, i, j), own in pdf.groupby(["t", "h", "len", "i", "j"], sort=False):
            x = np.frombuffer(b"".join(own["v"]), np.float64).reshape(len(own), -1)
            x = x / np.sqrt((x * x).sum(axis=1))[:, None]
            codes = np.frombuffer(b"".join(own["codes"]), np.int32).reshape(len(own), -1)
            part, m, who = own["part"].to_numpy(), own["m"].to_numpy(), own["node"].to_numpy()
            near = np.triu(x @ x.T >= threshold, 1)
            if i != j:
                near &= part[:, None] != part[None, :]
            p, q = np.nonzero(near)
            new = ~(codes[p, :t] == codes[q, :t]).any(axis=1)
            p, q = p[new], q[new]
            if not len(p):
                continue
            count = np.zeros(len(own), np.int64)
            np.add.at(count, p, m[q])
            np.add.at(count, q, m[p])
            node, root = stars(p, q)
            least = np.arange(len(own))
            least[node] = root
            some = np.flatnonzero(count)
            a.append(who[some])
            b.append(who[least[some]])
            n.append(count[some])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "n": np.concatenate(n)} if a else {"a": [], "b": [], "n": []})

    found, _ = written(cells.join(coded.select("node", "m", "v", "codes"), "node").groupBy("cell").applyInPandas(compare, "a long, b long, n long"))
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    parts = connected_components(found).withColumnRenamed("component", "top")
    named, _ = written(classes.join(counts, "node", "left").join(parts, "node", "left").select("v", "least", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("top", "node").alias("top")))
    whole, _ = written(named.groupBy("top").agg(F.min("least").alias("component")))
    linked = all_rows.where("v is not null and id is not null").join(named.join(whole, "top").select("v", "n_links", "component"), "v").select("id", "n_links", "component")
    alone = all_rows.where("v is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.union(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component")))
