"""Toxicity: character n-grams scaled by naive Bayes log-count ratios under a linear classifier."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import batches_by_bytes, only
from tidelog.llm.linear import fit_logistic, sigmoid

#: n-gram lengths in characters (code points); each has a table of 2^BITS hashed features.
LENGTHS, BITS = (3, 4, 5, 6), 18
WIDTH = len(LENGTHS) << BITS
#: Labelled rows that a model is fitted on, at most; features it keeps, at most. A feature is kept if its log-count
#: ratio is SURE standard errors from 0; if fewer than FEW are, the FEW furthest.
SURE, FEW = 4.0, 512
MAX_TRAIN, MAX_FEATURES = 8192, 16384
_BASE, _SPREAD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def grams(texts: list[object]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length (text, feature) of every n-gram of that many characters.

    Texts are lower-cased and stand between two blanks, null ones are empty; no n-gram reaches over its text's blanks.
    An n-gram's hash is a polynomial of its code points modulo 2^64, spread over its length's table.
    """
    padded = [f" {t.lower() if isinstance(t, str) else ''} " for t in texts]
    sizes = np.array([len(p) for p in padded], np.int64)
    size = int(sizes.sum())
    c = np.zeros(size + max(LENGTHS), np.uint64)
    c[:size] = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner, left = np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(size)
    code, out = np.zeros(size, np.uint64), []
    for k in range(max(LENGTHS)):
        code = code * _BASE + c[k : k + size]
        if k + 1 in LENGTHS:
            i, whole = LENGTHS.index(k + 1), left > k
            out.append((owner[whole], ((code[whole] * _SPREAD) >> np.uint64(64 - BITS)).astype(np.int32) + np.int32(i << BITS)))
    return out


def present(texts: list[object], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each feature that a text has, once; those that keep marks, if given."""
    keys = []
    for owner, f in grams(texts):
        at = slice(None) if keep is None else np.flatnonzero(keep[f])
        keys.append(np.unique(owner[at].astype(np.int64) << 32 | f[at].astype(np.int64)))
    key = np.concatenate(keys)
    return (key >> 32).astype(np.int64), (key & 0xFFFFFFFF).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[object]) -> np.ndarray:
        row, feature = present(texts, self.weights != 0)
        return sigmoid(np.bincount(row, weights=self.weights[feature], minlength=len(texts))[: len(texts)] + self.bias)


def held_out(id_column: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES, l2: float = 3e-3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most max_train labelled rows (the first by a hash of their id) that are not held out.

    Tasks count the classes' documents for each hashed feature; a log-count ratio with add-one smoothing scales each,
    and those that stand out from chance are kept, max_features at most. Without rows of both classes the model is a
    constant, the smoothed share of label 1. A row with several labels counts with each; null labels and null ids are
    left out; labels of absent documents count for the bound only; ties in the order of labels fall by (id, label), of
    features by their number; null and empty texts have the n-grams of an empty text; texts are taken whole; other
    columns are not read; empty tables give a constant.
    """
    spark = docs.sparkSession
    chosen = only(labels, id_col, label_col).toDF("id", "y").where("y is not null").where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id", "y").limit(max_train)
    few = F.broadcast(spark.createDataFrame(chosen.collect(), chosen.schema))  # max_train rows of two numbers
    train = only(docs, id_col, text_col).toDF("id", "text").join(few, "id").selectExpr("id", "text", "cast(y > 0 as int) y")
    ranges = 64

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, n = np.zeros((2, WIDTH), np.int32), np.zeros(2, np.int64)
        for pdf in batches_by_bytes(batches, "text", 1 << 20):
            row, feature = present(list(pdf["text"]))
            y = pdf["y"].to_numpy()
            for c in (0, 1):
                sums[c] += np.bincount(feature[y[row] == c], minlength=WIDTH).astype(np.int32)
                n[c] += int((y == c).sum())
        if n.sum():
            yield pd.DataFrame({"part": range(ranges), "n0": n[0], "n1": n[1], "sums": [np.ascontiguousarray(s).tobytes() for s in np.split(sums, ranges, axis=1)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        q, p = sum(np.frombuffer(s, np.int32).reshape(2, -1).astype(np.int64) for s in pdf["sums"])
        some = np.flatnonzero(p + q >= 5)
        return pd.DataFrame({"feature": some + int(pdf["part"].iloc[0]) * (WIDTH // ranges), "q": q[some], "p": p[some], "n0": int(pdf["n0"].sum()), "n1": int(pdf["n1"].sum())})

    totals = train.select("text", "y").mapInPandas(count, "part int, n0 long, n1 long, sums binary").groupBy("part").applyInPandas(add, "feature long, q long, p long, n0 long, n1 long")
    ratio = F.log((F.col("p") + 1) / (F.col("n1") + 2)) - F.log((F.col("q") + 1) / (F.col("n0") + 2))
    best = totals.withColumn("r", ratio).withColumn("z", F.abs("r") / F.sqrt(1 / (F.col("p") + 1) + 1 / (F.col("q") + 1))).orderBy(F.desc("z"), "feature").limit(max_features).select("feature", "r", "z", "n0", "n1").toPandas()
    best = best[: max(FEW, int((best["z"] >= SURE).sum()))]
    n0, n1 = (int(best[c].iloc[0]) if len(best) else 0 for c in ("n0", "n1"))
    if not n0 or not n1:
        n0, n1 = (train.where(f"y = {c}").count() for c in (0, 1))
        return Model(np.zeros(WIDTH, np.float32), float(np.log((n1 + 1) / (n0 + 1))))
    place = np.full(WIDTH, -1, np.int32)
    place[best["feature"].to_numpy()] = np.arange(len(best))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches_by_bytes(batches, "text", 1 << 20):
            row, feature = present(list(pdf["text"]), place >= 0)
            order = np.argsort(row, kind="stable")
            parts = np.split(place[feature[order]], np.cumsum(np.bincount(row, minlength=len(pdf)))[:-1])
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "has": [np.sort(p).astype(np.int32).tobytes() for p in parts]})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = train.mapInPandas(pick, f"id {kind}, y int, has binary").toPandas().sort_values(["id", "y", "has"], kind="stable")
    has = [np.frombuffer(x, np.int32) for x in rows["has"]]
    r = best["r"].to_numpy()
    cols = np.concatenate(has).astype(np.int64)
    w, bias = fit_logistic(np.repeat(np.arange(len(has)), [len(x) for x in has]), cols, r[cols], rows["y"].to_numpy(float), len(r), l2, 150, 0.05)
    weights = np.zeros(WIDTH, np.float32)
    weights[best["feature"].to_numpy()] = w * r
    return Model(weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): every whole text's chance of label 1, a row each. Null and empty texts score as an empty text does;
    null ids and repeated rows come back as they came, equal texts have equal scores; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH floats, whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches_by_bytes(batches, "text"):
            yield pd.DataFrame({"id": pdf["id"], "score": shared.value.scores(list(pdf["text"]))})

    kind = docs.schema[id_col].dataType.simpleString()
    return only(docs, id_col, text_col).toDF("id", "text").mapInPandas(run, f"id {kind}, score double")
