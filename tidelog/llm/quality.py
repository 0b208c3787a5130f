"""Quality: heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Hashes, batches_by_bytes, only, sliced, utf8
from tidelog.llm.linear import fit_logistic, sigmoid

#: Documents whose features the scorer is fitted on, about, at most.
MAX_TRAIN = 4096
#: Hashed features: classes of 4 bytes in a row, then pairs of word shapes.
CHAR, PAIR = 1 << 16, 1 << 16
WIDTH = CHAR + PAIR
LABELLERS = ("symbols", "repeats", "lines", "capitals", "length", "stops", "short_words", "word_length", "variety")

_CLASS = np.zeros(256, np.uint8)
_CLASS[128:] = 3
for _set, _class in ((b" \t\r\x0b\x0c", 1), (b"\n", 2), (bytes(range(97, 123)), 3), (bytes(range(65, 91)), 4), (bytes(range(48, 58)), 5), (b".", 6), (b",", 7), (b";:?'\"-()/@_", 8), (b"!", 9), (b"#", 10), (b"$", 11), (b"%", 12), (b"&", 13), (b"*+=<>^~\\`[]{}", 14), (b"|", 15)):
    _CLASS[np.frombuffer(_set, np.uint8)] = _class


def _vote(value: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, 0, np.where(good, 1, 2)).astype(np.int8)


class Batch:
    """Byte and word arrays of a few texts, from which votes and features are taken."""

    def __init__(self, texts: list[bytes]) -> None:
        self.n = n = len(texts)
        padded = [t + b"\n\n\n\n" for t in texts]
        b = np.frombuffer(b"".join(padded), np.uint8)
        sizes = np.array([len(p) for p in padded], np.int64)
        self.owner = np.repeat(np.arange(n), sizes)
        self.cls = cls = _CLASS[b]
        blank = (cls == 1) | (cls == 2)
        edge = np.diff(np.concatenate(([True], blank)).astype(np.int8))
        self.start, self.stop = start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.hash_of = Hashes(b).of
        self.word_owner = self.owner[start]
        self.words = np.bincount(self.word_owner, minlength=n)
        self.bytes = sizes - 4
        whole = self.hash_of(start, stop)
        size = stop - start
        same = np.zeros(len(start), bool)
        same[1:] = (whole[1:] == whole[:-1]) & (size[1:] == size[:-1]) & (self.word_owner[1:] == self.word_owner[:-1])
        tally = lambda mask: np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        upper, lower, odd = tally(cls == 4), tally(cls == 3), tally(cls >= 9)
        self.upper, self.lower, self.odd = (np.diff(x[np.concatenate(([0], np.cumsum(sizes)))]) for x in (upper, lower, odd))
        uppers, lowers, odds = (x[stop] - x[start] for x in (upper, lower, odd))
        last = cls[stop - 1]
        self.same, self.size, self.letters, self.whole = same, size, uppers + lowers, whole
        self.stopped = (last == 6) | (last == 7)
        self.shape = (
            np.digitize(size, (4, 7, 11))
            | (cls[start] == 4).astype(np.int64) << 2
            | ((uppers >= 2) & (lowers == 0)).astype(np.int64) << 3
            | np.where(last <= 4, 0, np.where(last == 6, 1, np.where(last == 7, 2, 3))) << 4
            | (odds > 0).astype(np.int64) << 6
            | same.astype(np.int64) << 7
            | (self.letters == 0).astype(np.int64) << 8
        )
        self.breaks = np.flatnonzero(cls == 2)
        self.inner = np.ones(len(cls), bool)  # where four bytes in a row are all of one text and its padding
        self.inner[(np.cumsum(sizes)[:, None] - np.arange(1, 4)).ravel()] = False

    def _distinct_pairs(self, together: np.ndarray) -> np.ndarray:
        """How many different pairs of neighbouring words each text has."""
        owner = self.word_owner[1:][together].astype(np.uint64)
        code = (self.whole[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + self.whole[1:] * np.uint64(0x165667B19E3779F9))[together]
        code = (code ^ code >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)  # upper bits that all bytes decide
        code = np.sort(code >> np.uint64(20) | owner << np.uint64(44))  # 44 bits of hash behind the text's number
        new = np.concatenate(([True], code[1:] != code[:-1])) if len(code) else np.zeros(0, bool)
        return np.bincount((code[new] >> np.uint64(44)).astype(np.int64), minlength=self.n)

    def votes(self) -> np.ndarray:
        """(texts, labellers): 1 good, 0 bad, 2 abstains."""
        words, per = np.maximum(self.words, 1), lambda mask: np.bincount(self.word_owner[mask], minlength=self.n)
        letters = np.maximum(self.upper + self.lower, 1)
        odd, same = self.odd / np.maximum(self.bytes, 1), per(self.same) / words
        caps, stops = self.upper / letters, per(self.stopped) / words
        short, mean = per((self.size <= 3) & (self.letters > 0)) / words, np.bincount(self.word_owner, weights=self.size, minlength=self.n) / words
        begin = np.concatenate(([0], self.breaks + 1))[:-1]
        real = self.breaks > begin
        begin, end = begin[real], self.breaks[real]
        who = self.owner[begin]
        lines = np.bincount(who, minlength=self.n)
        key = np.lexsort((self.hash_of(begin, end), who))
        h, o = self.hash_of(begin, end)[key], who[key]
        again = np.concatenate(([False], (h[1:] == h[:-1]) & (o[1:] == o[:-1]))) if len(h) else np.zeros(0, bool)
        repeated = np.bincount(o[again], minlength=self.n) / np.maximum(lines, 1)
        enough = self.words >= 20
        together = self.word_owner[1:] == self.word_owner[:-1]
        distinct = self._distinct_pairs(together)
        fresh = distinct / np.maximum(self.words - 1, 1)
        return np.stack(
            [
                _vote(odd, odd < 0.01, odd > 0.04),
                _vote(same, enough & (same < 0.03), (self.words >= 3) & (same > 0.2)),
                _vote(repeated, (lines >= 3) & (repeated < 0.1), (lines >= 3) & (repeated > 0.4)),
                _vote(caps, caps < 0.15, (letters >= 8) & (caps > 0.4)),
                _vote(words, self.words >= 30, self.words < 1),
                _vote(stops, enough & (stops > 0.03) & (stops < 0.5), enough & (stops < 0.01)),
                _vote(short, enough & (short > 0.15), enough & (short < 0.05)),
                _vote(mean, (self.words > 0) & (mean >= 2.5) & (mean <= 9), (mean > 14) | ((self.words > 0) & (mean < 1.5))),
                _vote(fresh, (self.words >= 6) & (fresh > 0.8), (self.words >= 6) & (fresh < 0.5)),
            ],
            axis=1,
        )

    def features(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, feature, weight) arrays of the hashed features: shares of a text's bytes and of its words, damped for short texts."""
        c = np.concatenate((self.cls, np.zeros(3, np.uint8))).astype(np.int32)
        size = len(self.cls)
        four = (c[:size] << 12 | c[1 : size + 1] << 8 | c[2 : size + 2] << 4 | c[3 : size + 3])[self.inner]
        before = np.concatenate(([511], self.shape[:-1])) if len(self.shape) else self.shape
        if len(self.shape):
            before[np.concatenate(([True], self.word_owner[1:] != self.word_owner[:-1]))] = 511
        pair = CHAR + (((before << 9 | self.shape) * 40503 >> 4) & (PAIR - 1))
        alone = CHAR + (((510 << 9 | self.shape) * 40503 >> 4) & (PAIR - 1))
        return [(self.owner[self.inner], four, 1 / (self.bytes + 32)), (self.word_owner, pair, 1 / (self.words + 8)), (self.word_owner, alone, 1 / (self.words + 8))]


@dataclass
class LabelModel:
    """Shares of the classes (bad, good) and chances of each labeller's votes (bad, good) in each."""

    prior: np.ndarray
    chance: np.ndarray  # class, labeller, vote

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The chance that a text is good, for rows of votes."""
        table = np.concatenate((np.log(self.chance), np.zeros_like(self.chance[:, :, :1])), axis=2)  # who abstains says nothing
        logs = np.log(self.prior)[None, :] + sum(table[:, j, votes[:, j]].T for j in range(votes.shape[1]))
        return sigmoid(logs[:, 1] - logs[:, 0])


def fit_labels(patterns: np.ndarray, counts: np.ndarray, steps: int = 200) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns and how many texts have each.

    A labeller looks for one kind of fault, so it starts out as one that sees a quarter of the bad texts and blames one
    good text in 200. Counts are smoothed towards that, so the model stays defined on any input.
    """
    j = patterns.shape[1]
    start = np.tile(np.array([[0.25, 0.75], [0.005, 0.995]])[:, None, :], (1, j, 1))
    model, weight = LabelModel(np.array([0.15, 0.85]), start), max(2.0, 0.002 * float(counts.sum()))
    for _ in range(steps if len(counts) else 0):
        good = model.posterior(patterns)
        mass = np.stack([(1 - good) * counts, good * counts])
        chance = np.stack([mass @ (patterns == v) for v in (0, 1)], axis=2) + weight * start
        chance /= chance.sum(axis=2, keepdims=True)
        prior = (mass.sum(axis=1) + 1) / (counts.sum() + 2)
        done = np.abs(chance - model.chance).max() < 1e-7
        model = LabelModel(prior, chance)
        if done:
            break
    return model


@dataclass
class Scorer:
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Votes, posterior and score of each text; a text without words scores 0."""
        batch = Batch(texts)
        margin = np.full(batch.n, self.bias)
        for who, feature, share in batch.features():
            margin += np.bincount(who, weights=self.weights[feature], minlength=batch.n) * share
        votes = batch.votes()
        return votes, self.labels.posterior(votes), np.where(batch.words > 0, sigmoid(margin), 0.0)


def fit(docs: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Votes of all documents give the label model; about max_train documents, chosen by hash, give the scorer.

    A text has at most WIDTH features, so what the driver gathers is bounded too, however long texts are. Null texts are
    empty and vote as such; equal texts are chosen together or not at all if their ids are equal; other columns are not
    read; without documents the label model is its prior and the scorer a constant.
    """
    texts = only(docs, id_col, text_col).toDF("id", "text")

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches_by_bytes(batches, "text"):
            keys, n = np.unique(Batch([utf8(t) for t in pdf["text"]]).votes() @ (3 ** np.arange(len(LABELLERS))), return_counts=True)
            yield pd.DataFrame({"pattern": keys, "n": n})

    seen = texts.select("text").mapInPandas(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas()  # 3^9 rows at most
    patterns = seen["pattern"].to_numpy(np.int64)[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    model = fit_labels(patterns, seen["n"].to_numpy(float))
    share = min(1.0, max_train / max(1, int(seen["n"].sum())))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches_by_bytes(batches, "text"):
            batch = Batch([utf8(t) for t in pdf["text"]])
            rows, cols, vals = [], [], []
            for who, feature, part in batch.features():
                key, n = np.unique(who.astype(np.int64) << 20 | feature, return_counts=True)
                rows.append(key >> 20)
                cols.append(key & ((1 << 20) - 1))
                vals.append(n * part[key >> 20])
            rows, cols, vals = map(np.concatenate, (rows, cols, vals))
            order = np.argsort(rows, kind="stable")
            cut = np.cumsum(np.bincount(rows, minlength=batch.n))[:-1]
            yield pd.DataFrame({"order": pdf["order"], "good": model.posterior(batch.votes()), "cols": [x.astype(np.int32).tobytes() for x in np.split(cols[order], cut)], "vals": [x.astype(np.float32).tobytes() for x in np.split(vals[order], cut)]})

    sample = texts.withColumn("order", F.xxhash64("id", "text")).where(F.pmod(F.col("order"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else texts.withColumn("order", F.xxhash64("id", "text"))
    rows = sample.select("order", "text").mapInPandas(pick, "order long, good double, cols binary, vals binary").toPandas().sort_values(["order", "good"], kind="stable")
    weights, bias = np.zeros(WIDTH), 0.0
    if len(rows):
        cols = [np.frombuffer(x, np.int32) for x in rows["cols"]]
        at = np.repeat(np.arange(len(cols)), [len(x) for x in cols])
        cols, vals = np.concatenate(cols).astype(np.int64), np.concatenate([np.frombuffer(x, np.float32) for x in rows["vals"]]).astype(float)
        support = np.bincount(cols, minlength=WIDTH)
        scale = np.where(support >= max(2, len(rows) // 1000), 1 / np.sqrt(np.bincount(cols, weights=vals * vals, minlength=WIDTH) / len(rows) + 1e-6), 0)
        live = scale[cols] > 0
        weights, bias = fit_logistic(at[live], cols[live], vals[live] * scale[cols[live]], rows["good"].to_numpy(), WIDTH, 1e-3, 200, 0.02)
        weights = weights * scale
    return Scorer(model, weights.astype(np.float32), bias)


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, votes, posterior, score, keep), a row for each document; votes has a letter for each labeller: g, b or -.

    Null and empty texts, and those without words, have score 0 and are not kept; a score at the threshold is; texts of
    any length are read whole; null ids and repeated rows come back as often as they came, equal texts with equal scores;
    other columns are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # WIDTH floats, whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches_by_bytes(batches, "text"):
            votes, posterior, got = shared.value([utf8(t) for t in pdf["text"]])
            yield pd.DataFrame({"id": pdf["id"], "votes": ["".join("bg-"[v] for v in row) for row in votes], "posterior": posterior, "score": got, "keep": got >= threshold})

    kind = docs.schema[id_col].dataType.simpleString()
    return only(docs, id_col, text_col).toDF("id", "text").mapInPandas(run, f"id {kind}, votes string, posterior double, score double, keep boolean")


def kept(docs: DataFrame, scorer: Scorer, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that the scorer keeps, all columns as they are, whatever their names. Nulls, long texts, ties,
    repeated rows and empty tables are as in score()."""
    shared, at = docs.sparkSession.sparkContext.broadcast(scorer), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, at):
                yield part.filter(pa.array(shared.value([utf8(t) for t in part.column(at).to_pylist()])[2] >= threshold))

    return docs.mapInArrow(run, docs.schema)
