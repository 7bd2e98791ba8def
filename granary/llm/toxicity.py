"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

A linear classifier over hashed word features is trained in numpy from confirmed toxic texts (positives) and
unlabelled texts, a sample of all training rows whatever is said about them, as the estimate asks for. With class prior p, positives' risks R+ and R-, and the unlabelled texts' negative risk U-, the
estimate p R+ + max(0, U- - p R-) is minimised; where the bracket turns negative, the step climbs out of it instead,
so that a flexible model can't push the risk of what it takes for negatives below zero. The class prior is the share of
toxic rows among the labelled rows of the training folds: the only use of labels other than toxic. Features are those
whose frequencies in positives and in unlabelled texts differ significantly, in either direction. Fitting uses a bounded sample (`POSITIVES`, `UNLABELLED` texts); scoring reads every
whole text in one pass without a shuffle.

Defined results: null and empty texts have no features and get the bias' score; held-out rows are never learnt from, nor
are rows without a doc_id, whose held_out is null; repeated rows are scored alike; without a positive label every score is 0; an empty table gives an empty table;
columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import fold_of, table

POSITIVES, UNLABELLED = 3000, 6000
FOLDS, HELD_OUT, BAR = 3, 1, 0.7
BITS, ROUNDS, RATE, DECAY = 20, 300, 0.05, 1e-4
#: Beginnings of words, in bytes, that are features beside the words.
PREFIXES = (5, 6, 7, 8)
#: Features count if they occur in so many texts of the sample, and their shares in the two classes differ by so many standard errors.
LEAST_TEXTS, LEAST_Z = 4, 5
CACHE_ENTRIES = 400_000


def word_features(word: str) -> tuple[int, ...]:
    """The hashed word (lower case, without the punctuation around it) and its hashed beginnings."""
    bare = word.lower().strip(".,;:!?\"'()[]{}*#$%&|<>").encode("utf-8")
    if not bare:
        return ()
    heads = [b"^" + bare[:n] for n in PREFIXES if len(bare) > n]
    return tuple(zlib.crc32(x) & ((1 << BITS) - 1) for x in [bare, *heads])


class Hasher(dict):
    """word -> features; forgets everything when full."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = got = self.made(word)
        return got

    def made(self, word: str) -> tuple[int, ...]:
        return word_features(word)


class Weighed(Hasher):
    """word -> those of its features that have a weight."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights = weights

    def made(self, word: str) -> tuple[int, ...]:
        return tuple(f for f in word_features(word) if self.weights[f])


def features_of(text: str | None, hashed: Hasher) -> set[int]:
    return set().union(*map(hashed.__getitem__, set((text or "").split())))


class Rows:
    """Binary sparse rows."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.n = len(rows)
        self.sizes = np.array([len(r) for r in rows], dtype=np.int64)
        self.columns = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def times(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(w[self.columns])])
        return total[self.starts + self.sizes] - total[self.starts]

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.columns, weights=np.repeat(g, self.sizes), minlength=width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, width: int, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss (Adam, whole sample at a time)."""
    p, u = Rows(positive), Rows(unlabelled)
    w, bias = np.zeros(width), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, rounds + 1):
        zp, zu = p.times(w) + bias, u.times(w) + bias
        sp, su = sigmoid(zp), sigmoid(zu)
        negative_part = float(np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp)))
        # derivatives by the logit: of log(1 + e^-z) s - 1, of log(1 + e^z) s
        gp_plus, gp_minus, gu = prior * (sp - 1) / p.n, -prior * sp / p.n, su / u.n
        gp, gz = (gp_plus + gp_minus, gu) if negative_part >= 0 else (-gp_minus, -gu)
        grad = p.back(gp, width) + u.back(gz, width) + DECAY * w
        gb = float(gp.sum() + gz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= RATE * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        bias -= RATE * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, bias


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """The features whose shares in positives and unlabelled texts differ by LEAST_Z standard errors or more."""
    count = lambda rows: np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *rows]), minlength=1 << BITS)
    p, u = count(positive), count(unlabelled)
    pooled = (p + u) / (len(positive) + len(unlabelled))
    error = np.sqrt(pooled * (1 - pooled) * (1 / len(positive) + 1 / max(1, len(unlabelled)))) + 1e-12
    return np.flatnonzero((p + u >= LEAST_TEXTS) & (np.abs(p / len(positive) - u / max(1, len(unlabelled))) >= LEAST_Z * error))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> tuple[np.ndarray, float] | None:
    """Weights by feature and bias, from training folds; None without a positive.

    prior is the share of toxic texts among all; by default that among the labels of training folds.
    """
    learn = fold_of(F.col("doc_id"), FOLDS) != HELD_OUT
    said = labels.where(learn & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = said.agg(F.sum("toxic"), F.count("*")).first()
    if not count[0]:
        return None
    if prior is None:
        # labels that are toxic without exception leave less than one other in twice as many
        prior = min(count[0] / count[1], 1 - 1 / (2 * count[1]))
    n_docs = docs.count()
    order = F.xxhash64(F.col("doc_id"), F.lit(7))

    def sampled(rows: DataFrame, n: int, of: int) -> DataFrame:
        share = min(1.0, 1.2 * n / max(1, of))
        return rows.where(order <= int(-(2**63) + share * (2**64 - 1))) if share < 1 else rows

    toxic_ids = sampled(said.where("toxic = 1"), positives, count[0]).select("doc_id").orderBy(F.xxhash64("doc_id")).limit(positives)
    texts = docs.select("doc_id", "text")
    some = sampled(texts.where(learn), unlabelled, n_docs).limit(2 * unlabelled)
    kinds = texts.join(F.broadcast(toxic_ids), "doc_id").select(F.lit(1).alias("toxic"), "text").unionByName(some.select(F.lit(0).alias("toxic"), "text"))

    def hashed(batches):
        words = Hasher()
        for batch in batches:
            rows = [sorted(features_of(t, words)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, type=pa.list_(pa.int32()))], names=["toxic", "f"])

    got = kinds.mapInArrow(hashed, "toxic int, f array<int>").toArrow()
    toxic = got["toxic"].to_numpy()
    rows = [np.array(x, dtype=np.int64) for x in got["f"].to_pylist()]
    if not toxic.any():
        return None
    positive, others = [r for r, y in zip(rows, toxic) if y], [r for r, y in zip(rows, toxic) if not y]
    place = np.full(1 << BITS, -1)
    kept = telling(positive, others)
    place[kept] = np.arange(len(kept))
    w, bias = train(*[[place[r][place[r] >= 0] for r in own] for own in (positive, others)], prior, len(kept))
    full = np.zeros(1 << BITS, dtype=np.float32)
    full[kept] = w
    return full, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """doc_id and score (the probability of being toxic) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        hashed = Weighed(own[0]) if own else Hasher()
        for batch in batches:
            if own is None:
                got = np.zeros(batch.num_rows)
            else:
                logits = [own[1] + float(own[0][list(f)].sum()) if (f := features_of(t.as_py(), hashed)) else own[1] for t in batch.column(1)]
                got = sigmoid(np.array(logits, dtype=np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, type=pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = score(docs, fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return got.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= BAR).cast("int").alias("predicted"))
