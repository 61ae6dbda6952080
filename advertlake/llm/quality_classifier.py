"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent.

Features of a text are its words, the character 3- and 4-grams of <word>, and its word bigrams, each hashed to a row of a table of learned
vectors; a bigram of a word with itself backs off to one row of its own, so that repetition is learned whatever word it is of. A document is the
mean of its feature vectors, and a softmax over two classes gives the probability of label 1. The bias is the log odds of the labels. A document
of n distinct features moves each of its vectors by sqrt(n) times the plain gradient step, since the mean gives each of them a share of 1 / n.
Because the output is linear in the mean, a trained model is one number per hash row (weight of class 1 minus class 0) and a bias: scoring is a
sum over words, each computed once per worker, and over bigrams, and needs neither the text's prefix nor a cap. A null or empty text has no
features and scores the bias. Documents that repeat get equal scores. With no usable label, or only one class, the score is the smoothed share of
label 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advertlake.llm.common import mix, powers

_GRAMS = (3, 4)
_OPEN, _CLOSE = 0x110001, 0x110002


def word_features(words: list[str], rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash rows of the features of all words, for each feature the number of its word, and a 64-bit hash of each word."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    stop = np.cumsum(size)
    start = stop - size
    chars = np.empty(int(stop[-1]) if len(stop) else 0, np.uint64)
    inner = np.ones(len(chars), bool)
    inner[start] = inner[stop - 1] = False
    chars[start], chars[stop - 1] = _OPEN, _CLOSE
    chars[inner] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    chars += np.uint64(1)
    n = len(chars)
    up, down = powers(n + 1)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(chars) * up[:n], out=s[1:])
    left = np.repeat(stop, size) - np.arange(n)
    found, owner = [mix((s[stop] - s[start]) * down[start] ^ np.uint64(7))], [np.arange(len(words))]
    who = np.repeat(np.arange(len(words)), size)
    for g in _GRAMS:
        at = np.flatnonzero(left >= g)
        found.append(mix((s[at + g] - s[at]) * down[at] + np.uint64(g)))
        owner.append(who[at])
    return (np.concatenate(found) % np.uint64(rows)).astype(np.int64), np.concatenate(owner), found[0]


def bigram_rows(words: np.ndarray, rows: int) -> np.ndarray:
    """Hash rows of the bigrams of a text's word hashes; row `rows`, behind the hashed ones, stands for a word that repeats the one before."""
    a, b = words[:-1], words[1:]
    return np.where(a == b, rows, (mix(a * np.uint64(0x9E3779B97F4A7C15) + b) % np.uint64(rows)).astype(np.int64))


@dataclass
class Model:
    weights: np.ndarray  # per hash row: vector @ (softmax weights of class 1 - class 0)
    bias: float


def text_features(text: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hash rows of a text and how often each occurs."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, _, whole = word_features(words, rows)
    return np.unique(np.concatenate([ids, bigram_rows(whole, rows)]), return_counts=True)


def learn(texts: list[str], labels: list[int], rows: int, dim: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors (rows + 1, dim), softmax weights (2, dim) and biases (2) by SGD, a document per step; their order comes from the arguments alone."""
    ones = sum(labels)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (rows + 1, dim)).astype(np.float32)
    out = rng.uniform(-1 / dim, 1 / dim, (2, dim)).astype(np.float32)
    bias = np.array([0.0, math.log((ones + 1) / (len(labels) - ones + 1))], np.float32)
    docs = [text_features(t, rows) for t in texts]
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, n = docs[i]
            step = rate * (1 - done / steps)
            done += 1
            if not len(ids):
                continue
            share = (n / n.sum()).astype(np.float32)
            mean = share @ vectors[ids]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ out
            out -= step * np.outer(p, mean)
            vectors[ids] -= (step * share)[:, None] * back * len(ids) ** 0.5
    return vectors, out, bias


def train(texts: list[str], labels: list[int], rows: int = 1 << 17, dim: int = 12, steps: int = 12000, rate: float = 0.5, seed: int = 11) -> Model:
    """The model that learn() gives after about `steps` steps (4 to 16 epochs), folded into one number per hash row."""
    ones = sum(labels)
    if not ones or ones == len(labels):
        return Model(np.zeros(rows + 1, np.float32), math.log((ones + 1) / (len(labels) - ones + 1)))
    vectors, out, bias = learn(texts, labels, rows, dim, min(16, max(4, steps // len(texts))), rate, seed)
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    """Scores texts with a model; keeps the sums of known words, up to `memory` of them."""

    def __init__(self, model: Model, memory: int = 400_000):
        self.model, self.memory, self.rows = model, memory, len(model.weights) - 1
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sums, self.counts, self.hashes = np.zeros(1 << 12), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.uint64)

    def learn(self, new: list[str]) -> None:
        ids, who, whole = word_features(new, self.rows)
        at, z = len(self.known), len(self.known) + len(new)
        while z > len(self.sums):
            self.sums, self.counts, self.hashes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.counts, self.hashes))
        self.sums[at:z] = np.bincount(who, weights=self.model.weights[ids], minlength=len(new))
        self.counts[at:z] = np.bincount(who, minlength=len(new))
        self.hashes[at:z] = whole
        self.known.update(zip(new, range(at, z), strict=True))

    def score(self, texts: list[str | None]) -> list[float]:
        out: list[float] = []
        at = 0
        while at < len(texts):
            words, held = [], 0
            while at < len(texts) and (not words or held < 1 << 21):
                t = texts[at] or ""
                words.append(t.split())
                held += len(t)
                at += 1
            fresh = set().union(*words).difference(self.known)
            if len(self.known) + len(fresh) > self.memory:
                self.forget()
                fresh = set().union(*words)
            if fresh:
                self.learn(sorted(fresh))
            size = np.fromiter(map(len, words), np.int64, len(words))
            ids = np.fromiter((self.known[w] for own in words for w in own), np.int64, int(size.sum()))
            owner = np.repeat(np.arange(len(words)), size)
            inner = owner[1:] == owner[:-1]
            pairs = self.model.weights[bigram_rows(self.hashes[ids], self.rows)[inner]] if len(ids) else np.zeros(0)
            total = np.bincount(owner, weights=self.sums[ids], minlength=len(words)) + np.bincount(owner[1:][inner], weights=pairs, minlength=len(words))
            n = np.bincount(owner, weights=self.counts[ids], minlength=len(words)) + np.maximum(size - 1, 0)
            z = self.model.bias + total / np.maximum(n, 1)
            out += (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()
        return out


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the rows whose crc32(doc_id as text) mod folds is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 3000) -> Model:
    """A model from the labelled documents; of more than max_rows (the documented bound of the sample), those first by the hash of their doc_id; of texts that
    share a doc_id, the first by its hash."""
    own = labels.filter("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y"))
    own = own.groupBy("_id").agg(F.max("_y").alias("_y"), F.min("_y").alias("_l")).filter("_y = _l").drop("_l")
    picked = own.orderBy(F.xxhash64("_id"), "_id").limit(max_rows).collect()  # at most max_rows numbers
    if not picked:
        return train([], [])
    y = {r["_id"]: r["_y"] for r in picked}
    ids = docs.sparkSession.createDataFrame(pd.DataFrame({"_id": list(y)}))
    got = docs.select(F.col("doc_id").alias("_d"), F.coalesce("text", F.lit("")).alias("_t"))
    got = got.join(F.broadcast(ids), F.col("_d") == F.col("_id"), "left_semi")
    got = got.groupBy("_d").agg(F.min_by("_t", F.struct(F.xxhash64("_t"), F.col("_t"))).alias("_t")).collect()
    got.sort(key=lambda r: r["_d"])
    return train([r["_t"] for r in got], [y[r["_d"]] for r in got])


def quality_score(text: Column, model: Model) -> Column:
    """Probability of label 1 (0 to 1), also for null and empty texts."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Scorer(model)
        for texts in batches:
            yield pd.Series(own.score(texts.tolist()), dtype="float64")

    return score(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, max_rows: int = 3000) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted (1 if score >= threshold). Held-out labels are not learned from."""
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"), folds)), max_rows)
    got = docs.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), quality_score(F.col("text"), model).alias("score"))
    return got.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, max_rows: int = 3000) -> DataFrame:
    """The documents, with all their columns, that the classifier does not reject."""
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"), folds)), max_rows)
    return docs.filter(quality_score(F.col("text"), model) >= threshold)
