"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word's features are the word in marks and its character 3- to 5-grams, hashed
into ``BUCKETS`` rows of an embedding table.  A document is the mean embedding of
the features of its distinct words (and of ``PADDING`` null ones), and a linear softmax over the two labels stands
on it.  Table and softmax are trained together (AdaGrad on mini-batches), so a
misspelling that was never seen gets its score through the n-grams it shares.

Training takes a bounded sample: at most ``rows_per_class`` documents of each
label, the first by a hash of the id, of at most ``train_chars`` characters.
Scoring takes every document and whole texts: as softmax and mean are linear in
the features, a word adds one number, which a worker works out once.

Defined results: a null or empty text has no features and gets the score of the
softmax's bias; rows without a label, or with a null one, take no part in
training; of several labels for an id the largest counts; without both labels
among the training rows the score is 0.5 for all.  Rows pass through one by one.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import table

BUCKETS = 1 << 20
DIM = 8
#: parameters of the training sample
ROWS_PER_CLASS, TRAIN_CHARS = 3000, 30_000
EPOCHS, RATE, BATCH, SCALE = 5, 0.3, 64, 60.0
#: each HOLD-th training row chooses the shrinkage; a mistaken clean row weighs as CLEAN toxic ones
HOLD, CLEAN = 4, 3.0
#: null features that every document has besides, so that a few words alone decide nothing
PADDING = 300
#: words kept by a worker that scores and by the task that trains; others are worked out again
KEPT_WORDS, KEPT_IN_TRAINING = 150_000, 50_000
_WORDS = re.compile(r"[^\W_]+")


def features(word: str) -> list[int]:
    w = f"<{word}>"
    grams = {w[i:i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)}
    return [crc32(g.encode()) % BUCKETS for g in sorted(grams | {w})]


def bag(text: str, kept: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of a text and their shares."""
    parts = []
    for w in sorted(set(_WORDS.findall(text.lower()))):
        f = kept.get(w)
        if f is None:
            if len(kept) >= KEPT_IN_TRAINING:
                kept.clear()
            f = kept[w] = np.array(features(w), np.int32).tobytes()
        parts.append(f)
    ids = np.frombuffer(b"".join(parts), np.int32)
    col, n = np.unique(ids, return_counts=True)
    return col, (n / (len(ids) + PADDING)).astype(np.float32)


def train(texts: list[str], toxic: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """The weight of each feature for label 1 over label 0, and the bias."""
    y = np.array(toxic, np.float64)
    if not len(y) or y.min() == y.max():
        return np.zeros(BUCKETS, np.float32), 0.0
    kept: dict[str, bytes] = {}
    bags = [bag(t, kept) for t in texts]
    kept.clear()
    part = np.arange(len(y)) % HOLD == 0
    if min(y[part].sum(), (1 - y[part]).sum()) < 10 or min(y[~part].sum(), (1 - y[~part]).sum()) < 10:
        weight = fit(bags, y, seed)  # too few rows to spare
        return prune(weight, bags, y)
    weight = fit([b for b, x in zip(bags, part) if not x], y[~part], seed)
    return prune(weight, [b for b, x in zip(bags, part) if x], y[part])


def prune(weight: np.ndarray, bags: list, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights shrunk towards 0, and the bias: how far is chosen on ``bags``.

    Most n-grams say nothing and their weights are noise, so all are shrunk by a
    quantile of their sizes.  A mistaken clean row counts as ``CLEAN`` toxic ones.
    """
    used = np.abs(weight[weight != 0])
    best = (math.inf, 0.0, 0.0, weight)
    for q in (0, 0.5, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 0.998, 0.999) if len(used) else ():
        w = np.sign(weight) * np.maximum(np.abs(weight) - np.quantile(used, q), 0)
        z = np.array([w[c] @ s if len(c) else 0.0 for c, s in bags])
        cut = np.unique(z)
        cut = np.concatenate([[cut[0] - 1], (cut[1:] + cut[:-1]) / 2, [cut[-1] + 1]])
        toxic, clean = np.sort(z[y == 1]), np.sort(z[y == 0])
        wrong = np.searchsorted(toxic, cut) / len(toxic) + CLEAN * (1 - np.searchsorted(clean, cut) / len(clean))
        at = cut[wrong == wrong.min()]
        at = at[len(at) // 2]
        # as sharp as the rows around the cut allow
        near = np.sort(np.abs(z - at))[max(1, len(z) // 20)] or 1.0
        if wrong.min() < best[0]:
            best = (wrong.min(), float(at), 2.0 / near, w)
    _, at, sharp, w = best
    return (w * sharp).astype(np.float32), -at * sharp


def fit(bags: list, y: np.ndarray, seed: int) -> np.ndarray:
    """The weight of each feature for label 1 over label 0, from joint training."""
    rng = np.random.default_rng(seed)
    table_ = np.empty((BUCKETS, DIM), np.float32)
    for part in np.array_split(table_, 64):  # the doubles of a part alone lie in memory
        part[:] = rng.normal(0, 0.1, part.shape)
    soft, bias = rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    g_table, g_soft, g_bias = np.full(BUCKETS, 1e-6), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            col = np.concatenate([bags[i][0] for i in rows])
            row = np.repeat(np.arange(len(rows)), [len(bags[i][0]) for i in rows])
            share = np.concatenate([bags[i][1] for i in rows]) * SCALE
            uniq, of = np.unique(col, return_inverse=True)
            e = table_[uniq]
            doc = np.stack([np.bincount(row, share * e[of, k], len(rows)) for k in range(DIM)], 1)
            z = doc @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - np.stack([1 - y[rows], y[rows]], 1)) * weight[rows, None] / len(rows)
            back = d @ soft.T
            ge = np.stack([np.bincount(of, share * back[row, k], len(uniq)) for k in range(DIM)], 1)
            gs, gb = doc.T @ d, d.sum(0)
            g_table[uniq] += (ge ** 2).mean(1)
            g_soft += gs ** 2
            g_bias += gb ** 2
            table_[uniq] -= RATE * ge / np.sqrt(g_table[uniq])[:, None]
            soft -= RATE * 0.3 * gs / np.sqrt(g_soft)
            bias -= RATE * 0.3 * gb / np.sqrt(g_bias)
    seen = np.zeros(BUCKETS, bool)
    for c, _ in bags:
        seen[c] = True
    return np.where(seen, table_ @ (soft[:, 1] - soft[:, 0]) * SCALE, 0.0)


class Scorer(dict):
    """Adds up words: the sum of a word's feature weights, and as imaginary part how many they are."""

    def __init__(self, weight: np.ndarray, bias: float):
        super().__init__()
        self.weight, self.bias = array("f", weight.astype(np.float32).tobytes()), bias  # 4 bytes each, where a list takes 32

    def __missing__(self, word: str) -> complex:
        if len(self) >= KEPT_WORDS:
            self.clear()
        f = features(word)
        got = self[word] = complex(sum([self.weight[i] for i in f]), len(f))
        return got

    def score(self, text: str) -> float:
        s = sum(map(self.__getitem__, sorted(set(_WORDS.findall(text.lower())))), 0j)
        z = s.real / (s.imag + PADDING) + self.bias
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rows_per_class: int = ROWS_PER_CLASS, train_chars: int = TRAIN_CHARS) -> DataFrame:
    """The bounded sample (_id, text, toxic)."""
    one = (labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
                 .where("_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out("_id"))
                 .groupBy("_id").agg(F.max("toxic").alias("toxic")))
    pick = [one.where(F.col("toxic") == k).orderBy(F.xxhash64("_id"), "_id").limit(rows_per_class) for k in (0, 1)]
    pick = F.broadcast(pick[0].union(pick[1]))  # at most 2 * rows_per_class rows of 12 bytes
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    return d.where(F.length("text") <= train_chars).join(pick, "_id").select("_id", "text", "toxic")


def trained(sample: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and bias from the bounded sample; one task trains, in the order of the ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        weight, bias = train([r[1] for r in rows], [r[2] for r in rows])
        yield pa.RecordBatch.from_pydict({"weight": pa.array([weight.tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})

    got = sample.repartition(1).mapInArrow(run, "weight binary, bias double").first()
    return (np.frombuffer(bytes(got["weight"]), np.float32), got["bias"]) if got else train([], [])


def score(docs: DataFrame, weight: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Scorer(weight, bias)
        for whole in batches:
            for b in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([m.score(x or "") for x in b.column("text").to_pylist()], pa.float64())], schema=out)

    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id bigint, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; trains on the rows that are not held out."""
    weight, bias = trained(training_rows(docs, labels, id_col, text_col))
    s = score(docs, weight, bias, id_col, text_col)
    return s.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` less the rows predicted as toxic; all columns as they were."""
    weight, bias = trained(training_rows(docs, labels, "doc_id", text_col))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Scorer(weight, bias)
        for b in batches:
            texts = pa.RecordBatch.from_arrays([b.column(text_col).cast(pa.string())], ["text"])
            keep = [m.score(x or "") < 0.5 for part in slices(texts, "text") for x in part.column("text").to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


def op8_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
