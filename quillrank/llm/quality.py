"""Quality classifier with supervised subword embeddings (operator 4).

A document is the average of learned vectors, one for each word, each
character n-gram of its words (characters as UTF-8 bytes, words with a mark at
both ends) and each word that repeats the one before, all hashed into
``BUCKETS`` rows.  A softmax over two classes
reads the average; vectors and output are trained together by stochastic
gradient descent in numpy.

Training takes at most ``TRAIN_DOCUMENTS`` labelled documents, the first by a
hash of the id (a bounded, documented sample; whole texts).  Scoring covers
every row and whole texts: as the output is linear in the average, each bucket
comes down to one number, and a text's score is a mean of table entries.

Null and empty texts have no features and get the score of the output's bias
alone.  Without any labelled rows, every text scores the prior, 0.5.  Repeated
rows get equal scores; an id with several labels teaches each of them, and
labels other than 0 and 1, null too, teach none.  Ties in the hash of the id go
by the id.  An empty table gives no rows.  A column called score (in any case)
is replaced, all others stay, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, kernel

BITS, SIZES, DIM = 18, (3, 4, 5), 12
BUCKETS = 1 << BITS
AGAIN = 1
TRAIN_DOCUMENTS, STEPS, RATE = 3000, 18_000, 2.0
_STEP = np.uint32(0x01000193)
_SPREAD = np.uint32(0x9E3779B1)
_BYTE = (np.random.default_rng(7).integers(1, 1 << 32, 256, dtype=np.uint32)) | np.uint32(1)
_BYTE[kernel.SPACE] = _BYTE[32]


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and n-grams, row by row, and how many each row has."""
    rows = len(offsets) - 1
    size = len(raw) + rows + 1
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    body = np.full(size, 32, np.uint8)
    body[np.arange(len(raw)) + owner + 1] = raw
    row_of = np.zeros(size, np.int32)
    row_of[np.arange(len(raw)) + owner + 1] = owner
    at = offsets[1:] + np.arange(rows) + 1  # the mark after each row
    row_of[at] = np.arange(rows)
    space = kernel.SPACE[body]
    code = _BYTE[body]
    found, rows_of = [], []
    h = code.copy()
    inner = np.ones(size, bool)
    with np.errstate(over="ignore"):
        for n in range(2, max(SIZES) + 1):
            h = h[:-1] * _STEP + code[n - 1 :]
            if n > 2:  # what was the last byte is now inside
                inner = inner[:-1] & ~space[n - 2 : size - 1][: len(h)]
            else:
                inner = inner[:-1]
            if n in SIZES:
                at = np.flatnonzero(inner)
                found.append(((h[at] * _SPREAD) >> np.uint32(32 - BITS)).astype(np.int32))
                rows_of.append(row_of[at + 1])
    starts, ends, counts = kernel.words(raw, offsets, kernel.NOT_SPACE)
    words, row = kernel.span_hashes(raw, starts, ends, kernel.CODES), np.repeat(np.arange(rows), counts)
    found.append((words >> np.uint64(64 - BITS)).astype(np.int32))
    rows_of.append(row)
    again = row[1:][(words[1:] == words[:-1]) & (row[1:] == row[:-1])]  # the word pair "the same again" has a bucket of its own
    found.append(np.full(len(again), AGAIN, np.int32))
    rows_of.append(again)
    return np.concatenate(found), np.concatenate(rows_of)


class Classifier:
    """Bucket vectors and a two-class softmax output."""

    def __init__(self, vectors: np.ndarray, output: np.ndarray, bias: np.ndarray):
        self.vectors, self.output, self.bias = vectors, output, bias

    @classmethod
    def fit(cls, texts: list[bytes], labels: list[int]) -> Classifier:
        random = np.random.default_rng(11)
        self = cls((random.random((BUCKETS, DIM), np.float32) - 0.5) / DIM, np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32))
        documents = []
        for t in texts:
            ids, n = np.unique(features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0], return_counts=True)
            documents.append((ids, (n / max(1, n.sum())).astype(np.float32)))
        epochs = max(1, round(STEPS / len(texts)))  # as many steps for few documents as for many
        steps, done = epochs * len(texts), 0
        for _ in range(epochs):
            for i in random.permutation(len(texts)):
                ids, weight = documents[i]
                rows = self.vectors[ids]
                mean = weight @ rows
                rate = RATE * (1 - done / steps)
                done += 1
                z = mean @ self.output + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = self.output @ p
                self.output -= rate * np.outer(mean, p)
                self.bias -= 0.1 * rate * p
                if len(ids):  # a step of the mean: each row moves by its share, relative to the squared weights
                    self.vectors[ids] = rows - (rate * 0.5 / float(weight @ weight)) * np.outer(weight, back) * float(weight.max())
        return self

    def table(self) -> tuple[np.ndarray, float]:
        """Each bucket's share of the log odds of class 1, and the bias."""
        lean = self.output[:, 1] - self.output[:, 0]
        return (self.vectors @ lean).astype(np.float32), float(self.bias[1] - self.bias[0])


def scores(table: np.ndarray, bias: float, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = []
    for a, b in common.chunks(offsets, 1 << 18):  # features take some fifty times a text's bytes
        ids, rows = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        total = np.bincount(rows, table[ids], b - a)
        odds = total / np.maximum(1, np.bincount(rows, minlength=b - a)) + bias
        out.append(1 / (1 + np.exp(-odds)))
    return np.concatenate(out) if out else np.zeros(0)


def fit(df: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", limit: int = TRAIN_DOCUMENTS) -> Classifier:
    """Train on at most ``limit`` labelled documents whose id isn't held out."""
    chosen = labels.select(
        F.col(key).alias("__id"), F.col(label).cast("int").alias("__label"),
    ).where(F.col("__label").isin(0, 1) & ~held_out("__id")).orderBy(F.xxhash64("__id"), "__id").limit(limit)
    rows = df.select(
        F.col(key).alias("__own"), common.text_bytes(text).alias("__text"),
    ).join(F.broadcast(chosen), F.col("__own") == F.col("__id")).select("__id", "__text", "__label").orderBy("__id", "__text").limit(limit).collect()
    if not rows:
        return Classifier(np.zeros((BUCKETS, 1), np.float32), np.zeros((1, 2), np.float32), np.zeros(2, np.float32))
    return Classifier.fit([bytes(r[1]) for r in rows], [r[2] for r in rows])


def held_out(key: str) -> F.Column:
    """Rows that are never trained on: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(df: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """``df`` with score: how likely class 1 is."""
    table = df.sparkSession.sparkContext.broadcast(model.table())  # ``BUCKETS`` numbers

    def run(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(scores(*table.value, *common.buffer_of(texts)))]

    return common.with_columns(df, common.text_bytes(text), [T.StructField("score", T.DoubleType())], run)
