"""Toxicity by FTRL-proximal logistic regression on hashed word n-grams.

Features are the words and their stems (the first letters), in the lower half
of the ``DIMENSIONS`` hash coordinates, and pairs of neighbours and pairs with
one word between (skip-grams), in the upper half, with the smaller value
``PAIR_VALUE``, since most pairs are rare. A feature counts once per document. Training is
follow-the-regularised-leader with a learning rate for each coordinate and an
L1 term, which leaves all but a few coordinates at exactly zero; what is sent
to the tasks is only the others.

Fitting takes a bounded sample of labelled rows, chosen by a hash of their
id; features of the sample are made in parallel, and one task fits them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surfacewx.llm.common import ascii_words, mapped, position, slices, wider

BITS = 22
DIMENSIONS = 1 << BITS
FIT_ROWS = 16_000
THRESHOLD = 0.7
#: Words held between slices, by number and by bytes.
CACHED_WORDS, CACHED_BYTES = 300_000, 8 << 20
STEM = 4
PAIR_VALUE = 0.3
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Words(dict):
    """Word to a number; ``hashes`` and ``stems`` hold what belongs to it."""

    def __init__(self):
        self.hashes, self.stems = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.held = 0  # bytes of the words

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n == len(self.hashes):
            self.hashes, self.stems = np.concatenate([self.hashes, self.hashes]), np.concatenate([self.stems, self.stems])
        self[word] = n
        self.held += len(word)
        self.hashes[n] = zlib.crc32(word) | len(word) << 32
        stem = word.decode()[:STEM].encode()
        self.stems[n] = zlib.crc32(stem) | (1 << 40 if len(stem) < len(word) else 1 << 41)
        return n


def hashed(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and coordinates of all features of several texts, repeats included."""
    if len(words) > CACHED_WORDS or words.held > CACHED_BYTES:
        words.clear()
        words.held = 0
    rows = [ascii_words(t.lower()) if t else [] for t in texts]
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    doc = np.repeat(np.arange(len(rows)), sizes)
    number = np.fromiter((words[w] for row in rows for w in row), np.int64, len(doc))
    h, stem = words.hashes[number], words.stems[number]
    near, apart = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    pairs = np.concatenate([(h[1:] * _A + h[:-1] * _B)[near] * _A, (h[2:] * _A + h[:-2] * _B)[apart] * _B])
    half = np.uint64(DIMENSIONS >> 1)
    index = np.concatenate([_mixed(h), _mixed(stem * _A + _B), _mixed(pairs) + half])
    return np.concatenate([doc, doc, doc[1:][near], doc[2:][apart]]), index.astype(np.int32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _A
    return ((h ^ h >> np.uint64(29)) * _A) >> np.uint64(65 - BITS)


def values(index: np.ndarray) -> np.ndarray:
    return np.where((index >= DIMENSIONS >> 1) & (index < DIMENSIONS), PAIR_VALUE, 1.0)


class Ftrl:
    """FTRL-proximal logistic regression on sets of coordinates with fixed values."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 5.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)  # the last coordinate is the bias

    def weights(self, index: np.ndarray) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        l1 = np.where(index == DIMENSIONS, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(index)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + g * g


class Model:
    """The coordinates with weights, rising, and their weights times values; the bias apart."""

    def __init__(self, index: np.ndarray, weight: np.ndarray, bias: float):
        self.index, self.weight, self.bias = index, weight, bias
        self.dense: np.ndarray | None = None

    def __getstate__(self):
        return {"index": self.index, "weight": self.weight, "bias": self.bias, "dense": None}

    def scores(self, texts: list[str | None], words: Words) -> np.ndarray:
        if self.dense is None:
            self.dense = np.zeros(DIMENSIONS, np.float32)
            self.dense[self.index] = self.weight
        doc, at = hashed(texts, words)
        w = self.dense[at]
        some = np.flatnonzero(w)
        once = np.unique(doc[some] * DIMENSIONS + at[some])
        total = np.bincount(once // DIMENSIONS, self.dense[once % DIMENSIONS].astype(np.float64), len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(total + self.bias, -35, 35)))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 3, is 1. A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, epochs: int = 10) -> Model:
    """Fit on at most ``fit_rows`` rows of ``docs`` with a label 0 or 1 that are not :func:`held_out`.

    Labels with a null id or another value are left out; of several for one
    id the largest counts. The sample is the rows with the smallest hash of
    the id; labels without a document take no place in it. Without any labelled row the model scores everything 0.5.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    labelled = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    some = labelled.join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi").withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(fit_rows)
    found = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(some), F.col("doc") == F.col("id")).select("h", "label", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in slices(batches):
            doc, at = hashed(b.column(2).to_pylist(), words)
            both = np.unique(doc * DIMENSIONS + at)
            ends = np.searchsorted(both, np.arange(1, b.num_rows) * DIMENSIONS)
            sets = [(x % DIMENSIONS).astype(np.int32).tobytes() for x in np.split(both, ends)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())], names=["h", "label", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort()
        model = Ftrl()
        order = np.random.default_rng(0)
        sets = [(np.frombuffer(x, np.int32), label) for _, label, x in rows]  # no copies of the features
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                index = np.append(sets[i][0], np.int32(DIMENSIONS))
                model.learn(index, values(index), sets[i][1])
        at = np.flatnonzero(np.abs(model.z[:DIMENSIONS]) > model.l1)
        bias = model.weights(np.array([DIMENSIONS]))[0]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((at.astype(np.int32).tobytes(), pa.binary()), ((model.weights(at) * values(at)).astype(np.float32).tobytes(), pa.binary()), (float(bias), pa.float64()))], names=["i", "w", "b"])

    # A repeated id can bring more rows than were chosen: the bound holds for rows too.
    ready = mapped(found, make, "h long, label int, x binary").orderBy("h").limit(fit_rows)
    row = mapped(ready.repartition(1), learn, "i binary, w binary, b double").first()
    if row is None:  # no labelled row at all
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0)
    return Model(np.frombuffer(row.i, np.int32), np.frombuffer(row.w, np.float32), row.b)


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score (double, 0 to 1) in column ``into``, from the whole
    text alone. A null or empty text gets the bias's score. Repeated rows score
    alike. A column of ``docs`` that is named like the new one gives way to it."""
    docs = docs.drop(into)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = position(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in slices(batches):
            scores = sent.value.scores(b.column(at).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, into])

    return mapped(docs, run, wider(docs, **{into: "double"}))
