"""Quality by ordinal regression: a cumulative-link model on graded ratings.

One weight vector over hashed features gives a document's latent quality
``f``; ordered thresholds turn it into grades, ``P(grade > k) = s(f - t_k)``
with the logistic ``s``. All grades share the weights. Features are hashed
n-grams of word shapes (case, digits, punctuation), of repeats of the word
before, and single words (long ones in pieces), each family scaled by the square root of its share
of the text, so they say how much of a text looks so whatever its length.

Fitting takes a bounded sample of rated rows, chosen by a hash of their id;
features of the sample are made in parallel, and one task fits them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfacewx.llm.common import mapped, position, slices, wider

DIMENSIONS = 1 << 18
FIT_ROWS = 12_000
CACHED_WORDS = 200_000
#: Words above ``LONG`` characters (a text without white space is one) count as consecutive pieces of ``PIECE``.
LONG, PIECE = 64, 8
_RUNS = re.compile(r"(.)\1+", re.S)


class _Words(dict):
    """Word to (hash, shape hash), made when first asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        shape = _RUNS.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))
        value = self[word] = zlib.crc32(word.lower().strip(".,;:!?").encode()) << 32 | zlib.crc32(shape.encode())
        return value


def features(text: str | None, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Indices (rising) and values of a text's features; none for a text without words."""
    tokens = text.split() if text else []
    if max(map(len, tokens), default=0) > LONG:
        tokens = [x for w in tokens for x in ([w] if len(w) <= LONG else [w[i : i + PIECE] for i in range(0, len(w), PIECE)])]
    if not tokens:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    both = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    same = np.zeros(len(tokens), np.uint64)
    same[1:] = word[1:] == word[:-1]
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    pairs = shape[1:] * a + shape[:-1] * b
    threes = pairs[1:] * a + shape[:-2]
    families = [shape, pairs, threes, same + np.uint64(7), word]
    index, value = [], []
    for k, family in enumerate(families):
        hashed = (family * a + np.full(1, k + 1, np.uint64) * b) >> np.uint64(64 - 18)
        at, count = np.unique(hashed, return_counts=True)
        index.append(at.astype(np.int32))
        value.append(np.sqrt(count / max(1, len(family))).astype(np.float32))
    at, back = np.unique(np.concatenate(index), return_inverse=True)
    return at, np.bincount(back, np.concatenate(value)).astype(np.float32)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class OrdinalModel:
    """Weights and rising thresholds of a cumulative-link model."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """``P(grade > k)`` for each ``k`` but the last grade."""
        return sigmoid(float(self.weights[index] @ value) - self.thresholds)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], grades: int, epochs: int = 12, rate: float = 0.3, l2: float = 1e-5) -> OrdinalModel:
    """AdaGrad on the likelihood of ``(index, value, grade)`` rows, in the
    order given, each epoch. Thresholds are kept in order."""
    w, seen = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-6)
    have = np.bincount([g for *_, g in rows], minlength=grades) + 1.0
    above = 1 - np.cumsum(have)[:-1] / have.sum()
    t = -np.log(above / (1 - above))
    t_seen = np.full(grades - 1, 1.0)
    for _ in range(epochs):
        for index, value, grade in rows:
            tail = np.concatenate([[1.0], sigmoid(w[index] @ value - t), [0.0]])
            p = max(tail[grade] - tail[grade + 1], 1e-9)
            slope = tail * (1 - tail)
            d_f = (slope[grade] - slope[grade + 1]) / p
            step = d_f * value - l2 * w[index]
            seen[index] += step * step
            w[index] += rate * step / np.sqrt(seen[index])
            d_t = np.zeros(grades - 1)
            if grade > 0:
                d_t[grade - 1] -= slope[grade] / p
            if grade < grades - 1:
                d_t[grade] += slope[grade + 1] / p
            t_seen += d_t * d_t
            t = np.maximum.accumulate(t + 0.1 * d_t / np.sqrt(t_seen))
    return OrdinalModel(w.astype(np.float32), t)


def train(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", fit_rows: int = FIT_ROWS) -> OrdinalModel:
    """Fit on at most ``fit_rows`` rows of ``docs`` that ``ratings`` grades 0 to ``grades - 1``.

    Ratings with a null id or a grade out of range are left out; of several
    for one id the lowest counts. The sample is those with the smallest hash
    of the id among those with a document; it and the model are all that reaches
    one task or the driver.
    """
    rated = ratings.filter(F.col(id_col).isNotNull() & F.col(grade_col).between(0, grades - 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(grade_col).cast("int").alias("grade"))
    some = rated.join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi").withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(fit_rows)
    found = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(some), F.col("doc") == F.col("id")).select("h", "grade", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in slices(batches):
            made = [features(x, words) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())], names=["h", "grade", "i", "v"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for h, grade, i, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows.append((h, len(rows), np.frombuffer(i, np.int32), np.frombuffer(v, np.float32), grade))
        model = fit([x[2:] for x in sorted(rows, key=lambda x: (x[0], x[4], x[2].tobytes()))], grades)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.thresholds.tobytes()], pa.binary())], names=["w", "t"])

    # A repeated id can bring more rows than were chosen: the bound holds for rows too.
    ready = mapped(found, make, "h long, grade int, i binary, v binary").orderBy("h").limit(fit_rows)
    row = mapped(ready.repartition(1), learn, "w binary, t binary").first()
    if row is None:  # no rated row at all
        return fit([], grades)
    return OrdinalModel(np.frombuffer(row.w, np.float32), np.frombuffer(row.t, np.float64))


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text", at_least: int = 1, into: tuple[str, str] = ("expected_grade", "tail_prob")) -> DataFrame:
    """``docs`` with two columns named by ``into``: the expected grade (double)
    and the probability (double) of grade ``at_least`` or better. A null, empty or blank text
    has no features, so the thresholds alone decide. Repeated rows score alike.
    Columns of ``docs`` that are named like the new ones give way to them."""
    docs = docs.drop(*into)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = position(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in slices(batches):
            tails = [sent.value.tails(*features(x, words)) for x in b.column(at).to_pylist()]
            made = [pa.array([float(t.sum()) for t in tails], pa.float64()), pa.array([float(t[at_least - 1]) for t in tails], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *into])

    return mapped(docs, run, wider(docs, **dict.fromkeys(into, "double")))
