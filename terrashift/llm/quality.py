"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal.

Tokens are maximal runs of letters and digits, or of anything else that is not
white space. A text's features are the hashed counts of its tokens, of pairs
of neighbours, of the tokens' shapes (case, digits, punctuation, length class)
and of pairs of shapes marked by whether the two tokens are equal; the vector
is scaled to length 1. Hashing is vectorised: a token's hash is the difference
of two prefix sums of a polynomial over its code points.

Training follows the regularised leader, coordinate by coordinate, over a
bounded sample of the labelled rows (``max_rows``, the rows whose id hashes
lowest, so the sample is the same on every run); scoring is a sparse dot
product of every whole text. The model is 2^``bits`` doubles whatever the
corpus, which is all that travels to the executors.

Only the text is an input of the score. Defined results: null, empty and
blank texts have no features and get the score of the intercept; without any
labelled row every score is 0.5; a null id is not held out; labels other than
0 and 1 are ignored and of repeated labels the smallest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x100000001B3  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
BLANK = " \t\n\v\f\r\xa0"
SLAB = 1 << 20  # code points hashed at a time


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * MULTIPLIER
    return (x ^ (x >> np.uint64(29))) * MULTIPLIER


class Hasher:
    """Texts to (index, value) vectors of 2^``bits`` dimensions."""

    def __init__(self, bits: int = 18):
        self.shift = np.uint64(64 - bits)
        self.up = _powers(BASE, SLAB)
        self.down = _powers(INVERSE, SLAB)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._tokens(piece) for piece in _slabs(text or "")]
        terms = self._terms(*map(np.concatenate, zip(*parts))) if parts else np.zeros(0, np.int32)
        if not len(terms):
            return np.zeros(0, np.int32), np.zeros(0)
        index, count = np.unique(terms, return_counts=True)
        value = np.sqrt(count.astype(np.float64))
        return index, value / np.sqrt((value * value).sum())

    def _tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Hash and shape of each token."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        upper = ((c >= 65) & (c <= 90)) | ((c >= 192) & (c <= 222) & (c != 215))
        digit = (c >= 48) & (c <= 57)
        space = (c == 32) | ((c >= 9) & (c <= 13)) | (c == 160)
        word = ((c >= 97) & (c <= 122)) | (c >= 192) | upper | digit
        kind = np.where(space, 0, np.where(word, 1, 2)).astype(np.int8)
        cut = np.flatnonzero(np.diff(kind, prepend=np.int8(-1)) != 0)
        cut = cut[kind[cut] != 0]
        if not len(cut):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        after = np.flatnonzero(np.diff(kind, append=np.int8(-1)) != 0) + 1
        after = after[kind[after - 1] != 0]
        low = np.where(upper, c + 32, c).astype(np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low * self.up[: len(c)], dtype=np.uint64)])
        token = (sums[after] - sums[cut]) * self.down[cut]
        size = after - cut
        capitals = np.concatenate([[0], np.cumsum(upper)])
        capitals = capitals[after] - capitals[cut]
        shape = (
            kind[cut].astype(np.uint64)
            + np.uint64(4) * upper[cut]
            + np.uint64(8) * ((capitals == size) & (size > 1))
            + np.uint64(16) * digit[cut]
            + np.uint64(32) * np.minimum(size, 15).astype(np.uint64)
        )
        return token, shape

    def _terms(self, token: np.ndarray, shape: np.ndarray) -> np.ndarray:
        if not len(token):
            return np.zeros(0, np.int32)
        broad = shape & np.uint64(31)
        terms = [_mixed(token, 1), _mixed(shape, 2)]
        if len(token) > 1:
            same = (token[1:] == token[:-1]).astype(np.uint64)
            terms += [
                _mixed(token[1:] + _mixed(token[:-1], 3), 4),
                _mixed(broad[1:] * np.uint64(64) + broad[:-1] * np.uint64(2) + same, 5),
            ]
        return (np.concatenate(terms) >> self.shift).astype(np.int32)


def _slabs(text: str) -> Iterator[str]:
    """The text in pieces of at most SLAB code points, cut at white space; only a run of SLAB without any is cut inside a token."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SLAB)
        if end < len(text) and (gap := max(text.rfind(c, at + 1, end) for c in BLANK)) > 0:
            end = gap
        yield text[at:end]
        at = end


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    bits: int

    def score(self, vector: tuple[np.ndarray, np.ndarray]) -> float:
        index, value = vector
        z = self.bias + float(self.weights[index] @ value)
        return float(1.0 / (1.0 + np.exp(-min(max(z, -35.0), 35.0))))


def train_ftrl(
    vectors: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    bits: int = 18,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.5,
    epochs: int = 6,
    seed: int = 7,
) -> Model:
    """FTRL-proximal: per-coordinate learning rates, L1 by the closed form of the leader.

    The intercept is held at the log-odds of the labels (with one row of each
    added), so a text with few features keeps the prior.
    """
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias = float(np.log((labels.sum() + 1) / ((1 - labels).sum() + 1)))
    order = np.random.default_rng(seed)

    def leader(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for k in order.permutation(len(vectors)):
            index, value = vectors[k][0], vectors[k][1].astype(np.float64)
            w = leader(index)
            margin = bias + float(w @ value)
            slope = 1.0 / (1.0 + np.exp(-min(max(margin, -35.0), 35.0))) - labels[k]
            g = slope * value
            grown = n[index] + g * g
            z[index] += g - (np.sqrt(grown) - np.sqrt(n[index])) / alpha * w
            n[index] = grown
    return Model(leader(np.arange(1 << bits)), bias, bits)


def held_out(key: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """text and quality of the ``max_rows`` labelled rows outside the fold whose id hashes lowest."""
    marked = labels.select(F.col(key).alias("k"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    marked = marked.where(~held_out(F.col("k"))).groupBy("k").agg(F.min("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("k"), "k").limit(max_rows)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    return rows.join(F.broadcast(chosen), "k").select("k", "text", "quality")  # at most max_rows small rows


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = 6000, bits: int = 18, key: str = "doc_id", text: str = "text"
) -> Model:
    """Train on the driver: ``max_rows`` bounds what it gathers, however large the tables are.

    The texts become vectors on the executors, so only those travel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(bits)
        for batch in batches:
            found = [hasher.vector(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.string()),
                    batch.column(2),
                    pa.array([i for i, _ in found], pa.list_(pa.int32())),
                    pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32())),
                ],
                names=["k", "quality", "i", "v"],
            )

    rows = training_rows(docs, labels, max_rows, key, text)
    got = rows.mapInArrow(run, "k string, quality int, i array<int>, v array<float>").toArrow()
    order = got.column("k").to_pylist()
    vectors, marks = [], []
    for chunk in got.to_batches():
        index, value = chunk.column("i"), chunk.column("v")
        vectors += [(i.values.to_numpy(), v.values.to_numpy()) for i, v in zip(index, value)]  # views
        marks += chunk.column("quality").to_pylist()
    at = sorted(range(len(order)), key=lambda k: order[k])
    return train_ftrl([vectors[k] for k in at], np.array([marks[k] for k in at], np.float64), bits)


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``key``, score and predicted of every row."""
    weights, bias, bits = model.weights, model.bias, model.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, fitted = Hasher(bits), Model(weights, bias, bits)
        for batch in batches:
            found = [fitted.score(hasher.vector(x.as_py())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["k", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = rows.mapInArrow(run, f"k {kind}, score double")
    return out.select(F.col("k").alias(key), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(
    docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7
) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``; no shuffle."""
    weights, bias, bits = model.weights, model.bias, model.bits
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, fitted = Hasher(bits), Model(weights, bias, bits)
        for batch in batches:
            good = [fitted.score(hasher.vector(x.as_py())) >= threshold for x in batch.column(at)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
