"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are runs of letters and digits, or of other visible characters. A text's features are its token unigrams and
bigrams, unigrams and trigrams of the tokens' shapes (case of a word, the characters of a mark), and the bigrams that the
text has had before; each is hashed to one of 2**BITS weights and counts 1 / tokens. A score is the sparse dot product of
these features with the weights, gathered in one pass over a batch's bytes.

The model is fitted on the driver from at most TRAIN_ROWS labelled rows outside the held-out fold, the first in the order
of a hash of their ids; that bound is a parameter. Their features are made on the executors. All rows are scored.

Defined results: null and empty texts have no features and score the model's bias; a null doc_id is held out; a null
label is no label, of several labels of an id the largest counts, of several rows of an id one is learned from; without labels of both kinds every score is the share
of label 1 (0.5 without any). Equal rows each get their result; other columns are kept by ``scored`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom import ship

from .common import Rolling, mix, slices, text_bytes

BITS = 18
TRAIN_ROWS = 4000
EPOCHS = 4
SCALE = 8.0
FOLDS = 5
KINDS = 5

_CLASS = np.full(256, 2, np.uint8)
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 0
_CLASS[0x30:0x3A] = _CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:] = 1


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """A weight's number for each (kind, token), and the first token of each row."""
    data, offsets = text_bytes(texts)
    n = len(data)
    if not n:
        return np.empty((KINDS, 0), np.int64), np.zeros(len(offsets), np.int64)
    kind = _CLASS[data]
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    cut[1:n] = kind[1:] != kind[:-1]
    cut[offsets] = True
    bounds = np.flatnonzero(cut)
    starts, ends = bounds[:-1], bounds[1:]
    seen = kind[starts] > 0
    starts, ends = starts[seen], ends[seen]
    first = np.searchsorted(starts, offsets)
    word = Rolling(data).spans(starts, ends)
    count = lambda low, high: np.concatenate([[0], np.cumsum((data >= low) & (data <= high), dtype=np.int64)])
    upper, digit = count(0x41, 0x5A), count(0x30, 0x39)
    capitals, digits, size = upper[ends] - upper[starts], digit[ends] - digit[starts], ends - starts
    # a word's shape: all, first, some or no capitals, digits or none, one letter or more; a mark's shape is the mark
    begins = (data[starts] >= 0x41) & (data[starts] <= 0x5A)
    code = np.where(capitals * 2 > size, 3, np.where(begins & (capitals == 1), 1, np.where(capitals > 0, 2, 0))) * 8 + (digits > 0) * 4 + (size == 1) * 2 + 1
    code[1:] += 16 * 4 * (word[1:] == word[:-1]) * (kind[starts][1:] == 1)  # the word before, once more
    shape = np.where(kind[starts] == 1, code.astype(np.uint64), word)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))

    def after(values: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(values), np.uint64)
        if len(values) > k:
            same = row[k:] == row[:-k]
            out[:-k][same] = values[k:][same]
        return out

    pair = mix(word * np.uint64(3) + after(word, 1))
    triple = mix(mix(shape * np.uint64(5) + after(shape, 1)) + after(shape, 2))
    own = mix(pair + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(own, return_index=True)
    again = np.ones(len(word), np.uint64)
    again[at] = 0
    mask = np.uint64((1 << bits) - 1)
    kinds = [mix(v + np.uint64(1 + 7919 * k)) & mask for k, v in enumerate((word, pair, mix(shape), triple, again))]
    return np.stack(kinds).astype(np.int64), first


class Model:
    """Weights and bias; a FTRL-proximal learner while it is fitted."""

    def __init__(self, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 1e-3, l2: float = 0.05):
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.weights, self.bias = np.zeros(1 << bits), 0.0

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> Model:
        """rows: (weight numbers, values, label), in a fixed order."""
        ones = sum(y for *_, y in rows)
        share = (ones + 1e-9) / (len(rows) + 2e-9) if rows else 0.5
        if not rows or ones in (0, len(rows)):
            share = min(max(share, 1e-6), 1 - 1e-6)
            self.bias = float(np.log(share / (1 - share)))
            return self
        z, n = np.zeros(len(self.weights) + 1), np.zeros(len(self.weights) + 1)
        last = len(self.weights)
        for _ in range(epochs):
            for ids, values, y in rows:
                ids, values = np.append(ids, last), np.append(values, 1.0)
                zi, ni = z[ids], n[ids]
                w = self._solve(zi, ni)
                p = 1.0 / (1.0 + np.exp(-np.clip(w @ values, -35, 35)))
                g = (p - y) * values
                z[ids] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / self.alpha * w
                n[ids] = ni + g * g
        w = self._solve(z, n)
        self.weights, self.bias = w[:last], float(w[last])
        return self

    def _solve(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def score(self, texts: pa.Array) -> np.ndarray:
        ids, first = features(texts, self.bits)
        each = self.weights[ids].sum(axis=0)
        n = np.diff(first)
        mean = np.zeros(len(n))
        if n.any():  # each row's sum by itself, so that a score does not depend on the rows beside it
            mean[n > 0] = np.add.reduceat(each, first[:-1][n > 0]) / n[n > 0]
        logit = self.bias + SCALE * mean
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def fitted(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    ship(docs.sparkSession)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.select(F.col("doc_id").alias("_q_id"), F.col("quality").cast("int").alias("_q_y"), F.xxhash64("doc_id").alias("_q_order")).orderBy("_q_order", "_q_id").limit(train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_q_id")).select("_q_order", "_q_id", "_q_y", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                ids, first = features(piece.column("text"))
                packed = []
                for r in range(piece.num_rows):
                    own = ids[:, first[r] : first[r + 1]]
                    each, times = np.unique(own, return_counts=True)
                    packed.append((each.astype(np.int32).tobytes(), (times * (SCALE / max(1, own.shape[1]))).astype(np.float32).tobytes()))
                cols = [piece.column(c) for c in ("_q_order", "_q_id", "_q_y")] + [pa.array([p[i] for p in packed], pa.binary()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(cols, ["o", "id", "y", "ids", "xs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # of rows with one id one is learned from, so that no more than train_rows reach the driver
    got = rows.mapInArrow(extract, f"o long, id {kind}, y int, ids binary, xs binary").groupBy("o", "id", "y").agg(F.min(F.struct("ids", "xs")).alias("x")).select("o", "id", "y", "x.*").collect()
    got = sorted(got, key=lambda r: (r["o"], r["id"]))
    return Model().fit([(np.frombuffer(r["ids"], np.int32).astype(np.int64), np.frombuffer(r["xs"], np.float32).astype(np.float64), int(r["y"])) for r in got])


def scored(docs: DataFrame, model: Model, column: str = "_q_score") -> DataFrame:
    """docs and the score of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(sent.value.score(piece.column("text")))], [*piece.schema.names, column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(score, f"{fields}, {column} double")


def digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; one row for each row of docs."""
    s = scored(docs.select("doc_id", "text"), fitted(docs, labels))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_q_score").alias("score"), (F.col("_q_score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the classifier does not reject; it is fitted on ``labelled`` (docs itself without it)."""
    return scored(docs, fitted(docs if labelled is None else labelled, labels)).filter(F.col("_q_score") >= threshold).drop("_q_score")
