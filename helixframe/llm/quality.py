"""Quality of documents: random-indexing word vectors, pooled, then a small network with calibrated probabilities.

Every token (a run of letters and digits, or of other marks) falls by its hash into one of a fixed number of rows. A row's
vector is the sum, over the whole corpus, of the sparse random index vectors of the tokens next to it. Tasks add up
their own counts and hand on one matrix each; matrices are summed in a tree over the tasks' numbers. A document is the mean and spread of its
tokens' vectors. The network learns from a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import MARKS, SPACES, TO_LOWER, bound_batches, crc_mod, share, shared, utf8_parts, word_hashes

ROW_BITS, DIMS, ONES = 14, 32, 4
ROWS = 1 << ROW_BITS
#: Labelled documents that the network learns from, at most: those whose ids hash lowest.
MAX_LABELLED = 20_000
FEATURES = 2 * DIMS + 3
HIDDEN, EPOCHS, CALIBRATION_SHARE = 24, 250, 5
ACCEPT = 0.3
#: Matrices are added in groups of 64 neighbouring tasks, then 64 such groups, and so on.
_CHUNK_ROWS, _FAN_BITS, _LEVELS = 256, 6, 3

_MARK = MARKS & (TO_LOWER == np.arange(256))  # capitals are letters
_KIND = np.where(SPACES, 0, np.where(_MARK, 2, 1)).astype(np.uint8)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of the non-zero entries of each row's index vector; always the same."""
    rng = np.random.default_rng(11)
    return rng.integers(0, DIMS, (ROWS, ONES)), rng.choice([-1.0, 1.0], (ROWS, ONES))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each token, and the first token of each text (with one more entry for the end)."""
    kind = _KIND[data]
    edge = np.concatenate([[0], kind[:-1]]) != kind if len(kind) else np.zeros(0, bool)
    cuts = np.zeros(len(data) + 1, bool)
    cuts[offsets] = True
    starts = np.flatnonzero((kind > 0) & (edge | cuts[:-1]))
    edge = np.concatenate([kind[1:], [0]]) != kind if len(kind) else edge
    ends = np.flatnonzero((kind > 0) & (edge | cuts[1:])) + 1
    rows = (word_hashes(data, starts, ends) >> np.uint64(64 - ROW_BITS)).astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    return rows, np.searchsorted(starts, offsets)


def add_neighbours(matrix: np.ndarray, rows: np.ndarray, first: np.ndarray, dims: np.ndarray, signs: np.ndarray) -> None:
    together = np.ones(max(len(rows) - 1, 0), bool)
    inner = first[1:-1]
    together[inner[(inner > 0) & (inner < len(rows))] - 1] = False
    left, right = rows[:-1][together], rows[1:][together]
    for a in range(0, len(left), 1 << 17):
        for x, y in ((left[a : a + (1 << 17)], right[a : a + (1 << 17)]), (right[a : a + (1 << 17)], left[a : a + (1 << 17)])):
            matrix += np.bincount((x[:, None] * DIMS + dims[y]).ravel(), signs[y].ravel(), ROWS * DIMS)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The matrix of row vectors, of unit length, from the texts of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, signs = index_vectors()
        matrix = np.zeros(ROWS * DIMS)
        for batch in batches:
            for _, _, data, offsets in utf8_parts(batch.column(0)):
                add_neighbours(matrix, *tokens(data, offsets), dims, signs)
        parts = matrix.astype(np.int64).reshape(-1, _CHUNK_ROWS * DIMS)
        task = TaskContext.get().partitionId()
        if matrix.any():
            yield pa.RecordBatch.from_pydict({"chunk": range(len(parts)), "task": [task] * len(parts), "sums": [_pack(p) for p in parts]}, schema)

    schema = pa.schema([("chunk", pa.int32()), ("task", pa.int32()), ("sums", pa.binary())])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(_unpack(x) for x in pdf["sums"])
        return pd.DataFrame({"chunk": pdf["chunk"][:1], "task": pdf["task"][:1], "sums": [_pack(total)]})

    bound_batches(docs.sparkSession)
    kind = "chunk int, task int, sums binary"
    parts = docs.select("text").mapInArrow(count, kind)
    for level in range(1, _LEVELS + 1):
        parts = parts.groupBy("chunk", F.shiftright("task", level * _FAN_BITS)).applyInPandas(add, kind)
    parts = parts.groupBy("chunk").applyInPandas(add, kind)
    matrix = np.zeros((ROWS // _CHUNK_ROWS, _CHUNK_ROWS * DIMS))
    for r in parts.collect():
        matrix[r.chunk] = _unpack(r.sums)
    matrix = matrix.reshape(ROWS, DIMS)
    return (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _pack(sums: np.ndarray) -> bytes:
    return (sums.astype(np.int32) if np.abs(sums).max(initial=0) < 2**31 else sums.astype(np.int64)).tobytes()


def _unpack(sums: bytes) -> np.ndarray:
    return np.frombuffer(sums, np.int32 if len(sums) == 4 * _CHUNK_ROWS * DIMS else np.int64).astype(np.int64)


def pooled(texts: pa.Array, matrix: np.ndarray) -> np.ndarray:
    """One row of features for each text: mean, spread, length of the mean, share of tokens that repeat the one before,
    and log of the number of tokens."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for a, b, data, offsets in utf8_parts(texts):
        rows, first = tokens(data, offsets)
        n = np.diff(first)
        sums, squares = np.zeros((b - a, DIMS)), np.zeros((b - a, DIMS))
        step = 1 << 17
        owner = np.repeat(np.arange(b - a), n)
        for k in range(0, len(rows), step):
            vectors, own = matrix[rows[k : k + step]], owner[k : k + step]
            at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            sums[own[at]] += np.add.reduceat(vectors, at, axis=0)
            squares[own[at]] += np.add.reduceat(vectors * vectors, at, axis=0)
        some = np.maximum(n, 1)[:, None]
        mean = sums / some
        out[a:b, :DIMS], out[a:b, DIMS : 2 * DIMS] = mean, np.sqrt(np.maximum(squares / some - mean * mean, 0))
        again = (rows[1:] == rows[:-1]) & (owner[1:] == owner[:-1])
        out[a:b, -3] = np.bincount(owner[1:][again], minlength=b - a) / some[:, 0]
        out[a:b, -2], out[a:b, -1] = np.linalg.norm(mean, axis=1), np.log1p(n)
    return out


class Network:
    """Two layers and a temperature, in numpy. Without labels of both kinds it gives the share of label 1 (else 0.5)."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.rate = float(y.mean()) if len(y) else 0.5
        self.fixed = len(y) < 2 or y.min() == y.max()
        if self.fixed:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.scale
        held = np.arange(len(y)) % CALIBRATION_SHARE == 0
        self._train(z[~held], y[~held])
        logits = self._logits(z[held])
        loss = lambda t: np.mean(np.logaddexp(0, np.where(y[held] > 0, -logits, logits) / t))
        self.temperature = float(min(np.geomspace(0.3, 10, 60), key=loss))

    def _train(self, x: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(5)
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
        for step in range(1, EPOCHS + 1):
            h = np.tanh(x @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y) / len(y)
            back = np.outer(g, p[2]) * (1 - h * h)
            grads = [x.T @ back + 1e-4 * p[0], back.sum(0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
            for k, d in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p = p

    def _logits(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.fixed:
            return np.full(len(x), self.rate)
        return 1 / (1 + np.exp(-np.clip(self._logits((x - self.mean) / self.scale) / self.temperature, -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    """Word vectors from all texts; a network from at most MAX_LABELLED labelled documents outside the held-out fifth."""
    matrix = word_vectors(docs)
    known = labels.where(F.col("quality").isin(0, 1) & (crc_mod(F.col("doc_id"), 5) != 0)).select(F.col("doc_id").alias("labelled"), F.col("quality").cast("double").alias("y"))
    known = F.broadcast(known.orderBy(F.xxhash64("labelled"), "labelled", "y").limit(MAX_LABELLED))
    sample = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("labelled")).select("doc_id", "y", "text")
    sent = share(docs.sparkSession, matrix)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared(sent)
        for batch in batches:
            rows = [x.tobytes() for x in pooled(batch.column(2), m)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "y", "x"])

    rows = sample.mapInArrow(features, "doc_id long, y double, x binary").orderBy(F.xxhash64("doc_id"), "doc_id", "x", "y").limit(2 * MAX_LABELLED).collect()
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows], np.float64).reshape(len(rows), FEATURES)
    return matrix, Network(x, np.array([r.y for r in rows]))


def score_quality(docs: DataFrame, model: tuple[np.ndarray, Network], score: str = "score") -> DataFrame:
    """docs with one more column, the probability of label 1. An input column of that name is replaced."""
    docs = docs.drop(score)
    sent = share(docs.sparkSession, model)
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, network = shared(sent)
        for batch in batches:
            values = network.predict(pooled(batch.column("text"), matrix).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names)

    return docs.mapInArrow(run, schema)


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with `score`. Null texts count as empty, and empty ones get a score like any other; label rows with other
    values than 0 and 1 are passed over; repeated rows are scored alike; an empty table gives an empty result."""
    return score_quality(docs, fit_quality(docs, labels))


def op4_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = classify_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
