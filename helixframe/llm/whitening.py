"""Whitening of vectors by polarisation.

No product of two different dimensions is ever summed. Exact squares of centred values are, for every dimension and for the
sum of every two dimensions; as (a + b)^2 - a^2 - b^2 = 2 a b, differences of these variances are all cross-covariances.
Values are integers and sums are exact, so the covariance matrix doesn't depend on how rows are dealt to tasks. Tasks add
up their batches and give one value for each dimension or pair; Spark adds those by key. Only the sums, d (d + 1) / 2 for
vectors of d dimensions, come to the driver, which puts the matrix together and takes its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import bound_batches, cut, share, shared

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Cells of a part of a batch, to bound memory.
PART_CELLS = 1 << 18
_SAFE = 1 << 62


class Fit(NamedTuple):
    """Of the vectors of one length: how many, each dimension's sum as whole part and rest (sum = n * whole + rest), and
    the components (columns), their variances (falling) and the trace of the covariance matrix."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float


def integer_vectors(batch: pa.RecordBatch, column: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integers) for the vectors of each length in a batch, in parts. Vectors that are null or hold null or
    non-finite entries are left out; an entry that gives no 64-bit integer is an error."""
    vectors = batch.column(column)
    sizes = np.where(vectors.is_valid(), vectors.value_lengths().fill_null(0), -1)
    flat = vectors.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        step = max(1, PART_CELLS // d)
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            values = flat[starts[part][:, None] + np.arange(d)]
            fine = np.isfinite(values).all(1)
            scaled = np.floor(values[fine] * SCALE)
            if len(scaled) and np.abs(scaled).max() >= _SAFE:
                raise OverflowError(f"vectors of entries up to 2**62 / {SCALE} can be whitened")
            yield part[fine], scaled.astype(np.int64) + SHIFT


def exact_sum(x: np.ndarray) -> np.ndarray:
    """Sums of columns as integers without bound."""
    most = int(np.abs(x).max(initial=0))
    return (x.sum(0) if most * max(len(x), 1) < _SAFE else x.astype(object).sum(0)).astype(object)


def squares(y: np.ndarray, sums: Callable[[np.ndarray], np.ndarray] = exact_sum) -> np.ndarray:
    """Exact sums of the squares of each column, then of each sum of columns i < j, by i, then j."""
    if 4 * int(np.abs(y).max(initial=0)) ** 2 >= _SAFE:
        y = y.astype(object)
    d = y.shape[1]
    return np.concatenate([sums(y**2), *[sums((y[:, i : i + 1] + y[:, i + 1 :]) ** 2) for i in range(d - 1)]])


def covariance(n: int, rest: np.ndarray, squared: np.ndarray) -> np.ndarray:
    """The covariance matrix, divisor n, from sums of squares of values whose sums are `rest`; rounded once, at the end."""
    d = len(rest)
    out = np.zeros((d, d))
    pairs = iter(squared[d:])
    for i in range(d):
        out[i, i] = (n * squared[i] - rest[i] ** 2) / n**2
        for j in range(i + 1, d):
            both = (next(pairs) - squared[i] - squared[j]) // 2
            out[i, j] = out[j, i] = (n * both - rest[i] * rest[j]) / n**2
    return out


def _totals(vectors: DataFrame, width: Callable[[int], int], add: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, list[int]]:
    """For each length d the sums of add(d, integers) over all vectors, `width(d)` exact values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for rows, x in integer_vectors(batch, 0):
                if len(rows):
                    d = x.shape[1]
                    found[d] = found.get(d, np.zeros(width(d), object)) + add(d, x)
        for d, values in found.items():
            k = np.arange(len(values))
            value = pa.array([Decimal(v) for v in values.tolist()], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), d)), pa.array(k), value], ["d", "k", "value"])

    sums = vectors.select("embedding").mapInArrow(run, "d long, k long, value decimal(38,0)").groupBy("d", "k").agg(F.sum("value").alias("value"))
    out: dict[int, list[int]] = {}
    for r in sums.collect():
        if r.value is None:
            raise OverflowError("sums of squares pass 38 digits")
        out.setdefault(r.d, [0] * width(r.d))[r.k] = int(r.value)
    return out


def fit_whitening(vectors: DataFrame) -> dict[int, Fit]:
    """A fit for each length of vectors. Two passes: sums, then squares of values less the whole part of their mean."""
    bound_batches(vectors.sparkSession)
    sums = _totals(vectors, lambda d: d + 1, lambda d, x: np.concatenate([exact_sum(x), np.array([len(x)], object)]))
    whole = {d: np.array([s // v[-1] for s in v[:-1]], np.int64) for d, v in sums.items()}
    squared = _totals(vectors, lambda d: d * (d + 1) // 2, lambda d, x: squares(x - whole[d]))
    fits = {}
    for d, v in sums.items():
        n, rest = v[-1], np.array([s % v[-1] for s in v[:-1]], object)
        matrix = covariance(n, rest, squared[d])
        variances, components = np.linalg.eigh(matrix)
        fits[d] = Fit(n, whole[d], rest, components[:, ::-1], variances[::-1], float(np.trace(matrix)))
    return fits


def _deviation(y: np.ndarray, fit: Fit) -> pa.Array:
    """Exact sums of (n y - rest)^2, that is of (n x - S)^2."""
    if (fit.n * (int(np.abs(y).max(initial=0)) + 1)) ** 2 * y.shape[1] < _SAFE:
        return pa.array(((fit.n * y - fit.rest.astype(np.int64)) ** 2).sum(1)).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(int(v)) for v in ((fit.n * y.astype(object) - fit.rest) ** 2).sum(1)], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """(vec_id, dims, n, deviation, whitened, explained, identity_error): the first `components` (all, if fewer) whitened
    values of every vector, an array, beside n vectors' share of variance of each, and how far from the identity the
    covariance of the whitened values is, measured over all rows.

    Vectors that are null or hold null or non-finite entries are left out, empty ones too. Vectors are whitened with those
    of their length. A repeated row counts each time; a null id stays null. Components without variance have null values,
    share 0 and no part in identity_error, which is null if none has any. An entry of 2**62 / SCALE or more, and sums of
    over 38 digits, are errors. The driver holds d^2 numbers for vectors of d dimensions. An empty table gives none. Only
    vec_id and embedding are read."""
    fits = fit_whitening(vectors)
    sent = share(vectors.sparkSession, (fits, components))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, components = shared(sent)
        for batch in batches:
            for rows, x in integer_vectors(batch):
                if not len(rows):
                    continue
                d = x.shape[1]
                fit, k = fits[d], min(components, d)
                y = x - fit.whole
                able = fit.variances[:k] > has_variance(fit)
                centred = y - (fit.rest / fit.n).astype(float)
                values = np.where(able, (centred @ fit.components[:, :k]) / np.sqrt(np.where(able, fit.variances[:k], 1)), 0)
                flat = pa.array(values.ravel(), mask=np.tile(~able, len(rows)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, k), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), d), pa.int32()), _deviation(y, fit), lists], ["vec_id", "dims", "deviation", "whitened"])

    rows = cut(vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, dims int, deviation decimal(38,0), whitened array<double>"))
    errors = identity_errors(rows, {d: sum(f.variances[: min(components, d)] > has_variance(f)) for d, f in fits.items()})
    by_length = [(d, f.n, [float(v) / f.trace if v > has_variance(f) else 0.0 for v in f.variances[: min(components, d)]], errors[d]) for d, f in fits.items()]
    known = vectors.sparkSession.createDataFrame(by_length, "dims int, n long, explained array<double>, identity_error double")
    return rows.join(F.broadcast(known), "dims").select("vec_id", "dims", "n", "deviation", "whitened", "explained", "identity_error")


def has_variance(fit: Fit) -> float:
    """What a variance must exceed to be told from rounding."""
    return float(fit.variances[0]) * len(fit.variances) * np.finfo(float).eps if fit.trace > 0 else np.inf


def identity_errors(rows: DataFrame, able: dict[int, int]) -> dict[int, float | None]:
    """For each length, the largest absolute entry of the covariance of the first `able` whitened values minus the
    identity: centred before multiplying, as Spark's covar_pop is."""
    k = max(able.values(), default=0)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    entries = [F.covar_pop(F.get("whitened", i), F.get("whitened", j)).alias(f"c{i}_{j}") for i, j in pairs]
    if not pairs:
        return dict.fromkeys(able)
    found = {r.dims: r for r in rows.groupBy("dims").agg(*entries).collect()}
    worst = lambda d: max(abs(found[d][f"c{i}_{j}"] - (i == j)) for i, j in pairs if j < able[d])
    return {d: worst(d) if n else None for d, n in able.items()}


def op11_whitening(spark, sf_dir):
    rows = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = rows.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "z"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", F.col("z.whitened").alias("whitened"), F.col("z.explained").alias("explained"), "identity_error")
