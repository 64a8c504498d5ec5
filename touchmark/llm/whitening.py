"""Whitening of vectors by shifted CholeskyQR: Gram passes over the rows, triangular solves, the SVD of the R factor."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchmark.llm.common import read, register, stored

_LONG = 2**63 - 1
#: Rounding of doubles, and passes after the first that may be needed until the rows are orthonormal.
_UNIT = float(np.finfo("float64").eps) / 2
_PASSES = 6


def scaled(vector: str, factor: int = 256):
    """floor(factor * x) of each component as long; null unless all components are finite numbers."""
    values = F.transform(vector, lambda x: F.floor(x.cast("double") * factor))
    # NaN is beyond infinity here.
    return F.when(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), values)


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: ``n`` vectors, their sums, and the components as columns with their eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def dimensions(self) -> int:
        return len(self.sums)

    def centred(self, rows: np.ndarray) -> np.ndarray:
        return rows - np.array([s / self.n for s in self.sums])

    def whitened(self, rows: np.ndarray, upto: int) -> np.ndarray:
        return self.centred(rows) @ (self.components[:, :upto] / np.sqrt(self.values[:upto]))


def _longs(column: pa.Array, dimensions: int) -> np.ndarray:
    """Rows of whole numbers, short ones filled with zeros."""
    out = np.zeros((len(column), dimensions), "int64")
    out[np.arange(dimensions) < column.value_lengths().to_numpy()[:, None]] = column.flatten().to_numpy()
    return out


def _summed(rows: DataFrame, dimensions: int, matrix: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all batches of a matrix made of their rows; each task sends its own sum, cell by cell."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = matrix(_longs(batch.column(0), dimensions))
            total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape, "int32")
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "x"])

    cells = rows.select("x").mapInArrow(partial, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
    found = cells.toPandas()  # as many cells as the matrix has
    out = np.zeros((int(found["i"].max()) + 1, int(found["j"].max()) + 1))
    out[found["i"], found["j"]] = found["x"]
    return out


def _sums(rows: DataFrame, dimensions: int) -> list[int]:
    """The exact sum of each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dimensions
        for batch in batches:
            x = _longs(batch.column(0), dimensions)
            # Halves of 32 bits add up without overflow in any batch.
            parts = zip((x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist())
            total = [t + (high << 32) + low for t, (high, low) in zip(total, parts)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dimensions), pa.int32()), pa.array(total, pa.decimal128(38, 0))], ["i", "x"])

    cells = rows.select("x").mapInArrow(partial, "i int, x decimal(38,0)").groupBy("i").agg(F.sum("x").alias("x"))
    out = [0] * dimensions
    for r in cells.collect():
        out[r["i"]] = int(r["x"])
    return out


def fit(vectors: DataFrame) -> Whitening | None:
    """The whitening of the distinct vectors of ``x``; None when there are none.

    Shifted CholeskyQR: the Gram matrix of the centred rows, with a small shift, gives a first triangular
    factor; each further pass solves every row through the factors so far and factors the Gram matrix of what
    comes out, until that is the identity. The product of the factors is the rows' R, whose SVD has the
    components, more exactly than the covariance would: a Gram matrix squares what rounding has to bear.
    Directions without variance never become orthonormal; what is left of the last Gram matrix then goes
    into R by its square root, so that they keep a singular value near zero.
    """
    listed = stored(vectors.select("x").distinct(), "fit-list")
    n, dimensions = listed.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        return None
    dimensions = max(dimensions, 1)
    sums = _sums(listed, dimensions)
    means = np.array([s / n for s in sums])

    def gram(r: np.ndarray) -> np.ndarray:
        def matrix(rows: np.ndarray) -> np.ndarray:
            solved = np.linalg.solve(r.T, (rows - means).T)  # the factor's rows: r' y = x
            return solved @ solved.T

        return _summed(listed, dimensions, matrix)

    whole = gram(np.eye(dimensions))
    trace = float(np.trace(whole))
    if trace <= 0:
        return Whitening(n, sums, np.zeros((dimensions, 0)), np.zeros(0), 0.0)
    r, step, error = np.eye(dimensions), whole, np.inf
    for _ in range(_PASSES):
        # The shift keeps the factor real whatever rounding does to small eigenvalues.
        size = np.linalg.norm(step, 2)
        shift = 11 * (n * dimensions + dimensions * (dimensions + 1)) * _UNIT * size if error > 0.5 else 0.0
        try:
            factor = np.linalg.cholesky(step + max(shift, 0.0) * np.eye(dimensions)).T
        except np.linalg.LinAlgError:
            factor = np.linalg.cholesky(step + max(shift, 1e3 * dimensions * _UNIT * size) * np.eye(dimensions)).T
        r = factor @ r
        step = gram(r)
        before, error = error, float(np.abs(step - np.eye(dimensions)).max())
        if error < 1e-13 * dimensions or error > 0.5 * before:
            break
    values, vectors_ = np.linalg.eigh(step)
    r = np.sqrt(np.maximum(values, 0))[:, None] * vectors_.T @ r
    _, singular, components = np.linalg.svd(r)
    eigenvalues = singular**2 / n
    found = eigenvalues > dimensions * 4 * _UNIT * eigenvalues[0]
    return Whitening(n, sums, components[found].T, eigenvalues[found], trace / n)


def identity_error(vectors: DataFrame, whitening: Whitening, upto: int) -> float:
    """How far the covariance of the whitened fit list is from the identity, at its worst entry; another pass."""
    upto = min(upto, len(whitening.values))
    if not upto:
        return 0.0
    rows = vectors.select("x").distinct()

    def matrix(x: np.ndarray) -> np.ndarray:
        white = whitening.whitened(x, upto)
        return np.vstack([white.T @ white, white.sum(0)])

    sums = _summed(rows, whitening.dimensions, matrix) / whitening.n
    covariance = sums[:-1] - np.outer(sums[-1], sums[-1])
    return float(np.abs(covariance - np.eye(upto)).max())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """Per row and component: key, component, n, deviation, whitened, explained, identity_error.

    Fitted on each distinct scaled vector once. Rows whose vector is null or holds null or non-finite
    entries are left out; missing entries of short vectors count as zero, scaled ones beyond long stay at
    its ends. Components without variance have no whitened value and are left out, so vectors that are all
    equal, or an empty table, give no rows. Repeated rows come back each. ``deviation`` is exact and a
    decimal, for it grows with the square of n.
    """
    rows = vectors.select(F.col(key).alias("key"), scaled(vector).alias("x")).filter("x IS NOT NULL")
    rows = stored(rows, "scaled")
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    fitted = fit(rows)
    if fitted is None or not len(fitted.values):
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    upto = min(components, len(fitted.values))
    error = identity_error(rows, fitted, upto)
    explained = fitted.values[:upto] / fitted.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.array(fitted.sums, object)
        small = max(map(abs, fitted.sums)) < _LONG // 2
        for batch in batches:
            x = _longs(batch.column(1), fitted.dimensions)
            most = int(np.abs(x.astype("float64")).max(initial=0)) + 1
            if small and fitted.dimensions * (2 * fitted.n * most) ** 2 < _LONG:
                deviation = pa.array(((fitted.n * x - sums.astype("int64")) ** 2).sum(1)).cast(pa.decimal128(38, 0))
            else:
                exact = (((fitted.n * x.astype(object) - sums) ** 2).sum(1)).tolist()
                deviation = pa.array([min(d, 10**38 - 1) for d in exact], pa.decimal128(38, 0))
            white = fitted.whitened(x, upto)
            again = pa.array(np.repeat(np.arange(len(x)), upto))
            columns = {
                "key": batch.column(0).take(again),
                "component": pa.array(np.tile(np.arange(1, upto + 1), len(x)), pa.int32()),
                "n": pa.array(np.full(len(again), fitted.n), pa.int64()),
                "deviation": deviation.take(again),
                "whitened": pa.array(white.ravel()),
                "explained": pa.array(np.tile(explained, len(x))),
                "identity_error": pa.array(np.full(len(again), error)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(project, schema).withColumnRenamed("key", key)


@register("op13_cholesky_whitening")
def op13_cholesky_whitening(spark: SparkSession, d: str) -> DataFrame:
    rows = whiten(read(spark, d, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").cast("long"))
