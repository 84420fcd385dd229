"""Embedding whitening: MLlib's singular values of the centred rows, with exact integer offsets and a check of the result.

Entries become integers, so that counts, sums and each row's offset ``n * x - sum`` are exact whatever the order of tasks; rows
are centred by that offset before anything is multiplied. ``RowMatrix.computeSVD`` sums the products of centred rows in a tree
and decomposes a matrix of dimensions, not of rows; its singular values, over n, are the variances of the components. The
total variance is not theirs but the sum of the exact deviations.

The driver holds one number for each dimension, the matrix of the components, and a Gramian of dimensions squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SCALE, SHIFT = 64, 1_000_000
#: Components with a smaller part of the largest singular value are rounding errors of the decomposition.
LEAST_RATIO = 1e-5
#: Up to so many dimensions all components are asked for, which MLlib answers by a dense decomposition to double precision.
DENSE = 1024
#: Entries beyond it have no place in a long once they are scaled.
LARGEST = 2.0**56
ROWS = "vec_id long, deviation decimal(38, 0), whitened array<double>"


@dataclass
class Whitening:
    n: int
    sums: list[int]
    variances: np.ndarray  # falling
    components: np.ndarray  # dimensions x components, unit columns
    total: float

    @property
    def projection(self) -> np.ndarray:
        return self.components / np.sqrt(self.variances)

    @property
    def explained(self) -> list[float]:
        return [float(e / self.total) for e in self.variances]


def integers(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that take part; the most frequent length counts, of equally frequent ones the longest."""
    C.small_batches(embeddings.sparkSession)
    whole = F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    rows = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & whole)
    lengths = rows.groupBy(F.size("embedding").alias("length")).count()
    top = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    if top is None:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, x array<bigint>")
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    return rows.where(F.size("embedding") == top.length).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def exact_sum(x: np.ndarray, axis: int) -> list[int]:
    """Integer sums without overflow."""
    if x.dtype != object and int(np.abs(x).max(initial=0)) * max(x.shape) >= 2**62:
        x = x.astype(object)
    return [int(v) for v in x.sum(axis=axis)]


def offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums; as Python's integers where 64 bits may not do."""
    largest = max(abs(n * int(v) - s) for column, s in zip(x.T, sums) for v in (column.min(), column.max()))
    if largest >= 2**62:
        return n * x.astype(object) - np.array(sums, object)
    low = np.array([s % 2**64 for s in sums], np.uint64).astype(np.int64)
    with np.errstate(over="ignore"):
        return x * np.int64(n) - low  # what wraps around comes back


def deviations(d: np.ndarray) -> list[int]:
    """The sum of squares of each row, exact."""
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] >= 2**62:
        d = d.astype(object)
    return [int(v) for v in (d * d).sum(axis=1)]


def counts(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each dimension; a task sends one row for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                part = exact_sum(matrix(batch), 0)
                n, total = n + batch.num_rows, part if total is None else [a + b for a, b in zip(total, part)]
        if n:
            yield pa.RecordBatch.from_pydict({"dim": range(len(total)), "n": [n] * len(total), "s": [str(v) for v in total]})

    parts = rows.mapInArrow(run, "dim long, n long, s string")
    got = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38, 0)")).alias("s")).orderBy("dim").collect()
    return (int(got[0].n), [int(r.s) for r in got]) if got else (0, [])


def total_variance(rows: DataFrame, n: int, sums: list[int]) -> float:
    """The trace of the covariance, from exact deviations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(sum(deviations(offsets(matrix(b), n, sums))) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_pydict({"part": [total / n**3]})

    return rows.mapInArrow(run, "part double").agg(F.sum("part")).first()[0]


def projected(rows: DataFrame, n: int, sums: list[int], by: np.ndarray | None) -> DataFrame:
    """ROWS: each vector centred, and projected if there is a matrix to project by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = offsets(matrix(batch), n, sums)
            centred = (d / n).astype(np.float64)
            out = np.ascontiguousarray(centred if by is None else centred @ by)
            ends = pa.array((np.arange(len(out) + 1) * out.shape[1]).astype(np.int32))
            dev = [Decimal(v) if v < 10**38 else None for v in deviations(d)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(dev, pa.decimal128(38, 0)), pa.ListArray.from_arrays(ends, pa.array(out.reshape(-1)))], names=["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(run, ROWS)


def row_matrix(rows: DataFrame, n: int, width: int) -> RowMatrix:
    vectors = rows.select(array_to_vector("whitened").alias("v"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"), n, width)


def fit(embeddings: DataFrame, k: int = 32) -> Whitening:
    """Count, sums, and at most ``k`` components by falling variance.

    Vectors that are null, empty, hold null or non-finite entries or such beyond 2**56, or have another length than most take no
    part. Components whose variance is nothing but rounding are left out, so there may be less than ``k``; without vectors, or
    where all are equal, there is none. Repeated rows count each time; of equal variances any base will do.
    """
    rows = integers(embeddings)
    n, sums = counts(rows)
    width = len(sums)
    none = Whitening(n, sums, np.zeros(0), np.zeros((width, 0)), 0.0)
    if not n or not (total := total_variance(rows, n, sums)):
        return none
    svd = row_matrix(projected(rows, n, sums, None), n, width).computeSVD(width if width <= DENSE else min(k, width), False, LEAST_RATIO)
    variances = np.array(svd.s.toArray()) ** 2 / n
    return Whitening(n, sums, variances[:k], svd.V.toArray()[:, : min(k, len(variances))], total)


def transform(embeddings: DataFrame, model: Whitening) -> DataFrame:
    """ROWS: vec_id, the exact deviation (null from 10**38 on) and the whitened vector of each row that takes part."""
    rows = integers(embeddings)
    if not model.n:
        return rows.sparkSession.createDataFrame([], ROWS)
    return projected(rows, model.n, model.sums, model.projection)


def identity_error(whitened: DataFrame, model: Whitening) -> float:
    """How far the covariance of the fitted rows, whitened, is from the identity; offsets add up to zero exactly, so they stay centred."""
    width = len(model.variances)
    if not width:
        return 0.0
    gramian = row_matrix(whitened, model.n, width).computeGramianMatrix().toArray()
    return float(np.abs(gramian / model.n - np.eye(width)).max())
