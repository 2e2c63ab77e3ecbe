"""Embeddings on whole-number steps, whitened by the leading components of their covariance.

A vector's entries c become long numbers floor(1024 * c) + 100000, so their sums and what is left after taking the mean are
exact. The centred rows, (n * x - S) / n from whole numbers, make an MLlib ``RowMatrix``; its Gramian divided by n is the
covariance. That is a table of dimensions by dimensions, whatever the number of rows is: its eigenvectors are found on the
driver, scaled by one over the root of their eigenvalue and broadcast, and ``mapInArrow`` multiplies batches of rows by them.

Nulls: a row whose vector is null or holds a null, a NaN, an infinity or an entry of 2**50 or more in size is dropped, and so is one
whose length is not the most common one (of equally common ones, the longest). Null and repeated ids are rows like any other.
Components whose eigenvalue is 0 to rounding are left out, so a table of one row or of equal rows gives none. Of either sign of
a component the one is taken whose entry of largest size is positive; equal eigenvalues are in LAPACK's order. A ``deviation`` that
no long can hold is null. An empty table gives an empty table. Columns named ``whitened`` or ``deviation`` are replaced.
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

STEPS, SHIFT = 1024, 100_000
LARGEST = float(1 << 50)
COMPONENTS = 8
#: Whole numbers of at most this size are added and multiplied as 64-bit ones, larger ones as Python's.
SAFE = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """The exact sums of ``n`` rows, the matrix that whitens a centred row, and the share of the trace of each component."""

    n: int
    sums: list[int]
    matrix: np.ndarray
    explained: list[float]


def whole_rows(df: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows that remain, with ``x``, the vector in whole numbers. Other columns are in the struct ``row``."""
    entries = F.transform(F.col(column), lambda c: c.cast("double"))
    fine = F.forall(entries, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)) & ~F.isnan(c))
    x = F.transform(entries, lambda c: F.floor(c * STEPS) + F.lit(SHIFT).cast("long"))
    rows = df.select(F.struct(*[c for c in df.columns if c not in ("whitened", "deviation")]).alias("row"), F.when(fine, x).alias("x")).where("x is not null")
    # One row.
    common = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("x") == (common["size"] if common else -1))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)


def _largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the sum of each dimension of ``x``. One row for each dimension reaches the driver."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, len(batch.column("x")[0]))
                more = x.sum(axis=0) if _largest(x) * len(x) < SAFE else x.astype(object).sum(axis=0)
                n, total = n + len(x), more.astype(object) if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0)), pa.array([n] * len(total), pa.int64())],
                names=["k", "total", "n"],
            )

    parts = rows.select("x").mapInArrow(of_batches, "k int, total decimal(38,0), n long")
    found = parts.groupBy("k").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("k").collect()
    return (found[0]["n"] if found else 0), [int(r["total"]) for r in found]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, as 64-bit numbers where they fit, else as Python's."""
    if _largest(x) * n + max(map(abs, sums), default=0) < SAFE:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviations(y: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row, or null where it is beyond a long."""
    if y.size and _largest(y) ** 2 * y.shape[1] >= SAFE:
        y = y.astype(object)
    return [int(v) if v < 1 << 63 else None for v in (y * y).sum(axis=1)]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of ``whole_rows`` by their ``components`` largest components."""
    n, sums = exact_sums(rows)
    d = len(sums)
    if not n or not d:
        return Whitening(n, sums, np.zeros((d, 0)), [])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = (centred(_matrix(batch, d), n, sums) / n).astype(float)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(0, c.size + 1, d, dtype=np.int32), c.ravel())], names=["c"])

    vectors = rows.select("x").mapInArrow(of_batches, "c array<double>").select(array_to_vector("c").alias("c"))
    gramian = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "c"), n, d).computeGramianMatrix()
    covariance = gramian.toArray() / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    kept = [k for k in range(min(components, d)) if values[k] > d * np.finfo(float).eps * values[0]]
    axes = axes[:, kept]
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(kept))]) if kept else np.ones(0)
    trace = float(np.trace(covariance))
    return Whitening(n, sums, axes * signs / np.sqrt(values[kept]), [float(values[k]) / trace for k in kept])


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """The columns of ``whole_rows``, with ``deviation`` (long) and ``whitened`` (array of one number for each component)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        d, k = m.matrix.shape
        for batch in batches:
            y = centred(_matrix(batch, d), m.n, m.sums)
            w = (y / m.n).astype(float) @ m.matrix
            lists = pa.ListArray.from_arrays(np.arange(0, k * len(y) + 1, max(k, 1), dtype=np.int32) if k else np.zeros(len(y) + 1, np.int32), w.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(deviations(y), pa.int64()), lists], names=["row", "deviation", "whitened"])

    row = rows.schema["row"].dataType.simpleString()
    found = rows.select("row", "x").mapInArrow(of_batches, f"row {row}, deviation long, whitened array<double>")
    return found.select("row.*", "deviation", "whitened")


def identity_error(whitened: DataFrame, components: int) -> float:
    """The largest entry, in size, of the covariance of ``whitened`` minus the identity. One row reaches the driver."""
    if not components:
        return 0.0
    at = lambda k: F.get("whitened", F.lit(k))
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    found = whitened.agg(*[F.covar_pop(at(i), at(j)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
