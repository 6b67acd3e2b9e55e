"""Embedding whitening: leading components of the covariance, scaled to unit variance.

The covariance is summed by tasks over the distinct vectors, centred before
multiplying.  One matrix of its side is solved on the driver; components travel
to the tasks, which project every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from lintlake.llm.common import stored
from lintlake.llm.tridiagonal import leading_eigenpairs

# The grid on which entries are counted.
STEPS, OFFSET = 64, 1_000_000
COMPONENTS = 16
# Entries beyond this are taken as this, so that sums of a batch fit a long.
LARGEST_ENTRY = 1e12
# A component with a smaller share of the variance is rounding noise.
LEAST_SHARE = 1e-11


def grid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, x)`` of rows whose vector is whole and finite, entries on the grid, all of one width."""
    entries = F.col(vector_col).cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = table.where(F.col(vector_col).isNotNull() & finite).select(F.col(id_col).alias("id"), entries.alias("c"))
    width = whole.agg(F.max(F.size("c"))).first()[0] or 0
    limit = F.lit(LARGEST_ENTRY)
    x = F.transform("c", lambda c: F.floor(STEPS * F.least(F.greatest(c, -limit), limit)) + F.lit(OFFSET).cast("long"))
    missing = F.array_repeat(F.lit(OFFSET).cast("long"), F.lit(width) - F.size("c"))
    return whole.select("id", F.when(F.size("c") == width, x).otherwise(F.concat(x, missing)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def vector_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                part = [int(s) for s in _matrix(batch.column(0)).sum(axis=0)]
                sums = part if sums is None else [a + b for a, b in zip(sums, part)]
                n += batch.num_rows
        sums = sums or []
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(sums)), pa.int32()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0)),
             pa.array([n] * len(sums), pa.int64())], names=["i", "total", "n"])

    parts = fit.mapInArrow(partial, "i int, total decimal(38,0), n long")
    rows = parts.groupBy("i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("i").collect()
    return (rows[0]["n"] if rows else 0), [int(r["total"]) for r in rows]


def _row_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up rows of one number; memory is that of one matrix."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        for i, row in zip(batch.column(0).to_pylist(), _matrix(batch.column(1))):
            sums[i] = sums[i] + row if i in sums else row.copy()
    yield _rows_batch(sums)


def _rows_batch(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    rows = pa.array([r.tolist() for r in sums.values()], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), rows], names=["i", "row"])


def summed_products(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray], side: int) -> np.ndarray:
    """Sum of ``y yᵀ`` over the vectors, ``of`` giving the rows ``y`` of a batch.

    Each task adds up its own matrix and hands on its rows, which are then
    added up by row number.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((side, side))
        for batch in batches:
            if batch.num_rows:
                y = of(_matrix(batch.column(0)))
                total += y.T @ y
        yield _rows_batch(dict(enumerate(total)))

    schema = "i int, row array<double>"
    rows = fit.mapInArrow(partial, schema).repartition("i").mapInArrow(_row_sums, schema)
    return np.array([r["row"] for r in rows.orderBy("i").collect()])


class Whitener:
    """What whitening needs: exact sums, components, their eigenvalues and shares."""

    def __init__(self, fit: DataFrame, most: int = COMPONENTS):
        self.n, self.sums = vector_sums(fit)
        self.floors = np.array([s // self.n for s in self.sums], dtype=np.int64)
        self.rests = np.array([s % self.n for s in self.sums], dtype=np.int64)
        side = len(self.sums)
        covariance = summed_products(fit, self.centred, side) / self.n if side else np.zeros((0, 0))
        trace = float(np.trace(covariance))
        values, vectors = leading_eigenpairs((covariance + covariance.T) / 2, most) if trace > 0 else (np.zeros(0), np.zeros((side, 0)))
        real = values > LEAST_SHARE * trace
        self.values, self.shares = values[real], values[real] / (trace or 1.0)
        self.projection = vectors[:, real] / np.sqrt(self.values)
        k = len(self.values)
        # Whitened vectors have mean zero, since their originals are centred.
        spread = summed_products(fit, self.whitened, k) / self.n if k else np.zeros((0, 0))
        self.identity_error = float(np.abs(spread - np.eye(k)).max(initial=0.0))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floors) - self.rests / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.projection

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of ``(n x - S)²`` over the dimensions; None where a long can't hold it."""
        shifted = x - self.floors
        largest = (int(np.abs(shifted).max(initial=0)) + 1) * self.n
        if largest * largest * max(1, x.shape[1]) < 1 << 63:
            d = shifted * self.n - self.rests
            return (d * d).sum(axis=1).tolist()
        exact = [sum((int(v) * self.n - int(r)) ** 2 for v, r in zip(row, self.rests)) for row in shifted]
        return [v if v < 1 << 63 else None for v in exact]


def whitened_rows(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per whole vector and component: the whitened coordinate and what explains it.

    Rows whose vector is null or holds a null or non-finite entry are dropped.
    The covariance is over distinct vectors, so copies do not count twice;
    every other row, repeated or with a null id, gets its rows.  Shorter vectors
    are as if they ended in zeros.  Components whose share of the variance is
    below 1e-11 are left out, so an empty table, one vector, or only copies of
    one give no rows.  Entries beyond 1e12 are taken as 1e12; ``deviation`` is
    null where no long holds it.  Other columns are not read.

    The driver holds one matrix whose side is the vectors' width.
    """
    id_type = table.schema[id_col].dataType
    schema = StructType([
        StructField(id_col, id_type), StructField("component", IntegerType()), StructField("n", LongType()),
        StructField("deviation", LongType()), StructField("whitened", DoubleType()),
        StructField("explained", DoubleType()), StructField("identity_error", DoubleType())])
    vectors = grid_vectors(table, id_col, vector_col)
    fit = stored(vectors.select("x").distinct(), "vectors")
    whitener = Whitener(fit, components)
    k = len(whitener.values)
    if not k:
        return table.sparkSession.createDataFrame([], schema)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = _matrix(batch.column(1))
            each = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, whitener.n, dtype=np.int64)),
                pa.array(whitener.deviations(x), pa.int64()).take(pa.array(each)),
                pa.array(whitener.whitened(x).ravel()),
                pa.array(np.tile(whitener.shares, rows)),
                pa.array(np.full(rows * k, whitener.identity_error)),
            ], names=schema.names)

    return vectors.mapInArrow(project, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
