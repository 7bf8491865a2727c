"""Whitening of embeddings by their principal components.

Sums and covariance are added up by the tasks that hold the vectors; only a matrix as wide as a vector is long reaches the driver. Its
eigenvectors are found in single precision and corrected by the iteration of Ogita and Aishima, matrix products in extended precision
that double the correct digits a round. Eigenvalues too close to be told apart in a round form a cluster: its basis is kept
orthonormal and turned by the solution of the small problem that the cluster's own vectors span, shifted to its middle.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import rows, workers, written

#: Steps a unit of a component; the whole numbers that vectors are counted in.
SCALE = 256
#: Tasks that first add up the matrices of all others.
ADDED = 64
ROUNDS = 12
LONG = np.longdouble
_LARGEST = (1 << 63) - 1


# ---- eigenvectors

def clusters(values: np.ndarray, close: float) -> list[np.ndarray]:
    """Places of values that hang together by distances of at most ``close``, two or more."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > close) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def _largest(m: np.ndarray):
    return np.sqrt((m * m).sum())


def _round(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One correction of approximate eigenvectors: corrected vectors, eigenvalues, the correction, and distance below which eigenvalues are not told apart."""
    lack = np.eye(len(a), dtype=LONG) - x.T @ x
    turned = x.T @ (a @ x)
    values = np.diag(turned) / (1 - np.diag(lack))
    close = 2 * (_largest(turned - np.diag(values)) + _largest(a) * _largest(lack))
    apart = values[None, :] - values[:, None]
    far = np.abs(apart) > close
    change = np.where(far, (turned + values[None, :] * lack) / np.where(far, apart, 1), lack / 2)
    return x + x @ change, values, change, close


def _turn(a: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The eigenvectors within the space of a cluster's vectors."""
    part = own.T @ (a @ own)
    part = (part + part.T) / 2
    part -= np.eye(len(part), dtype=LONG) * (np.trace(part) / len(part))
    size = np.abs(part).max()
    if not size or _largest(part - np.diag(np.diag(part))) <= np.finfo(LONG).eps * len(a) * _largest(a):
        return own  # equal as far as this precision goes: every basis will do
    return own @ np.linalg.eigh((part / size).astype(np.float64))[1].astype(LONG)


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns, their largest entry positive) of a symmetric matrix, to double precision."""
    size = np.abs(matrix).max(initial=0)
    if not size:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    a = matrix.astype(LONG) / LONG(size)
    a = (a + a.T) / 2
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(LONG)
    for _ in range(ROUNDS):
        x, values, change, close = _round(a, x)
        for own in clusters(values, close):
            x[:, own] = _turn(a, x[:, own])
        if np.abs(change).max() <= 8 * np.finfo(LONG).eps * len(a):
            break
    values = np.diag(x.T @ (a @ x)) / np.diag(x.T @ x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(0))
    x *= np.where(x[np.abs(x).argmax(0), np.arange(len(a))] < 0, -1, 1)
    return (values[order] * LONG(size)).astype(np.float64), x.astype(np.float64)


# ---- sums over tasks

def _matrix(column) -> np.ndarray:
    """A list column whose lists have one length, as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


PART = pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))])
PART_DDL = "i int, row array<double>"


def _emit(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if total is not None:
        yield rows(PART, i=range(len(total)), row=list(total))


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch.column("i").to_pylist(), _matrix(batch.column("row")) if batch.num_rows else ()):
            total[i] = total[i] + row if i in total else row.copy()
    if total:
        yield rows(PART, i=sorted(total), row=[total[i] for i in sorted(total)])


def matrix_sum(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum over all vectors (column x) of the matrices that ``of`` makes of some; a task holds one sum, whatever it reads."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                more = of(_matrix(batch.column("x")))
                total = more if total is None else total + more
        yield from _emit(total)

    parts = fit.mapInArrow(run, PART_DDL).repartition(ADDED, F.spark_partition_id()).mapInArrow(_added, PART_DDL)
    found = {r.i: r.row for r in parts.repartition(1).mapInArrow(_added, PART_DDL).collect()}
    return np.array([found[i] for i in sorted(found)]) if found else None


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of their components."""
    schema = pa.schema([("i", pa.int32()), ("total", pa.decimal128(38, 0)), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                high, low = x >> 32, x & 0xFFFFFFFF
                total = total + np.array([(int(h) << 32) + int(v) for h, v in zip(high.sum(0), low.sum(0))], object)
                n += len(x)
        if n:
            yield rows(schema, i=range(len(total)), total=[decimal.Decimal(int(t)) for t in total], n=[n] * len(total))

    found = fit.mapInArrow(run, "i int, total decimal(38,0), n long").groupBy("i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    found.sort(key=lambda r: r.i)
    return (found[0].n, [int(r.total) for r in found]) if found else (0, [])


# ---- rows

def whole_numbers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and x, floor(256 * component) as whole numbers, of vectors without null or non-finite components.

    Null and empty vectors are left out too, and so are those not as long as most (of equally many, as the longest).
    """
    workers(vectors.sparkSession)
    c = F.col(column)
    fine = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    own = vectors.filter(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform(c, lambda v: F.floor(v.cast("double") * SCALE).cast("long")).alias("x"))
    usual = own.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return own.filter(F.size("x") == (usual.d if usual else 0))


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[list, np.ndarray]:
    """Of some vectors: n * x - sums, exact (64-bit where that holds them, else Python's), and x - sums / n."""
    if n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, sums), default=0) < 1 << 62:
        exact = n * x - np.array(sums, np.int64)
    else:
        exact = n * x.astype(object) - np.array(sums, object)
    return exact, exact.astype(np.float64) / n


def _squares(exact: np.ndarray) -> list[int | None]:
    """Exact sums of squares; null beyond 64 bits."""
    if exact.dtype != object and (exact.astype(np.float64) ** 2).sum(1).max(initial=0) < 9e18:
        return (exact * exact).sum(1).tolist()
    return [s if (s := sum(int(v) ** 2 for v in row)) <= _LARGEST else None for row in exact]


def whitened(vectors: DataFrame, most: int = 4, column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and each of its first components.

    Components are fitted to the distinct vectors of whole numbers (``whole_numbers`` says which rows are left out); every row then gets
    its values, rows that repeat a vec_id or have none too. Equal eigenvalues leave their order open; a component without variance
    is left out, so a single vector, or none, gives an empty result. A deviation that 64 bits do not hold is null.
    """
    spark = vectors.sparkSession
    own = whole_numbers(vectors, column)
    fit = written(own.select("x").distinct(), "fit-list")
    n, sums = _sums(fit)
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
    ddl = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n:
        return spark.createDataFrame([], ddl)

    def outer(x: np.ndarray) -> np.ndarray:
        y = centred(x, n, sums)[1]
        return y.T @ y

    covariance = matrix_sum(fit, outer) / n
    values, axes = eigen(covariance)
    keep = min(most, int((values > len(values) * np.finfo(np.float64).eps * values[0]).sum()) if values[0] > 0 else 0)
    if not keep:
        return spark.createDataFrame([], ddl)
    turn = axes[:, :keep] / np.sqrt(values[:keep])
    explained = values[:keep] / math.fsum(np.diag(covariance))

    def of_whitened(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, sums)[1] @ turn  # their mean is zero, as that of the centred vectors is
        return w.T @ w

    error = float(np.abs(matrix_sum(fit, of_whitened) / n - np.eye(keep)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            exact, y = centred(_matrix(batch.column("x")), n, sums)
            m = len(y)
            again = np.repeat(np.arange(m), keep)
            yield rows(schema, vec_id=batch.column("vec_id").take(pa.array(again)), component=np.tile(np.arange(1, keep + 1), m), n=np.full(m * keep, n),
                       deviation=pa.array(_squares(exact), pa.int64()).take(pa.array(again)), whitened=(y @ turn).ravel(),
                       explained=np.tile(explained, m), identity_error=np.full(m * keep, error))

    return own.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, ddl)
