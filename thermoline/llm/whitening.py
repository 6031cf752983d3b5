"""Embedding whitening: pivoted Cholesky of the scatter, then one-sided Jacobi on its factor."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermoline.llm.common import library_path, others
from thermoline.session import materialize

#: Entries are fixed-point numbers: SCALE steps a unit, from OFFSET on.
SCALE, OFFSET = 64, 1_000_000

COMPONENTS = 16

MADE = ["deviation", "whitened"]

#: Rows that one numpy product takes.
ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """Counts and sums of the fit list, and the eigenpairs of its covariance by falling value:
    `axes` has one unit column for each."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part of the mean is taken off in integers, so that nothing is lost
        to the size of the entries."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.axes / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n*x - S)^2, exact; None beyond 63 bits."""
        sums = np.array(self.sums, object)
        most = max((abs(int(v)) for v in (x.max(), x.min())), default=0) if x.size else 0
        most = most * self.n + max((abs(s) for s in self.sums), default=0)
        if most < 1 << 62:
            apart = x * np.int64(self.n) - sums.astype(np.int64)
            if float(np.abs(apart).max(initial=0)) ** 2 * max(1, x.shape[1]) < 2.0 ** 62:
                return (apart * apart).sum(axis=1).tolist()
        exact = ((x.astype(object) * self.n - sums) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def fixed_point(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """`rows` with `x`, the entries as whole numbers; rows whose vector is null or holds null or
    non-finite entries go. Entries beyond what a long holds take its ends."""
    good = F.col(vector).isNotNull() & ~F.exists(
        F.col(vector), lambda c: c.isNull() | F.isnan(c.cast("double"))
        | (F.abs(c.cast("double")) == float("inf")))
    return rows.where(good).withColumn("x", F.transform(
        vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, size: int,
            of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of the (size, size) products `of` makes: each task sends its own sum
    only, entry by entry; the driver gets size * size numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                total += of(_matrix(batch.column("x").slice(at, ROWS)))
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.reshape(-1)), pa.array(j.reshape(-1)), pa.array(total.reshape(-1))],
            ["i", "j", "value"])

    done = rows.select("x").mapInArrow(run, "i long, j long, value double").groupBy("i", "j").agg(
        F.sum("value").alias("value")).toArrow()
    out = np.zeros((size, size))
    out[done["i"].to_numpy(), done["j"].to_numpy()] = done["value"].to_numpy()
    return out


def pivoted_cholesky(matrix: np.ndarray, least: float = 1e-13) -> np.ndarray:
    """Lower trapezoidal factor, rows in the order of `matrix`, one column for each pivot: the
    largest remaining diagonal entry comes next, until all are `least` of the first or below."""
    a = np.array(matrix, np.float64)
    left = a.diagonal().copy()
    stop = least * max(left.max(initial=0.0), 0.0)
    columns: list[np.ndarray] = []
    done: list[int] = []
    for _ in range(len(a)):
        p = int(np.argmax(left))
        if left[p] <= stop or left[p] <= 0:
            break
        made = np.array(columns).reshape(len(columns), len(a))
        column = (a[:, p] - made.T @ made[:, p]) / np.sqrt(left[p])
        column[done] = 0.0  # above the diagonal
        left = left - column ** 2
        done.append(p)
        left[done] = 0.0
        columns.append(column)
    return np.array(columns).reshape(len(columns), len(a)).T


def jacobi(factor: np.ndarray, close: float = 1e-15, sweeps: int = 60) -> tuple[np.ndarray,
                                                                                np.ndarray]:
    """Eigenvalues of factor @ factor.T, falling, and unit eigenvectors as columns: columns of the
    factor are turned in pairs until all are at right angles; then squared lengths are the values
    and directions the vectors. Each round turns pairs that share no column."""
    work = np.array(factor, np.float64)
    count = work.shape[1]
    even = count + count % 2
    ring = np.arange(even)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(even - 1):
            p, q = ring[:even // 2], ring[even // 2:][::-1]
            real = (p < count) & (q < count)
            p, q = p[real], q[real]
            x, y = work[:, p], work[:, q]
            alpha, beta = (x * x).sum(axis=0), (y * y).sum(axis=0)
            gamma = (x * y).sum(axis=0)
            size = np.sqrt(alpha * beta)
            apart = np.divide(np.abs(gamma), size, out=np.zeros_like(size), where=size > 0)
            worst = max(worst, float(apart.max(initial=0.0)))
            turn = apart > close
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0)
                         / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            work[:, p], work[:, q] = c * x - s * y, s * x + c * y
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if worst <= 8 * close:
            break
    length = np.sqrt((work * work).sum(axis=0))
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    return length[order] ** 2, work[:, order] / length[order]


def learn(distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the rows of `distinct` (a column x); None where no row is left or all are
    equal. Rows must have one length."""
    library_path(distinct.sparkSession)
    first = distinct.select(F.size("x").alias("size")).first()
    size = first["size"] if first else 0
    if not size:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"))
            n += len(x)
            # Halves, so that no sum of a task leaves 63 bits.
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int64()), pa.array([n] * size, pa.int64()),
             pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    wide = T.DecimalType(38, 0)
    rows = distinct.select("x").mapInArrow(run, "i long, n long, high long, low long").groupBy(
        "i").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast(wide)).alias("high"),
                 F.sum(F.col("low").cast(wide)).alias("low")).collect()
    rows.sort(key=lambda r: r["i"])
    n = rows[0]["n"]
    sums = [(int(r["high"]) << 32) + int(r["low"]) for r in rows]
    start = Whitening(n, sums, np.zeros(0), np.zeros((size, 0)), 0.0)

    def products(x: np.ndarray) -> np.ndarray:
        d = start.centred(x)
        return d.T @ d

    covariance = _summed(distinct, size, products) / n
    trace = float(covariance.trace())
    if trace <= 0:
        return None
    values, axes = jacobi(pivoted_cholesky(covariance))
    return Whitening(n, sums, values[:components], axes[:, :components], trace)


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    size = len(model.values)

    def products(x: np.ndarray) -> np.ndarray:
        w = model.project(x)
        return w.T @ w

    done = _summed(distinct, size, products) / model.n
    return float(np.abs(done - np.eye(size)).max())


def fit_list(rows: DataFrame) -> DataFrame:
    """Each different x once, of the length that most rows have (the longer one of two), written
    to the shared folder."""
    common = rows.groupBy(F.size("x").alias("size")).count().orderBy(
        F.desc("count"), F.desc("size")).first()
    size = common["size"] if common else 0
    return materialize(rows.where(F.size("x") == size).select("x").distinct(), "fit_list")


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """All columns of `rows` (one of them x) with `deviation`, exact (null beyond 63 bits), and
    `whitened`, one entry for each component. Rows of another length than the fit list are not in
    its space and left out."""
    library_path(rows.sparkSession)
    size = len(model.sums)
    kept = rows.where(F.size("x") == size)
    kept = kept.select(*others(kept, MADE))
    schema = T.StructType([*kept.schema.fields, T.StructField("deviation", T.LongType()),
                           T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part.column("x"))
                done = model.project(x)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(model.deviation(x), pa.int64()),
                     pa.ListArray.from_arrays(
                         np.arange(len(x) + 1, dtype=np.int32) * done.shape[1],
                         pa.array(done.reshape(-1)))], schema.names)

    return kept.mapInArrow(run, schema)


def whiten(embeddings: DataFrame, vector: str = "embedding",
           components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, float]:
    """(rows, model, identity error): every row of `embeddings` whose vector is whole, with x,
    deviation and `whitened`, by a model that is fitted to each different x once.

    Scatter and sums are added up in tasks, centred before multiplying; only these (the square of
    a vector's length, whatever the number of rows) reach the driver, where a pivoted Cholesky
    factor is turned by one-sided Jacobi. Repeated rows count once in the fit and are all in the
    result; a table of fewer than two different vectors has no components, and (rows, None, 0.0)
    comes back with no row. Columns named x, deviation or whitened are replaced.
    """
    rows = fixed_point(embeddings, vector)
    distinct = fit_list(rows)
    model = learn(distinct, components)
    if model is None:
        none = rows.where(F.lit(False))
        return none.select(*others(none, MADE), F.lit(None).cast("long").alias("deviation"),
                           F.lit(None).cast("array<double>").alias("whitened")), None, 0.0
    return transform(rows, model), model, identity_error(distinct, model)


def by_component(rows: DataFrame, model: Whitening | None, error: float) -> DataFrame:
    """One row for each row of `rows` and component, numbered from 1."""
    share = [] if model is None else (model.values / model.trace).tolist()
    n = 0 if model is None else model.n
    return rows.select(
        "vec_id", F.lit(n).cast("long").alias("n"), "deviation",
        F.posexplode("whitened").alias("_place", "whitened"),
        F.lit(share).cast("array<double>").alias("_share")).select(
            "vec_id", (F.col("_place") + 1).alias("component"), "n", "deviation", "whitened",
            F.get("_share", F.col("_place")).alias("explained"),
            F.lit(error).cast("double").alias("identity_error"))
