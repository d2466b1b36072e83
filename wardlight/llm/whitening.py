"""Embedding whitening by pivoted Cholesky and one-sided Jacobi.

Entries become whole numbers ``x = floor(64 c) + 1,000,000``.  One pass adds up
the count and the sums of each dimension, a second the products of what is left
after a whole-number centre near the mean is taken away.  All of these are whole
numbers, exact in any order, so the covariance (divisor n) does not depend on how
the table is cut; it is rounded once, when divided.

The covariance V is factored as ``P V P' = L L'`` with the largest remaining
diagonal as pivot, until nothing is left above rounding.  Jacobi rotations
then make the columns of L orthogonal: V = L L', so their squared norms are its
eigenvalues and the columns, divided by their norms, its components.  V itself
is never rotated, which keeps small eigenvalues accurate.

A row's deviation from the mean, projected on a component and divided by the
root of its eigenvalue, is its whitened coordinate.  The covariance of the
coordinates written out is measured in a third pass.

Vectors that are null or hold null or non-finite entries are dropped, and so are
those with an entry of 2**50 or more, which has no exact place on the grid.
Each vector length is a space of its own, with its own fit.  Components without
variance are not returned: one row, equal rows, empty vectors and an empty table
give no rows.  Repeated rows and rows without an id count as they occur.  A
deviation beyond 64 bits is null.  Equal eigenvalues come in either order.
Columns other than key and vector are not read, so they cannot clash.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.tables import written

SCALE, SHIFT = 64, 1_000_000
LARGEST = 2.0**50
ROWS = 2048
#: Bytes of models sent to the tasks at once.
MODEL_BYTES = 64 << 20


@dataclass
class Model:
    """Fit of one vector length: exact count and sums, eigenvalues and components."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray  # one in each row
    trace: float


# -- exact sums -------------------------------------------------------------------


class Exact:
    """Arrays of whole numbers added up; beyond 64 bits they go on as Python's own."""

    def __init__(self):
        self.n = 0
        self.total: list[np.ndarray] = []
        self.bound = 0

    def add(self, n: int, arrays: list[np.ndarray], bound: int) -> None:
        self.bound += bound
        if self.bound >= 1 << 62:
            arrays = [a.astype(object) for a in arrays]
            self.total = [a.astype(object) for a in self.total]
        self.total = [a + b for a, b in zip(self.total, arrays)] if self.total else arrays
        self.n += n

    def packed(self) -> bytes:
        return pickle.dumps((self.n, self.total, self.bound))


def gram(y: np.ndarray) -> tuple[np.ndarray, int]:
    """``y' y`` of whole numbers, exact, and a bound of its entries."""
    bound = int(np.abs(y).max(initial=0)) ** 2 * len(y)
    if bound < 1 << 53:
        y = y.astype(np.float64)
        return (y.T @ y).astype(np.int64), bound
    y = y.astype(object)
    return y.T @ y, bound


def grid(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each vector length of a batch: the rows and their whole numbers without the shift."""
    sizes = np.array([len(v) for v in batch.column("v")], np.int64)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        flat = batch.column("v").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield int(size), rows, np.floor(SCALE * flat).astype(np.int64).reshape(len(rows), size)


def _partial(centres: dict[int, np.ndarray] | None):
    """A task's part of the sums (first pass) or of sums and products about ``centres``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Exact] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                for size, rows, x in grid(whole.slice(at, ROWS)):
                    part = found.setdefault(size, Exact())
                    if centres is not None:
                        x = x - centres[size]
                    bound = int(np.abs(x).max(initial=0)) * len(x)
                    arrays = [x.sum(axis=0)]
                    if centres is not None:
                        products, more = gram(x)
                        arrays.append(products)
                        bound = max(bound, more)
                    part.add(len(rows), arrays, bound)
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int32()), pa.array([p.packed() for p in found.values()], pa.binary())], ["size", "part"]
            )

    return work


def _added(group: pd.DataFrame) -> pd.DataFrame:
    total = Exact()
    for raw in group["part"]:
        total.add(*pickle.loads(raw))
    return pd.DataFrame({"size": [group["size"].iloc[0]], "part": [total.packed()]})


def _totals(rows: DataFrame, centres: dict[int, np.ndarray] | None) -> dict[int, Exact]:
    """Sums by vector length, added in two steps so that no task meets all parts."""
    parts = rows.select("v").mapInArrow(_partial(centres), "size int, part binary")
    salted = parts.withColumn("salt", F.spark_partition_id() % 32)
    first = salted.groupBy("size", "salt").applyInPandas(_added, "size int, part binary")
    out = {}
    for row in first.groupBy("size").applyInPandas(_added, "size int, part binary").toLocalIterator():
        out[row["size"]] = Exact()
        out[row["size"]].add(*pickle.loads(row["part"]))
    return out


# -- factoring --------------------------------------------------------------------


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with ``v[order][:, order] = L L'``; L has a column for each pivot above rounding."""
    n = len(v)
    order, left = np.arange(n), np.diag(v).copy()
    factor = np.zeros((n, n))
    least = n * np.finfo(float).eps * left.max(initial=0.0)
    for k in range(n):
        p = k + int(np.argmax(left[k:]))
        if left[p] <= least:
            return factor[:, :k], order
        for a in (order, left):
            a[[k, p]] = a[[p, k]]
        factor[[k, p], :k] = factor[[p, k], :k]
        factor[k, k] = math.sqrt(left[k])
        factor[k + 1 :, k] = (v[order[k + 1 :], order[k]] - factor[k + 1 :, :k] @ factor[k, :k]) / factor[k, k]
        left[k + 1 :] -= factor[k + 1 :, k] ** 2
    return factor, order


def rotated(columns: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns made orthogonal by plane rotations, disjoint pairs at once."""
    w = columns.copy()
    r = w.shape[1]
    if r < 2:
        return w
    if r % 2:
        w = np.hstack([w, np.zeros((len(w), 1))])
    ring = np.arange(w.shape[1])
    limit = 4 * np.finfo(float).eps
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            i, j = ring[:half], ring[half:][::-1]
            a, b = w[:, i], w[:, j]
            alpha, beta, gamma = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            size = np.sqrt(alpha * beta)
            turn = np.abs(gamma) > limit * size
            if turn.any():
                worst = max(worst, float((np.abs(gamma[turn]) / size[turn]).max()))
                i, j, a, b = i[turn], j[turn], a[:, turn], b[:, turn]
                zeta = (beta[turn] - alpha[turn]) / (2 * gamma[turn])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                w[:, i], w[:, j] = c * (a - t * b), c * (t * a + b)
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if worst == 0.0:
            break
    return w[:, :r]


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above rounding, falling, and unit components in rows, signed by their largest entry."""
    factor, order = pivoted_cholesky(v)
    w = rotated(factor)
    norms = np.sqrt((w * w).sum(0))
    rank = np.argsort(-norms, kind="stable")
    rank = rank[norms[rank] > 0]
    components = np.zeros((len(rank), len(v)))
    components[:, order] = (w[:, rank] / norms[rank]).T
    if len(rank):
        top = np.argmax(np.abs(components), axis=1)
        components *= np.where(components[np.arange(len(rank)), top] < 0, -1.0, 1.0)[:, None]
    return norms[rank] ** 2, components


# -- the job --------------------------------------------------------------------


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v): rows whose vector is whole, as doubles."""
    whole = F.transform(column, lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(LARGEST / SCALE)))
    return vectors.select(F.col(key).alias("id"), whole.alias("v")).where("v is not null").where(fine)


def fit(rows: DataFrame, components: int | None = None) -> dict[int, Model]:
    """Fits by vector length; there are at most as many as the longest vector has entries."""
    first = _totals(rows, None)
    centres = {size: np.array([int(s) // t.n for s in t.total[0]], np.int64) for size, t in first.items()}
    models = {}
    for size, t in _totals(rows, centres).items():
        n = t.n
        sums = [int(s) for s in t.total[0]]
        products = t.total[1]
        cov = np.array([[(n * int(products[i, j]) - sums[i] * sums[j]) / (n * n) for j in range(size)] for i in range(size)]).reshape(size, size)
        values, vectors = eigen(cov)
        keep = len(values) if components is None else components
        whole = [s + n * (int(c) + SHIFT) for s, c in zip(sums, centres[size])]
        models[size] = Model(n, whole, values[:keep], vectors[:keep], float(np.trace(cov)))
    return models


def deviations(x: np.ndarray, model: Model) -> tuple[np.ndarray, list]:
    """``n x - S`` (exact where 64 bits hold it) and the sum of its squares (None beyond 64 bits)."""
    n = model.n
    base = np.array([s - n * SHIFT for s in model.sums], object)  # sums of the numbers without the shift
    if n * int(np.abs(x).max(initial=0)) < 1 << 61 and all(abs(int(b)) < 1 << 61 for b in base):
        d = n * x - base.astype(np.int64)
    else:
        d = n * x.astype(object) - base
    if int(np.abs(d).max(initial=0)) ** 2 * max(1, d.shape[1]) < 1 << 63:
        return d, (d * d).sum(axis=1).tolist()
    squares = (d.astype(object) ** 2).sum(axis=1).tolist()
    return d, [int(v) if v < 1 << 63 else None for v in squares]


def _projected(models: dict[int, Model]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                for size, rows, x in grid(batch):
                    m = models[size]
                    d, squares = deviations(x, m)
                    w = (d / m.n).astype(np.float64) @ (m.components / np.sqrt(m.values)[:, None]).T
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("id").take(pa.array(rows)),
                            pa.array(np.full(len(rows), size), pa.int32()),
                            pa.array(np.full(len(rows), m.n), pa.int64()),
                            pa.array(squares, pa.int64()),
                            pa.array(w.tolist(), pa.list_(pa.float64())),
                            pa.array([(m.values / m.trace).tolist()] * len(rows), pa.list_(pa.float64())),
                        ],
                        ["id", "size", "n", "deviation", "w", "e"],
                    )

    return work


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums and products of the whitened coordinates."""
    found: dict[int, list] = {}
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        for size in np.unique(sizes):
            rows = batch.column("w").take(pa.array(np.flatnonzero(sizes == size)))
            w = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            part = [len(w), w.sum(axis=0), w.T @ w]
            found[int(size)] = [a + b for a, b in zip(found[int(size)], part)] if int(size) in found else part
    if found:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int32()), pa.array([pickle.dumps(p) for p in found.values()], pa.binary())], ["size", "part"]
        )


def _identity(group: pd.DataFrame) -> pd.DataFrame:
    """Parts of one length added; the error of what they say so far."""
    n, sums, products = (sum(x) for x in zip(*map(pickle.loads, group["part"])))
    error = np.abs(products / n - np.outer(sums / n, sums / n) - np.eye(len(sums))).max(initial=0.0)
    return pd.DataFrame({"size": [group["size"].iloc[0]], "part": [pickle.dumps([n, sums, products])], "identity_error": [float(error)]})


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = 32) -> DataFrame:
    """One row for each usable vector and component: coordinates, share of the variance, checks."""
    rows = usable(vectors, key, column)
    models = fit(rows, components)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, size int, n long, deviation long, w array<double>, e array<double>"
    done = None
    # Lengths go in lots, so that the models sent to the tasks at once are bounded.
    lot: dict[int, Model] = {}
    for size, model in [*models.items(), (None, None)]:
        if lot and (size is None or sum(m.components.nbytes for m in lot.values()) > MODEL_BYTES):
            part = rows.where(F.size("v").isin(list(lot))).mapInArrow(_projected(lot), schema)
            done = part if done is None else done.unionByName(part)
            lot = {}
        if size is not None:
            lot[size] = model
    if done is None:
        done = rows.limit(0).mapInArrow(_projected({}), schema)
    done = written(done, "whitened")
    parts = done.where(F.size("w") > 0).select("size", "w").mapInArrow(_spread, "size int, part binary")
    checked = "size int, part binary, identity_error double"
    first = parts.withColumn("salt", F.spark_partition_id() % 32).groupBy("size", "salt").applyInPandas(_identity, checked)
    errors = first.drop("salt").groupBy("size").applyInPandas(_identity, checked).drop("part")
    # One number for each length: no more rows than the longest vector has entries.
    met = done.join(F.broadcast(errors), "size")
    return met.select(F.col("id").alias(key), "n", "deviation", "identity_error", "e", F.posexplode("w").alias("at", "whitened")).select(
        key,
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        F.col("e")[F.col("at")].alias("explained"),
        "identity_error",
    )
