"""Whitening of embeddings by a covariance that is polarised: only squares are ever summed.

An entry c becomes the integer floor(64 * c) + 1000000. A first pass counts rows and sums each dimension. A second one centres
each entry by the integer mean of its dimension and sums, exactly, the squares of every dimension and of the sum of
every two dimensions. With Q the sum of squares about the true mean, which the remainder of the integer mean gives exactly,
the cross-covariance is half of Q(i + j) - Q(i) - Q(j), and is rounded once, from integers. ``eigh`` of the assembled matrix gives the
components; a third pass measures the covariance of what comes out.

Tasks send one row for each dimension or pair, so what moves depends on the dimensions and tasks and not on the rows;
the driver sees one row for each pair. Sums are kept as two decimals, so they stay exact at any size.

Rows whose vector is null, empty, or holds null or non-finite entries are dropped. Vectors of another length than the most
frequent one (the longer of two that are as frequent) have no place in the matrix and are dropped too. A floor beyond 2^62
is held there, as a long holds no more; a deviation that a long can't hold is null. A component without variance
can't be whitened: ``whitened`` is null and ``identity_error`` is of the others. Null and repeated ids stay as they are.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmatch.operators.storage import written

SCALE, SHIFT = 64, 1_000_000
# Entries that a task holds at a time.
ENTRIES = 1 << 20
# Sums are kept as high * _PART + low.
_PART = 10**30
_SUM = "high decimal(38,0), low decimal(38,0)"


def _vectors(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of all vectors of a batch as doubles, the vectors' lengths (0 where one is dropped) and starts."""
    lists = batch.column(column)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    return values, np.where(bad[starts + sizes] > bad[starts], 0, sizes), starts


def _integers(values: np.ndarray) -> np.ndarray:
    """int64, or Python's integers where squares of sums of two might not fit."""
    floors = np.clip(np.floor(values * SCALE), -(2.0**62), 2.0**62)
    if not floors.size or np.abs(floors).max() < 2**28:
        return floors.astype(np.int64) + SHIFT
    return np.array([int(x) + SHIFT for x in floors.ravel()], object).reshape(floors.shape)


def _matrices(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows with a sound vector of ``size`` entries, some at a time, and their integers."""
    for batch in batches:
        step = max(1, ENTRIES // size)
        for at in range(0, batch.num_rows, step):
            some = batch.slice(at, step)
            values, sizes, starts = _vectors(some, column)
            rows = np.flatnonzero(sizes == size)
            if len(rows):
                yield some.take(pa.array(rows)), _integers(values[starts[rows][:, None] + np.arange(size)])


def _decimals(sums: list[int]) -> list[pa.Array]:
    parts = [divmod(int(x), _PART) for x in sums]
    return [pa.array([str(p[i]) for p in parts]).cast(pa.decimal128(38, 0)) for i in range(2)]


def _total(row) -> int:
    return int(row["high"]) * _PART + int(row["low"])


def _sums(vectors: DataFrame) -> DataFrame:
    """``size, dim, n, high, low``: of each length of vectors and dimension, rows and sum of the integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            values, sizes, starts = _vectors(batch, 0)
            for size in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == size)
                n, sums = found.get(size, (0, [0] * size))
                for at in range(0, len(rows), max(1, ENTRIES // size)):
                    some = rows[at : at + max(1, ENTRIES // size)]
                    x = _integers(values[starts[some][:, None] + np.arange(size)])
                    sums = [a + int(b) for a, b in zip(sums, x.sum(axis=0))]
                found[size] = (n + len(rows), sums)
        for size, (n, sums) in found.items():
            columns = [pa.array([size] * size), pa.array(range(size)), pa.array([n] * size), *_decimals(sums)]
            yield pa.RecordBatch.from_arrays(columns, ["size", "dim", "n", "high", "low"])

    told = vectors.mapInArrow(run, f"size long, dim long, n long, {_SUM}")
    return told.groupBy("size", "dim").agg(F.sum("n").alias("n"), *[F.sum(c).cast("decimal(38,0)").alias(c) for c in ("high", "low")])


def _squares(vectors: DataFrame, means: list[int]) -> DataFrame:
    """``i, j, high, low``: sums of the squares of centred entries (``j`` = -1) and of sums of two (``i < j``)."""
    size = len(means)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, twos = [0] * size, [[0] * (size - i - 1) for i in range(size)]
        seen = False
        for _, x in _matrices(batches, 0, size):
            seen = True
            d = x - np.array(means, object if x.dtype == object else np.int64)
            # few rows at a time: int64 holds the sums of their squares
            if d.dtype != object and np.abs(d).max() >= 2**20:
                d = d.astype(object)
            ones = [a + int(b) for a, b in zip(ones, (d * d).sum(axis=0))]
            for i in range(size - 1):
                both = d[:, i + 1 :] + d[:, i : i + 1]
                twos[i] = [a + int(b) for a, b in zip(twos[i], (both * both).sum(axis=0))]
        if seen:
            kinds = [(i, -1) for i in range(size)] + [(i, j) for i in range(size) for j in range(i + 1, size)]
            i, j = (pa.array(c, pa.int64()) for c in zip(*kinds))
            sums = _decimals(ones + [x for row in twos for x in row])
            yield pa.RecordBatch.from_arrays([i, j, *sums], ["i", "j", "high", "low"])

    told = vectors.mapInArrow(run, f"i long, j long, {_SUM}")
    return told.groupBy("i", "j").agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in ("high", "low")])


class Fit:
    """``n`` rows, the ``sums`` of their dimensions, ``covariance`` (divisor n), ``values`` and ``vectors`` of its components."""

    def __init__(self, n: int, sums: list[int], squares: dict[tuple[int, int], int]):
        self.n, self.sums, size = n, sums, len(sums)
        self.means = [s // n for s in sums]
        # what the integer means leave of the sums; n * squares - rest^2 is n times the squares about the true mean
        self.rest = [s - n * m for s, m in zip(sums, self.means)]
        about = {(i, -1): n * squares[i, -1] - self.rest[i] ** 2 for i in range(size)}
        self.covariance = np.zeros((size, size))
        for i in range(size):
            self.covariance[i, i] = about[i, -1] / n**2
            for j in range(i + 1, size):
                both = n * squares[i, j] - (self.rest[i] + self.rest[j]) ** 2
                self.covariance[i, j] = self.covariance[j, i] = (both - about[i, -1] - about[j, -1]) / (2 * n**2)
        values, vectors = np.linalg.eigh(self.covariance)
        self.values, self.vectors = values[::-1].copy(), vectors[:, ::-1].copy()

    def project(self, x: np.ndarray, components: int) -> np.ndarray:
        """Whitened coordinates of integer rows; not a number where a component has no variance."""
        d = (x - np.array(self.means, x.dtype)).astype(np.float64) - np.array(self.rest, np.float64) / self.n
        values = self.values[:components].copy()
        values[values <= max(self.values.max(initial=0), 0) * len(self.values) * 2.3e-16] = np.nan
        return d @ self.vectors[:, :components] / np.sqrt(values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Of each row the sum over dimensions of (n * x - sum)^2, exactly; None beyond a long."""
        d = x - np.array(self.means, x.dtype)
        most = int(np.abs(d).max()) + 1
        if len(self.means) * (self.n * most) ** 2 < 2**63:
            d = self.n * d - np.array(self.rest, np.int64)
            return (d * d).sum(axis=1).tolist()
        found = [sum((self.n * int(a) - r) ** 2 for a, r in zip(row, self.rest)) for row in d]
        return [x if x < 2**63 else None for x in found]


def fit(df: DataFrame, vector: str = "embedding") -> Fit | None:
    """The fit over all rows with a sound vector; None if there is none."""
    vectors = df.select(F.col(vector).cast("array<double>").alias("vector"))
    sums = written(_sums(vectors), "sums")
    best = sums.filter("dim = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if best is None:
        return None
    totals = [_total(r) for r in sums.filter(F.col("size") == best["size"]).orderBy("dim").collect()]
    squares = _squares(vectors, [s // best["n"] for s in totals]).collect()
    return Fit(best["n"], totals, {(r["i"], r["j"]): _total(r) for r in squares})


def identity_error(df: DataFrame, fitted: Fit, components: int, vector: str = "embedding") -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    size, kept = len(fitted.sums), min(components, len(fitted.sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(kept), np.zeros((kept, kept))
        for _, x in _matrices(batches, 0, size):
            w = fitted.project(x, components)
            first += w.sum(axis=0)
            second += w.T @ w
        values = np.concatenate((first[None], second)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values))), pa.array(values)], ["at", "value"])

    told = df.select(F.col(vector).cast("array<double>").alias("vector")).mapInArrow(run, "at long, value double")
    sums = told.groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
    both = np.array([r["value"] for r in sums]).reshape(kept + 1, kept) / fitted.n
    off = np.abs(both[1:] - np.outer(both[0], both[0]) - np.eye(kept))
    return float(np.nanmax(off)) if np.isfinite(off).any() else None


def whiten(df: DataFrame, components: int = 32, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of each sound row and component."""
    schema = f"{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(df, vector)
    if fitted is None:
        return df.sparkSession.createDataFrame([], schema)
    size, kept = len(fitted.sums), min(components, len(fitted.sums))
    error, trace = identity_error(df, fitted, components, vector), float(np.trace(fitted.covariance))
    explained = [max(float(v), 0.0) / trace if trace > 0 else None for v in fitted.values[:kept]]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in _matrices(batches, 1, size):
            m, w = len(x), fitted.project(x, components).ravel()
            row, component = np.repeat(np.arange(m), kept), np.tile(np.arange(kept, dtype=np.int32), m)
            columns = [
                rows.column(0).take(pa.array(row)),
                pa.array(component + np.int32(1)),
                pa.array(np.full(m * kept, fitted.n, np.int64)),
                pa.array(fitted.deviations(x), pa.int64()).take(pa.array(row)),
                pa.array(w, mask=np.isnan(w)),
                pa.array(explained, pa.float64()).take(pa.array(component)),
                pa.array([error] * (m * kept), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, schema)
