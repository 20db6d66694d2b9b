"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers on a grid, so that sums, means and deviations are exact. The principal
directions of the distinct grid vectors come from products of their centred matrix X alone: each step
sends one direction v through ``u = X v`` and back through ``w = X'u``, both summed over the rows where they
lie. Every new u and v is made orthogonal to all before it, twice. The small bidiagonal matrix of the
steps gives the components and their deviations.

A left vector has as many entries as there are rows, and is never stored: it is ``u = X p`` for a vector p as short
as a row, which the driver keeps. So a lost executor costs a repeated task and nothing else. The driver
holds a few vectors per step; no matrix of covariances is built from the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.session import written

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
# A step's residual, and a direction's deviation, against the largest deviation: what counts as none.
RESIDUAL = 1e-13
RANK_TOLERANCE = 1e-10
# Steps from a fresh direction after convergence, in search of components with equal deviations.
RESTART_STEPS = 8
# Entries beyond these bounds are put at them; differences of two still fit a long.
_BOUND = 4 * 10**18
_LONG_MAX = (1 << 63) - 1


def _grid(vectors: DataFrame, column: str) -> Column:
    bound = float(_BOUND - OFFSET)
    return F.transform(column, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(bound)), F.lit(-bound))) + OFFSET)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is not null or empty and has finite entries only."""
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where(F.col(column).isNotNull() & (F.size(column) > 0)).where(~bad)


def grid_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, x) of the usable rows: ``x = floor(64 * c) + 1000000`` for each entry c.

    Entries beyond 4e18 are put there.
    """
    rows = usable(vectors, column)
    return rows.select(F.col(id_column).cast("long").alias("id"), _grid(rows, column).alias("x"))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("x"))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


@dataclass(frozen=True)
class Centre:
    """Number of rows n and sums S by dimension; the mean S / n as a whole part and a rest over n."""

    n: int
    sums: tuple[int, ...]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows less the mean; whole parts are taken off first, so no digit is lost."""
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of ``(n * x - S)^2`` over the dimensions; null where one does not fit a long."""
        off = x - self.whole
        most = (np.abs(off).max(initial=0).astype(float) + 1) * self.n
        if most * most * x.shape[1] < 2**62:
            scaled = off * self.n - self.rest
            return (scaled * scaled).sum(axis=1).tolist()
        exact = [sum((int(o) * self.n - r) ** 2 for o, r in zip(row, self.rest.tolist())) for row in off.tolist()]
        return [d if d <= _LONG_MAX else None for d in exact]


def _summed(frame: DataFrame, kind: str) -> np.ndarray:
    """Sum of the arrays ``part`` of all rows, by place, in the order of the places."""
    places = frame.select(F.posexplode("part").alias("place", "value")).groupBy("place").agg(F.sum("value").alias("value"))
    table = places.toPandas().sort_values("place")
    return table["value"].to_numpy(object if kind == "exact" else np.float64)


def _partial_sums(rows: DataFrame, add: Callable[[np.ndarray], np.ndarray], size: int, dims: int) -> np.ndarray:
    """Sum over all batches of ``add(batch's rows)``; a task gives back one array of ``size`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += add(_matrix(batch, dims))
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.tolist()], pa.list_(pa.float64()))})

    summed = _summed(rows.select("x").mapInArrow(run, "part array<double>"), "double")
    return summed if len(summed) else np.zeros(size)


def centre_of(fit: DataFrame) -> Centre:
    """Exact count and sums of the rows' entries."""
    n = fit.count()
    exact = fit.select(F.posexplode("x").alias("place", "v")).groupBy("place").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"))
    return Centre(n, tuple(int(r["s"]) for r in sorted(exact.collect())))


def products(fit: DataFrame, centre: Centre) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """A function of p that gives the squared length of ``u = X p`` and ``X'u``, from one pass over the rows."""
    dims = len(centre.sums)

    def product(p: np.ndarray) -> tuple[float, np.ndarray]:
        def add(x: np.ndarray) -> np.ndarray:
            rows = centre.centred(x)
            u = rows @ p
            return np.concatenate(([u @ u], u @ rows))

        total = _partial_sums(fit, add, dims + 1, dims)
        return float(total[0]), total[1:]

    return product


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for b in basis:
            v = v - (b @ v) * b
    return v


def bidiagonalise(
    product: Callable[[np.ndarray], tuple[float, np.ndarray]], dims: int, wanted: int, scale: float
) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (as rows) and singular values of X, the ``wanted`` largest ones, by falling value.

    ``scale`` is the Frobenius norm of X, against which a length counts as zero. Steps end when the residuals of
    the wanted values are negligible and steps from a fresh direction have not changed them, or when the directions fill
    the space.
    """
    rng = np.random.default_rng(17)
    rights: list[np.ndarray] = []  # v, orthonormal
    lefts: list[np.ndarray] = []  # p of the orthonormal u = X p
    images: list[np.ndarray] = []  # X'u
    places: list[tuple[int, int, float]] = []  # entries of the bidiagonal matrix
    zero = 1e-12 * scale
    settled, steps_since = None, 0

    def fresh() -> np.ndarray:
        v = _orthogonal(rng.standard_normal(dims), rights)
        return v / np.linalg.norm(v)

    def small() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = np.zeros((max(1, len(lefts)), len(rights)))
        for i, j, value in places:
            b[i, j] = value
        return np.linalg.svd(b, full_matrices=False)

    v, beta = fresh(), 0.0
    while True:
        k = len(rights)
        rights.append(v)
        if beta:
            places.append((len(lefts) - 1, k, beta))
        # u = X v, less what the lefts before it hold of it; once more where little is left.
        p, before = v, float("inf")
        while True:
            squared, image = product(p)
            if squared <= zero * zero:
                break
            whole = squared
            for _ in range(2):
                for left, back in zip(lefts, images):
                    c = left @ image
                    p, image = p - c * left, image - c * back
            squared = max(0.0, float(p @ image))
            if squared >= 0.1 * whole or squared <= zero * zero or whole >= 0.5 * before:
                break
            before = whole
        length = squared**0.5
        beta = 0.0
        if length > zero:
            places.append((len(lefts), k, length))
            lefts.append(p / length)
            images.append(image / length)
            v = _orthogonal(images[-1], rights)
            beta = float(np.linalg.norm(v))
        if len(rights) == dims:
            break
        steps_since += 1
        u, values, _ = small()
        top = values[:wanted]
        residual = beta * np.abs(u[-1, : len(top)]).max(initial=0.0) if beta > zero else 0.0
        if len(top) == wanted and residual <= RESIDUAL * values[0] and (settled is None or steps_since >= RESTART_STEPS):
            if settled is not None and np.allclose(settled, top, rtol=1e-12, atol=0):
                break
            settled, steps_since, beta = top, 0, 0.0
        if beta > zero:
            v = v / beta
        else:
            beta, v = 0.0, fresh()
    _, values, vt = small()
    return (vt @ np.array(rights))[:wanted], values[:wanted]


@dataclass(frozen=True)
class Whitening:
    """Components as rows, their eigenvalues, and the share of the whole variance that each explains."""

    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ (self.components.T / np.sqrt(self.eigenvalues))


def common_length(grid: DataFrame) -> int:
    """The most frequent length of a vector, the larger one of two as frequent; 0 without rows."""
    most = grid.groupBy(F.size("x").alias("dims")).count().agg(F.max(F.struct("count", "dims")).alias("m")).first()["m"]
    return most["dims"] if most else 0


def fit(grid: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of the distinct vectors of (id, x), all of one length; None without a direction that varies."""
    distinct = written(grid.select("x").groupBy("x").agg(F.lit(1).alias("one")).select("x"), "whitening_fit")
    centre = centre_of(distinct)
    dims = len(centre.sums)
    if centre.n < 2:
        return None
    total = float(_partial_sums(distinct, lambda x: np.array([(centre.centred(x) ** 2).sum()]), 1, dims)[0])
    wanted = min(components, dims, centre.n - 1)
    vectors, values = bidiagonalise(products(distinct, centre), dims, wanted, total**0.5)
    kept = values > RANK_TOLERANCE * values[0]
    vectors, values = vectors[kept], values[kept]
    # Either sign would do: the entry of largest size is positive.
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
    whitening = Whitening(centre, vectors, values**2 / centre.n, values**2 / total, 0.0)
    k = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        white = whitening.apply(x)
        return np.concatenate((white.sum(axis=0), (white.T @ white).ravel()))

    summed = _partial_sums(distinct, moments, k + k * k, dims) / centre.n
    covariance = summed[k:].reshape(k, k) - np.outer(summed[:k], summed[:k])
    error = float(np.abs(covariance - np.eye(k)).max())
    return Whitening(centre, vectors, whitening.eigenvalues, whitening.explained, error)


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector of (vec_id, embedding) and each component, numbered from 1 by falling variance.

    ``n`` counts the distinct grid vectors that components are fitted on, ``deviation`` is the vector's sum of ``(n * x - S)^2``,
    ``whitened`` its place along the component in units of the component's deviation, ``explained`` the component's share
    of the variance, and ``identity_error`` the largest entry by which the covariance of the whitened fit list differs from
    the identity. Rows that are null, empty or hold null or non-finite entries take no part, nor do vectors of another length than
    the most frequent one (the larger of two as frequent). Repeated rows and null ids each have their rows; equal
    vectors count once in the fit. Components without variance are left out: with fewer than two distinct vectors, or an
    empty table, there are no rows. A deviation that does not fit a long is null. Other columns are not read.
    """
    spark = vectors.sparkSession
    grid = grid_vectors(vectors)
    dims = common_length(grid)
    grid = grid.where(F.size("x") == dims)
    model = fit(grid, components) if dims else None
    if model is None:
        return spark.createDataFrame([], _RESULT)
    k = len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = _matrix(batch, dims)
            ids = batch.column(batch.schema.get_field_index("id")).take(pa.array(np.repeat(np.arange(rows), k)))
            deviations = pa.array(model.centre.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k)))
            columns = [
                ids,
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, model.centre.n, np.int64)),
                deviations,
                pa.array(model.apply(x).ravel()),
                pa.array(np.tile(model.explained, rows)),
                pa.array(np.full(rows * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _RESULT.split(", ")])

    return grid.mapInArrow(run, _RESULT)
