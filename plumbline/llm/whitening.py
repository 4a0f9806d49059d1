"""Embedding whitening by a randomised range finder and Rayleigh-Ritz.

Every entry c of a vector becomes the integer floor(SCALE * c) + SHIFT, so that sums and the mean are
exact. The covariance V of all rows is never formed at first: a pass over the rows gives V times a
thin random matrix (components and OVERSAMPLING columns wide), and each further pass multiplies
its orthonormal base by V again. After each pass, Rayleigh-Ritz on the base gives eigenvectors and
their residuals. If these are not small against the gaps between eigenvalues after POWER passes, as
on a flat spectrum, the base grows to the full dimension, where one more pass makes the vectors exact.

A pass is one scan in which each task adds up one (dimension x columns) matrix; Spark adds them up by
row of the matrix. What reaches the driver is bounded by the square of the dimension, whatever the
number of rows.

Defined results: vectors that are null or hold null or non-finite entries get no row, nor do entries
beyond LARGEST in size after scaling; the dimension is the commonest length of a vector (ties: the
greater), and vectors of other lengths get no row; a null id is kept; repeated rows count each on its
own; an empty table gives no rows; other columns are ignored, whatever their names. A component without
variance (fewer different vectors than components) has whitened null and explained 0, and does not
enter identity_error. A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 1024.0, 100_000, 8
#: Extra columns of the random base; passes before the base grows; residual that counts as converged, as a share of the gap.
OVERSAMPLING, POWER, CONVERGED = 8, 3, 1e-12
#: Largest scaled entry that takes part, so that sums over a batch fit in a long; least share of the trace that counts as variance.
LARGEST, LEAST = 2.0**50, 1e-12
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """Mean (sums over n rows), unit eigenvectors by columns, eigenvalues, and how they were found."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    expanded: bool
    residual: float

    def live(self) -> np.ndarray:
        return self.values > LEAST * self.trace


def integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, x): which rows take part, and their integer vectors."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    fits = lengths == dim
    flat = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    scaled = np.floor(SCALE * flat)
    with np.errstate(invalid="ignore"):
        whole = (np.abs(scaled) <= LARGEST).all(axis=1)
    return np.flatnonzero(fits)[whole], scaled[whole].astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x minus the mean: the exact n * x - S over n where it fits in a long."""
    s = np.array(sums, dtype=object)
    top = max(int(np.abs(x).max(initial=0)), 1)
    if n * top < 1 << 61:
        return (n * x - s.astype(np.int64)) / n
    return (x - (s / n).astype(np.float64)).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n * x - S) squared, exact; null beyond a long."""
    top = max(int(np.abs(x).max(initial=0)), 1)
    if n * top < 1 << 61:
        d = n * x - np.array([int(s) for s in sums], np.int64)
        # Sums of squares wrap around, so they are exact wherever the true value, told in doubles, fits.
        found, about = (d * d).sum(axis=1), (d.astype(np.float64) ** 2).sum(axis=1)
    else:
        found, about = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    out: list[int | None] = found.tolist()
    for k in np.flatnonzero(about > 9.2e18):
        wide = sum((n * int(v) - s) ** 2 for v, s in zip(x[k], sums, strict=True))
        out[k] = wide if wide < 1 << 63 else None
    return out


def _dimension(rows: DataFrame) -> int:
    open_ = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    found = rows.where((F.size("embedding") > 0) & ~open_).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found.d if found else 0


def _sums(rows: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    """Number of rows that take part, and the exact sum of each dimension."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, np.zeros(dim, dtype=object)
        for b in batches:
            x = integers(b.column(0), dim)[1]
            n += len(x)
            for part in np.array_split(x, len(x) // 1024 + 1):
                s += part.sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array([n, *s], pa.decimal128(38, 0))], ["i", "s"])

    parts = rows.select("embedding").mapInArrow(added, "i int, s decimal(38,0)")
    total = {r.i: int(r.s) for r in parts.groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return total.get(-1, 0), tuple(total.get(k, 0) for k in range(dim))


def _times_covariance(rows: DataFrame, n: int, sums: tuple[int, ...], base: np.ndarray) -> tuple[np.ndarray, float]:
    """(V base, trace of V) by one scan of all rows, centred before multiplying."""
    dim, width = base.shape

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, squares = np.zeros((dim, width)), 0.0
        for b in batches:
            c = centred(integers(b.column(0), dim)[1], n, sums)
            y += c.T @ (c @ base)
            squares += float((c * c).sum())
        lines = [[squares] + [0.0] * (width - 1), *y.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array(lines, pa.list_(pa.float64()))], ["i", "y"])

    parts = rows.select("embedding").mapInArrow(added, "i int, y array<double>")
    lines = parts.groupBy("i").agg(*[F.sum(F.get("y", F.lit(k))).alias(f"y{k}") for k in range(width)]).collect()
    total = {r.i: list(r)[1:] for r in lines}
    return np.array([total[k] for k in range(dim)]) / n, total[-1][0] / n


def ritz(base: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling), vectors and residual norms of V within base, where image = V base."""
    small = base.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    return values, base @ turn, np.linalg.norm(image @ turn - base @ turn * values, axis=0)


def converged(values: np.ndarray, residuals: np.ndarray, components: int) -> bool:
    """Are the leading vectors exact: residuals small against the gaps to their neighbours?"""
    if len(values) <= components:
        return False
    gaps = -np.diff(values[: components + 1])
    nearest = np.minimum(gaps, np.append(np.inf, gaps[:-1]))
    return bool((residuals[:components] <= CONVERGED * nearest).all())


def fit(rows: DataFrame, components: int = COMPONENTS, seed: int = 13) -> Whitening | None:
    """The whitening of rows (embedding); None if no row takes part."""
    dim = _dimension(rows)
    if not dim:
        return None
    n, sums = _sums(rows, dim)
    if not n:
        return None
    components, passes, expanded = min(components, dim), 0, False
    width = min(dim, components + OVERSAMPLING)
    base = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))[0]
    while True:
        image, trace = _times_covariance(rows, n, sums, base)
        passes += 1
        values, vectors, residuals = ritz(base, image)
        if expanded or width == dim or converged(values, residuals, components):
            break
        if passes <= POWER:
            base = np.linalg.qr(image)[0]
        else:
            filled = np.hstack([vectors, np.random.default_rng(seed + 1).standard_normal((dim, dim - width))])
            base, expanded = np.linalg.qr(filled)[0], True
    return Whitening(n, sums, vectors[:, :components], np.maximum(values[:components], 0.0), trace, passes, expanded, float(residuals[:components].max()))


def projected(c: np.ndarray, model: Whitening) -> np.ndarray:
    live = model.live()
    return c @ model.vectors[:, live] / np.sqrt(model.values[live])


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of all whitened rows minus the identity, by one more scan."""
    width = int(model.live().sum())
    if not width:
        return 0.0

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        for b in batches:
            w = projected(centred(integers(b.column(0), len(model.sums))[1], model.n, model.sums), model)
            total += np.vstack([w.sum(axis=0), w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "y"])

    parts = rows.select("embedding").mapInArrow(added, "i int, y array<double>")
    lines = parts.groupBy("i").agg(*[F.sum(F.get("y", F.lit(k))).alias(f"y{k}") for k in range(width)]).orderBy("i").collect()
    total = np.array([list(r)[1:] for r in lines]) / model.n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(width)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector (vec_id, embedding) and component, with the error of the whole."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    model = fit(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    error, dim, shown = identity_error(rows, model), len(model.sums), len(model.values)
    live = np.flatnonzero(model.live())
    explained = np.where(model.live(), model.values / (model.trace or 1.0), 0.0)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 4096):
                part = b.slice(at, 4096)
                places, x = integers(part.column(1), dim)
                w = np.full((len(x), shown), np.nan)
                w[:, live] = projected(centred(x, model.n, model.sums), model)
                ids = pc.take(part.column(0), pa.array(np.repeat(places, shown)))
                far = pc.take(pa.array(deviations(x, model.n, model.sums), pa.int64()), pa.array(np.repeat(np.arange(len(x)), shown)))
                size = len(x) * shown
                columns = [
                    ids,
                    pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(size, model.n)),
                    far,
                    pa.array(w.ravel(), from_pandas=True),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(size, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(shaped, SCHEMA)
