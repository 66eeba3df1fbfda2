"""Whitened embeddings by spectrum slicing.

Inertia counts of the shifted covariance (the signs of D in LDLᵀ) say how many eigenvalues lie above a shift. Bisection
on these counts isolates each leading eigenvalue, Rayleigh quotient iteration finishes it, and counts beside the result
certify its number. Rows are read by Spark tasks only; the driver holds sums per dimension and one matrix of dimension
by dimension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..sources.shared import settle, tidy

SCALE, SHIFT = 64, 1_000_000
LARGEST = 2.0**52          # scaled entries beyond are set to this bound
COMPONENTS = 16
SMALLEST = 1e-11           # eigenvalues below this share of the largest count as no variance
ROWS = 2_000               # rows that a task turns into one matrix


class Spectrum(NamedTuple):
    values: np.ndarray     # falling eigenvalues
    vectors: np.ndarray    # one unit vector per column


def scaled(embedding: Column, length: int) -> Column:
    """Entries as whole numbers ``floor(64 * c) + 1000000``; vectors shorter than ``length`` are filled up with zeros."""
    whole = F.transform(embedding, lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c.cast("double") * SCALE))) + SHIFT)
    return F.concat(whole, F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(length) - F.size(embedding)))


def finite(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, x``: rows whose vector has no null and no entry that is not finite."""
    c = F.col(embedding)
    good = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return vectors.select(F.col(vec_id).alias("vec_id"), c.alias("x")).filter(c.isNotNull() & good)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            yield _matrix(batch.column("x").slice(first, ROWS))


def _summed(rows: DataFrame, shape: tuple[int, ...], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of an array that ``part`` makes of a block of them: one array per task, added up by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for block in _blocks(batches):
            total += part(block)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], ["v"])

    parts = rows.select("x").mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("at", "v"))
    found = parts.groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(int(np.prod(shape)))
    out[found["at"].to_numpy()] = found["v"].to_numpy()
    return out.reshape(shape)


def _sums(fit: DataFrame, length: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums per dimension: whole numbers that fit into 64 bits for less than 2**43 rows of usual entries."""
    n = fit.count()
    dims = fit.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    sums = {r["at"]: int(r["s"]) for r in dims.collect()}
    return n, [sums.get(i, 0) for i in range(length)]


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor ``n``, centred before multiplying: rows are taken minus the whole number nearest to the
    mean, so the sums of products are whole and exact below 2**53, and what is left of the mean (at most a half) is taken off at the end."""
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([float(s - n * int(m)) for s, m in zip(sums, middle)]) / n

    def products(block: np.ndarray) -> np.ndarray:
        y = (block - middle).astype(np.float64)
        return y.T @ y

    return _summed(fit, (len(sums), len(sums)), products) / n - np.outer(rest, rest)


def inertia(matrix: np.ndarray) -> tuple[int, int, int]:
    """Positive, negative and zero eigenvalues of a symmetric matrix, by the signs of D in P·A·Pᵀ = L·D·Lᵀ.

    Pivots are single entries or blocks of two rows, chosen so that what is left does not grow (Bunch and Parlett's rule).
    """
    a = matrix.astype(np.float64, copy=True)
    tiny = np.finfo(float).tiny
    signs = [0, 0, 0]

    def count(value: float) -> None:
        signs[0 if value > tiny else 1 if value < -tiny else 2] += 1

    while len(a):
        diagonal = np.abs(np.diag(a))
        k = int(diagonal.argmax())
        off = np.abs(a)
        np.fill_diagonal(off, 0)
        i, j = divmod(int(off.argmax()), len(a))
        if max(diagonal[k], off[i, j]) <= tiny:
            signs[2] += len(a)
            break
        if diagonal[k] >= 0.6404 * off[i, j]:
            count(a[k, k])
            rest = np.delete(np.arange(len(a)), k)
            column = a[rest, k]
            a = a[np.ix_(rest, rest)] - np.outer(column / a[k, k], column)
        else:  # a block of two with a negative determinant: one eigenvalue of either sign
            signs[0] += 1
            signs[1] += 1
            rest = np.delete(np.arange(len(a)), [i, j])
            block, columns = a[np.ix_([i, j], [i, j])], a[np.ix_(rest, [i, j])]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(block, columns.T)
    return signs[0], signs[1], signs[2]


class Slicer:
    """Counts of eigenvalues above shifts of one matrix; every count narrows the intervals of all eigenvalues."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        radius = np.abs(matrix).sum(1)
        self.size = float(radius.max(initial=0.0))
        span = self.size + 1.0 if self.size == 0 else 1.01 * self.size
        self.counts = {-span: len(matrix), span: 0}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = inertia(self.matrix - shift * np.eye(len(self.matrix)))[0]
        return self.counts[shift]

    def numbered(self, k: int, value: float) -> bool:
        """Whether at most k eigenvalues lie clearly above the value and at least k + 1 above or clearly beside it."""
        slack = 1e-10 * max(self.size, np.finfo(float).tiny)
        return self.above(value + slack) <= k < self.above(value - slack)

    def isolate(self, number: int) -> tuple[float, float]:
        """An interval with the ``number``-th largest eigenvalue (from 1): alone in it, unless it is as narrow as rounding allows."""
        low = max(s for s, c in self.counts.items() if c >= number)
        high = min(s for s, c in self.counts.items() if c < number and s > low)
        while self.above(low) - self.above(high) > 1 and high - low > 4 * np.finfo(float).eps * self.size:
            middle = low + (high - low) / 2
            if not low < middle < high:
                break
            if self.above(middle) >= number:
                low = middle
            else:
                high = middle
        return low, high

    def narrow(self, number: int, low: float, high: float, share: float) -> tuple[float, float]:
        """The interval bisected to a share of its width."""
        goal = (high - low) * share
        while high - low > goal:
            middle = low + (high - low) / 2
            if not low < middle < high:
                break
            low, high = (middle, high) if self.above(middle) >= number else (low, middle)
        return low, high


def leading(matrix: np.ndarray, components: int) -> Spectrum:
    """The largest eigenvalues and their vectors, each numbered by counts on both sides of it."""
    size = len(matrix)
    number = min(components, size)
    slicer = Slicer(matrix)
    values, vectors = np.zeros(number), np.zeros((size, number))
    for k in range(number):
        low, high = slicer.isolate(k + 1)
        values[k], vectors[:, k] = _refined(matrix, slicer, k, low, high, vectors[:, :k])
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    certify(slicer, values)
    return Spectrum(values, vectors)


def _refined(matrix: np.ndarray, slicer: Slicer, k: int, low: float, high: float, before: np.ndarray) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from the middle of an isolating interval, held to it by further counts."""
    rng = np.random.default_rng(k)
    goal = 16 * np.finfo(float).eps * max(slicer.size, np.finfo(float).tiny)
    best = None
    for _ in range(60):
        shift, vector = low + (high - low) / 2, _clean(rng.normal(size=len(matrix)), before)
        for step in range(12):
            vector = _clean(_solved(matrix, shift, vector), before)
            value = float(vector @ matrix @ vector)
            error = float(np.linalg.norm(matrix @ vector - value * vector))
            inside = low < value <= high
            if inside and error <= 1e6 * goal and (best is None or error < best[0]) and slicer.numbered(k, value):
                best = (error, value, vector)
                if error <= goal:
                    return value, vector
            # Two steps of inverse iteration turn the start towards the interval before the quotient takes over.
            shift = value if step >= 1 and inside else shift
        if high - low <= 8 * np.finfo(float).eps * slicer.size:
            break
        low, high = slicer.narrow(k + 1, low, high, 1 / 16)
    if best is None:  # a cluster as narrow as rounding: the vector of inverse iteration is as good as any in it
        return low + (high - low) / 2, vector
    return best[1], best[2]


def _clean(vector: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A unit vector at right angles to those found before (twice, so that rounding does not matter)."""
    for _ in range(2):
        vector = vector - before @ (before.T @ vector)
    return vector / np.linalg.norm(vector)


def _solved(matrix: np.ndarray, shift: float, vector: np.ndarray) -> np.ndarray:
    eye = np.eye(len(matrix))
    step = np.finfo(float).eps * max(abs(shift), float(np.abs(matrix).max(initial=0.0)), np.finfo(float).tiny)
    for moved in (0.0, step, 8 * step, 64 * step):  # a shift that hits an eigenvalue exactly is moved by a rounding
        try:
            found = np.linalg.solve(matrix - (shift + moved) * eye, vector)
            if np.isfinite(found).all() and found.any():
                return found / np.abs(found).max()
        except np.linalg.LinAlgError:
            continue
    return vector


def certify(slicer: Slicer, values: np.ndarray) -> None:
    """Raise unless the counts beside every eigenvalue agree with its number."""
    for k, value in enumerate(values):
        if not slicer.numbered(k, value):
            raise ArithmeticError(f"eigenvalue {k + 1} is not certified")


@tidy
def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per row and component.

    Rows whose vector is null or holds null, NaN or infinite entries take no part. The others become whole numbers (``scaled``);
    shorter vectors, empty ones too, count as filled up with zeros to the longest. The mean and the covariance (divisor ``n``) are
    those of the ``n`` distinct vectors, so repeated rows weigh once, but every row is returned. Components fall by
    eigenvalue; equal eigenvalues give some right-angled choice, the same for all rows. A component without variance has
    ``whitened`` 0 and stands apart from ``identity_error``. ``deviation`` is null where it does not fit a long. Extra columns are
    ignored. An empty table, and one of empty vectors alone, gives no rows.
    """
    rows = finite(vectors, vec_id, embedding)
    length = int(rows.agg(F.max(F.size("x"))).first()[0] or 0)
    shape = T.StructType([
        T.StructField("vec_id", rows.schema["vec_id"].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType())])
    ends = [F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error")]
    if not length:
        return rows.sparkSession.createDataFrame([], shape).select("*", *ends)
    rows = rows.select("vec_id", scaled(F.col("x"), length).alias("x"))
    fit = settle(rows.select("x").distinct())
    n, sums = _sums(fit, length)
    matrix = covariance(fit, n, sums)
    spectrum = leading(matrix, components)
    varied = spectrum.values > max(SMALLEST * spectrum.values.max(initial=0.0), 1e-100)
    shrink = np.where(varied, 1 / np.sqrt(np.where(varied, spectrum.values, 1)), 0.0)
    weights = spectrum.vectors * shrink
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([float(s - n * int(m)) for s, m in zip(sums, middle)])

    def white(block: np.ndarray) -> np.ndarray:
        # x - S / n, with the whole part exact
        return ((block - middle) - rest / n) @ weights

    def moments(block: np.ndarray) -> np.ndarray:
        w = white(block)
        return np.vstack((w.sum(0), w.T @ w))

    measured = _summed(fit, (len(shrink) + 1, len(shrink)), moments) / n
    spread = measured[1:] - np.outer(measured[0], measured[0]) - np.eye(len(shrink))
    error = float(np.abs(spread[np.ix_(varied, varied)]).max(initial=0.0))
    trace = float(np.trace(matrix))
    explained = [float(max(v, 0.0) / trace) if trace > 0 else 0.0 for v in spectrum.values]
    remain = np.array([int(s - n * int(m)) for s, m in zip(sums, middle)], np.int64)
    kinds = len(shrink)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                x = _matrix(part.column("x"))
                far = _deviations(x - middle, n, remain)
                size = len(x)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(size), kinds))),
                    pa.array(np.tile(np.arange(1, kinds + 1, dtype=np.int32), size)), pa.array(np.full(size * kinds, n)),
                    pa.array([d for d in far for _ in range(kinds)], pa.int64()), pa.array(white(x).ravel())], shape.names)

    share = F.element_at(F.array(*[F.lit(e) for e in explained]), F.col("component"))
    return rows.mapInArrow(run, shape).select("*", share.alias("explained"), F.lit(error).alias("identity_error"))


def _deviations(y: np.ndarray, n: int, remain: np.ndarray) -> list[int | None]:
    """Exact sums over the dimensions of ``(n * y - remain)**2``: 64-bit where all rows fit, else Python's whole numbers."""
    rough = ((n * y.astype(np.float64) - remain) ** 2).sum(1)
    if rough.max(initial=0.0) < 2.0**62:
        return ((n * y - remain) ** 2).sum(1).tolist()
    out = []
    for row in y.tolist():
        total = sum((n * v - r) ** 2 for v, r in zip(row, remain.tolist()))
        out.append(total if total < 2**63 else None)
    return out
