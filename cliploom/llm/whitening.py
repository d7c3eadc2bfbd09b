"""Whitening of embeddings: leading components of their covariance by contour integration, FEAST.

The covariance of the distinct quantised vectors is summed in tasks, exactly, as integers; only d x d sums reach the driver. There
inertia counts (signs in the symmetric factorisation of V - s I, in tridiagonal form) find intervals that hold the wanted eigenvalues
and no others. FEAST projects a random block onto the eigenvectors of an interval: a Gauss-Legendre quadrature, on a circle around it,
of solutions of (z I - V) X = Y for complex shifts z; Rayleigh-Ritz on what the projection spans gives eigenpairs, and both
repeat until the residuals fall no more. The count of pairs found must equal the inertia count, so none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import kept

COMPONENTS = 4
SCALE = 256  # steps of the quantisation per unit
NODES = 8  # of the quadrature, on the upper half circle
SPARE = 4  # columns of the block beyond the eigenvalues inside
TURNS = 40
TOGETHER = 1e-9  # of the largest: eigenvalues nearer than this share an interval
RANK = 1e-12  # an eigenvalue below this share of the trace is none

_EXACT = 1 << 53  # doubles hold all integers below this
_LIMB = 10**18
_MOST = 10**38 - 1  # of a decimal
OUTPUT = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]
    components: np.ndarray  # a row each, unit length
    eigenvalues: np.ndarray
    trace: float


# --- eigenvalues of a symmetric matrix inside an interval -----------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the same eigenvalues, by reflections."""
    a = matrix.astype(np.float64)
    off = np.zeros(max(len(a) - 1, 0))
    for k in range(len(off)):
        x, rest = a[k + 1 :, k].copy(), a[k + 1 :, k + 1 :]
        off[k] = -np.copysign(np.linalg.norm(x), x[0])
        x[0] -= off[k]
        if length := np.linalg.norm(x):
            x /= length
            p = rest @ x
            p -= (x @ p) * x
            rest -= 2 * (np.multiply.outer(x, p) + np.multiply.outer(p, x))
    return np.diag(a).copy(), off


def inertia(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Eigenvalues below each shift: negative pivots in the symmetric factorisation of the shifted tridiagonal matrix."""
    below, pivot = np.zeros(len(shifts), int), np.ones(len(shifts))
    tiny = np.finfo(float).tiny ** 0.5
    for value, square in zip(diagonal, np.r_[0.0, off**2], strict=True):
        pivot = value - shifts - square / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        below += pivot < 0
    return below


def located(diagonal: np.ndarray, off: np.ndarray) -> np.ndarray:
    """All eigenvalues, falling, each by bisection on the inertia count."""
    d = len(diagonal)
    reach = np.abs(np.r_[0.0, off]) + np.abs(np.r_[off, 0.0])
    low, high = np.full(d, (diagonal - reach).min()), np.full(d, (diagonal + reach).max())
    rank = np.arange(d)[::-1]  # eigenvalues below the one in question
    for _ in range(80):
        middle = (low + high) / 2
        above = inertia(diagonal, off, middle) <= rank
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return (low + high) / 2


def feast(matrix: np.ndarray, low: float, high: float, inside: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``inside`` eigenvalues in (low, high), falling, and their unit eigenvectors as rows."""
    d = len(matrix)
    block = np.random.default_rng(seed).standard_normal((d, min(d, inside + max(SPARE, inside // 2))))
    centre, radius = (low + high) / 2, (high - low) / 2
    at, weight = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(-0.5j * np.pi * (at - 1))  # angles from pi to 0
    norm, last = np.abs(matrix).max() * d, np.inf
    for _ in range(TURNS):
        projected = np.zeros_like(block)
        for w, z in zip(weight, turn, strict=True):
            solved = np.linalg.solve((centre + radius * z) * np.eye(d) - matrix, block)
            projected += w / 2 * (radius * z * solved).real
        basis, _ = np.linalg.qr(projected)
        values, ritz = np.linalg.eigh(basis.T @ matrix @ basis)
        block = basis @ ritz
        residual = np.linalg.norm(matrix @ block - block * values, axis=0)
        mine = np.flatnonzero((values > low) & (values < high) & (residual <= 1e-13 * norm))
        worst, last = last, residual[mine].max(initial=0.0)
        if len(mine) == inside and last >= worst / 2:  # at rounding: no turn makes it less
            mine = mine[::-1]
            return values[mine], (block[:, mine] / np.linalg.norm(block[:, mine], axis=0)).T
    raise ArithmeticError(f"{len(mine)} of {inside} eigenvalues between {low} and {high} found")


def intervals(values: np.ndarray, wanted: int) -> list[tuple[float, float]]:
    """Around each of the largest eigenvalues, or several too close to tell apart, half the way to the next outside."""
    same, found, first = TOGETHER * np.abs(values).max(), [], 0
    while first < wanted:
        last = first
        while last + 1 < len(values) and values[last] - values[last + 1] <= same:
            last += 1
        gaps = [values[first - 1] - values[first]] if first else []
        gaps += [values[last] - values[last + 1]] if last + 1 < len(values) else []
        margin = min(gaps, default=values[first] or 1.0) / 2
        found.append((values[last] - margin, values[first] + margin))
        first = last + 1
    return found


def leading(matrix: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues that are not zero, falling, at most ``wanted``, and their unit eigenvectors as rows."""
    form = tridiagonal(matrix)
    values = located(*form)
    wanted = min(wanted, int((values > RANK * np.trace(matrix)).sum()))
    if not wanted:
        return np.zeros(0), np.zeros((0, len(matrix)))
    found = []
    for low, high in intervals(values, wanted):
        inside = int(np.diff(inertia(*form, np.array([low, high])))[0])
        found.append(feast(matrix, low, high, inside)[1])
    basis, _ = np.linalg.qr(np.concatenate(found).T)  # those of neighbouring intervals, orthogonal to rounding
    values, ritz = np.linalg.eigh(basis.T @ matrix @ basis)
    return values[::-1][:wanted], (basis @ ritz).T[::-1][:wanted]


# --- sums in tasks ---------------------------------------------------------------


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): entries as floor(256 c); rows with a null vector, or null or non-finite entries, are left out."""
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("c"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = rows.where(F.col("c").isNotNull() & ~F.exists("c", bad))
    return rows.select("vec_id", F.transform("c", lambda c: F.floor(c * SCALE).cast("bigint")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _exactly(x: np.ndarray, terms: int) -> np.ndarray:
    """Doubles if sums of ``terms`` products of two entries are exact in them, else Python's integers."""
    most = int(max(x.max(), -int(x.min()))) if x.size else 0
    return x.astype(np.float64) if most * most * terms < _EXACT else x.astype(object)


def _moments(distinct: DataFrame) -> DataFrame:
    """(i, j, high, low) with i <= j: sums of x_i x_j in two limbs; i = -1 stands for a factor of 1."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.c_[np.ones(batch.num_rows, np.int64), _matrix(batch.column(0))]
                x = _exactly(x, len(x))
                total = (0 if total is None else total) + (x.T @ x).astype(object)
        if total is not None:
            i, j = np.triu_indices(len(total))
            limbs = [divmod(int(v), _LIMB) for v in total[i, j]]
            columns = [pa.array(i - 1, pa.int32()), pa.array(j - 1, pa.int32())]
            columns += [pa.array([limb[k] for limb in limbs], pa.decimal128(38, 0)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["i", "j", "high", "low"])

    parts = distinct.mapInArrow(add, "i int, j int, high decimal(38,0), low decimal(38,0)")
    return parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of the covariance of the rows of ``x``, which must be distinct; None for no rows. The driver holds d x d sums."""
    moments = _moments(distinct.where(F.size("x") > 0)).toArrow()
    if not moments.num_rows:
        return None
    i, j = (moments.column(c).to_numpy() + 1 for c in ("i", "j"))
    exact = np.zeros((i.max() + 1,) * 2, object)
    exact[i, j] = exact[j, i] = [int(h) * _LIMB + int(v) for h, v in zip(*(moments.column(c).to_pylist() for c in ("high", "low")), strict=True)]
    n, sums = exact[0, 0], exact[0, 1:].tolist()
    # Integers do not cancel: n * sum(x x) - S S is n * n times the sum of centred products, exactly.
    centred = n * exact[1:, 1:] - np.multiply.outer(exact[0, 1:], exact[0, 1:])
    covariance = np.array([[v / (n * n) for v in row] for row in centred.tolist()])
    values, vectors = leading(covariance, components)
    return Whitening(n, sums, vectors, values, float(np.trace(covariance)))


def _project(x: np.ndarray, found: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """n x - S per entry, as exact numbers, and the whitened components."""
    sums = np.array(found.sums, object)
    bound = found.n * int(max(x.max(), -int(x.min()))) + max(map(abs, found.sums)) if x.size else 0
    deviations = x * found.n - sums.astype(np.int64) if bound < 1 << 62 else x.astype(object) * found.n - sums
    return deviations, (deviations / found.n).astype(np.float64) @ found.components.T / np.sqrt(found.eigenvalues)


def _square_sums(deviations: np.ndarray) -> list[int]:
    most = int(max(deviations.max(), -int(deviations.min()))) if deviations.size else 0
    if most * most * deviations.shape[1] >= 1 << 62:
        deviations = deviations.astype(object)
    return [int(v) for v in (deviations * deviations).sum(axis=1)]


def identity_error(distinct: DataFrame, found: Whitening) -> float:
    """Largest absolute entry of the covariance of whitened rows, minus the identity. Blocks are centred before they multiply."""
    k = len(found.eigenvalues)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, w = _project(_matrix(batch.column(0)), found)
                mean = w.mean(axis=0)
                products = (w - mean).T @ (w - mean)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.num_rows], pa.int64()), pa.array([mean.tolist()]), pa.array([products.ravel().tolist()])],
                    ["n", "mean", "products"],
                )

    parts = distinct.where(F.size("x") > 0).mapInArrow(add, "n bigint, mean array<double>, products array<double>")
    parts = kept(parts, "blocks")
    # Over blocks: products add up, and each mean's distance from the whole mean counts for its rows.
    entry = lambda c, i: F.get(c, F.lit(i))
    rows = F.sum("n").alias("n")
    means = parts.agg(rows, *[F.sum(F.col("n") * entry("mean", i)).alias(f"m{i}") for i in range(k)]).first()
    mean = [means[f"m{i}"] / means.n for i in range(k)]
    sums = parts.agg(*[
        F.sum(entry("products", a * k + b) + F.col("n") * (entry("mean", a) - mean[a]) * (entry("mean", b) - mean[b])).alias(f"p{a}_{b}")
        for a in range(k) for b in range(k)
    ]).first()
    covariance = np.array(sums).reshape(k, k) / means.n
    return float(np.abs(covariance - np.eye(k)).max())


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``OUTPUT`` per row and component: coordinates of variance 1 without correlation, over distinct quantised vectors.

    Rows with a null vector or null or non-finite entries are left out; a null vec_id stays, so do repeated rows. There are as
    many components as eigenvalues beyond rounding, so copies of one vector, and vectors of no entries, give no rows. Vectors of
    different lengths have no covariance: a ValueError. ``deviation`` is the sum of squares of n x - S, exactly
    (null beyond 38 digits). Entries beyond a long are the greatest or least long.
    """
    rows = quantised(vectors)
    distinct = kept(rows.select("x").distinct(), "distinct")
    sizes = [r.n for r in distinct.where(F.size("x") > 0).select(F.size("x").alias("n")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes}")
    found = fit(distinct, components)
    if found is None or not len(found.eigenvalues):
        return vectors.sparkSession.createDataFrame([], OUTPUT)
    error, k = identity_error(distinct, found), len(found.eigenvalues)
    explained = found.eigenvalues / found.trace

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if m:
                deviations, w = _project(_matrix(batch.column("x")), found)
                squares = pa.array([v if v <= _MOST else None for v in _square_sums(deviations)], pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        pc.take(batch.column("vec_id"), each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, found.n, np.int64)), pc.take(squares, each), pa.array(w.ravel()),
                        pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    [c.split()[0] for c in OUTPUT.split(", ")],
                )

    return rows.where(F.size("x") > 0).mapInArrow(score, OUTPUT)
