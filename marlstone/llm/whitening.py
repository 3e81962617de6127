"""Embedding whitening by TSQR and one-sided Jacobi rotations.

Entries become integers, so sums and centred values are exact before they are divided. The fit list, each distinct vector once, is
cut into blocks of rows; each task folds its blocks into one triangle R by QR, and triangles are folded again, some at a time, until
one is left: the covariance is never formed. Plane rotations then make R's columns orthogonal. Their lengths are the standard deviations
times the square root of n, accurate for small ones too, and the product of all rotations holds the components.

Vectors that are null, hold null or non-finite entries or have another length than most are left out. Entries beyond 2^62 / 64 count as
that. Repeated rows and null ids are kept in the result, each with its own rows. Components are those whose deviation is not
zero to double precision, `top` at most: none if all vectors are the same, so no rows then, as for an empty table. A deviation sum
beyond a long's range is null. Columns besides the id and the vector are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.vectors import as_bytes, dimension, from_bytes, matrices, sums

Store = Callable[[DataFrame, str], DataFrame]

#: x = floor(SCALE * c) + SHIFT for an entry c.
SCALE, SHIFT = 64, 1_000_000
LARGEST = 2.0**62
#: Triangles that one task or the driver folds.
FAN = 64


def integers(c: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * c), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def distinct(df: DataFrame, d: int, column: str) -> DataFrame:
    """(x): each distinct integer vector once, as bytes. Equal ones are dropped in each task first."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([as_bytes(integers(matrices(b, column, d)[1]))], ["x"])

    return df.select(column).mapInArrow(read, "x binary").distinct()


def scaled_sums(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S, exact: as longs, or Python's integers where a long could overflow."""
    if 2 * n * max(int(np.abs(x).max(initial=0)), 1) < 1 << 62:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def deviations(scaled: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row, None beyond a long."""
    if scaled.dtype != object and scaled.shape[1] * float(np.abs(scaled).max(initial=0)) ** 2 < 2.0**62:
        return (scaled * scaled).sum(axis=1).tolist()
    return [s if (s := sum(int(v) ** 2 for v in row)) < 1 << 63 else None for row in scaled]


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of a QR decomposition, square: with rows of zeros where there are few rows."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def tsqr(blocks: DataFrame, block: Callable[[pa.RecordBatch], np.ndarray], d: int, store: Store) -> np.ndarray:
    """R of all rows of block(batch): each task folds its blocks, and tasks' triangles are folded FAN at a time until the driver has FAN at most."""

    def fold(rows: Callable[[pa.RecordBatch], np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = None
            for b in batches:
                if b.num_rows:
                    r = triangle(rows(b) if r is None else np.vstack([r, rows(b)]))
            if r is not None:
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

        return run

    stacked = lambda b: from_bytes(b.column(0), d)
    parts = store(blocks.mapInArrow(fold(block), "r binary"), "triangles")
    while (held := parts.count()) > FAN:
        parts = store(parts.repartition(-(-held // FAN)).mapInArrow(fold(stacked), "r binary"), "triangles")
    last = [np.frombuffer(r, np.float64).reshape(d, d) for r in parts.toArrow().column("r").to_pylist()]
    return triangle(np.vstack(last)) if last else np.zeros((d, d))


def rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of d columns, as rounds of disjoint pairs: one column stays, the others go round."""
    ring = [*range(d), *([-1] if d % 2 else [])]
    out = []
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(a, b) for a, b in zip(ring[:half], ring[: half - 1 : -1], strict=True) if a >= 0 and b >= 0]
        if pairs:
            out.append(tuple(np.array(x, np.int64) for x in zip(*pairs, strict=True)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of a square matrix, falling, and its right singular vectors as columns, by one-sided Jacobi rotations.

    Each round rotates disjoint pairs of columns until all pairs are orthogonal to double precision.
    """
    d = r.shape[1]
    size = np.abs(r).max(initial=0) or 1.0
    order = np.argsort(-(r / size * (r / size)).sum(axis=0), kind="stable")
    a, v = r[:, order] / size, np.eye(d)[:, order]
    eps = np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for p, q in rounds(d):
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            some = np.abs(gamma) > eps * np.sqrt(alpha * beta)
            if not some.any():
                continue
            turned, p, q = True, p[some], q[some]
            zeta = (beta[some] - alpha[some]) / (2 * gamma[some])
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            for m in (a, v):
                x, y = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    sigma = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-sigma, kind="stable")
    return sigma[order] * size, v[:, order]


@dataclass(frozen=True)
class Whitening:
    """n vectors of d entries with these sums; standard deviations, falling, and components, as columns, of those that are not zero; identity_error of the first `top`."""

    d: int
    n: int
    total: list[int]
    deviation: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float

    def projected(self, scaled: np.ndarray, top: int) -> np.ndarray:
        return scaled.astype(np.float64) / self.n @ (self.components[:, :top] / self.deviation[:top])


def fitted(df: DataFrame, store: Store, column: str = "embedding", top: int = 16) -> Whitening:
    """Three scans of the distinct vectors: their sums, R, and the covariance of what is whitened. What reaches the driver depends on the dimension alone."""
    d = dimension(df, column)
    if not d:
        return Whitening(0, 0, [], np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0)
    fit = store(distinct(df, d, column), "distinct")
    n = fit.count()
    ints = lambda b: from_bytes(b.column("x"), d, np.int64)
    halves = sums(fit, lambda b: np.concatenate([(ints(b) >> 32).sum(axis=0), (ints(b) & 0xFFFFFFFF).sum(axis=0)]), "long").tolist() or [0] * (2 * d)
    total = [(high << 32) + low for high, low in zip(halves[:d], halves[d:], strict=True)]
    sigma, v = jacobi(tsqr(fit, lambda b: scaled_sums(ints(b), n, total).astype(np.float64) / n, d, store))
    rank = int((sigma > sigma[0] * d * np.finfo(float).eps).sum())
    k = min(rank, top)
    model = Whitening(d, n, total, sigma[:rank] / np.sqrt(max(n, 1)), v[:, :rank], (sigma**2 / max((sigma**2).sum(), 1e-300))[:rank], 0.0)
    if not k:
        return model

    def products(b: pa.RecordBatch) -> np.ndarray:
        w = model.projected(scaled_sums(ints(b), n, total), top)
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    found = sums(fit, products, "double") / n
    mean = found[k * k :]  # about zero already
    error = np.abs(found[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max()
    return Whitening(*(getattr(model, f) for f in ("d", "n", "total", "deviation", "components", "explained")), float(error))


ROWS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(df: DataFrame, model: Whitening, vec_id: str = "vec_id", column: str = "embedding", top: int = 16) -> DataFrame:
    """vec_id and the columns of ROWS: a row for each remaining vector and each of its first `top` components."""
    k = min(len(model.deviation), top)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches if k else ():
            at, c = matrices(b, column, model.d)
            scaled = scaled_sums(integers(c), model.n, model.total)
            m = len(at)
            arrays = [b.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n))]
            arrays += [pa.array(deviations(scaled), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(model.projected(scaled, top).ravel())]
            arrays += [pa.array(np.tile(model.explained[:k], m)), pa.array(np.full(m * k, model.identity_error))]
            yield pa.RecordBatch.from_arrays(arrays, [vec_id, *(c.split()[0] for c in ROWS.split(", "))])

    kind = df.schema[vec_id].dataType.simpleString()
    return df.select(vec_id, F.col(column)).mapInArrow(read, f"`{vec_id}` {kind}, {ROWS}")
