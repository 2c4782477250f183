"""Embedding whitening; the spectrum comes from QDWH spectral divide and conquer.

Vectors become integers, x = floor(64 * component) + 1,000,000. The fit list holds each distinct x
vector once, so copies (one vector may be a third of all rows) do not weigh, and are combined before
anything is shuffled. Its sums are exact; the covariance is summed from centred products, one d x d
part per task, added up per entry.

The covariance is d x d, whatever the number of rows, and is decomposed in the driver. For a shift s, the
polar factor U of V - s has the eigenvalues +1 and -1, so (U + 1) / 2 projects on the span of the
eigenvectors above s. U comes from QR-based dynamically weighted Halley iterations, which converge in about
six steps from any condition. Bases of the span and of its complement turn V into two smaller blocks, each of
which is split again, down to single components (or blocks that are a multiple of the identity, where any
basis is one of eigenvectors).

The model (mean, components, eigenvalues: at most 16 of d entries each) is broadcast to whiten all rows.

Defined results
    null vector, null or non-finite entry    takes no part
    entries beyond 2^50                      as 2^50 with the entry's sign
    vectors of other lengths                 fitted and whitened apart, one model per length
    null vec_id                              kept like any other row
    repeated rows                            each is returned; equal vectors are fitted once
    equal eigenvalues                        any basis of their span, numbered as found
    eigenvalue zero (up to rounding)         no component; none at all for a single distinct vector
    deviation beyond a long                  null
    empty vector, empty table                no rows
    extra columns                            dropped
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gatewarden.plans.durable import materialize

COMPONENTS = 16
SCALE, OFFSET = 64.0, 1_000_000
FURTHEST = float(1 << 50)
EPS = np.finfo(float).eps
#: Shifts that are tried for a split before the next strategy.
SHIFTS = 12


# ---------------------------------------------------------------- spectrum


def polar(a: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix, by QR-based dynamically weighted Halley iterations."""
    n = len(a)
    x = a / np.linalg.norm(a)
    # A lower bound of the least singular value, from the triangle of a QR decomposition; too small a guess
    # costs a step, not accuracy.
    triangle = np.linalg.qr(x, mode="r")
    singular = np.abs(np.diag(triangle)).min() <= EPS
    low = EPS if singular else max(1.0 / np.linalg.norm(np.linalg.solve(triangle, np.eye(n))), EPS)
    low = min(low, 1.0)
    for _ in range(30):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        new = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(low * (wa + wb * square) / (1 + wc * square), 1.0)
        moved = np.linalg.norm(new - x)
        x = new
        if moved < np.cbrt(5 * EPS) and abs(low - 1) < 10 * EPS:
            break
    return x


def _basis(projector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a projector's range (k columns) and of its complement, by QR with column pivoting."""
    rest, columns = projector.copy(), []
    for _ in range(k):
        j = int(np.argmax(np.einsum("ij,ij->j", rest, rest)))
        c = rest[:, j] / np.linalg.norm(rest[:, j])
        columns.append(c)
        rest -= np.outer(c, c @ rest)
    # One step of subspace iteration, then a full orthogonal matrix.
    q, _ = np.linalg.qr(projector @ np.array(columns).T, mode="complete")
    return q[:, :k], q[:, k:]


def _shifts(a: np.ndarray) -> Iterator[float]:
    """Candidates between the least and the greatest eigenvalue, the middle of the diagonal first."""
    diagonal = np.diag(a)
    yield float(np.median(diagonal))
    yield float(np.mean(diagonal))
    spread = np.abs(a).sum(axis=1) - np.abs(diagonal)
    low, high = float((diagonal - spread).min()), float((diagonal + spread).max())
    low, high = max(low, -np.linalg.norm(a)), min(high, np.linalg.norm(a))
    for step in range(1, SHIFTS):
        # Odd fractions of the interval's bounds.
        for part in range(1, 2**step, 2):
            yield low + (high - low) * (part / 2**step)


def spectrum(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix."""
    v = (v + v.T) / 2
    whole = np.linalg.norm(v) or 1.0
    values, vectors = [], []
    waiting = [(v, np.eye(len(v)))] if len(v) else []
    while waiting:
        a, basis = waiting.pop()
        n = len(a)
        split = None if n == 1 else _split(a, whole)
        if split is None:
            values.extend(np.diag(a))
            vectors.append(basis)
            continue
        for q in split:
            part = q.T @ a @ q
            waiting.append(((part + part.T) / 2, basis @ q))
    found = np.hstack(vectors) if vectors else np.empty((0, 0))
    # The Rayleigh quotient's error is the square of the vector's.
    values = np.einsum("ij,ik,kj->j", found, v, found) if len(v) else np.array(values)
    order = np.argsort(-values, kind="stable")
    return values[order], found[:, order]


def _split(a: np.ndarray, whole: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of two invariant subspaces; None for a multiple of the identity."""
    n = len(a)
    flat = np.linalg.norm(a - np.eye(n) * np.trace(a) / n)
    if flat <= 4 * EPS * n * whole:
        return None
    best = None
    for shift in _shifts(a):
        projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = round(float(np.trace(projector)))
        if not 0 < k < n:
            continue
        above, below = _basis(projector, k)
        # What couples the two spans is lost by the split.
        lost = np.linalg.norm(below.T @ a @ above)
        if best is None or lost < best[0]:
            best = (lost, above, below)
        if lost <= 10 * EPS * n * whole:
            break
    return None if best is None else best[1:]


# ---------------------------------------------------------------- fit


@dataclass(frozen=True)
class Model:
    """What whitening needs: count and sums of the fit list, components as rows, their eigenvalues and shares."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly (as Python integers where 64 bits do not hold it)."""
        if len(x) and self.n * int(np.abs(x).max()) + max(map(abs, self.sums), default=0) >= 1 << 62:
            return x.astype(object) * self.n - np.array(self.sums, object)
        return x * self.n - np.array(self.sums, np.int64)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(float) / self.n) @ self.components.T / np.sqrt(self.values)


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the vectors that take part."""
    parts = F.col(embedding).cast("array<double>")
    finite = ~F.exists(parts, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    held = F.transform(parts, lambda c: F.floor(SCALE * F.least(F.greatest(c, F.lit(-FURTHEST)), F.lit(FURTHEST))) + OFFSET)
    return vectors.where(F.coalesce(finite, F.lit(False)) & (F.size(parts) > 0)).select(
        F.col(vec_id).alias("vec_id"), held.cast("array<long>").alias("x")
    )


def _matrix(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, x as a matrix) per vector length of a batch."""
    x = batch.column("x")
    lengths = np.diff(x.offsets.to_numpy())
    flat, starts = x.values.to_numpy(), x.offsets.to_numpy()[:-1]
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, flat[starts[rows][:, None] + np.arange(d)]


def _sum_of_parts(fit: DataFrame, part, kind: type) -> dict[int, np.ndarray]:
    """``part(d, matrix)`` (any shape) of all batches, added up per length d: a task adds its own, Spark adds entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _matrix(batch):
                d = x.shape[1]
                made = part(d, x)
                totals[d] = totals[d] + made if d in totals else made
        for d, total in totals.items():
            flat = total.ravel()
            # Exact integers travel as text, since a sum of a task may pass 64 bits.
            value = pa.array([str(v) for v in flat]) if kind is int else pa.array(flat, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), d, np.int32)), pa.array(np.arange(len(flat))), value], names=["d", "i", "value"])

    value = F.sum(F.col("value").cast("decimal(38,0)")) if kind is int else F.sum("value")
    made = fit.mapInArrow(run, f"d int, i long, value {'string' if kind is int else 'double'}")
    # Bounded by the vectors' length: d (sums) or d * d (covariance) entries per length.
    rows = made.groupBy("d", "i").agg(value.alias("value")).collect()
    found: dict[int, dict[int, object]] = {}
    for r in rows:
        found.setdefault(r.d, {})[r.i] = r.value
    return {d: np.array([entries[i] for i in range(len(entries))], object if kind is int else float) for d, entries in found.items()}


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model per vector length, from the distinct vectors of ``integers``."""
    distinct = materialize(vectors.select("x").distinct(), "whitening-fit")
    exact = _sum_of_parts(distinct, lambda d, x: np.r_[x.sum(axis=0, dtype=object), len(x)], int)
    plain = {d: Model(int(s[-1]), [int(v) for v in s[:-1]], np.empty((0, d)), np.empty(0), np.empty(0), 0.0) for d, s in exact.items()}

    def products(d: int, x: np.ndarray) -> np.ndarray:
        y = plain[d].centred(x).astype(float) / plain[d].n
        return y.T @ y / plain[d].n

    found = {}
    for d, v in _sum_of_parts(distinct, products, float).items():
        values, vectors_ = spectrum(v.reshape(d, d))
        kept = [i for i in range(min(components, d)) if values[i] > EPS * d * max(values[0], 0)]
        trace = float(np.trace(v.reshape(d, d)))
        found[d] = Model(plain[d].n, plain[d].sums, vectors_[:, kept].T, values[kept], values[kept] / trace if trace else values[kept], 0.0)

    def squares(d: int, x: np.ndarray) -> np.ndarray:
        # Whitened vectors have the mean zero, since n * x - S adds up to zero exactly.
        w = found[d].whitened(found[d].centred(x))
        return w.T @ w / found[d].n

    errors = {d: float(np.abs(c.reshape(len(found[d].values), -1) - np.eye(len(found[d].values))).max()) if len(c) else 0.0
              for d, c in _sum_of_parts(distinct, squares, float).items()}
    return {d: Model(m.n, m.sums, m.components, m.values, m.explained, errors.get(d, 0.0)) for d, m in found.items()}


# ---------------------------------------------------------------- whitening


def _deviation(centred: np.ndarray) -> list[int | None]:
    """Exact squared lengths; None beyond a long."""
    if not len(centred):
        return []
    if centred.dtype != object and int(np.abs(centred).max()) ** 2 * centred.shape[1] < 1 << 63:
        return (centred * centred).sum(axis=1).tolist()
    exact = (sum(v * v for v in row) for row in centred.tolist())
    return [v if v < 1 << 63 else None for v in exact]


def whitened(vectors: DataFrame, models: dict[int, Model]) -> DataFrame:
    """One row per vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error).

    The models hold at most 16 vectors per vector length; they are broadcast.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(models)
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrix(batch):
                model = shared.value[x.shape[1]]
                k = len(model.values)
                if not k:
                    continue
                centred = model.centred(x)
                m = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(np.repeat(rows, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n, np.int64)),
                        pa.array(_deviation(centred), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(model.whitened(centred).ravel()),
                        pa.array(np.tile(model.explained, m)),
                        pa.array(np.full(m * k, model.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.mapInArrow(
        run, f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )


def whitening(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Fit on all distinct vectors and whiten every row."""
    vectors = integers(embeddings)
    return whitened(vectors, fit(vectors, components))
