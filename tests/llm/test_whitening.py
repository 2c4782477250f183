import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewarden.llm import whitening


def orthogonal(draw, n):
    return np.linalg.qr(draw.normal(size=(n, n)))[0]


@pytest.mark.parametrize("values", [
    [5.0], [3.0, 3.0, 3.0], [4.0, 0.0], [9.0, 1.0, 1.0, 1.0, 0.5], [0.0] * 4,
    list(np.geomspace(1e8, 1e-4, 40)), [1e6] * 10 + [1.0] * 10, list(range(64)), [2.0, 2.0 + 1e-9, 1.0], [-3.0, 0.0, 3.0, 1e-13],
])
def test_spectrum_against_a_library(values):
    draw = np.random.default_rng(len(values))
    q = orthogonal(draw, len(values))
    v = q @ np.diag(values) @ q.T
    found, vectors = whitening.spectrum(v)
    size = np.linalg.norm(v) or 1.0
    assert np.allclose(found, np.sort(np.linalg.eigvalsh((v + v.T) / 2))[::-1], atol=1e-13 * size * len(values))
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-13 * len(values))
    assert np.linalg.norm(v @ vectors - vectors * found) <= 1e-13 * size * len(values)


def test_diagonal_and_graded_matrices():
    for v in (np.diag([1.0, 2.0, 2.0, 7.0]), np.array([[2.0, 1.0], [1.0, 2.0]]), np.ones((6, 6)), np.full((3, 3), 0.0)):
        found, vectors = whitening.spectrum(v)
        assert np.allclose(vectors * found @ vectors.T, v, atol=1e-13)


def plain(rows, k=16):
    """Whitening by numpy's eigenvectors on exact integers."""
    whole = [(i, [math.floor(64 * float(np.float32(c))) + 10**6 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fits = np.array(sorted({tuple(x) for _, x in whole}), dtype=object)
    n, sums = len(fits), fits.sum(axis=0)
    y = ((fits * n - sums) / n).astype(float)
    v = y.T @ y / n
    e, vectors = np.linalg.eigh(v)
    e, vectors = e[::-1], vectors[:, ::-1]
    out = {}
    for i, x in whole:
        c = np.array(x, dtype=object) * n - sums
        for j in range(min(k, len(e))):
            out[(i, j + 1)] = (n, int((c * c).sum()), float((c / n).astype(float) @ vectors[:, j] / np.sqrt(e[j])), e[j] / np.trace(v))
    return out


def test_matches_a_plain_version(spark):
    draw = np.random.default_rng(3)
    mix = draw.normal(size=(20, 20)) * np.geomspace(2, 0.05, 20)
    rows = [(i, [float(np.float32(c)) for c in draw.normal(size=20) @ mix]) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(300)] + [(None, rows[6][1])]
    odd = [(2000, None), (2001, [None] * 20), (2002, [float("nan")] + [0.0] * 19), (2003, [float("inf")] * 20), (2004, [])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({"n": F.lit("clash"), "x": F.lit(0)})
    got = whitening.whitening(table).collect()
    want = plain(rows)
    assert len(got) == 16 * len(rows)
    sign = {}
    for r in sorted(got, key=lambda r: (r.vec_id is None, r.vec_id or 0)):
        n, deviation, value, share = want[(r.vec_id, r.component)]
        assert (r.n, r.deviation) == (n, deviation)
        assert math.isclose(r.explained, share, rel_tol=1e-9) and r.identity_error < 1e-9
        side = sign.setdefault(r.component, 1 if value * r.whitened > 0 else -1)
        assert math.isclose(r.whitened, side * value, rel_tol=1e-7, abs_tol=1e-7)


def test_lengths_ranks_and_empty_tables(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0]), (4, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 4.0]), (6, [0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.vec_id, r.component): r for r in whitening.whitening(table).collect()}
    # Two lengths with one direction each; a single vector has none.
    assert set(got) == {(i, 1) for i in range(1, 6)}
    assert got[(1, 1)].n == 3 and got[(4, 1)].n == 2
    assert math.isclose(abs(got[(4, 1)].whitened), 1.0) and math.isclose(abs(got[(1, 1)].whitened), math.sqrt(1.5))
    assert whitening.whitening(table.limit(0)).collect() == []


def test_beyond_64_bits(spark):
    rows = [(i, [1e300 if i % 2 else -1e300, float(i), 0.0]) for i in range(6)]
    got = whitening.whitening(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in got} == {None} and all(math.isfinite(r.whitened) for r in got)
