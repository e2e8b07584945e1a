"""Queries that SQL can't express, against plain formulas over the series they are made from."""

import os

import numpy as np
import pytest

from tidemark.kernels import matrices
from tidemark.plans import analysis_queries as aq
from tidemark.plans import base as b
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
Q = catalogue.queries()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def growth(spark):
    out = {}
    for r in b.weekly_growth(spark, SF).orderBy("pos").collect():
        out.setdefault(str(r.sid), []).append(r.x)
    return {k: np.array(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def pairs(spark):
    out = {}
    for r in aq._pair(spark, SF).orderBy("pos").collect():
        out.setdefault(str(r.sid), []).append((r.g, r.du))
    return {k: np.array(v) for k, v in out.items()}


def by_pos(rows, value):
    out = {}
    for r in sorted(rows, key=lambda r: r.pos):
        out.setdefault(r.sid, []).append(np.nan if r[value] is None else r[value])
    return {k: np.array(v, float) for k, v in out.items()}


def test_filters_by_their_normal_equations(spark, growth):
    hp, hamilton = by_pos(Q["hp_cycle"](spark, SF).collect(), "cycle"), by_pos(Q["hamilton_cycle"](spark, SF).collect(), "cycle")
    assert set(hp) == set(hamilton) == set(growth)
    for sid, y in growth.items():
        n = len(y)
        d = np.diff(np.eye(n), 2, axis=0)
        assert np.allclose(hp[sid], y - np.linalg.solve(np.eye(n) + 1600 * d.T @ d, y), atol=1e-6)
        z = np.stack([np.ones(n - 11), *(y[3 - j : n - 8 - j] for j in range(4))], 1)
        want = y[11:] - z @ np.linalg.solve(z.T @ z, z.T @ y[11:])
        assert np.isnan(hamilton[sid][:11]).all() and np.allclose(hamilton[sid][11:], want, atol=1e-6)


def vector_fit(x):
    z = np.concatenate([np.ones((len(x) - 2, 1)), x[1:-1], x[:-2]], 1)
    beta = np.linalg.lstsq(z, x[2:], rcond=None)[0]
    a1, a2 = beta[1:3].T, beta[3:5].T
    return beta[0], np.abs(np.linalg.eigvals(np.block([[a1, a2], [np.eye(2), np.zeros((2, 2))]]))).max()


def test_vector_fits_by_least_squares(spark, pairs):
    for r in Q["ols_var2"](spark, SF).collect():
        c, m = vector_fit(pairs[r.sid])
        assert np.allclose((r.c_g, r.c_du), c, atol=1e-6) and abs(r.modulus - m) < 1e-6
    rows = Q["rolling_var2"](spark, SF).collect()
    assert len(rows) == sum(len(x) - 39 for x in pairs.values())
    for k, r in [x for sid in pairs for x in enumerate(sorted((r for r in rows if r.sid == sid), key=lambda r: r.pos))][::97]:
        c, m = vector_fit(pairs[r.sid][k : k + 40])
        assert np.allclose((r.c_g, r.c_du), c, atol=1e-6) and abs(r.modulus - m) < 1e-6


def test_filtered_moduli_by_the_general_filter(spark, growth):
    got = {}
    for r in Q["filtered_modulus"](spark, SF).collect():
        got[r.sid, r.pos] = r.modulus
    for sid, x in growth.items():
        z = np.stack([np.ones(len(x) - 2), x[1:-1], x[:-2]], 1)
        states = matrices.state_filter(x[2:], z, np.eye(3), np.diag([0, 1e-4, 1e-4]), 1.0, np.zeros(3), 1e8 * np.eye(3))["states"]
        for t in range(39, len(x), 23):
            want = np.abs(np.roots([1, -states[t - 2, 1], -states[t - 2, 2]])).max()
            assert abs(got[sid, t] - want) < 1e-5


def test_radii_and_roots_of_whole_vectors(spark):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    rows = Q["spectral_radius"](spark, SF).collect()
    assert len(rows) == sum(len(v) // 8 for v in vectors.values())
    for r in rows[::53]:
        a = vectors[r.vec_id][8 * r.system : 8 * r.system + 8]
        a = (np.sign(a) * (np.abs(a) % 0.5)).reshape(2, 2, 2)
        m = np.block([[a[0], a[1]], [np.eye(2), np.zeros((2, 2))]])
        assert abs(r.radius - np.abs(np.linalg.eigvals(m)).max()) < 1e-6
    rows = Q["roots_stable"](spark, SF).collect()
    assert len(rows) == len(vectors)
    for r in rows[::41]:
        v = vectors[r.vec_id]
        n = len(v) - 1
        c = np.eye(n, k=-1)
        c[:, -1] = -v[:-1] / v[-1]
        size = np.abs(np.linalg.eigvals(c))
        assert r.stable == (size < 1).all() and abs(r.gap - np.abs(size - 1).min()) < 1e-4


def test_white_noise_cells(spark):
    rows = {r.size: r for r in Q["white_noise"](spark, SF).collect()}
    assert set(rows) == {30, 1000} and all(r.n == 2000 and r.interval.low < r.k / r.n < r.interval.high for r in rows.values())


def test_bootstrap_bands(spark, growth):
    for r in Q["residual_bootstrap"](spark, SF).collect():
        low, high = r.modulus_band
        x = growth[r.sid]
        z = np.stack([np.ones(len(x) - 2), x[1:-1], x[:-2]], 1)
        _, p1, p2 = np.linalg.lstsq(z, x[2:], rcond=None)[0]
        assert low < high and low - 0.1 < np.abs(np.roots([1, -p1, -p2])).max() < high + 0.1
