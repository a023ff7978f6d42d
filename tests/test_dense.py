import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.functions import dense
from strataline.operators import features
from strataline.sources import mocks
from strataline.types import Geometry


def test_ball_grid_size():
    g = dense.ball_grid(3.0, 0.225)
    assert len(g) == 9889 and (np.sqrt((g * g).sum(1)) <= 3).all()


def test_quadric_is_recovered():
    rng = np.random.default_rng(0)
    a = rng.normal(size=10) * 10
    g = Geometry((0.5, 0.4, 0.25), (17, 21, 33))
    field = lambda p: dense.quadric_terms(p - 4.0) @ a
    p = rng.uniform(0, 8, (40, 3))
    fitter = features.QuadricFitter(g, field, 2.0, 0.15, "linear", 0.5)
    coef, centre = fitter.fit(p)
    for c, at, place in zip(coef, centre, p):
        d = rng.uniform(-1, 1, (20, 3))
        assert np.allclose(dense.quadric_terms(d) @ c, field(at + d)) and np.abs(at - place).max() <= 0.25 + 1e-9
    assert np.allclose(features.QuadricFitter(g, field, 2.0, 0.15, "linear", 0.5).fit(p[7:8])[0][0], coef[7])
    assert not features.QuadricFitter(g, lambda q: np.full(len(q), 5.0), 2.0, 0.15, "linear", 0.5).fit(p)[0].any()


def test_fits_are_the_weighted_least_squares_of_single_points():
    g = Geometry((0.5, 0.4, 0.25), (9, 11, 13))
    field = lambda p: np.sin(p[:, 0]) * 50 + p[:, 1] ** 3 * 9 - np.cos(3 * p[:, 2]) * 20
    p = np.random.default_rng(3).uniform(-0.2, 4, (30, 3))
    step, offsets = features.quadric_lattice(g, 1.6, 0.5)
    base = features.sampling_weights(offsets, g.spacing, "elliptical")
    coef, centre = features.QuadricFitter(g, field, 1.6, 0.2, "elliptical", 0.5).fit(p)
    for place, c, at in zip(p, coef, centre):
        q = at + offsets
        ok = ((q >= 0) & (q <= np.array(g.bounds))).all(1)
        if ok.sum() < 12:
            continue
        w = np.sqrt(base[ok] * np.exp(math.log(0.2) / 1.6**2 * ((q[ok] - place) ** 2).sum(1)))
        terms = dense.quadric_terms(offsets[ok])
        if np.linalg.cond(terms * w[:, None]) < 1e5:
            want = np.linalg.lstsq(terms * w[:, None], field(q[ok]) * w, rcond=None)[0]
            assert np.allclose(c, want, rtol=1e-5, atol=1e-5)


def test_curvature_of_a_sphere():
    a = np.array([1.0, 1, 1, 0, 0, 0, 0, 0, 0, 0])
    k, h = dense.curvatures(np.stack([a, a]), np.array([[2.0, 0, 0], [0, 0, 0]]))
    assert (k[0], h[0]) == pytest.approx((0.25, -0.5))
    s, c = dense.shape_index(k, h)
    assert s[0] == pytest.approx(-1, abs=1e-6) and c[0] == pytest.approx(0.5)
    assert np.isnan([k[1], h[1]]).all()


def test_kabsch_is_exact_without_noise():
    rng = np.random.default_rng(1)
    p, r, t = rng.normal(size=(20, 3)), mocks.turn(0.3, -0.7, 1.1), np.array([1.0, 2, 3])
    got = dense.kabsch(p, p @ r.T + t)
    assert np.allclose(got[0], r) and np.allclose(got[1], t)
    assert dense.kabsch(p[:2], p[:2]) is None
    line = np.outer(np.arange(5.0), [1, 2, 3])
    assert dense.kabsch(line, line) is None


def test_harmonic_power_does_not_change_with_rotation():
    theta, phi = dense.fibonacci(4000)
    d = np.stack([np.sin(theta) * np.cos(phi), np.sin(theta) * np.sin(phi), np.cos(theta)], -1)
    table = dense.harmonics(4, theta, phi)
    f = lambda p: p[:, 0] + 2 * p[:, 1] * p[:, 2] + 0.5 * p[:, 2] ** 3
    a, b = dense.harmonic_power(np.stack([f(d), f(d @ mocks.turn(0.4, 1.0, -0.6).T)]), table, 4)
    assert np.allclose(a, b, atol=0.01 * a.max())


def test_pca_bases_find_a_planted_rotation():
    s = np.array([1.0, 0.6, 0.35])
    field = lambda p: np.exp(-((p * s) ** 2).sum(-1) * 0.5) * 1000 + p[..., 0] * 60 + p[..., 1] * 25 + p[..., 2] * 9
    r = mocks.turn(0.5, 0.2, -0.8)
    ball = dense.ball_grid(3.0, 0.225)
    micro, macro = dense.pca_bases(ball, field(ball)), dense.pca_bases(ball, field(ball @ r))
    errors = []
    for b in micro:
        m = macro[0] @ b.T
        assert np.linalg.det(m) == pytest.approx(1)
        errors.append(math.degrees(math.acos(min(1, (np.trace(m.T @ r) - 1) / 2))))
    assert min(errors) < 2
    assert dense.pca_bases(ball, np.ones(len(ball))) is None


def test_pca_lengths():
    rng = np.random.default_rng(2)
    p = rng.normal(size=(4000, 3)) * [5, 2, 1]
    v, inside = np.stack([rng.random(4000), np.ones(4000), rng.random(4000)]), np.ones((3, 4000), bool)
    inside[2, 100:] = False
    v = np.where(inside, v, np.inf)
    e = dense.pca_lengths(p, v, inside, np.sort(v, axis=1), inside.sum(1))
    assert (np.diff(e[0]) > 0).all() and (e[0] * e[0]).sum() == pytest.approx(1) and np.isnan(e[1]).all()
    kept = p[:100][v[2, :100] >= np.sort(v[2, :100])[50]]
    want = np.abs(np.linalg.eigvalsh(np.cov(kept.T)))
    assert np.allclose(e[2], want / np.sqrt((want**2).sum()))


def test_weights_at_the_origin():
    for kind in ("linear", "elliptical"):
        w = features.sampling_weights(np.array([[0.0, 0, 0], [1, 0, 0], [0, 2, 0]]), (0.5, 1.0, 0.25), kind)
        assert w[0] == 1 and w[1] == pytest.approx(0.5) and w[2] == pytest.approx(1)


def test_descent_finds_the_features():
    describe = lambda p: np.stack([p[:, 0], 2 * p[:, 1], p[:, 2] ** 2], 1)
    target = describe(np.array([[2.0, 3.0, 1.5]]))
    p, moved, why = features.descend(np.array([[1.5, 2.5, 1.2]]), target, describe, np.full(3, 10.0), steps=300)
    assert np.abs(p - [2.0, 3.0, 1.5]).max() < 0.05 and features.ENDS[why[0]] == "converged" and 5 < moved[0] < 300


def test_descents_end_apart():
    describe = lambda p: p * [1.0, 1.0, 1.0]
    start = np.array([[2.0, 2, 2], [0.1, 2, 2], [9.99, 2, 2], [2.0, 2, 2]])
    target = np.array([[2.5, 2.5, 1.5], [-3.0, 2, 2], [5.0, 5, 5], [2.5, 2.5, 1.5]])
    p, moved, why = features.descend(start, target, describe, np.full(3, 10.0))
    assert [features.ENDS[k] for k in why] == ["converged", "border", "border", "converged"] and moved[2] == 0
    for k in range(4):
        alone = features.descend(start[k : k + 1], target[k : k + 1], describe, np.full(3, 10.0))
        assert np.array_equal(alone[0][0], p[k]) and (alone[1][0], alone[2][0]) == (moved[k], why[k])
    assert features.ENDS[features.descend(start[:1], target[:1], describe, np.full(3, 10.0), steps=2)[2][0]] == "limit"
    wild = features.descend(start[:1], target[:1] + [0, 0, 2.0], describe, np.full(3, 10.0), rate=1.05, largest=50.0)
    assert features.ENDS[wild[2][0]] == "diverged" and wild[1][0] == 1


def test_descended_points_without_a_target(spark):
    rows = [(1, 1.0, 1.0, 1.0, [1.2, 1.1, 1.0]), (2, None, 1.0, 1.0, [1.0, 1.0, 1.0]), (3, 1.0, 1.0, 1.0, None), (4, 1.0, 1.0, 1.0, [1.0]), (5, 1.0, 1.0, 1.0, [1.0, None, 1.0])]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double, target array<double>").withColumn("steps", F.lit("kept out"))
    got = {r.id: r for r in features.descended(points, mocks.constant(Geometry((1.0,) * 3, (5, 5, 5))), (features.Computer("position"),)).collect()}
    assert got[1].ended == "converged" and got[1].distance < 0.05 and got[1].steps > 1
    assert all(got[k].ended == "border" and got[k].distance is None and got[k].steps == 0 for k in (2, 3, 4, 5)) and got[2].x is None and got[3].x == 1.0
    assert features.descended(points.limit(0), mocks.constant(Geometry((1.0,) * 3, (5, 5, 5))), (features.Computer("position"),)).count() == 0


def test_numpy_and_column_fields_agree(spark):
    g = Geometry((0.3, 0.2, 0.4), (5, 6, 4))
    for f in (mocks.sphere(), mocks.ellipsoid(3, 2, 2, (4, 5, 6)), mocks.spheres(20), mocks.small(), mocks.halves("y", g), mocks.constant(g), mocks.cylinder("x", 1.0, (0.5, 0.5, 0.5), g)):
        rows = f.voxels(spark).toPandas()
        assert np.allclose(f.numpy(rows[["x", "y", "z"]].to_numpy()), rows["value"].to_numpy())
