"""Operator 11 against a dense eigensolver."""

import numpy as np
import pytest

from strataline.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, component int, n string"


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], SCHEMA)
    model, dim = W.fit(df, "embedding")
    return model, ([] if model is None else W.whitened(df, model, dim, "vec_id", "embedding").collect())


@pytest.mark.parametrize("n,d,seed", [(400, 24, 0), (300, 64, 1), (50, 3, 2), (30, 1, 3)])
def test_same_as_a_dense_solver(spark, n, d, seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d)) * np.linspace(1, 1.2, d)
    v[: n // 3] = v[0]
    model, rows = run(spark, [(i, x.tolist()) for i, x in enumerate(v)])
    x = np.floor(v * 256)
    fit = np.unique(x, axis=0)
    mean, count = fit.mean(0), len(fit)
    e, u = np.linalg.eigh((fit - mean).T @ (fit - mean) / count)
    e, u = e[::-1], u[:, ::-1]
    k = min(4, d)
    assert model.n == count and model.residual < 1e-11 and model.identity_error < 1e-9
    assert len(rows) == n * k
    for r in rows:
        c = r["component"] - 1
        want = (x[r["vec_id"]] - mean) @ u[:, c] / np.sqrt(e[c])
        sign = np.sign(model.vectors[:, c] @ u[:, c])
        assert abs(r["whitened"] - sign * want) < 1e-7 and abs(r["explained"] - e[c] / e.sum()) < 1e-10
        assert r["deviation"] == sum((count * int(a) - int(s)) ** 2 for a, s in zip(x[r["vec_id"]], fit.sum(0)))


def test_edges(spark):
    assert run(spark, []) == (None, [])
    assert run(spark, [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0])]) == (None, [])
    assert run(spark, [(i, [0.5, 0.25]) for i in range(5)]) == (None, [])
    model, rows = run(spark, [(None, [0.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0]), (4, [1e300, 0.0]), (5, None)])
    assert model.n == 3 and len(model.values) == 1
    assert sorted((r["vec_id"] or 0, r["component"], r["deviation"]) for r in rows) == [(0, 1, 768**2), (1, 1, 0), (1, 1, 0), (2, 1, 768**2)]
    model, rows = run(spark, [(i, [float(i) * 2**38, 1.0 * i]) for i in range(64)])
    assert len(rows) == 64 and all(r["deviation"] is None for r in rows if r["vec_id"] in (0, 63))


def test_solver_on_close_eigenvalues():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(200, 200)))
    e = np.concatenate([[1.0, 0.999, 0.998, 0.9979], np.linspace(0.9, 0, 196)])
    v = (q * e) @ q.T
    values, u, norms, rounds = W.lobpcg(lambda b: v @ b, 200, 4)
    assert np.allclose(values, e[:4], atol=1e-12) and norms.max() < 1e-10 and rounds < 60
    assert np.allclose(np.abs((u * q[:, :4]).sum(0)), 1, atol=1e-9)
