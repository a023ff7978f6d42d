"""Factorisation machine in numpy: low-rank pairwise interactions, linear-time scores.

For a row with features x, with weights w and factors V,

    score = b + sum_i w_i x_i + 1/2 sum_f [(sum_i V_if x_i)^2 - sum_i V_if^2 x_i^2]

the sum-of-squares identity, so a row costs (number of features) x rank, never the square of it.
Rows are in compressed form: idx and val concatenated, `ptr` with the row bounds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class FM:
    bias: float
    w: np.ndarray  # [dim]
    v: np.ndarray  # [dim, rank]

    def logits(self, idx: np.ndarray, val: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        lin, s, _ = self.parts(idx, val, ptr)
        return lin + s

    def parts(self, idx, val, ptr):
        n = len(ptr) - 1
        vx = self.v[idx] * val[:, None]
        sums, squares = segments(vx, ptr), segments((vx * vx).sum(1), ptr)
        lin = self.bias + segments(self.w[idx] * val, ptr)
        return (lin if n else np.zeros(0)), 0.5 * ((sums * sums).sum(1) - squares), sums

    def proba(self, idx, val, ptr) -> np.ndarray:
        return sigmoid(self.logits(idx, val, ptr))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def segments(x: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of x over [ptr[k], ptr[k+1]); an empty segment gives 0."""
    n = len(ptr) - 1
    out = np.zeros((n, *x.shape[1:]), dtype=np.float64)
    full = np.flatnonzero(ptr[1:] > ptr[:-1])
    if len(full):
        out[full] = np.add.reduceat(x, ptr[:-1][full], axis=0)
    return out


def take(idx, val, ptr, rows):
    """The compressed rows `rows`, in that order."""
    lens = ptr[1:][rows] - ptr[:-1][rows]
    p = np.concatenate([[0], np.cumsum(lens)])
    at = np.repeat(ptr[:-1][rows] - p[:-1], lens) + np.arange(p[-1])
    return idx[at], val[at], p


def fit(idx, val, ptr, y, dim: int, rank: int = 8, epochs: int = 8, rate: float = 0.08, l2: float = 1e-5, batch: int = 256, seed: int = 7) -> FM:
    """Logistic loss, Adagrad on minibatches. With one class only, a constant (smoothed share of 1s)."""
    rng = np.random.default_rng(seed)
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    m = FM(float(np.log(share / (1 - share))), np.zeros(dim), rng.normal(0, 0.05, (dim, rank)))
    if len(y) == 0 or y.min() == y.max():
        m.v[:] = 0
        return m
    gw, gv, gb = np.full(dim, 1e-6), np.full((dim, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            i, x, p = take(idx, val, ptr, rows)
            lin, pair, sums = m.parts(i, x, p)
            err = (sigmoid(lin + pair) - y[rows]) / len(rows)
            gb += err.sum() ** 2
            m.bias -= rate * err.sum() / np.sqrt(gb)
            if not len(i):
                continue
            own = np.repeat(np.arange(len(rows)), np.diff(p))
            ex = err[own] * x
            gf = ex[:, None] * (sums[own] - m.v[i] * x[:, None])
            by = np.argsort(i, kind="stable")
            u, first = np.unique(i[by], return_index=True)
            dw = np.add.reduceat(ex[by], first) + l2 * m.w[u]
            dv = np.add.reduceat(gf[by], first, axis=0) + l2 * m.v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            m.w[u] -= rate * dw / np.sqrt(gw[u])
            m.v[u] -= rate * dv / np.sqrt(gv[u])
    return m
