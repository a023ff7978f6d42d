"""Small dense linear algebra on the rows of an Arrow batch: fits, eigenvalues, bases, harmonics."""

from __future__ import annotations

import itertools
import math

import numpy as np


def ball_grid(radius: float = 3.0, step: float = 0.225) -> np.ndarray:
    """[n, 3] points of a cube's ticks within the ball. Ticks are summed up from -radius, as the fixed sample set wants."""
    ticks, t = [], -radius
    while t <= radius:
        ticks.append(t)
        t += step
    g = np.stack(np.meshgrid(ticks, ticks, ticks, indexing="ij"), -1).reshape(-1, 3)
    return g[np.sqrt((g * g).sum(1)) <= radius]


def fibonacci(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Polar and azimuth angles of n points spread over the sphere."""
    i = np.arange(n)
    return np.arccos(1 - 2 * i / (n - 1)), 2 * np.pi * i / ((1 + 5**0.5) / 2)


def quadric_terms(p: np.ndarray) -> np.ndarray:
    """[..., 3] -> [..., 10]: x2 y2 z2 xy xz yz x y z 1."""
    x, y, z = np.moveaxis(p, -1, 0)
    return np.stack([x * x, y * y, z * z, x * y, x * z, y * z, x, y, z, np.ones_like(x)], -1)


def solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of stacked systems [n, k, k], [n, k]; zeros for a system without a finite one."""
    try:
        x = np.linalg.solve(a, b[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        if len(a) == 1:
            return np.zeros_like(b)
        x = np.concatenate([solved(a[i : i + 1], b[i : i + 1]) for i in range(len(a))])
    return np.where(np.isfinite(x), x, 0.0)


def gradients(a: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Of quadrics [n, 10] at [n, 3]."""
    return np.einsum("nij,nj->ni", hessians(a), d) + a[:, 6:9]


def hessians(a: np.ndarray) -> np.ndarray:
    return np.stack([2 * a[:, 0], a[:, 3], a[:, 4], a[:, 3], 2 * a[:, 1], a[:, 5], a[:, 4], a[:, 5], 2 * a[:, 2]], -1).reshape(-1, 3, 3)


def curvatures(a: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian and mean curvature; NaN without a gradient."""
    g, h = gradients(a, d), hessians(a)
    n2 = np.where((g * g).sum(1) == 0, np.nan, (g * g).sum(1))
    cof = np.stack([np.cross(h[:, 1], h[:, 2]), np.cross(h[:, 2], h[:, 0]), np.cross(h[:, 0], h[:, 1])], 1)
    form = lambda m: np.einsum("ni,nij,nj->n", g, m, g)
    return form(cof) / n2**2, (form(h) - n2 * np.trace(h, axis1=1, axis2=2)) / (2 * n2**1.5)


def shape_index(k: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shape index and curvedness; h is the mean and d half the difference of the principal curvatures."""
    d = np.sqrt(np.maximum(0.0, h * h - k))
    return 2 / math.pi * np.arctan2(h, d), np.hypot(h, d)


def upper_half(values: np.ndarray) -> np.ndarray:
    """Which values reach the order statistic n // 2."""
    return values >= np.partition(values, len(values) // 2)[len(values) // 2]


def pca_lengths(offsets: np.ndarray, values: np.ndarray, inside: np.ndarray, ordered: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Normalised absolute eigenvalues, ascending, of the covariance of the places (those inside) with upper-half values; NaN
    for constant values. values, inside, ordered: [points, places]; n: places inside."""
    bar = np.take_along_axis(ordered, np.minimum(n // 2, ordered.shape[1] - 1)[:, None], 1)
    top = np.take_along_axis(ordered, np.maximum(n - 1, 0)[:, None], 1)
    w = (inside & (values >= bar)).astype(float)
    k = w.sum(1)
    ok = (n > 1) & (k > 1) & (ordered[:, 0] < top[:, 0])
    mean = w @ offsets / np.maximum(k, 1)[:, None]
    second = (w @ (offsets[:, :, None] * offsets[:, None, :]).reshape(-1, 9)).reshape(-1, 3, 3)
    cov = (second - k[:, None, None] * mean[:, :, None] * mean[:, None, :]) / np.maximum(k - 1, 1)[:, None, None]
    e = np.linalg.eigvalsh(np.where(ok[:, None, None], cov, np.eye(3)))
    return np.where(ok[:, None], np.sort(np.abs(e), axis=1) / np.sqrt((e * e).sum(1))[:, None], np.nan)


def linear_gradient(points: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Slope of the least-squares plane v = g p + c."""
    m = np.column_stack([points, np.ones(len(points))])
    return np.linalg.lstsq(m, values, rcond=None)[0][:3]


def pca_bases(points: np.ndarray, values: np.ndarray) -> list[np.ndarray] | None:
    """Two rotations whose columns are principal axes of the upper-half points, largest spread first.

    Axes have no sign of their own, so four rotations have the same axes; two of them have the axis that is best aligned
    with the gradient point its way. None for constant values or no gradient.
    """
    if len(values) < 4 or values.max() == values.min():
        return None
    slope = linear_gradient(points, values)
    kept = points[upper_half(values)]
    if len(kept) < 2 or np.linalg.norm(slope) < 1e-12:
        return None
    spread, axes = np.linalg.eigh(np.cov(kept.T))
    axes = axes[:, np.argsort(-np.abs(spread), kind="stable")]
    turns = [axes * s for s in itertools.product((1.0, -1.0), repeat=3) if np.prod(s) * np.linalg.det(axes) > 0]
    along = [slope @ t for t in turns]
    best = int(np.abs(along[0]).argmax())
    return [t for t, a in zip(turns, along) if a[best] >= 0]


def kabsch(micro: np.ndarray, macro: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Rotation and translation with least squared error from micro to macro; None below three pairs or for points on a line."""
    if len(micro) < 3:
        return None
    m, n = micro.mean(0), macro.mean(0)
    return rotation_from((micro - m).T @ (macro - n), m, n)


def rotation_from(h: np.ndarray, m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """From the cross-covariance and the two centroids."""
    if not np.isfinite(h).all():
        return None
    u, s, vt = np.linalg.svd(h)
    if s[1] <= 1e-12 * max(s[0], 1e-300):
        return None
    r = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
    return r, n - r @ m


def legendre(l_max: int, x: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Associated Legendre functions P_l^m, 0 <= m <= l, with the Condon-Shortley phase."""
    p, s = {(0, 0): np.ones_like(x)}, np.sqrt(1 - x * x)
    for m in range(l_max + 1):
        if m:
            p[m, m] = -(2 * m - 1) * s * p[m - 1, m - 1]
        if m < l_max:
            p[m + 1, m] = (2 * m + 1) * x * p[m, m]
        for l in range(m + 2, l_max + 1):  # noqa: E741
            p[l, m] = ((2 * l - 1) * x * p[l - 1, m] - (l + m - 1) * p[l - 2, m]) / (l - m)
    return p


def harmonics(l_max: int, theta: np.ndarray, phi: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Y_l^m, m >= 0; the others are their conjugates up to sign, with equal power for real fields."""
    p = legendre(l_max, np.cos(theta))
    return {(l, m): math.sqrt((2 * l + 1) / (4 * math.pi) * math.exp(math.lgamma(l - m + 1) - math.lgamma(l + m + 1))) * v * np.exp(1j * m * phi) for (l, m), v in p.items()}


def harmonic_power(values: np.ndarray, table: dict[tuple[int, int], np.ndarray], l_max: int) -> np.ndarray:
    """Power of each band l of real fields [n, samples] at the points of the table."""
    out = np.zeros((len(values), l_max + 1))
    for (l, m), y in table.items():
        c = 4 * math.pi / values.shape[1] * (values @ np.conj(y))
        out[:, l] += (1 if m == 0 else 2) * np.abs(c) ** 2
    return out
