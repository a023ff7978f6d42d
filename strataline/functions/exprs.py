"""Scalar operators as Column builders. Points are triples of columns, rotations lists of nine, row by row."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = Sequence[Column]


def xyz(prefix: str = "", suffix: str = "") -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}{suffix}") for c in "xyz")


def lit3(p) -> tuple[Column, Column, Column]:
    return tuple(F.lit(float(c)) for c in p)


# --------------------------------------------------------------------------------------------------------- points


def add(p: Point, q: Point) -> list[Column]:
    return [a + b for a, b in zip(p, q)]


def sub(p: Point, q: Point) -> list[Column]:
    return [a - b for a, b in zip(p, q)]


def scale(p: Point, k) -> list[Column]:
    return [a * k for a in p]


def divide(k, p: Point) -> list[Column]:
    """k / p by coordinate; a zero coordinate is an error."""
    return [F.when(a == 0, F.raise_error(F.lit("division by a zero coordinate")).cast("double")).otherwise(F.lit(k) / a) for a in p]


def dot(p: Point, q: Point) -> Column:
    (a, b, c), (d, e, f) = p, q
    return a * d + b * e + c * f


def norm(p: Point) -> Column:
    return F.sqrt(dot(p, p))


def distance(p: Point, q: Point) -> Column:
    return norm(sub(p, q))


def in_bounds(p: Point, bounds: Sequence[float]) -> Column:
    """0 <= p <= bound on each axis, ends included."""
    ok = [c.between(0.0, float(b)) for c, b in zip(p, bounds)]
    return ok[0] & ok[1] & ok[2]


def clamp(v: Column, lo, hi) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


# ------------------------------------------------------------------------------------------------------ transforms


def rotate(r: Sequence, p: Point) -> list[Column]:
    return [dot([F.lit(c) if not isinstance(c, Column) else c for c in r[3 * i : 3 * i + 3]], p) for i in range(3)]


def apply_rigid(r: Sequence, t: Sequence, p: Point) -> list[Column]:
    """R p + t."""
    return [a + (b if isinstance(b, Column) else F.lit(float(b))) for a, b in zip(rotate(r, p), t)]


def transpose(r: Sequence) -> list:
    return [r[3 * j + i] for i in range(3) for j in range(3)]


def inverse(r: Sequence[Column], t: Sequence[Column]) -> tuple[list[Column], list[Column]]:
    rt = transpose(r)
    return rt, [-c for c in rotate(rt, t)]


def matmul(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)]


def compose(first, then):
    """The transform that applies `first`, then `then`; both are (r, t)."""
    (r1, t1), (r2, t2) = first, then
    return matmul(r2, r1), add(rotate(r2, t1), t2)


def euler(ax: Column, ay: Column, az: Column) -> list[Column]:
    """Rx Ry Rz."""
    o, i = F.lit(0.0), F.lit(1.0)
    rx = [i, o, o, o, F.cos(ax), -F.sin(ax), o, F.sin(ax), F.cos(ax)]
    ry = [F.cos(ay), o, F.sin(ay), o, i, o, -F.sin(ay), o, F.cos(ay)]
    rz = [F.cos(az), -F.sin(az), o, F.sin(az), F.cos(az), o, o, o, i]
    return matmul(matmul(rx, ry), rz)


def elements(array: Column, n: int) -> list[Column]:
    return [F.get(array, F.lit(i)) for i in range(n)]


# -------------------------------------------------------------------------------------------------------- features


def squared_l2(a: Column, b: Column) -> Column:
    """Squared distance of two arrays of doubles of equal length; lengths that differ are an error."""
    same = F.size(a) == F.size(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return F.when(same, total).otherwise(F.raise_error(F.lit("feature vectors differ in length")).cast("double"))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def magnitude(a: Column) -> Column:
    return F.sqrt(inner(a, a))


def cosine_score(a: Column, b: Column) -> Column:
    """100 * cosine, at least 0; 0 for lengths that differ, NaN for a zero vector."""
    m = magnitude(a) * magnitude(b)
    s = F.when(m == 0, F.lit(float("nan"))).otherwise(F.lit(100.0) * inner(a, b) / F.nullif(m, F.lit(0.0)))
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).when(s < 0, F.lit(0.0)).otherwise(s)


def all_finite(a: Column) -> Column:
    """No NaN, infinity or null among the elements."""
    return F.coalesce(F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))


def weighted(a: Column, weights: Sequence[float]) -> Column:
    return F.zip_with(a, F.array(*(F.lit(float(w)) for w in weights)), lambda v, w: v * w)


# ------------------------------------------------------------------------------------------- lattices and kernels


def to_lattice(v: Column, s: float) -> Column:
    """Nearest multiple of s, a tie upwards."""
    return F.floor(v / s + 0.5) * s


def extents(c: Column, top: float, s: float, shift: int) -> tuple[Column, Column]:
    """Steps of s that fit below and above c within [0, top], at most shift."""
    return F.least(c / s, F.lit(float(shift))).cast("int"), F.least((F.lit(top) - c) / s, F.lit(float(shift))).cast("int")


def lattice_step(spacing: float, least: float = 0.5) -> float:
    """The spacing, or the multiple of it nearest to `least` (half to even) if it is finer."""
    return spacing if spacing >= least else round(least / spacing) * spacing


def gaussian(p: Point, radius: float, border: float) -> Column:
    """1 at the origin, `border` at the radius."""
    return F.exp(F.lit(math.log(border) / radius**2) * dot(p, p))


def gaussian_by_axis(p: Point, spacing: Sequence[float], border: float = 0.4) -> Column:
    return F.exp(sum((F.lit(math.log(border) / 2 / s) * c * c for c, s in zip(p, spacing)), F.lit(0.0)))


def linear_weight(p: Point, spacing: Sequence[float]) -> Column:
    """Spacings averaged by the share of each axis, relative to the largest; 1 at the origin."""
    total, top = sum((F.abs(c) for c in p[1:]), F.abs(p[0])), max(spacing)
    mixed = sum((F.lit(s / top) * F.abs(c) for c, s in zip(p[1:], spacing[1:])), F.lit(spacing[0] / top) * F.abs(p[0]))
    return F.when(total < 1e-3, F.lit(1.0)).otherwise(mixed / total)


def elliptical_weight(p: Point, spacing: Sequence[float]) -> Column:
    """|p| / |p by spacing|, relative to the largest spacing; 1 at the origin, where the ratio has no value."""
    n = norm([c / s for c, s in zip(p, spacing)])
    return F.when(n == 0, F.lit(1.0)).otherwise(norm(p) / n / max(spacing))


def min_max(v: Column, lo: Column, hi: Column) -> Column:
    """(v - lo) / (hi - lo); 0 where all values are equal."""
    return F.when(hi == lo, F.lit(0.0)).otherwise((v - lo) / (hi - lo))


def grey(v: Column) -> Column:
    """A value of 0..1 as 0..255, truncated."""
    return clamp((v * 255).cast("int"), 0, 255)


# ------------------------------------------------------------------------------------- the quadric and its surfaces


def quadric_gradient(a: Sequence[Column], d: Point) -> list[Column]:
    x, y, z = d
    return [2 * a[0] * x + a[3] * y + a[4] * z + a[6], 2 * a[1] * y + a[3] * x + a[5] * z + a[7], 2 * a[2] * z + a[4] * x + a[5] * y + a[8]]


def curvature(a: Sequence[Column], d: Point) -> tuple[Column, Column]:
    """Gaussian and mean curvature of the iso-surface through d of the quadric with coefficients a; NaN without a gradient."""
    g = quadric_gradient(a, d)
    xx, yy, zz, xy, xz, yz = 2 * a[0], 2 * a[1], 2 * a[2], a[3], a[4], a[5]
    g2 = dot(g, g)
    adj = [yy * zz - yz * yz, xx * zz - xz * xz, xx * yy - xy * xy, xz * yz - xy * zz, xy * yz - xz * yy, xy * xz - xx * yz]
    form = lambda m: m[0] * g[0] * g[0] + m[1] * g[1] * g[1] + m[2] * g[2] * g[2] + 2 * (m[3] * g[0] * g[1] + m[4] * g[0] * g[2] + m[5] * g[1] * g[2])
    k = form(adj) / F.nullif(g2 * g2, F.lit(0.0))
    h = (form([xx, yy, zz, xy, xz, yz]) - g2 * (xx + yy + zz)) / F.nullif(2 * F.pow(g2, 1.5), F.lit(0.0))
    return F.coalesce(k, F.lit(float("nan"))), F.coalesce(h, F.lit(float("nan")))


def shape_index(k: Column, h: Column) -> tuple[Column, Column]:
    """Shape index and curvedness from Gaussian and mean curvature; d is half the difference of the principal ones."""
    d = F.sqrt(F.greatest(F.lit(0.0), h * h - k))
    return F.lit(2 / math.pi) * F.atan2(h, d), F.sqrt(h * h + d * d)


# --------------------------------------------------------------------------------------------------------- randomness


def uniform(seed: int, k: int, *ids: Column) -> Column:
    """In [0, 1), a function of the ids, the seed and the draw number k only: the same under any partitioning."""
    return F.pmod(F.xxhash64(*ids, F.lit(seed), F.lit(k)), F.lit(1 << 53)) / float(1 << 53)
