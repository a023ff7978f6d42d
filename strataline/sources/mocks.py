"""Synthetic volumes: fields by formula, and point clouds for testing principal axes."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions import exprs as E
from strataline.sources.fields import AnalyticField
from strataline.types import Geometry


def sphere() -> AnalyticField:
    """Distance from the middle of a box of side 5, in thousandths of the radius 2.5, at most 1000."""
    return AnalyticField(
        Geometry((0.2,) * 3, (25,) * 3),
        lambda x, y, z: F.least(E.distance((x, y, z), E.lit3((2.5, 2.5, 2.5))) / 2.5, F.lit(1.0)) * 1000,
        lambda p: np.minimum(np.sqrt(((p - 2.5) ** 2).sum(-1)) / 2.5, 1) * 1000,
    )


def ellipsoid(a: int, b: int, c: int, dims: tuple[int, int, int], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> AnalyticField:
    """4000 q inside q = (x/a)^2 + (y/b)^2 + (z/c)^2 <= 1, 5000 outside: a hard edge."""
    if min(a, b, c) < 1:
        raise ValueError("half axes must be positive")

    def column(x, y, z):
        q = x * x / (a * a) + y * y / (b * b) + z * z / (c * c)
        return F.when(q <= 1, 4000 * q).otherwise(F.lit(5000.0))

    def plain(p):
        q = (p**2 / np.array([a * a, b * b, c * c])).sum(-1)
        return np.where(q <= 1, 4000 * q, 5000.0)

    return AnalyticField(Geometry(spacing, dims), column, plain)


def sphere_row(shrink: int = 1) -> list[tuple[float, float, float, float]]:
    """Centres and radii of the eight spheres, divided by `shrink`."""
    out = []
    for i in range(8):
        r = 20 + 20 * i
        x = 10 * (i + 1) + r + ((i + 1) // 2) * 40 * i
        out.append((x / shrink, 170 / shrink, 170 / shrink, r / shrink))
    return out


def spheres(shrink: int = 1) -> AnalyticField:
    """Eight growing spheres: 1000 inside, falling to 0 over the outer 10; the first sphere that covers a point counts."""
    row, rim = sphere_row(shrink), 10 / shrink

    def column(x, y, z):
        each = []
        for cx, cy, cz, r in row:
            d = E.distance((x, y, z), E.lit3((cx, cy, cz)))
            v = F.when(d < r - rim, F.lit(1.0)).when(d < r, (r - d) / rim)
            each.append(F.when(v > 0, v))
        return F.coalesce(*each, F.lit(0.0)) * 1000

    def plain(p):
        out = np.zeros(p.shape[:-1])
        for cx, cy, cz, r in reversed(row):
            d = np.sqrt(((p - np.array([cx, cy, cz])) ** 2).sum(-1))
            v = np.where(d < r - rim, 1.0, np.clip((r - d) / rim, 0, 1))
            out = np.where(v > 0, v, out)
        return out * 1000

    return AnalyticField(Geometry((1.0,) * 3, tuple(d // shrink for d in (1530, 340, 340))), column, plain)


def sphere_index(x, shrink: int = 1):
    """Number of the sphere whose stretch of the x axis holds x, else null."""
    hits = [F.when((x >= cx - r) & (x <= cx + r), F.lit(i)) for i, (cx, _, _, r) in enumerate(sphere_row(shrink))]
    return F.coalesce(*hits)


def small() -> AnalyticField:
    return AnalyticField(Geometry((1.0,) * 3, (2, 2, 2)), lambda x, y, z: x + 2 * y + 4 * z, lambda p: p @ np.array([1.0, 2.0, 4.0]))


def segment(of: AnalyticField, r: Sequence[float], t: Sequence[float], g: Geometry, outside: float = 5000.0) -> AnalyticField:
    """What stands in `of` at T p; `outside` where T p leaves its box."""

    def column(x, y, z):
        p = E.apply_rigid(list(r), list(t), (x, y, z))
        return F.when(E.in_bounds(p, of.geometry.bounds), of.column(*p)).otherwise(F.lit(outside))

    def plain(p):
        q = p @ np.array(r).reshape(3, 3).T + np.array(t)
        inside = ((q >= 0) & (q <= np.array(of.geometry.bounds))).all(-1)
        return np.where(inside, of.numpy(q), outside)

    return AnalyticField(g, column, plain)


def anchors(dims: Sequence[int], bounds: Sequence[float], seed: int) -> list[tuple[float, ...]]:
    """Points of the distance field: half the smallest dimension, one at least."""
    rng = np.random.default_rng(seed)
    return [tuple(float(v) for v in rng.random(3) * np.array(bounds)) for _ in range(max(min(dims) // 2, 1))]


def point_distances(spark: SparkSession, g: Geometry, points: Sequence[Sequence[float]], kind: str = "sum") -> DataFrame:
    """Voxels of the summed distances (kind `sum`), summed squares (`squared`) or least distance (`closest`) to points, scaled to 0..1 over the grid."""
    from strataline.sources.fields import lattice

    d = [E.distance(E.xyz(), E.lit3(p)) for p in points]
    raw = {"sum": lambda: sum(d[1:], d[0]), "squared": lambda: sum((x * x for x in d[1:]), d[0] * d[0]), "closest": lambda: F.least(*d) if len(d) > 1 else d[0]}[kind]()
    rows = lattice(spark, g).withColumn("raw", raw)
    ends = rows.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    return rows.crossJoin(F.broadcast(ends)).withColumn("value", E.min_max(F.col("raw"), F.col("lo"), F.col("hi"))).drop("raw", "lo", "hi")


def cylinder(axis: str = "z", radius: float = 50.0, centre: Sequence[float] = (50.0, 50.0, 50.0), g: Geometry | None = None) -> AnalyticField:
    """0 within `radius` of the line through the centre along the axis, else 127."""
    g = g or Geometry((0.053059, 0.053059, 0.053058), (1012, 1024, 1014))
    others = [i for i in range(3) if "xyz"[i] != axis]

    def column(x, y, z):
        a, b = ((x, y, z)[i] - float(centre[i]) for i in others)
        return F.when(F.sqrt(a * a + b * b) < radius, F.lit(0.0)).otherwise(F.lit(127.0))

    def plain(p):
        d = p[..., others] - np.array([centre[i] for i in others])
        return np.where(np.sqrt((d * d).sum(-1)) < radius, 0.0, 127.0)

    return AnalyticField(g, column, plain)


def halves(axis: str, g: Geometry, low: float = 0.0, high: float = 127.0) -> AnalyticField:
    """`low` in the lower half along the axis, `high` in the upper."""
    i, mid = "xyz".index(axis), None
    mid = g.bounds[i] / 2
    return AnalyticField(g, lambda *p: F.when(p[i] < mid, F.lit(low)).otherwise(F.lit(high)), lambda p: np.where(p[..., i] < mid, low, high))


def constant(g: Geometry, value: float = 127.0) -> AnalyticField:
    return AnalyticField(g, lambda x, y, z: F.lit(float(value)), lambda p: np.full(p.shape[:-1], float(value)))


def oriented_cloud(spark: SparkSession, n: int, seed: int, centre: Sequence[float] = (0.0, 0.0, 0.0), spread: Sequence[float] = (500.0, 50.0, 5.0)) -> DataFrame:
    """id, x, y, z of points spread by very different amounts along three random orthogonal axes."""
    rng = np.random.default_rng(seed)
    axes = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    draws = [(2 * E.uniform(seed, k, F.col("id")) - 1) * float(s) for k, s in enumerate(spread)]
    places = [sum((draws[k] * float(axes[c, k]) for k in range(3)), F.lit(float(centre[c]))) for c in range(3)]
    return spark.range(n).select("id", *(p.alias(c) for p, c in zip(places, "xyz")))


def turn(ax: float, ay: float, az: float) -> np.ndarray:
    """Rx Ry Rz of angles in radians, as a matrix."""
    c, s = [math.cos(v) for v in (ax, ay, az)], [math.sin(v) for v in (ax, ay, az)]
    rx = np.array([[1, 0, 0], [0, c[0], -s[0]], [0, s[0], c[0]]])
    ry = np.array([[c[1], 0, s[1]], [0, 1, 0], [-s[1], 0, c[1]]])
    rz = np.array([[c[2], -s[2], 0], [s[2], c[2], 0], [0, 0, 1]])
    return rx @ ry @ rz
