"""Distances of rigid transforms over the vertices of a grid."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataline.functions import exprs as E
from strataline.types import Geometry


def row_sum(n: int, a: float, s: float) -> float:
    """Sum over k < n of (a + k s)^2."""
    return a * s * n * (n - 1) + n * a * a + s * s / 6 * n * (2 * n * n - 3 * n + 1)


def axis_sums(g: Geometry) -> list[float]:
    """Over all vertices, the sums of the squared coordinates about the middle."""
    return [row_sum(d, -b / 2, s) * (g.count / d) for d, b, s in zip(g.dims, g.bounds, g.spacing)]


def closed_form(g: Geometry, r1: Sequence[Column], t1: Sequence[Column], r2: Sequence[Column], t2: Sequence[Column]) -> Column:
    """Sum over all vertices of |T1 q - T2 q|^2, in constant time: about the middle of the box, cross terms vanish."""
    mid = [F.lit(b / 2) for b in g.bounds]
    s, n = axis_sums(g), float(g.count)
    shift = E.sub(E.add(E.rotate(r1, mid), t1), E.add(E.rotate(r2, mid), t2))
    turned = sum((F.lit(s[i]) * (r1[i] * r2[i] + r1[3 + i] * r2[3 + i] + r1[6 + i] * r2[6 + i]) for i in range(3)), F.lit(0.0))
    return F.lit(2 * sum(s)) + n * E.dot(shift, shift) - 2 * turned


def root_relative(g: Geometry, d: Column) -> Column:
    """Root mean square over the diagonal of the box: what results are judged by."""
    return F.sqrt(F.abs(d) / float(g.count)) / g.diagonal


def mean_relative(g: Geometry, d: Column) -> Column:
    """The plain mean, as the older forms of the metric report it."""
    return d / float(g.count)


def from_moments(n: Column, q: Sequence[Column], qq: Sequence[Column], r1, t1, r2, t2) -> Column:
    """The same from the vertices' moments: n, sum q (3), sum q q^T (xx, yy, zz, xy, xz, yz)."""
    d = [a - b for a, b in zip(r1, r2)]
    e = E.sub(t1, t2)
    m = [d[i] * d[j] + d[3 + i] * d[3 + j] + d[6 + i] * d[6 + j] for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))]
    quad = m[0] * qq[0] + m[1] * qq[1] + m[2] * qq[2] + 2 * (m[3] * qq[3] + m[4] * qq[4] + m[5] * qq[5])
    return quad + 2 * E.dot(E.rotate(d, q), e) + n * E.dot(e, e)


def coordinates(g: Geometry, r: Sequence[Column], t: Sequence[Column]) -> list[Column]:
    """Twelve numbers whose Euclidean distance is the root of closed_form: the moved middle and the turned axes, weighed."""
    mid = E.add(E.rotate(r, [F.lit(b / 2) for b in g.bounds]), t)
    return [math.sqrt(g.count) * v for v in mid] + [math.sqrt(s) * r[3 * j + i] for i, s in enumerate(axis_sums(g)) for j in range(3)]


Pair = Callable[[Geometry, Sequence[Column], Sequence[Column], Sequence[Column], Sequence[Column]], Column]


@dataclass(frozen=True)
class Metric:
    """A distance of rigid transforms for joins and votes.

    delta(g, r1, t1, r2, t2) is the distance; coordinates(g, r, t) are numbers whose Euclidean distance is never above it, the
    first three of them the moved middle, so that cells of them may cut a join. `tight` says that it is equal to it.
    inclusive: whether a search radius includes its end.
    """

    delta: Pair
    coordinates: Callable[[Geometry, Sequence[Column], Sequence[Column]], list[Column]]
    tight: bool
    inclusive: bool = False


#: The root of the sum over vertices; its root mean square over the diagonal; how far the middle moves (turns do not count).
PLAIN = Metric(lambda g, *p: F.sqrt(F.abs(closed_form(g, *p))), coordinates, True)
RELATIVE = Metric(lambda g, *p: root_relative(g, closed_form(g, *p)), lambda g, r, t: [v / (math.sqrt(g.count) * g.diagonal) for v in coordinates(g, r, t)], True, True)
MIDDLE = Metric(lambda g, r1, t1, r2, t2: E.norm(E.sub(coordinates(g, r1, t1)[:3], coordinates(g, r2, t2)[:3])), lambda g, r, t: coordinates(g, r, t)[:3], True)
