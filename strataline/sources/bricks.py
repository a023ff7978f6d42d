"""Stored volumes as bricks: a row for each cube of samples, with a margin of its neighbours' samples around it.

    bricks = BrickField.of(g, voxels)                  # one shuffle of the voxels; margins are exchanged here
    bricks.attach(points)                              # linear interpolation
    bricks.box_variance(points)                        # variance of 27 values around each point
    bricks.slopes()                                    # local gradient at every sample
    bricks.slopes_at(points)                           # and at points

A point meets its brick in one equality join and finds there all that it needs: it is shuffled once, whatever the number of
samples it looks at. Interpolation weights are hats, max(0, 1 - |q - sample|), and so products over the axes: a cube of samples
is contracted axis by axis, for one place or 27. Bricks are numbered along a Z-curve, so a range of numbers is a compact part of the
volume. A brick that holds a third of all points is split by adaptive execution; its row is small (`side` + margins, cubed).
Places outside are moved to the border; samples without a voxel row are 0; a null coordinate gives null.

Local gradients are those of a quadric fitted to the box of seven samples a side (fewer at the border) around the nearest sample, with a
kernel of the distance by axis. Kernel and box are products over the axes, so polynomials that are orthogonal along each axis
make the fit a sum of products, border included: no system is solved. A degree that an axis has too few samples for is left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions import exprs as E
from strataline.runtime import ship
from strataline.types import Geometry

SIDE = 16
REACH = 3  # samples on either side of a fitted box
BORDER = 0.4  # of the kernel


def z_number(parts: Sequence[Column]) -> Column:
    """The bits of three numbers below 2^21, interleaved: numbers near each other lie near each other."""
    bits = F.lit(0).cast("long")
    for axis, c in enumerate(parts):
        v = c.cast("long")
        for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            v = (v.bitwiseOR(F.shiftleft(v, shift))).bitwiseAND(F.lit(mask).cast("long"))
        bits = bits.bitwiseOR(F.shiftleft(v, axis))
    return bits


def _contracted(samples: Column, weights: Column, width: int, rows: int, each: int) -> Column:
    """Samples with `width` along their fastest axis, `rows` of these -> sums under each of `each` weights, which become the slowest axis."""
    def contract(s: Column, w: Column) -> Column:
        term = lambda k, i, o: F.get(w, k * width + o) * F.get(s, i * width + o)
        row = lambda k: F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: sum((term(k, i, o) for o in range(1, width)), term(k, i, 0)))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(each - 1)), row))

    return _once(samples, lambda s: _once(weights, lambda w: contract(s, w)))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def axis_polynomials(u: np.ndarray, w: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polynomials of degree 0, 1, 2 that are orthonormal under the weights w [n, m] of the places u [n, m]: w times their values
    there [n, 3, m], and their values and slopes at d [n]."""
    at, value, slope = [], [], []
    for k in range(3):
        p, q, s = u**k, d**k, k * d ** max(0, k - 1)
        size = (w * p * p).sum(1)
        for a, b, c in zip(at, value, slope):
            part = (w * p * a).sum(1)
            p, q, s = p - part[:, None] * a, q - part * b, s - part * c
        norm = (w * p * p).sum(1)
        ok = norm > 1e-9 * size
        scale = np.where(ok, 1 / np.sqrt(np.where(ok, norm, 1)), 0)
        at.append(p * scale[:, None]), value.append(q * scale), slope.append(s * scale)
    return w[:, None, :] * np.stack(at, 1), np.stack(value, 1), np.stack(slope, 1)


def _box(g: Geometry, axis: int, place: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`axis_polynomials` about the samples numbered `low` for points at `place` along an axis."""
    s, o = g.spacing[axis], np.arange(-REACH, REACH + 1)
    u, d = np.broadcast_to(o * s, (len(low), len(o))), place - low * s
    inside = (low[:, None] + o >= 0) & (low[:, None] + o < g.dims[axis])
    return axis_polynomials(u, np.where(inside, np.exp(math.log(BORDER) / 2 / s * (u - d[:, None]) ** 2), 0), d)


_DEGREES = [(i, j, k) for i in range(3) for j in range(3 - i) for k in range(3 - i - j)]


def _slopes(sums: np.ndarray, ends: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sums under the polynomials [..., x, y, z] and (values, slopes) [..., 3] by axis -> gradients [..., 3]."""
    return np.stack([sum(sums[(..., *e)] * math.prod(ends[a][a == axis][..., e[a]] for a in range(3)) for e in _DEGREES) for axis in range(3)], -1)


@dataclass(frozen=True)
class BrickField:
    """table: brick (Z-number), bx, by, bz, samples (x fastest, with margins of `below` and `above` samples)."""

    geometry: Geometry
    table: DataFrame
    side: int = SIDE
    below: int = REACH
    above: int = REACH

    @classmethod
    def of(cls, g: Geometry, voxels: DataFrame, side: int = SIDE) -> BrickField:
        """From voxels (x, y, z int indices, v); a voxel goes to every brick whose margin it lies in. Write the table for more than one use."""
        ship(voxels.sparkSession)
        full = side + 2 * REACH
        kind = voxels.schema["v"].dataType.simpleString()
        rows = voxels.select("x", "y", "z", "v")
        for c, d in zip("xyz", g.dims):
            first = F.greatest(F.lit(0), F.ceil((F.col(c) - (side + REACH - 1)) / side).cast("int"))
            last = F.least(F.lit((d - 1) // side), F.floor((F.col(c) + REACH) / side).cast("int"))
            rows = rows.filter(F.col(c).between(0, d - 1)).withColumn(f"b{c}", F.explode(F.sequence(first, last)))
        at = [F.col(c) - F.col(f"b{c}") * side + REACH for c in "xyz"]
        rows = rows.select(z_number([F.col(f"b{c}") for c in "xyz"]).alias("brick"), "bx", "by", "bz", ((at[2] * full + at[1]) * full + at[0]).cast("int").alias("at"), "v")

        def fill(rows: pd.DataFrame) -> pd.DataFrame:
            samples = np.zeros(full**3)
            samples[rows["at"].to_numpy()] = rows["v"].fillna(0).to_numpy()
            return rows[["brick", "bx", "by", "bz"]].head(1).assign(samples=[samples.astype(np.int64) if kind in ("int", "bigint", "smallint") else samples])

        return cls(g, rows.groupBy("brick").applyInPandas(fill, f"brick long, bx int, by int, bz int, samples array<{kind}>"), side)

    @property
    def full(self) -> int:
        return self.side + self.below + self.above

    def _met(self, points: DataFrame, low: Sequence[Column], first: int, width: int) -> DataFrame:
        """The points (all columns) and `_cube`: `width` samples along each axis, from `first` samples beside `low` on."""
        parts = [F.floor(c / self.side).cast("int") for c in low]
        start = [low[a] - parts[a] * self.side + self.below + first for a in range(3)]
        at = lambda j, k: ((start[2] + k) * self.full + start[1] + j) * self.full + start[0]
        known = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
        keyed = points.withColumns({"_brick": F.when(known, z_number(parts)), "_at": at(0, 0).cast("int")})
        bricks = self.table.select(F.col("brick").alias("_brick"), F.col("samples").alias("_samples"))
        lines = [F.slice("_samples", F.col("_at") + (k * self.full + j) * self.full + 1, width) for k in range(width) for j in range(width)]
        return keyed.join(bricks, "_brick", "left").select(*points.columns, F.concat(*lines).cast("array<double>").alias("_cube"))

    def _places(self) -> tuple[list[Column], list[Column]]:
        """The points in samples, and the samples below them."""
        f = [F.col(c) / s for c, s in zip("xyz", self.geometry.spacing)]
        return f, [F.floor(E.clamp(v, 0.0, float(d - 1))).cast("int") for v, d in zip(f, self.geometry.dims)]

    def _mixed(self, points: DataFrame, shifts: Sequence[int]) -> DataFrame:
        """The points and `_values`: interpolated at every combination of the shifts, in samples, along the axes."""
        f, low = self._places()
        first, width, each = min(shifts), max(shifts) - min(shifts) + 2, len(shifts)
        hats = {}
        for c, v, n, d in zip("xyz", f, low, self.geometry.dims):
            places = [E.clamp(v + k, 0.0, float(d - 1)) for k in shifts]
            hats[f"_w{c}"] = F.array(*(F.greatest(F.lit(0.0), 1 - F.abs(q - (n + first + o))) for q in places for o in range(width)))
        met = self._met(points.withColumns(hats), low, first, width)
        sums, rows = F.col("_cube"), width * width
        for c in "xyz":
            sums = _contracted(sums, F.col(f"_w{c}"), width, rows, each)
            rows = rows // width * each
        return met.withColumn("_values", sums).drop("_cube", *hats)

    def attach(self, points: DataFrame, out: str = "value") -> DataFrame:
        return self._mixed(points, (0,)).withColumn(out, F.get("_values", F.lit(0))).drop("_values")

    def box_variance(self, points: DataFrame, out: str = "variance") -> DataFrame:
        """Population variance of the 27 values around each point, a spacing apart, clipped to the box."""
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / 27
        variance = lambda v: _once(total(v), lambda m: total(F.transform(v, lambda x: (x - m) * (x - m))))
        return self._mixed(points, (-1, 0, 1)).withColumn(out, _once(F.col("_values"), variance)).drop("_values")

    def slopes(self) -> DataFrame:
        """x, y, z, gx, gy, gz of every sample: a map over the bricks, whose margins hold all that a box needs."""
        g, side, full, skip = self.geometry, self.side, self.full, self.below - REACH

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for bx, by, bz, samples in zip(b["bx"], b["by"], b["bz"], b["samples"]):
                    number = [np.arange(n * side, min((n + 1) * side, d)) for n, d in zip((bx, by, bz), g.dims)]
                    axes = [_box(g, a, n * g.spacing[a], n) for a, n in enumerate(number)]
                    v = np.asarray(samples, float).reshape(full, full, full).transpose(2, 1, 0)
                    cut = tuple(slice(skip, skip + len(n) + 2 * REACH) for n in number)
                    windows = np.lib.stride_tricks.sliding_window_view(v[cut], (2 * REACH + 1,) * 3)
                    centred = windows - windows[..., REACH, REACH, REACH][..., None, None, None]
                    sums = np.einsum("xyzuvw,xau->xyzavw", centred, axes[0][0], optimize=True)
                    sums = np.einsum("xyzavw,ybv->xyzabw", sums, axes[1][0], optimize=True)
                    sums = np.einsum("xyzabw,zcw->xyzabc", sums, axes[2][0], optimize=True)
                    spread = lambda m, a: np.expand_dims(m, tuple(k for k in range(3) if k != a))
                    s = _slopes(sums, [(spread(axes[a][1], a), spread(axes[a][2], a)) for a in range(3)])
                    x, y, z = np.meshgrid(*number, indexing="ij")
                    yield pd.DataFrame({"x": x.ravel(), "y": y.ravel(), "z": z.ravel(), **{f"g{c}": s[..., a].ravel() for a, c in enumerate("xyz")}})

        return self.table.select("bx", "by", "bz", "samples").mapInPandas(run, "x int, y int, z int, gx double, gy double, gz double")

    def slopes_at(self, points: DataFrame) -> DataFrame:
        """The points and gx, gy, gz there, of the box around the nearest sample (a tie upwards)."""
        g, width = self.geometry, 2 * REACH + 1
        low = [E.clamp(F.floor(F.col(c) / s + 0.5), 0, d - 1).cast("int") for c, s, d in zip("xyz", g.spacing, g.dims)]
        met = self._met(points, low, -REACH, width)

        @F.pandas_udf("struct<gx:double,gy:double,gz:double>")
        def slope(x: pd.Series, y: pd.Series, z: pd.Series, cube: pd.Series) -> pd.DataFrame:
            out = np.full((len(x), 3), np.nan)
            ok = np.flatnonzero(cube.notna().to_numpy())
            if len(ok):
                p = np.stack([c.to_numpy(float)[ok] for c in (x, y, z)], 1)
                near = np.clip(np.floor(p / np.array(g.spacing) + 0.5), 0, np.array(g.dims) - 1).astype(int)
                axes = [_box(g, a, p[:, a], near[:, a]) for a in range(3)]
                v = np.stack(cube.to_numpy()[ok]).reshape(-1, width, width, width).transpose(0, 3, 2, 1)
                v = v - v[:, REACH, REACH, REACH, None, None, None]
                sums = np.einsum("nuvw,nau,nbv,ncw->nabc", v, *(a[0] for a in axes), optimize=True)
                out[ok] = _slopes(sums, [a[1:] for a in axes])
            return pd.DataFrame(out, columns=["gx", "gy", "gz"])

        found = met.withColumn("_s", slope(*E.xyz(), "_cube"))
        return found.select(*points.columns, *(F.when(F.col("_cube").isNotNull(), F.col(f"_s.g{c}")).alias(f"g{c}") for c in "xyz"))
