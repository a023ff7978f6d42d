"""Feature vectors of points: what a volume looks like around them.

Two routes to the values around a point: expressions and joins (`quantiles_sql`, `pca_moments`), for volumes of any size, and Arrow
batches that evaluate the field in numpy (everything that needs a small solve), for volumes that can be shipped. One
quadric fit serves gradient, curvature and shape index.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions import dense
from strataline.functions import exprs as E
from strataline.operators.sampling import neighbourhood
from strataline.runtime import dealt, ship

#: Fixed values of the model: ball of samples, radius and spacing of the quadric's samples.
BALL_RADIUS, BALL_STEP, QUADRIC_RADIUS, QUADRIC_STEP = 3.0, 0.225, 18.0, 0.5


# ------------------------------------------------------------------------------------------ by expressions and joins


def ball_values(points: DataFrame, fld, radius: float = BALL_RADIUS, step: float = BALL_STEP) -> DataFrame:
    """id, px, py, pz, x, y, z, value of the ball's places in the box around each point. Points are dealt by id before they become
    many rows, so that what an analytic field gives is grouped by id where it is made, without a shuffle."""
    spark = points.sparkSession
    offsets = spark.createDataFrame(pd.DataFrame(dense.ball_grid(radius, step), columns=["dx", "dy", "dz"]))
    around = neighbourhood(dealt(points.select("id", "x", "y", "z")), offsets, fld.geometry.bounds, clip=False)
    return fld.attach(around, "value")


def quantiles_sql(points: DataFrame, fld, quantiles: Sequence[float], radius: float = BALL_RADIUS, step: float = BALL_STEP) -> DataFrame:
    """id, features: order statistics trunc(q (n - 1)) of the ball's values; NaN for constant values. A ball is bounded, so its values fit a row."""
    sets = ball_values(points, fld, radius, step).groupBy("id").agg(F.sort_array(F.collect_list("value")).alias("v"))
    at = [F.element_at("v", (F.lit(float(q)) * (F.size("v") - 1)).cast("int") + 1) for q in quantiles]
    flat = F.element_at("v", 1) == F.element_at("v", -1)
    return sets.select("id", F.array(*(F.when(flat, F.lit(float("nan"))).otherwise(a) for a in at)).alias("features"))


def covariance3(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sample covariance of x, y, z: cxx, cyy, czz, cxy, cxz, cyz, and n."""
    pairs = ("xx", "yy", "zz", "xy", "xz", "yz")
    return df.groupBy(*by).agg(*(F.covar_samp(p[0], p[1]).alias(f"c{p}") for p in pairs), F.count("*").alias("n"))


def linear_fit(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Slope gx, gy, gz of value over x, y, z by least squares: centred moments and Cramer's rule; NaN where they don't determine it."""
    c = lambda a, b: F.covar_pop(a, b)
    m = df.groupBy(*by).agg(*(c(a, b).alias(a + b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")), *(c(a, "value").alias(f"{a}v") for a in "xyz"))
    xx, yy, zz, xy, xz, yz, xv, yv, zv = (F.col(n) for n in ("xx", "yy", "zz", "xy", "xz", "yz", "xv", "yv", "zv"))
    det = lambda a, b, c_, d, e, f, g, h, i: a * (e * i - f * h) - b * (d * i - f * g) + c_ * (d * h - e * g)
    whole = F.nullif(det(xx, xy, xz, xy, yy, yz, xz, yz, zz), F.lit(0.0))
    gx, gy, gz = det(xv, xy, xz, yv, yy, yz, zv, yz, zz), det(xx, xv, xz, xy, yv, yz, xz, zv, zz), det(xx, xy, xv, xy, yy, yv, xz, yz, zv)
    return m.select(*by, *(F.coalesce(g / whole, F.lit(float("nan"))).alias(n) for g, n in ((gx, "gx"), (gy, "gy"), (gz, "gz"))))


def pca_moments(points: DataFrame, fld, radius: float = BALL_RADIUS, step: float = BALL_STEP) -> DataFrame:
    """id and the covariance of the ball's places whose value reaches the median order statistic."""
    balls = ball_values(points, fld, radius, step).groupBy("id").agg(F.collect_list(F.struct("value", "x", "y", "z")).alias("ball"))
    sets = balls.withColumn("v", F.sort_array(F.col("ball.value"))).filter(F.element_at("v", 1) < F.element_at("v", -1))
    bar = F.element_at("v", F.floor(F.size("v") / 2).cast("int") + 1)
    kept = sets.withColumn("bar", bar).select("id", F.explode(F.filter("ball", lambda p: p["value"] >= F.col("bar"))).alias("p")).select("id", "p.*")
    return covariance3(kept, ["id"])


# -------------------------------------------------------------------------------------------------- by Arrow batches


def quadric_lattice(geometry, radius: float = QUADRIC_RADIUS, least_step: float = QUADRIC_STEP) -> tuple[np.ndarray, np.ndarray]:
    """Steps along the axes and the offsets of the lattice within the ball."""
    step = np.array([E.lattice_step(s, least_step) if least_step else s for s in geometry.spacing])
    n = np.ceil(radius / step).astype(int)
    g = np.stack(np.meshgrid(*(np.arange(-k, k + 1) * s for k, s in zip(n, step)), indexing="ij"), -1).reshape(-1, 3)
    return step, g[(g * g).sum(1) <= radius * radius]


def sampling_weights(offsets: np.ndarray, spacing: Sequence[float], kind: str) -> np.ndarray:
    s = np.array(spacing)
    if kind == "elliptical":
        n = np.sqrt(((offsets / s) ** 2).sum(1))
        return np.where(n == 0, 1.0, np.sqrt((offsets**2).sum(1)) / np.where(n == 0, 1, n) / s.max())
    total = np.abs(offsets).sum(1)
    return np.where(total < 1e-3, 1.0, (np.abs(offsets) * s).sum(1) / s.max() / np.where(total < 1e-3, 1, total))


_TERMS = ((2, 0, 0), (0, 2, 0), (0, 0, 2), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0))
CHUNK = 1 << 17


class QuadricFitter:
    """Fits quadrics around points, many at once.

    The lattice is a box with a ball in it. The Gaussian and the box of the volume are products over the axes, so
    the normal equations are moments of the box contracted axis by axis, and all points share the base weights; solves
    are stacked. Only as many points at a time as their samples fit CHUNK numbers.
    """

    def __init__(self, geometry, values: Callable, radius: float, border: float, weighting: str, least_step: float):
        self.values, self.bounds = values, np.array(geometry.bounds)
        self.step, offsets = quadric_lattice(geometry, radius, least_step)
        self.reach = np.ceil(radius / self.step).astype(int)
        self.base = np.zeros(2 * self.reach + 1)
        at = np.rint(offsets / self.step).astype(int) + self.reach
        self.base[tuple(at.T)] = sampling_weights(offsets, geometry.spacing, weighting)
        self.ball = np.zeros(self.base.shape, bool)
        self.ball[tuple(at.T)] = True
        self.rate = -math.log(border) / radius**2

    def fit(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients [n, 10] about the lattice points nearest to the points [n, 3], and those lattice points."""
        centre = np.floor(p / self.step + 0.5) * self.step
        coef, at = np.zeros((len(p), 10)), 0
        while at < len(p):
            span = self._span(centre[at : at + 1])
            n = max(1, CHUNK // int(np.prod([hi - lo for lo, hi in span])))
            coef[at : at + n] = self._fit(p[at : at + n], centre[at : at + n])
            at += n
        return coef, centre

    def _span(self, centre: np.ndarray) -> list[tuple[int, int]]:
        """Along each axis, the part of the lattice that lies in the volume for any of the centres."""
        low = np.maximum(np.ceil(-centre.max(0) / self.step - 1e-9), -self.reach).astype(int)
        high = np.minimum(np.floor((self.bounds - centre.min(0)) / self.step + 1e-9), self.reach).astype(int)
        return [(int(lo + r), int(max(hi, lo) + r + 1)) for lo, hi, r in zip(low, high, self.reach)]

    def _fit(self, p: np.ndarray, centre: np.ndarray) -> np.ndarray:
        m, cut = len(p), tuple(slice(lo, hi) for lo, hi in self._span(centre))
        base, ball = self.base[cut], self.ball[cut]
        u = [(np.arange(s.start, s.stop) - r) * h for s, r, h in zip(cut, self.reach, self.step)]
        inside, powers = [], []
        for k in range(3):
            at = centre[:, k, None] + u[k]
            ok = (at >= 0) & (at <= self.bounds[k])
            g = np.where(ok, np.exp(-self.rate * (u[k] - (p[:, k] - centre[:, k])[:, None]) ** 2), 0.0)
            inside.append(ok)
            powers.append(g[:, :, None] * u[k][None, :, None] ** np.arange(5))
        where = np.nonzero(ball)
        ok = inside[0][:, where[0]] & inside[1][:, where[1]] & inside[2][:, where[2]]
        places = centre[:, None, :] + np.stack([x[i] for x, i in zip(u, where)], -1)
        v = np.zeros(ok.shape)
        v[ok] = self.values(places[ok])
        flat = np.where(ok, v, -np.inf).max(1) - np.where(ok, v, np.inf).min(1)
        field = np.zeros((m, *base.shape))
        field[(slice(None), *where)] = v * base[where]
        left = np.einsum("xyz,mzc->mxyc", base, powers[2], optimize=True)
        right = np.einsum("mxyz,mzc->mxyc", field, powers[2][:, :, :3], optimize=True)
        left, right = (np.einsum("mxbc,mxa->mabc", np.einsum("mxyc,myb->mxbc", t, powers[1][:, :, :d], optimize=True), powers[0][:, :, :d], optimize=True) for t, d in ((left, 5), (right, 3)))
        of = lambda t, *e: t[(slice(None), *(sum(x) for x in zip(*e)))]
        normal = np.stack([np.stack([of(left, e, f) for f in _TERMS], -1) for e in _TERMS], -2)
        sums = np.stack([of(right, e) for e in _TERMS], -1)
        return np.where((flat >= 1)[:, None], dense.solved(normal, sums), 0.0)


def _fitter(fld, radius: float, border: float, weighting: str, least_step: float) -> Callable[[], QuadricFitter]:
    geometry, values = fld.geometry, fld.evaluator()
    return lambda: QuadricFitter(geometry, values, radius, border, weighting, least_step)


def quadrics(points: DataFrame, fld, radius: float = QUADRIC_RADIUS, border: float = 0.15, weighting: str = "linear", least_step: float = QUADRIC_STEP) -> DataFrame:
    """Adds coef (10) and centre (3). points: id, x, y, z and what else."""
    make = _fitter(fld, radius, border, weighting, least_step)
    ship(points.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = make()
        for b in batches:
            coef, centre = f.fit(b[["x", "y", "z"]].to_numpy(float))
            yield b.assign(coef=coef.tolist(), centre=centre.tolist())

    schema = points.select("*", F.array(F.lit(0.0)).alias("coef"), F.array(F.lit(0.0)).alias("centre")).schema
    return dealt(points).mapInPandas(run, schema)


@dataclass(frozen=True)
class Computer:
    """One feature computer: its kind, parameters, and the weight of its features."""

    kind: str
    params: dict = field(default_factory=dict)

    @property
    def size(self) -> int:
        return {"gradient": 1, "curvature": 2, "pca": 3, "value": 1, "shape": 2, "position": 3}.get(self.kind) or (len(self.params["quantiles"]) if self.kind == "quantiles" else self.params["l_max"] + 1)

    @property
    def weights(self) -> list[float]:
        return [1 / self.size if self.kind == "quantiles" else 1.0] * self.size


#: Numbers of the kinds in configuration files, fixed by the format.
KINDS = ("gradient", "curvature", "pca", "quantiles", "value", "harmonics", "shape")
FITTED = ("gradient", "curvature", "shape")
DEFAULT = (
    Computer("curvature"),
    Computer("pca"),
    Computer("gradient"),
    Computer("shape"),
    Computer("quantiles", {"quantiles": (0.0, 0.25, 0.5, 0.75, 1.0)}),
)


def n_features(computers: Sequence[Computer]) -> int:
    return sum(c.size for c in computers)


def weights(computers: Sequence[Computer]) -> list[float]:
    return [w for c in computers for w in c.weights]


class Describer:
    """All features of a point in one pass: one ball of values, one quadric for each weighting and border."""

    def __init__(self, geometry, values: Callable, computers: Sequence[Computer], radius: float, border: float, ball_radius: float, ball_step: float, least_step: float):
        self.values, self.bounds, self.computers = values, np.array(geometry.bounds), computers
        self.border = border
        kinds = {self.fit_of(c) for c in computers if c.kind in FITTED}
        self.fitters = {k: QuadricFitter(geometry, values, radius, k[1], k[0], least_step) for k in kinds}
        self.ball = dense.ball_grid(ball_radius, ball_step) if any(c.kind in ("pca", "quantiles") for c in computers) else None
        self.waves = {}
        for c in computers:
            if c.kind == "harmonics":
                theta, phi = dense.fibonacci(c.params.get("samples", 200))
                r = c.params.get("radius", ball_radius)
                around = r * np.stack([np.sin(theta) * np.cos(phi), np.sin(theta) * np.sin(phi), np.cos(theta)], -1)
                self.waves[id(c)] = around, dense.harmonics(c.params["l_max"], theta, phi)

    def fit_of(self, c: Computer) -> tuple[str, float]:
        return c.params.get("weighting", "linear"), c.params.get("border", self.border)

    def describe(self, p: np.ndarray) -> np.ndarray:
        """[n, 3] -> [n, features]."""
        fits = {k: f.fit(p) for k, f in self.fitters.items()}
        out: list[np.ndarray] = []
        balls = self._balls(p) if self.ball is not None else None
        for c in self.computers:
            if c.kind in FITTED:
                a, centre = fits[self.fit_of(c)]
                if c.kind == "gradient":
                    out.append(np.sqrt((dense.gradients(a, p - centre) ** 2).sum(1))[:, None])
                else:
                    k, h = dense.curvatures(a, p - centre)
                    out.append(np.stack((k, h) if c.kind == "curvature" else dense.shape_index(k, h), -1))
            elif c.kind == "value":
                out.append(self.values(p)[:, None])
            elif c.kind == "position":
                out.append(p)
            elif c.kind == "pca":
                out.append(balls[0])
            elif c.kind == "quantiles":
                n, v = balls[1], balls[2]
                at = [np.take_along_axis(v, np.maximum((q * (n - 1)).astype(int), 0)[:, None], 1) for q in c.params["quantiles"]]
                last = np.take_along_axis(v, np.maximum(n - 1, 0)[:, None], 1)
                out.append(np.where((n > 0)[:, None] & (v[:, :1] < last), np.concatenate(at, 1), np.nan))
            else:
                around, table = self.waves[id(c)]
                out.append(dense.harmonic_power(self.values(np.clip(p[:, None] + around, 0, self.bounds)), table, c.params["l_max"]))
        return np.concatenate(out, 1)

    def _balls(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the ball's places in the box around each point: axis lengths, how many, and the values in order (the others last)."""
        at = p[:, None] + self.ball
        ok = ((at >= 0) & (at <= self.bounds)).all(2)
        v = np.full(ok.shape, np.inf)
        v[ok] = self.values(at[ok])
        n, ordered = ok.sum(1), np.sort(v, axis=1)
        return dense.pca_lengths(self.ball, v, ok, ordered, n), n, ordered


def feature_vectors(
    points: DataFrame, fld, computers: Sequence[Computer] = DEFAULT, radius: float = QUADRIC_RADIUS, border: float = 0.15,
    ball_radius: float = BALL_RADIUS, ball_step: float = BALL_STEP, least_step: float = QUADRIC_STEP,
) -> DataFrame:
    """id, x, y, z, features."""
    geometry, values, computers = fld.geometry, fld.evaluator(), tuple(computers)
    ship(points.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = Describer(geometry, values, computers, radius, border, ball_radius, ball_step, least_step)
        for b in batches:
            p = b[["x", "y", "z"]].to_numpy(float)
            size = max(1, CHUNK // (1 if d.ball is None else len(d.ball)))
            yield b.assign(features=[r for at in range(0, len(p), size) for r in d.describe(p[at : at + size]).tolist()])

    return dealt(points.select("id", "x", "y", "z")).mapInPandas(run, "id long, x double, y double, z double, features array<double>")


#: What each kind needs in a configuration file: parameter, its name there, its type. Fixed by the format.
PARAMETERS = {k: {"border": ("BorderPercentage", float), "radius": ("Radius", int)} for k in FITTED} | {
    "quantiles": {"quantiles": ("QuantileValues", lambda v: tuple(map(float, v)))},
    "harmonics": {"l_max": ("lMax", int), "radius": ("radius", float), "samples": ("sampleCount", int)},
}


def computers_from_json(text: str) -> list[Computer]:
    """A configuration {configurations: [{FeatureComputerType, Parameters: {name: {Value}}}]}; numbers are taken as numbers
    however they are written. Entries with an unknown type, or without all that their kind needs, are left out. The radius of
    a fitted kind must be there but does not change the fit, whose radius is an argument of `feature_vectors`."""
    out = []
    for c in json.loads(text).get("configurations") or []:
        kind, given = c.get("FeatureComputerType"), {k: (v or {}).get("Value") for k, v in (c.get("Parameters") or {}).items()}
        if not isinstance(kind, int) or not 0 <= kind < len(KINDS):
            continue
        wanted = PARAMETERS.get(KINDS[kind], {})
        if all(given.get(name) not in (None, []) for name, _ in wanted.values()):
            out.append(Computer(KINDS[kind], {k: read(given[name]) for k, (name, read) in wanted.items()}))
    return out


ENDS = ("limit", "converged", "diverged", "border")  # why a descent ended


def descend(p: np.ndarray, target: np.ndarray, describe: Callable[[np.ndarray], np.ndarray], bounds: np.ndarray, rate: float = 0.1, delta: float = 0.05, largest: float = 0.5, steps: int = 200, enough: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Moves points p [n, 3] towards features `target` [n, f], all at once: each round makes one forward difference by axis of the
    squared feature distance, clamps the step, and leaves out the points that have ended, so later rounds are smaller.

    A point ends where it stands when its step is below `enough` on every axis, when its step has grown on every axis, when its
    next place or the places it must look at lie outside, or features there are not finite ("border"); and after `steps` rounds.
    Gives the places, the rounds each moved, and why it ended (an index of ENDS).
    """
    p = np.array(p, float)
    moved, why = np.zeros(len(p), int), np.zeros(len(p), int)
    active, last = np.arange(len(p)), np.full(p.shape, np.inf)
    for _ in range(steps):
        ahead = p[active] + delta
        inside = ((ahead >= 0) & (ahead <= bounds)).all(1)
        why[active[~inside]] = 3
        active, last = active[inside], last[inside]
        if not len(active):
            break
        places = p[active][:, None] + delta * np.concatenate([np.zeros((1, 3)), np.eye(3)])
        found = describe(places.reshape(-1, 3)).reshape(len(active), 4, -1)
        cost = ((found - target[active][:, None]) ** 2).sum(2)
        step = np.clip(rate * (cost[:, 1:] - cost[:, :1]) / delta, -largest, largest)
        to = p[active] - step
        small, grown = (np.abs(step) < enough).all(1), (np.abs(step) > np.abs(last)).all(1)
        out = ~((to >= 0) & (to <= bounds)).all(1)
        ended = np.select([small, grown, out], [1, 2, 3], 0)
        why[active] = ended
        active, last = active[ended == 0], step[ended == 0]
        p[active] = to[ended == 0]
        moved[active] += 1
    return p, moved, why


def descended(
    points: DataFrame, fld, computers: Sequence[Computer] = DEFAULT, rate: float = 0.1, delta: float = 0.05, largest: float = 0.5, steps: int = 200, enough: float = 1e-6,
    radius: float = QUADRIC_RADIUS, border: float = 0.15, ball_radius: float = BALL_RADIUS, ball_step: float = BALL_STEP, least_step: float = QUADRIC_STEP,
) -> DataFrame:
    """Points (id, x, y, z, and `target`: the features wanted) moved to places near them whose features are closest to these:
    id, x, y, z, distance (of the features at the end), steps, ended. Weights are not applied. The points of a batch advance together, each as it would alone. A null or non-finite place or target, or one of another length, stays and has ended at the "border", distance null."""
    geometry, values, computers = fld.geometry, fld.evaluator(), tuple(computers)
    ship(points.sparkSession)
    size = n_features(computers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = Describer(geometry, values, computers, radius, border, ball_radius, ball_step, least_step)
        each = max(1, CHUNK // (4 if d.ball is None else 4 * len(d.ball)))
        for b in batches:
            p = b[["x", "y", "z"]].to_numpy(float)
            wanted = np.array([np.asarray(t, float) if t is not None and len(t) == size else np.full(size, np.nan) for t in b["target"]]).reshape(-1, size)
            ok = np.flatnonzero(np.isfinite(p).all(1) & np.isfinite(wanted).all(1))
            moved, why, far = np.zeros(len(p), int), np.full(len(p), 3), np.full(len(p), np.nan)
            for part in (ok[at : at + each] for at in range(0, len(ok), each)):
                p[part], moved[part], why[part] = descend(p[part], wanted[part], d.describe, d.bounds, rate, delta, largest, steps, enough)
                far[part] = np.sqrt(((d.describe(p[part]) - wanted[part]) ** 2).sum(1))
            yield pd.DataFrame({"id": b["id"], "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "distance": far, "steps": moved, "ended": np.array(ENDS)[why]})

    out = dealt(points.select("id", "x", "y", "z", "target")).mapInPandas(run, "id long, x double, y double, z double, distance double, steps int, ended string")
    plain = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select("id", *(plain(c) for c in ("x", "y", "z", "distance")), "steps", "ended")
