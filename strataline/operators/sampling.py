"""Choosing the points at which a volume is described. Draws depend on row ids and a seed only."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions import exprs as E
from strataline.types import Geometry


def uniform_points(spark: SparkSession, g: Geometry, n: int, seed: int) -> DataFrame:
    """id, x, y, z in the box."""
    return spark.range(n).select("id", *((E.uniform(seed, k, F.col("id")) * b).alias(c) for k, (c, b) in enumerate(zip("xyz", g.bounds))))


def neighbourhood(points: DataFrame, offsets: Sequence[Sequence[float]] | DataFrame, bounds: Sequence[float], clip: bool) -> DataFrame:
    """A row for each point and offset: px, py, pz are the point, x, y, z the place; places outside are moved to the border (clip) or left out."""
    if not isinstance(offsets, DataFrame):
        cells = F.array(*(F.struct(*(F.lit(float(v)).alias(f"d{c}") for v, c in zip(o, "xyz"))) for o in offsets))
        out = points.withColumn("o", F.explode(cells)).select(*points.columns, "o.*")
    else:
        out = points.crossJoin(F.broadcast(offsets))
    for c, b in zip("xyz", bounds):
        place = F.col(c) + F.col(f"d{c}")
        out = out.withColumn(f"p{c}", F.col(c)).withColumn(c, E.clamp(place, 0.0, float(b)) if clip else place)
    return out if clip else out.filter(E.in_bounds(E.xyz(), bounds))


def box27(spacing: Sequence[float]) -> list[tuple[float, float, float]]:
    return [tuple(s * k for s, k in zip(spacing, o)) for o in itertools.product((-1, 0, 1), repeat=3)]


def with_variance(points: DataFrame, field, out: str = "variance") -> DataFrame:
    """Population variance of the 27 values around each point, a spacing apart, clipped to the box. `id` is distinct. A field
    that has these values together (bricks) is met once for each point, not once for each value."""
    if hasattr(field, "box_variance"):
        return field.box_variance(points, out)
    around = neighbourhood(points.select("id", "x", "y", "z"), box27(field.geometry.spacing), field.geometry.bounds, clip=True)
    var = field.attach(around, "value").groupBy("id").agg(F.var_pop("value").alias(out))
    return points.join(var, "id")


def top_variance(points: DataFrame, field, n: int) -> DataFrame:
    """The n points of largest variance, falling (ties: smaller id): a bounded top-k."""
    return with_variance(points, field).orderBy(F.desc("variance"), "id").limit(n)


def percentile_sampler(spark: SparkSession, field, n: int, seed: int, oversample: int = 10) -> DataFrame:
    """The default: draw `oversample` times as many points as wanted and keep those of largest variance."""
    return top_variance(uniform_points(spark, field.geometry, n * oversample, seed), field, n)


def variance_threshold(points: DataFrame, field, least: float, n: int | None = None) -> DataFrame:
    """Points, in order of id, whose variance reaches the threshold; the first n of them. Few may be left, but it ends."""
    kept = with_variance(points, field).filter(F.col("variance") >= least)
    return kept.orderBy("id").limit(n) if n is not None else kept


def gradient_threshold(points: DataFrame, field, least: float, n: int | None = None, radius: float | None = None, steps: int = 3) -> DataFrame:
    """Points whose fitted quadric has a gradient of at least `least` there."""
    from strataline.operators.features import quadrics

    reach = radius or steps * max(field.geometry.spacing)
    fitted = quadrics(points, field, radius=reach, border=0.4, least_step=0.0)
    a = E.elements(F.col("coef"), 10)
    d = [F.col(c) - F.get("centre", F.lit(i)) for i, c in enumerate("xyz")]
    kept = fitted.withColumn("gradient", E.norm(E.quadric_gradient(a, d))).filter(F.col("gradient") >= least).drop("coef", "centre")
    return kept.orderBy("id").limit(n) if n is not None else kept


def cell_counts(bounds: Sequence[float], total: int) -> tuple[int, int, int]:
    """Cells along each axis for about `total` near-cubic ones."""
    size = (bounds[0] * bounds[1] * bounds[2] / total) ** (1 / 3)
    return tuple(max(1, math.ceil(b / size)) for b in bounds)


def cell_candidates(spark: SparkSession, g: Geometry, n: int, keep: float, each: int, seed: int) -> DataFrame:
    """id, cell, x, y, z: `each` points at random in each of about n / keep cells."""
    nx, ny, nz = cell_counts(g.bounds, math.ceil(n / keep))
    cell = F.floor(F.col("id") / each)
    at = (cell % nx, F.floor(cell / nx) % ny, F.floor(cell / (nx * ny)))
    places = [((at[k] + E.uniform(seed, k, F.col("id"))) * (b / m)).alias(c) for k, (c, b, m) in enumerate(zip("xyz", g.bounds, (nx, ny, nz)))]
    return spark.range(nx * ny * nz * each).select("id", cell.cast("long").alias("cell"), *places)


def best_per_cell(candidates: DataFrame, field, n: int, cut: float = 0.01) -> DataFrame:
    """The candidate of largest variance in each cell (ties: first), cells of almost constant value left out, then the n largest."""
    scored = with_variance(candidates, field)
    best = scored.groupBy("cell").agg(F.max_by(F.struct("id", "x", "y", "z", "variance"), F.struct(F.col("variance"), -F.col("id"))).alias("b")).select("cell", "b.*")
    values = field.voxels(candidates.sparkSession).select("value") if hasattr(field, "voxels") else field.table.select(F.col("v").alias("value"))
    ends = values.agg(((F.max("value") - F.min("value")) * cut).alias("floor"))
    return best.crossJoin(F.broadcast(ends)).filter(F.col("variance") >= F.col("floor") * F.col("floor")).drop("floor").orderBy(F.desc("variance"), "cell").limit(n)


def segmented_sampler(spark: SparkSession, field, n: int, seed: int, keep: float = 0.1, each: int = 5) -> DataFrame:
    return best_per_cell(cell_candidates(spark, field.geometry, n, keep, each, seed), field, n)


def paired_samples(spark: SparkSession, micro: Geometry, macro: Geometry, r: Sequence[float], t: Sequence[float], shared: int, total: int, jitter: float, seed: int = 100) -> tuple[DataFrame, DataFrame]:
    """Test sets: the first `shared` points correspond under (r, t) up to jitter, the others are drawn at random."""
    def points(g: Geometry, move: bool, salt: int) -> DataFrame:
        base = uniform_points(spark, micro, shared, seed)
        moved = E.apply_rigid(list(r), list(t), E.xyz()) if move else list(E.xyz())
        near = base.select("id", *((p + E.uniform(seed + salt, 3 + k, F.col("id")) * jitter).alias(c) for k, (p, c) in enumerate(zip(moved, "xyz"))))
        rest = uniform_points(spark, g, max(0, total - shared), seed + 10 + salt).withColumn("id", F.col("id") + shared)
        return near.unionByName(rest)

    return points(micro, False, 1), points(macro, True, 2)


def shuffled(df: DataFrame, seed: int, id_col: str = "id") -> DataFrame:
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col)


def shell_points(centres: DataFrame, inner: float, outer: float, each: int, seed: int) -> DataFrame:
    """`each` points at random, by volume, between two radii around each centre: id, n, x, y, z."""
    out = centres.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    u = [E.uniform(seed, k, F.col("id"), F.col("n")) for k in range(3)]
    r = F.pow(u[0] * (outer**3 - inner**3) + inner**3, 1 / 3)
    phi, theta = F.acos(2 * u[1] - 1), u[2] * (2 * math.pi)
    d = [r * F.sin(phi) * F.cos(theta), r * F.sin(phi) * F.sin(theta), r * F.cos(phi)]
    return out.select("id", "n", *((F.col(c) + v).alias(c) for c, v in zip("xyz", d)))
