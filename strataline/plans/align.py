"""From two volumes to one rigid transform."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.operators import density, features, matching, normalize, sampling, transforms
from strataline.operators.features import DEFAULT, Computer

STAGES = ("sample micro", "describe micro", "sample macro", "describe macro", "normalise and weigh", "match", "candidates", "vote")


@dataclass(frozen=True)
class Config:
    micro_points: int = 40_000
    macro_points: int = 40_000
    seed: int = 1
    computers: Sequence[Computer] = DEFAULT
    quadric_radius: float = features.QUADRIC_RADIUS
    quadric_step: float = features.QUADRIC_STEP
    border: float = 0.15
    ball_radius: float = features.BALL_RADIUS
    ball_step: float = features.BALL_STEP
    fraction: float = 1.0
    threshold: float = 0.1
    spread: float | None = None
    median_share: float = 1.0  # of the median distance, where no spread is given: lower values see finer clusters
    sampler: Callable = sampling.percentile_sampler
    matcher: Callable = matching.position
    progress: Callable[[int, int, str], None] = field(default=lambda stage, of, name: None)


def align(spark: SparkSession, micro, macro, config: Config = Config()) -> DataFrame:
    """One row r, t, density, from micro to macro; none if nothing matched. Each stage is a table of points or vectors, small against the volumes.

    Stages run under the job group `align`, so that spark.sparkContext.cancelJobGroup("align") stops them.
    """
    c = config
    spark.sparkContext.setJobGroup("align", "rigid alignment", interruptOnCancel=True)

    def tell(k: int) -> None:
        c.progress(k + 1, len(STAGES), STAGES[k])

    def described(fld, n: int, seed: int, stage: int) -> tuple[DataFrame, DataFrame]:
        tell(stage)
        points = c.sampler(spark, fld, n, seed).select("id", "x", "y", "z").persist()
        tell(stage + 1)
        spread = points.repartition(max(1, min(n // 16, spark.sparkContext.defaultParallelism * 4)))
        vectors = features.feature_vectors(spread, fld, c.computers, c.quadric_radius, c.border, c.ball_radius, c.ball_step, c.quadric_step)
        return points, normalize.finite_features(vectors).persist()

    try:
        micro_points, a = described(micro, c.micro_points, c.seed, 0)
        macro_points, b = described(macro, c.macro_points, c.seed + 1, 2)
        tell(4)
        n = features.n_features(c.computers)
        both = a.withColumn("set", F.lit("micro")).unionByName(b.withColumn("set", F.lit("macro")))
        ranked = normalize.weight_features(normalize.rank_features(both, n), features.weights(c.computers)).persist()
        side = lambda s: ranked.filter(F.col("set") == s).drop("set")
        tell(5)
        matches = c.matcher(side("micro"), side("macro"), fraction=c.fraction).persist()
        tell(6)
        bases = [transforms.with_bases(p, fld, c.ball_radius, c.ball_step) for p, fld in ((micro_points, micro), (macro_points, macro))]
        found = transforms.candidates(matches, *bases).persist()
        tell(7)
        return density.vote(found, macro.geometry if macro.geometry.count < micro.geometry.count else micro.geometry, c.spread, c.threshold, median_share=c.median_share)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def identity(spark: SparkSession) -> DataFrame:
    """The answer of a stand-in aligner."""
    return transforms.table(spark, [(np.eye(3).reshape(-1).tolist(), [0.0, 0.0, 0.0])]).drop("id")


def rotation_error(r: Sequence[float], expected: Sequence[float]) -> float:
    """Degrees between two rotations."""
    m = np.array(r, float).reshape(3, 3).T @ np.array(expected, float).reshape(3, 3)
    return math.degrees(math.acos(min(1.0, max(-1.0, (np.trace(m) - 1) / 2))))


def corner_error(bounds: Sequence[float], found, expected) -> float:
    """The largest displacement of a corner of the box between two transforms (r, t)."""
    corners = np.array([[b * (k >> i & 1) for i, b in enumerate(bounds)] for k in range(8)])
    moved = [corners @ np.array(r, float).reshape(3, 3).T + np.array(t, float) for r, t in (found, expected)]
    return float(np.sqrt(((moved[0] - moved[1]) ** 2).sum(1)).max())
