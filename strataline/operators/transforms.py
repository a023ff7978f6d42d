"""Candidate rigid transforms from matches, their refinement, and tables of transforms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions import dense
from strataline.functions import exprs as E
from strataline.operators import scan
from strataline.operators.features import BALL_RADIUS, BALL_STEP
from strataline.runtime import dealt, ship

_CANDIDATE = "id long, match_id long, r array<double>, t array<double>"


def table(spark: SparkSession, transforms: Sequence[tuple[Sequence[float], Sequence[float]]]) -> DataFrame:
    """id, r, t of a few given transforms."""
    return spark.createDataFrame([(i, [float(v) for v in r], [float(v) for v in t]) for i, (r, t) in enumerate(transforms)], "id long, r array<double>, t array<double>")


def inverted(df: DataFrame) -> DataFrame:
    r, t = E.inverse(E.elements(F.col("r"), 9), E.elements(F.col("t"), 3))
    return df.withColumn("sl_r", F.array(*r)).withColumn("t", F.array(*t)).withColumn("r", F.col("sl_r")).drop("sl_r")


def chained(df: DataFrame) -> DataFrame:
    """One transform r, t from rows (n, r, t): n orders the steps, the first is applied first. Steps are folded where they lie
    (`scan.folded`), so a chain may be of any length."""
    steps = df.select("n", F.concat("r", "t").alias("step"))
    done = scan.folded(steps, ["n"], "step", scan.RIGID)
    if done is None:
        raise ValueError("no transform to chain")
    return df.sparkSession.createDataFrame([(done[:9], done[9:])], "r array<double>, t array<double>")


def random_transforms(spark: SparkSession, n: int, seed: int, reach: float = 40.0) -> DataFrame:
    """Angles in [0, 2 pi), translations in [0, reach)."""
    u = [E.uniform(seed, k, F.col("id")) for k in range(6)]
    r = E.euler(*(v * (2 * np.pi) for v in u[:3]))
    return spark.range(n).select("id", F.array(*r).alias("r"), F.array(*(v * reach for v in u[3:])).alias("t"))


def with_bases(points: DataFrame, fld, radius: float = BALL_RADIUS, step: float = BALL_STEP) -> DataFrame:
    """id, x, y, z, bases (two of nine numbers, row by row), of the points that have any."""
    values, bounds = fld.evaluator(), np.array(fld.geometry.bounds)
    ship(points.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ball = dense.ball_grid(radius, step)
        for b in batches:
            made = []
            for p in b[["x", "y", "z"]].to_numpy(float):
                keep = ((p + ball >= 0) & (p + ball <= bounds)).all(1)
                two = dense.pca_bases(ball[keep], values(p + ball[keep]))
                made.append(None if two is None else [m.reshape(-1).tolist() for m in two])
            out = b.assign(bases=made)
            yield out[out["bases"].notna()]

    return dealt(points.select("id", "x", "y", "z")).mapInPandas(run, "id long, x double, y double, z double, bases array<array<double>>")


def candidates(matches: DataFrame, micro_bases: DataFrame, macro_bases: DataFrame) -> DataFrame:
    """Two transforms for each match (micro_id, macro_id): from the macro basis to either micro basis; t brings the points together."""
    side = lambda d, s: d.select(F.col("id").alias(f"{s}_id"), *(F.col(c).alias(f"{s}_{c}") for c in "xyz"), F.col("bases").alias(f"{s}_bases"))
    both = matches.join(side(micro_bases, "micro"), "micro_id").join(side(macro_bases, "macro"), "macro_id")
    first = E.elements(F.get("macro_bases", F.lit(0)), 9)
    options = []
    for k in range(2):
        r = E.matmul(first, E.transpose(E.elements(F.get("micro_bases", F.lit(k)), 9)))
        t = E.sub(E.xyz("macro_"), E.rotate(r, E.xyz("micro_")))
        options.append(F.struct(F.lit(k).alias("k"), F.array(*r).alias("r"), F.array(*t).alias("t")))
    out = both.withColumn("o", F.explode(F.array(*options)))
    return out.select((F.col("micro_id") * 2 + F.col("o.k")).alias("id"), F.col("micro_id").alias("match_id"), "o.r", "o.t")


def cross_covariance(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """h (nine sums, row by row), centroids m and n, and count of pairs with columns mx, my, mz (micro) and nx, ny, nz (macro)."""
    count = F.count("*")
    h = [(F.covar_pop(f"m{a}", f"n{b}") * count).alias(f"h{a}{b}") for a in "xyz" for b in "xyz"]
    return pairs.groupBy(*by).agg(*h, *(F.avg(f"{s}{c}").alias(f"c{s}{c}") for s in "mn" for c in "xyz"), count.alias("n_pairs"))


def refine(pairs: DataFrame, r: Sequence[float], t: Sequence[float], diagonal: float, tolerances: Sequence[float] = (0.10, 0.05, 0.025)) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares rounds over the pairs within ever smaller tolerances (shares of the diagonal); nine sums a round come to the driver."""
    r, t = np.array(r, float).reshape(3, 3), np.array(t, float)
    for share in tolerances:
        moved = E.apply_rigid(r.reshape(-1).tolist(), t.tolist(), E.xyz("m"))
        near = pairs.filter(E.distance(moved, E.xyz("n")) <= share * diagonal)
        s = cross_covariance(near).first()
        if s is None or s.n_pairs < 3:
            break
        h = np.array([[s[f"h{a}{b}"] for b in "xyz"] for a in "xyz"])
        new = dense.rotation_from(h, np.array([s[f"cm{c}"] for c in "xyz"]), np.array([s[f"cn{c}"] for c in "xyz"]))
        if new is None:
            break
        r, t = new
    return r, t
