"""Similarity joins between two sets of feature vectors.

Nearest neighbours come from `neighbours.knn`, exact by pivots, and least sums of ranks from `rank_sums`. Sets are (id, features); ids are
distinct within a set.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions import exprs as E
from strataline.operators import rank_sums, ranking, scan
from strataline.operators.neighbours import knn


def top_fraction(matches: DataFrame, fraction: float, best: str = "similarity", falling: bool = True, ids: tuple[str, ...] = ("micro_id",), up: bool = False, heap: int = 100_000) -> DataFrame:
    """The best trunc(n * fraction) rows (ceil with up), ties to the smaller ids.

    Few rows are a bounded top-k; beyond `heap`, the value at the cut comes from bucketed ranks and only its ties are sorted.
    """
    if fraction >= 1:
        return matches
    # A product that misses a whole number by rounding is that number.
    exact = matches.count() * fraction
    exact = round(exact) if abs(exact - round(exact)) < 1e-9 else exact
    keep = math.ceil(exact) if up else int(exact)
    if keep <= heap:
        return matches.orderBy(F.desc(best) if falling else F.col(best), *ids).limit(keep)
    key = -F.col(best) if falling else F.col(best)
    ranks = ranking.cumulative(ranking.value_counts(matches.select(key.alias("k")), [], "k"), [])
    cut = ranks.filter((F.col("below") < keep) & (F.col("upto") >= keep)).first()
    return matches.filter(key < cut.value).unionByName(matches.filter(key == cut.value).orderBy(*ids).limit(keep - cut.below))


def euclid_cosine(micro: DataFrame, macro: DataFrame, fraction: float = 0.1) -> DataFrame:
    """The nearest macro vector by distance, scored by cosine; the best-scored fraction."""
    near = knn(micro, macro, 1).select("micro_id", "macro_id")
    pairs = near.join(micro.select(F.col("id").alias("micro_id"), F.col("features").alias("a")), "micro_id").join(macro.select(F.col("id").alias("macro_id"), F.col("features").alias("b")), "macro_id")
    return top_fraction(pairs.select("micro_id", "macro_id", E.cosine_score(F.col("a"), F.col("b")).alias("similarity")), fraction)


def ratio_test(micro: DataFrame, macro: DataFrame, threshold: float = 0.8, fraction: float = 1.0) -> DataFrame:
    """Keep a nearest neighbour whose distance is at most `threshold` of the second's; similarity 1 - ratio. A single neighbour stays, a second at distance 0 drops the match."""
    two = knn(micro, macro, 2).groupBy("micro_id").agg(F.min(F.when(F.col("n") == 1, F.col("macro_id"))).alias("macro_id"), F.min(F.when(F.col("n") == 1, F.col("score"))).alias("d1"), F.min(F.when(F.col("n") == 2, F.col("score"))).alias("d2"))
    ratio = F.when(F.col("d2").isNull(), F.lit(0.0)).when(F.col("d2") > 0, F.col("d1") / F.col("d2"))
    kept = two.withColumn("ratio", ratio).filter(F.col("ratio") <= threshold).select("micro_id", "macro_id", (1 - F.col("ratio")).alias("similarity"))
    return top_fraction(kept, fraction)


def position(micro: DataFrame, macro: DataFrame, cutoff: float = 1.4, cap: int = 100, fraction: float = 1.0, same_set: bool = False) -> DataFrame:
    """How far apart in space a vector's neighbours lie: matches are best where they lie together.

    Neighbours are taken nearest first until the running population variance of their distances reaches the cutoff (from
    the second on) or `cap` are taken; the score is the mean squared distance of their places from the centroid, and the nearest is the match. macro
    has x, y, z. Columns: micro_id, macro_id, taken, similarity (minus the score); the ceil(n * fraction) lowest scores.
    """
    near = knn(micro, macro, cap, same_set=same_set)
    run = Window.partitionBy("micro_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = (F.count("*").over(run) > 1) & (F.var_pop("score").over(run) >= cutoff)
    taken = near.withColumn("hit", hit.cast("int")).withColumn("stop", F.max("hit").over(run)).filter("stop = 0")
    placed = taken.join(macro.select(F.col("id").alias("macro_id"), "x", "y", "z"), "macro_id")
    spread = F.var_pop("x") + F.var_pop("y") + F.var_pop("z")
    out = placed.groupBy("micro_id").agg(F.min_by("macro_id", "n").alias("macro_id"), F.count("*").alias("taken"), (-spread).alias("similarity"))
    return top_fraction(out, fraction, up=True)


def naive_cosine(micro: DataFrame, macro: DataFrame, fraction: float = 0.1) -> DataFrame:
    """The largest cosine for each vector of the smaller set (micro if equal); zero vectors have none."""
    swap = macro.count() < micro.count()
    left, right = (macro, micro) if swap else (micro, macro)
    fine = lambda d: d.filter(E.magnitude(F.col("features")) > 0)
    best = knn(fine(left), fine(right), 1, kind="cosine")
    a, b = ("macro_id", "micro_id") if swap else ("micro_id", "macro_id")
    out = best.select(F.col("micro_id").alias(a), F.col("macro_id").alias(b), F.col("score").alias("similarity")).select("micro_id", "macro_id", "similarity")
    return top_fraction(out, fraction, ids=("micro_id", "macro_id"))


def transformed_distance(micro: DataFrame, macro: DataFrame, r: list[float], t: list[float], fraction: float = 1.0) -> DataFrame:
    """The macro point nearest to R p + t for each micro point (x, y, z); similarity is minus the distance. For tests with a known transform."""
    moved = micro.select("id", F.array(*E.apply_rigid(r, t, E.xyz())).alias("features"))
    best = knn(moved, macro.select("id", F.array("x", "y", "z").alias("features")), 1)
    return top_fraction(best.select("micro_id", "macro_id", (-F.col("score")).alias("similarity")), fraction)


def rank_sum(micro: DataFrame, macro: DataFrame, fraction: float = 1.0, keep: str = "best") -> DataFrame:
    """Per dimension, macro vectors ranked by absolute difference (ties: smaller id); the least sum of ranks wins.

    similarity is the sum of ranks, from 0. keep `best` takes the lowest sums, `worst` the highest, as an older form did.
    """
    return top_fraction(rank_sums.least_rank_sums(micro, macro), fraction, falling=keep != "best")


def positional(micro: DataFrame, macro: DataFrame, fraction: float, similarity: float = 100.0) -> DataFrame:
    """The first trunc(n * fraction) rows of both sets by id, n the size of the smaller, paired in order."""
    n = int(min(micro.count(), macro.count()) * fraction)
    nth = lambda d, name: scan.numbered(d.select(F.col("id").alias(name)), [name], out="k").filter(F.col("k") < n)
    return nth(micro, "micro_id").join(nth(macro, "macro_id"), "k").select("micro_id", "macro_id", F.lit(similarity).alias("similarity"))
