"""Normalisers over columns and over arrays of features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions import exprs as E
from strataline.operators import ranking


def finite_features(df: DataFrame, column: str = "features") -> DataFrame:
    """Rows all of whose features are finite."""
    return df.filter(E.all_finite(F.col(column)))


def weight_features(df: DataFrame, weights: Sequence[float], column: str = "features") -> DataFrame:
    return df.withColumn(column, E.weighted(F.col(column), weights))


def _per_set(df: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """One row of statistics for each set; without sets, a single row is sent to every task."""
    return df.join(stats, by, "left") if by else df.crossJoin(F.broadcast(stats))


def zscore(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "z") -> DataFrame:
    """(v - mean) / population deviation of the set; 0 where the deviation is 0."""
    by = list(by)
    stats = df.groupBy(*by).agg(F.avg(value).alias("sl_mean"), F.stddev_pop(value).alias("sl_dev"))
    z = F.when(F.col("sl_dev") == 0, F.lit(0.0)).otherwise((F.col(value) - F.col("sl_mean")) / F.col("sl_dev"))
    return _per_set(df, stats, by).withColumn(out, z).select(*df.columns, out)


def min_max(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "scaled") -> DataFrame:
    by = list(by)
    stats = df.groupBy(*by).agg(F.min(value).alias("sl_lo"), F.max(value).alias("sl_hi"))
    return _per_set(df, stats, by).withColumn(out, E.min_max(F.col(value), F.col("sl_lo"), F.col("sl_hi"))).select(*df.columns, out)


def contrast_stretch(df: DataFrame, value: str, low: float = 0.05, high: float = 0.70, out: str = "stretched") -> DataFrame:
    """Clamped to 0..1 between two order statistics of the table, at trunc(n q)."""
    at = ranking.order_statistics(df, [], value, [low, high], of_last=False)
    ends = at.agg(F.max(F.when(F.col("q") == low, F.col("value"))).alias("sl_lo"), F.max(F.when(F.col("q") == high, F.col("value"))).alias("sl_hi"))
    scaled = E.clamp(E.min_max(F.col(value), F.col("sl_lo"), F.col("sl_hi")), 0.0, 1.0)
    return df.crossJoin(F.broadcast(ends)).withColumn(out, scaled).select(*df.columns, out)


def rank_features(df: DataFrame, n_features: int, set_col: str = "set", column: str = "features", id_col: str = "id") -> DataFrame:
    """Each feature becomes its mid-rank within its set; ids are distinct within a set."""
    long = df.select(set_col, id_col, F.posexplode(column).alias("feature", "v"))
    ranked = ranking.ecdf(long, [set_col, "feature"], "v")
    back = ranked.groupBy(set_col, id_col).agg(*(F.max(F.when(F.col("feature") == k, F.col("ecdf"))).alias(f"f{k}") for k in range(n_features)))
    return df.drop(column).join(back, [set_col, id_col]).withColumn(column, F.array(*(f"f{k}" for k in range(n_features)))).select(*df.columns)


def zscore_features(df: DataFrame, n_features: int, reference: DataFrame | None = None, column: str = "features") -> DataFrame:
    """Each feature by the mean and population deviation of the reference rows (df itself if none is given)."""
    source = df if reference is None else reference
    aggs = [a for k in range(n_features) for a in (F.avg(F.get(column, F.lit(k))).alias(f"m{k}"), F.stddev_pop(F.get(column, F.lit(k))).alias(f"s{k}"))]
    stats = source.agg(*aggs)
    z = F.array(*(F.when(F.col(f"s{k}") == 0, F.lit(0.0)).otherwise((F.get(column, F.lit(k)) - F.col(f"m{k}")) / F.col(f"s{k}")) for k in range(n_features)))
    return df.crossJoin(F.broadcast(stats)).withColumn(column, z).select(*df.columns)
