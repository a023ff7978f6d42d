"""Ranks, cumulative counts and order statistics over whole tables without a single-task window.

A plain window over a whole set sorts it in one task. Here, values are first summed by (set, value), once; each set is cut at
quantile bounds of all values that take part into buckets, the more of them the more values there are, a window runs
within each bucket, and the buckets' totals, a few numbers for each set, are added on top. Results are exact whatever the bounds are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.shared import materialize

IN_BUCKET, IN_JOIN = 1 << 17, 1 << 19


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by..., value, cnt; nulls and NaN are left out."""
    v = F.col(value).cast("double")
    return df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("value")).agg(F.count("*").alias("cnt"))


def _bucketed(values: DataFrame, by: list[str], buckets: int) -> tuple[DataFrame, DataFrame]:
    """The value counts with their bucket, dealt by it; of each set and bucket, base (what lies in earlier ones) and n."""
    values = materialize(values, "value-counts")
    rows = values.count()
    buckets = max(buckets, -(-rows // IN_BUCKET))
    grid = [(k + 1) / buckets for k in range(buckets - 1)]
    cuts = values.groupBy(*by).agg(F.percentile_approx("value", grid, max(200, 4 * buckets)).alias("cuts"))
    keyed = _in_bucket(values, cuts, by, buckets)
    totals = keyed.groupBy(*by, "bucket").agg(F.sum("cnt").alias("total"))
    across = Window.partitionBy(*by).orderBy("bucket")
    base = totals.select(*by, "bucket", (F.sum("total").over(across) - F.col("total")).alias("base"), F.sum("total").over(Window.partitionBy(*by)).alias("n"))
    parts = max(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * rows // IN_BUCKET))
    return keyed.repartition(parts, *by, "bucket"), base


def _in_bucket(values: DataFrame, cuts: DataFrame, by: list[str], buckets: int) -> DataFrame:
    """bucket: how many cuts are smaller, looked up by runs of them first."""
    run = max(1, math.isqrt(buckets))
    ends = F.transform(F.sequence(F.lit(run), F.lit(max(run, (buckets - 1) // run * run)), F.lit(run)), lambda k: F.get("cuts", k - 1))
    cuts = cuts.withColumn("ends", ends)
    keyed = values.join(cuts, by) if by else values.crossJoin(F.broadcast(cuts))
    smaller = lambda c: c < F.col("value")
    skipped = F.size(F.filter("ends", smaller)) * run
    return keyed.withColumn("bucket", skipped + F.size(F.filter(F.slice("cuts", skipped + 1, F.lit(run)), smaller))).drop("cuts", "ends")


def cumulative(counts: DataFrame, by: Sequence[str], buckets: int = 64) -> DataFrame:
    """Adds below (count of smaller values), upto (of values up to it) and n (of the set) to the value counts."""
    by = list(by)
    keyed, base = _bucketed(counts, by, buckets)
    within = F.sum("cnt").over(Window.partitionBy(*by, "bucket").orderBy("value"))
    out = keyed.withColumn("inner", within).join(base, [*by, "bucket"])
    upto = F.col("base") + F.col("inner")
    return out.select(*by, "value", "cnt", (upto - F.col("cnt")).alias("below"), upto.alias("upto"), "n")


def _looked_up(df: DataFrame, table: DataFrame, by: list[str], value: str) -> DataFrame:
    """df with the ranks of its values from the table. Where the table is no small one, tasks get so many rows and no more, however few bytes these are."""
    df = df.withColumn("sl_v", F.col(value).cast("double"))
    table, keys = materialize(table, "value-ranks"), [*by, "sl_v"]
    if table.count() > 8 * IN_BUCKET:
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // IN_JOIN))
        df, table = df.repartition(parts, *keys), table.repartition(parts, *keys)
    return df.join(table, keys, "left")


def ecdf(df: DataFrame, by: Sequence[str], value: str, out: str = "ecdf") -> DataFrame:
    """df with the mid-rank (below + upto) / 2n of each value in its set; null and NaN values get null."""
    by = list(by)
    ranks = cumulative(value_counts(df, by, value), by).select(*by, F.col("value").alias("sl_v"), ((F.col("below") + F.col("upto")) / (2.0 * F.col("n"))).alias(out))
    return _looked_up(df, ranks, by, value).select(*df.columns, out)


def ecdf_of(df: DataFrame, reference: DataFrame, by: Sequence[str], value: str, out: str = "ecdf", buckets: int = 64) -> DataFrame:
    """Mid-ranks in the reference set of values that need not be among it; null for a set without reference."""
    by = list(by)
    asked = df.select(*by, F.col(value).cast("double").alias("value")).filter("value IS NOT NULL AND NOT isnan(value)")
    both = value_counts(reference, by, value).unionByName(asked.withColumn("cnt", F.lit(0).cast("long")))
    # One row for a value, whichever side it is of; those asked for have no count of their own.
    each = both.groupBy(*by, "value").agg(F.sum("cnt").alias("cnt"), F.bool_or(F.col("cnt") == 0).alias("asked"))
    keyed, base = _bucketed(each, by, buckets)
    inner = F.sum("cnt").over(Window.partitionBy(*by, "bucket").orderBy("value"))
    placed = keyed.withColumn("inner", inner).filter("asked").join(base, [*by, "bucket"]).filter("n > 0")
    rank = (2 * (F.col("base") + F.col("inner")) - F.col("cnt")) / 2.0 / F.col("n")
    table = placed.select(*by, F.col("value").alias("sl_v"), rank.alias(out))
    return _looked_up(df, table, by, value).select(*df.columns, out)


def order_statistics(df: DataFrame, by: Sequence[str], value: str, quantiles: Sequence[float], of_last: bool = True) -> DataFrame:
    """by..., q, value: the value at place trunc(q (n - 1)) of the sorted set, from 0; with of_last False, min(trunc(q n), n - 1)."""
    by = list(by)
    ranks = cumulative(value_counts(df, by, value), by)
    asked = ranks.withColumn("q", F.explode(F.array(*(F.lit(float(q)) for q in quantiles))))
    n = F.col("n")
    place = (F.col("q") * (n - 1)).cast("long") if of_last else F.least((F.col("q") * n).cast("long"), n - 1)
    return asked.filter((F.col("below") <= place) & (place < F.col("upto"))).select(*by, "q", "value")
