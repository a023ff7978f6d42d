"""Histograms of integer values and their distribution function."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.operators import scan


def histogram(df: DataFrame, value: str) -> DataFrame:
    """value int, cnt."""
    return df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("int").alias("value")).agg(F.count("*").alias("cnt"))


def cdf(hist: DataFrame) -> DataFrame:
    """Every integer from the least to the largest value: value, cnt, cdf.

    An empty bin between two filled ones lies on the line between the running count before it and the one after; the
    table has as many rows as the value range, not as the data. Filled bins are numbered and summed up by one ordered
    scan; each then meets the next one and fills the gap between them.
    """
    counted = hist.filter("cnt > 0").select("value", "cnt", F.array(F.lit(1).cast("long"), F.col("cnt").cast("long")).alias("sum"))
    bins = scan.scanned(counted, ["value"], "sum", scan.sums(2)).select("value", "cnt", F.col("sum")[0].alias("k"), F.col("sum")[1].alias("cum"))
    ahead = bins.select((F.col("k") - 1).alias("k"), F.col("value").alias("next"), F.col("cnt").alias("more"))
    total = bins.agg(F.max("cum").alias("n"))
    both = bins.join(ahead, "k", "left").crossJoin(F.broadcast(total))
    filled = both.withColumn("at", F.explode(F.sequence("value", F.coalesce(F.col("next") - 1, F.col("value")))))
    own, share = F.col("at") == F.col("value"), (F.col("at") - F.col("value")) / F.nullif(F.col("next") - F.col("value"), F.lit(0))
    share = F.when(own, F.col("cum") / F.col("n")).otherwise((F.col("cum") + share * F.col("more")) / F.col("n"))
    return filled.select(F.col("at").alias("value"), F.when(own, F.col("cnt")).otherwise(F.lit(0).cast("long")).alias("cnt"), share.alias("cdf"))


def lookup(df: DataFrame, value: str, table: DataFrame, out: str = "percentile") -> DataFrame:
    """cdf at a real value, linear between integers; 0 below and 1 above the table."""
    ends = table.agg(F.min("value").alias("sl_lo"), F.max("value").alias("sl_hi"))
    v = F.col(value)
    placed = df.crossJoin(F.broadcast(ends)).withColumn("sl_f", F.floor(v).cast("int")).withColumn("sl_c", F.ceil(v).cast("int"))
    low = table.select(F.col("value").alias("sl_f"), F.col("cdf").alias("sl_a"))
    high = table.select(F.col("value").alias("sl_c"), F.col("cdf").alias("sl_b"))
    both = placed.join(low, "sl_f", "left").join(high, "sl_c", "left")
    between = F.col("sl_a") + (v - F.col("sl_f")) * (F.col("sl_b") - F.col("sl_a"))
    return both.withColumn(out, F.when(v < F.col("sl_lo"), F.lit(0.0)).when(v > F.col("sl_hi"), F.lit(1.0)).otherwise(between)).select(*df.columns, out)
