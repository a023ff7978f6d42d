"""Batches of alignments with known answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cases(groups: DataFrame, tests: DataFrame) -> DataFrame:
    """groups (macro, ...) with their tests (macro, test, ...); a group without a test is an error."""
    empty = groups.join(tests, "macro", "left_anti")
    missing = empty.limit(1).collect()
    if missing:
        raise ValueError(f"no test for {missing[0]['macro']}")
    return groups.join(tests, "macro")


def total_tests(tests: DataFrame) -> DataFrame:
    return tests.groupBy("macro").agg(F.count("*").alias("tests"))


def finished(results: DataFrame) -> DataFrame:
    """Results (macro, test, relative_distance) that are not NaN."""
    d = F.col("relative_distance")
    return results.filter(d.isNotNull() & ~F.isnan(d))


def summary(results: DataFrame) -> DataFrame:
    """For each macro: tests, those finished, and their mean, least and largest relative distance (NaN if none finished)."""
    d = F.col("relative_distance")
    good = F.when(d.isNotNull() & ~F.isnan(d), d)
    out = results.groupBy("macro").agg(F.count("*").alias("tests"), F.count(good).alias("finished"), F.avg(good).alias("mean"), F.min(good).alias("least"), F.max(good).alias("largest"))
    nan = F.lit(float("nan"))
    return out.select("macro", "tests", "finished", *(F.coalesce(c, nan).alias(c) for c in ("mean", "least", "largest")))
