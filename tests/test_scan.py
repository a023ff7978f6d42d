"""Ordered folds and scans against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.operators import scan


def test_row_numbers_of_a_key_over_many_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "hot", "hot", "hot", "a", "b"]), rng.choice([None, *range(40)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, turn int, i int")
    got = {r["i"]: r["place"] for r in scan.numbered(df, [F.asc_nulls_first("k"), F.asc_nulls_first("turn"), "i"], ["k"], partitions=13).collect()}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (-1 if r[1] is None else r[1], r[2]))
        assert [got[r[2]] for r in own] == list(range(len(own)))


@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_running_sums(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, *range(9)])) for i in range(n)]
    got = dict(scan.running_sum(spark.createDataFrame(rows, "i int, v int"), ["i"], F.col("v"), partitions=7).select("i", "upto").collect())
    total = 0
    for i, v in rows:
        total += v or 0
        assert got[i] == total


def test_an_order_that_matters_is_kept(spark):
    rng = np.random.default_rng(1)
    steps, r, t = [], np.eye(3), np.zeros(3)
    for i in range(700):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        s = rng.normal(size=3)
        steps.append((i, [*q.ravel().tolist(), *s.tolist()]))
        r, t = q @ r, q @ t + s
    rng.shuffle(steps)
    df = spark.createDataFrame([(int(i), s) for i, s in steps], "n int, s array<double>").repartition(5)
    assert np.allclose(scan.folded(df, ["n"], "s", scan.RIGID, partitions=9), [*r.ravel(), *t])
    last = scan.scanned(df, ["n"], "s", scan.RIGID, partitions=9).filter("n = 699").head()["s"]
    assert np.allclose(last, [*r.ravel(), *t])
    assert scan.folded(df.filter("n < 0"), ["n"], "s", scan.RIGID) is None


def test_segments_within_one_array():
    v = np.arange(1, 11)[:, None].astype(np.int64)
    starts = np.isin(np.arange(10), [0, 3, 4, 9])
    want, total = [], 0
    for x, s in zip(v[:, 0], starts):
        total = x if s else total + x
        want.append(total)
    assert scan.running(v, starts, np.add)[:, 0].tolist() == want


@pytest.mark.parametrize("name", ["transform_chain", "positional_match", "cell_lines", "histogram_cdf", "cdf_gap_interpolated"])
def test_no_window_over_a_whole_set(spark, name):
    from strataline.plans import queries

    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "Window" not in df._jdf.queryExecution().toString()


def test_an_empty_chain_is_an_error(spark):
    from strataline.operators import transforms

    with pytest.raises(ValueError):
        transforms.chained(spark.createDataFrame([], "n int, r array<double>, t array<double>"))
