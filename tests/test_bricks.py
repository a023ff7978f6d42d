import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.functions import dense
from strataline.operators import sampling
from strataline.sources.bricks import BORDER, REACH, BrickField, z_number
from strataline.sources.fields import GridField
from strataline.types import Geometry

G = Geometry((0.5, 0.25, 1.0), (21, 18, 5))


def volume(spark, g=G, seed=0):
    v = np.random.default_rng(seed).integers(0, 60000, g.dims[::-1])
    z, y, x = np.indices(v.shape)
    rows = np.stack([x.ravel(), y.ravel(), z.ravel(), v.ravel()], 1).tolist()
    return v, spark.createDataFrame(rows, "x int, y int, z int, v int")


def places(spark, g=G, n=300, seed=1):
    """Beyond the box too, on samples, on borders, twice, with a null."""
    rng = np.random.default_rng(seed)
    p = rng.uniform(-0.2, 1.2, (n, 3)) * g.bounds
    p[: n // 3] = np.rint(np.clip(p[: n // 3], 0, g.bounds) / g.spacing) * g.spacing
    p[1] = p[0]
    rows = [(i, *map(float, q), "kept") for i, q in enumerate(p)] + [(n, None, 1.0, 1.0, "null")]
    return p, spark.createDataFrame(rows, "id long, x double, y double, z double, note string")


def least_squares(v, g, q):
    near = np.clip(np.floor(q / np.array(g.spacing) + 0.5), 0, np.array(g.dims) - 1).astype(int)
    box = [np.arange(max(0, n - REACH), min(d, n + REACH + 1)) for n, d in zip(near, g.dims)]
    at = np.stack(np.meshgrid(*box, indexing="ij"), -1).reshape(-1, 3)
    u = (at - near) * np.array(g.spacing)
    d = q - near * np.array(g.spacing)
    w = np.sqrt(np.exp((math.log(BORDER) / 2 / np.array(g.spacing) * (u - d) ** 2).sum(1)))
    a = np.linalg.lstsq(dense.quadric_terms(u) * w[:, None], v[at[:, 2], at[:, 1], at[:, 0]] * w, rcond=None)[0]
    return dense.gradients(a[None], d[None])[0]


@pytest.mark.parametrize("side", [4, 16])
def test_bricks_interpolate_as_corners_do(spark, side):
    _, voxels = volume(spark)
    p, points = places(spark)
    got = {r.id: r.value for r in BrickField.of(G, voxels, side).attach(points).collect()}
    want = {r.id: r.value for r in GridField(G, voxels).attach(points).collect()}
    assert got[len(p)] is None and len(got) == len(p) + 1
    assert [got[i] for i in range(len(p))] == pytest.approx([want[i] for i in range(len(p))])


@pytest.mark.parametrize("side", [4, 16])
def test_bricks_have_the_variance_of_27_values(spark, side):
    _, voxels = volume(spark)
    p, points = places(spark)
    known = points.filter("x IS NOT NULL")
    bricks = BrickField.of(G, voxels, side)
    got = {r.id: (r.variance, r.note) for r in sampling.with_variance(known, bricks).collect()}
    want = {r.id: r.variance for r in sampling.with_variance(known, GridField(G, voxels)).collect()}
    assert got.keys() == want.keys() and len(got) > 50
    assert all(got[i] == (pytest.approx(want[i]), "kept") for i in want)


def test_one_shuffle_for_points(spark):
    _, voxels = volume(spark)
    plan = BrickField.of(G, voxels).box_variance(places(spark)[1])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("side", [4, 16])
def test_slopes_are_those_of_least_squares(spark, side):
    v, voxels = volume(spark)
    rows = BrickField.of(G, voxels, side).slopes().collect()
    assert len({(r.x, r.y, r.z) for r in rows}) == len(rows) == G.count
    for r in rows[:: 7 if side == 4 else 11]:
        want = least_squares(v, G, np.array([r.x, r.y, r.z]) * G.spacing)
        assert np.allclose([r.gx, r.gy, r.gz], want, rtol=1e-6, atol=1e-4)


def test_slopes_at_points(spark):
    v, voxels = volume(spark)
    p, points = places(spark, n=120)
    got = {r.id: r for r in BrickField.of(G, voxels, 8).slopes_at(points).collect()}
    assert got[len(p)].gx is None and got[0].note == "kept"
    for i, q in enumerate(p):
        if ((q >= 0) & (q <= G.bounds)).all():
            assert np.allclose([got[i].gx, got[i].gy, got[i].gz], least_squares(v, G, q), rtol=1e-6, atol=1e-4)


def test_flat_and_thin_volumes(spark):
    g = Geometry((1.0, 1.0, 1.0), (9, 2, 1))
    rows = spark.range(18).select((F.col("id") % 9).cast("int").alias("x"), (F.col("id") / 9).cast("int").alias("y"), F.lit(0).alias("z"), F.lit(7).alias("v"))
    assert {(r.gx, r.gy, r.gz) for r in BrickField.of(g, rows).slopes().collect()} == {(0.0, 0.0, 0.0)}
    sloped = rows.withColumn("v", F.col("x") * F.col("x") + 5 * F.col("y"))
    for r in BrickField.of(g, sloped).slopes().collect():
        assert (r.gx, r.gy, r.gz) == pytest.approx((2 * r.x, 5, 0), abs=1e-6)
    assert BrickField.of(g, rows.limit(0)).attach(spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")).collect()[0].value is None


def test_z_numbers(spark):
    n = [(5, 3, 1), (0, 0, 0), (2097151, 2097151, 2097151), (1 << 20, 0, 1)]
    got = [r.z for r in spark.createDataFrame(n, "a int, b int, c int").select(z_number([F.col(c) for c in "abc"]).alias("z")).collect()]
    assert got == [sum((v >> b & 1) << (3 * b + a) for a, v in enumerate(t) for b in range(21)) for t in n]
