import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataline.functions import exprs as E
from strataline.functions import metric
from strataline.operators import density, diagnostics, experiment, features, histogram, matching, neighbours, normalize, rank_sums, ranking, sampling, slices, tiles, transforms
from strataline.plans.align import STAGES, Config, align, corner_error, identity, rotation_error
from strataline.plans.queries import QUERIES, headless_pair
from strataline.sources import metaimage, mocks, texts, volumes
from strataline.sources.fields import GridField
from strataline.types import Geometry


def vectors(spark, m, first=0):
    rows = [(first + i, [float(x) for x in v]) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    return df.select("*", *(F.get("features", F.lit(k)).alias(c) for k, c in enumerate("xyz")))


def test_ecdf_with_ties_nulls_and_one_set(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", None), ("b", float("nan")), ("b", 2.0)], "s string, v double")
    got = {(r.s, str(r.v)): r.ecdf for r in ranking.ecdf(df, ["s"], "v").collect()}
    assert got[("a", "1.0")] == pytest.approx(1 / 3) and got[("a", "3.0")] == pytest.approx(5 / 6) and got[("b", "2.0")] == 0.5
    assert got[("a", "None")] is None and got[("b", "nan")] is None


def test_order_statistics_match_sorting(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(0, 50, 500).astype(float)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = {r.q: r.value for r in ranking.order_statistics(df, [], "v", [0.0, 0.3, 0.999, 1.0]).collect()}
    s = np.sort(v)
    assert got == {q: s[int(q * 499)] for q in (0.0, 0.3, 0.999, 1.0)}


def test_rank_features_by_set(spark):
    df = vectors(spark, [[1, 5, 0], [2, 5, 0], [3, 6, 0]]).select(F.lit("a").alias("set"), "id", "features")
    got = {r.id: r.features for r in normalize.rank_features(df, 3).collect()}
    assert got[0] == pytest.approx([1 / 6, 1 / 3, 0.5]) and got[2] == pytest.approx([5 / 6, 5 / 6, 0.5])


def test_zscore_features_of_a_constant(spark):
    df = vectors(spark, [[1, 4, 2], [3, 4, 2]]).select("id", "features")
    assert [r.features for r in normalize.zscore_features(df, 3).orderBy("id").collect()] == [[-1.0, 0.0, 0.0], [1.0, 0.0, 0.0]]


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4, (60, 5)).astype(float), rng.integers(0, 4, (90, 5)).astype(float)
    got = {(r.micro_id, r.n): (r.macro_id, r.score) for r in matching.knn(vectors(spark, a), vectors(spark, b, 1000), 4).collect()}
    for i, v in enumerate(a):
        d = np.sqrt(((b - v) ** 2).sum(1))
        for n, j in enumerate(np.lexsort((np.arange(90), d))[:4]):
            assert got[i, n + 1] == (1000 + j, pytest.approx(d[j]))


def test_knn_of_a_set_with_itself_and_of_none(spark):
    a = vectors(spark, [[0, 0, 0], [1, 0, 0], [5, 0, 0]])
    assert {(r.micro_id, r.macro_id) for r in matching.knn(a, a, 1, same_set=True).collect()} == {(0, 1), (1, 0), (2, 1)}
    assert matching.knn(a, a.filter("false"), 2).count() == 0


def test_ratio_test_edges(spark):
    micro = vectors(spark, [[0, 0, 0]])
    assert matching.ratio_test(micro, vectors(spark, [[1, 0, 0]], 7), 0.5).first().similarity == 1.0
    assert matching.ratio_test(micro, vectors(spark, [[0, 0, 0], [0, 0, 0]], 7), 0.5).count() == 0


def test_top_fraction_counts(spark):
    df = spark.range(10).select(F.col("id").alias("micro_id"), F.col("id").cast("double").alias("similarity"))
    assert matching.top_fraction(df, 0.25).count() == 2 and matching.top_fraction(df, 0.25, up=True).count() == 3
    assert matching.top_fraction(df, 0.3, up=True).count() == 3
    ties = df.withColumn("similarity", F.floor(F.col("similarity") / 4).cast("double"))
    for falling in (True, False):
        few, many = ({r.micro_id for r in matching.top_fraction(ties, 0.6, falling=falling, heap=h).collect()} for h in (100, 0))
        assert few == many and len(few) == 6


def test_fake_match_recovers_planted_pairs(spark):
    g = Geometry((1.0,) * 3, (20, 20, 20))
    r, t = mocks.turn(0.2, 0.1, 0.4).reshape(-1).tolist(), [3.0, 1.0, 2.0]
    micro, macro = sampling.paired_samples(spark, g, g, r, t, shared=40, total=60, jitter=0.0)
    got = {x.micro_id: x.macro_id for x in matching.transformed_distance(micro, macro, r, t).collect()}
    assert all(got[i] == i for i in range(40)) and len(got) == 60


def test_naive_cosine_takes_the_smaller_side(spark):
    a, b = vectors(spark, [[1, 0, 0], [0, 1, 0], [0, 0, 0]]), vectors(spark, [[0, 2, 0], [5, 0.1, 0]], 10)
    got = {(r.micro_id, r.macro_id) for r in matching.naive_cosine(a, b, 1.0).collect()}
    assert got == {(1, 10), (0, 11)}


def test_cosine_score_edges(spark):
    row = spark.sql("SELECT array(1D, 0D) a, array(-1D, 0D) b, array(0D, 0D) z, array(1D) s")
    c = lambda x, y: E.cosine_score(F.col(x), F.col(y))
    got = row.select(c("a", "a"), c("a", "b"), c("a", "z"), c("a", "s")).first()
    assert got[0] == 100 and got[1] == 0 and math.isnan(got[2]) and got[3] == 0


def test_rigid_algebra(spark):
    t = transforms.random_transforms(spark, 20, 3)
    back = t.join(transforms.inverted(t).select("id", F.col("r").alias("ri"), F.col("t").alias("ti")), "id")
    r, s = E.compose((E.elements(F.col("r"), 9), E.elements(F.col("t"), 3)), (E.elements(F.col("ri"), 9), E.elements(F.col("ti"), 3)))
    for row in back.select(F.array(*r), F.array(*s)).collect():
        assert np.allclose(row[0], np.eye(3).reshape(-1)) and np.allclose(row[1], 0, atol=1e-9)
    for row in t.collect():
        assert metaimage.is_rotation(row.r)


def test_chain_applies_the_first_first(spark):
    turn, move = mocks.turn(0, 0, math.pi / 2).reshape(-1).tolist(), np.eye(3).reshape(-1).tolist()
    steps = spark.createDataFrame([(1, turn, [0.0] * 3), (0, move, [1.0, 0.0, 0.0])], "n int, r array<double>, t array<double>")
    row = transforms.chained(steps).first()
    assert np.allclose(np.array(row.r).reshape(3, 3) @ [0, 0, 0] + row.t, [0, 1, 0])


def test_refine_improves_a_rough_transform(spark):
    rng = np.random.default_rng(5)
    p, r, t = rng.uniform(0, 10, (80, 3)), mocks.turn(0.3, 0.1, -0.2), np.array([1.0, 2, 0.5])
    q = p @ r.T + t
    q[60:] = rng.uniform(0, 10, (20, 3))
    pairs = spark.createDataFrame([tuple(map(float, (*a, *b))) for a, b in zip(p, q)], ", ".join(f"{s}{c} double" for s in "mn" for c in "xyz"))
    got = transforms.refine(pairs, mocks.turn(0.33, 0.08, -0.22).reshape(-1), t + 0.2, 17.0)
    assert np.abs(got[0] - r).max() < 0.02 and np.abs(got[1] - t).max() < 0.2


@pytest.mark.parametrize("relative", [False, True])
def test_density_against_all_pairs(spark, relative):
    g = Geometry((0.5, 0.4, 0.25), (9, 11, 13))
    rows = transforms.random_transforms(spark, 30, 9, 1.5).withColumn("r", F.when(F.col("id") < 20, F.array(*E.euler(*(E.uniform(1, k, F.col("id")) * 0.2 for k in range(3))))).otherwise(F.col("r"))).collect()
    df = spark.createDataFrame(rows, "id long, r array<double>, t array<double>")
    v = np.array([[i * 0.5, j * 0.4, k * 0.25] for i, j, k in itertools.product(range(9), range(11), range(13))])
    moved = [v @ np.array(x.r).reshape(3, 3).T + x.t for x in rows]
    spread = 0.002 if not relative else 40.0
    radius = math.sqrt(math.log(0.1) / -spread)
    want = []
    for a in moved:
        d = np.array([math.sqrt(((a - b) ** 2).sum() / (len(v) * g.diagonal**2 if relative else 1)) for b in moved])
        want.append(np.exp(-spread * d[d <= radius] ** 2).sum())
    got = {r.id: r.density for r in density.densities(df, g, spread, relative=relative).collect()}
    assert [got[i] for i in range(30)] == pytest.approx(want, abs=1e-6)
    assert density.vote(df, g, spread, relative=relative).first().id == int(np.argmax(want))


@pytest.mark.parametrize("kind", ["euclid", "cosine"])
@pytest.mark.parametrize("shape", ["clusters", "spread", "copies"])
def test_neighbours_by_pivots(spark, kind, shape, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST_BLOCK", 16)
    rng = np.random.default_rng(7)
    n, d, k = 1500, 6, 3
    centres = rng.normal(size=(30, d)) * 10
    v = {"clusters": centres[rng.integers(0, 30, n)] + 0.1 * rng.normal(size=(n, d)), "spread": rng.normal(size=(n, d)), "copies": np.round(rng.normal(size=(n, d)))}[shape]
    v[: n // 3] = v[0] if shape == "copies" else v[: n // 3]
    q = v[::5] + (0.01 if shape == "clusters" else 0.0)
    sets = [spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(-1, None), (-2, [float("nan")] * d), (-3, [])], "id long, features array<double>") for m in (q, v)]
    work = {}
    got = {}
    for r in neighbours.knn(*sets, k, kind, work=work).collect():
        got.setdefault(r.micro_id, {})[r.n] = (r.macro_id, r.score)
    for i, x in enumerate(q):
        d2 = np.sqrt(((v - x) ** 2).sum(1))
        norms = np.linalg.norm(v, axis=1) * np.linalg.norm(x)
        cos = np.maximum(0, 100 * np.divide(v @ x, norms, out=np.zeros(n), where=norms > 0))
        s = d2 if kind == "euclid" else cos
        want = np.sort(s)[:k] if kind == "euclid" else -np.sort(-s)[:k]
        assert [got[i][j + 1][1] for j in range(k)] == pytest.approx(want, abs=1e-6)
        if kind == "euclid":
            order = np.lexsort((np.arange(n), d2))[:k]
            assert [got[i][j + 1][0] for j in range(k)] == order.tolist()
    if shape == "clusters":
        assert work["met"] <= work["all"] / 5
    assert neighbours.knn(sets[0], sets[1].filter("false"), k, kind).count() == 0


@pytest.mark.parametrize("shape, fences", [("spread", 4096), ("copies", 4096), ("spread", 40), ("copies", 40), ("clusters", 64)])
def test_least_rank_sums(spark, shape, fences, monkeypatch):
    monkeypatch.setattr(rank_sums, "FENCES", fences)
    monkeypatch.setattr(rank_sums, "BLOCK", 32)
    rng = np.random.default_rng(11)
    n, d = 800, 3
    v = {"spread": rng.normal(size=(n, d)), "copies": np.round(rng.normal(size=(n, d)) * 2), "clusters": rng.normal(size=(20, d))[rng.integers(0, 20, n)] * 50 + rng.normal(size=(n, d))}[shape]
    q = np.concatenate([v[::40], v[:20] + 0.3])
    ids = rng.permutation(n)
    sets = [spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(k, m)] + [(-1, None)], "id long, features array<double>") for k, m in ((range(len(q)), q), (ids, v))]
    work = {}
    got = {r.micro_id: (r.macro_id, r.similarity) for r in rank_sums.least_rank_sums(*sets, work=work).collect()}
    for i, x in enumerate(q):
        sums = sum(np.argsort(np.lexsort((ids, np.abs(v[:, k] - x[k])))) for k in range(d))
        best = min(zip(sums.tolist(), ids.tolist()))
        assert got[i] == (best[1], float(best[0]))
    if shape == "clusters":
        assert work["met"] <= work["all"] / 2
    assert rank_sums.least_rank_sums(sets[0], sets[1].filter("false")).count() == 0


def test_rank_sums_of_a_crowd_keep_few(spark):
    rng = np.random.default_rng(3)
    q, v = rng.normal(size=(40, 4)), np.concatenate([np.tile(rng.normal(size=(1, 4)), (600, 1)), rng.normal(size=(200, 4))])
    work = {}
    got = {r.micro_id: (r.macro_id, r.similarity) for r in rank_sums.least_rank_sums(vectors(spark, q), vectors(spark, v), work=work).collect()}
    for i, x in enumerate(q):
        sums = sum(np.argsort(np.lexsort((np.arange(800), np.abs(v[:, k] - x[k])))) for k in range(4))
        assert got[i] == (int(sums.argmin()), float(sums.min()))
    assert work["kept"] < 2 * 800


def test_rank_sums_of_equal_micro_vectors_are_met_once(spark):
    rng = np.random.default_rng(4)
    q, v = np.repeat(rng.normal(size=(25, 5)), 40, axis=0), rng.normal(size=(500, 5))
    work = {}
    got = {r.micro_id: (r.macro_id, r.similarity) for r in rank_sums.least_rank_sums(vectors(spark, q), vectors(spark, v), work=work).collect()}
    assert len(got) == 1000 and work["kept"] < 500
    for i, x in enumerate(q[::40]):
        sums = sum(np.argsort(np.lexsort((np.arange(500), np.abs(v[:, k] - x[k])))) for k in range(5))
        assert all(got[j] == (int(sums.argmin()), float(sums.min())) for j in range(40 * i, 40 * i + 40))


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_rank_sums_where_differences_are_rounded(spark, offset):
    rng = np.random.default_rng(6)
    v = offset + np.concatenate([rng.normal(size=(5000, 3)), np.round(rng.normal(size=(3000, 3)) * 50) / 50]) * (1e-5 if offset else 1.0)
    q = np.concatenate([v[::400], v[:10] + 1e-7, offset + 5.0 + rng.normal(size=(4, 3))])
    got = {r.micro_id: (r.macro_id, r.similarity) for r in rank_sums.least_rank_sums(vectors(spark, q), vectors(spark, v)).collect()}
    for i, x in enumerate(q):
        sums = sum(np.argsort(np.lexsort((np.arange(len(v)), np.abs(v[:, k] - x[k])))) for k in range(3))
        assert got[i] == (int(sums.argmin()), float(sums.min()))


def test_rank_sums_by_products_leave_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    n, m, d = 12_000, 60, 64
    v, q = rng.normal(size=(n, d)), rng.normal(size=(m, d))
    micro, macro = (neighbours.clean(vectors(spark, x), "features") for x in (q, v))
    runs, _ = rank_sums._sorted_runs(macro, n)
    tables = rank_sums._tables(micro, runs, n)
    looks, sums = [], rank_sums.Tables.sums
    monkeypatch.setattr(rank_sums.Tables, "sums", lambda self, rows, places, i, j: (looks.append(len(i)), sums(self, rows, places, i, j))[1])
    i, j, low, high = rank_sums._best(runs, tables, q, np.full(m, np.iinfo(np.int64).max), np.array([0, m]), v, np.arange(0, n + 1, 100), [np.arange(n // 100)])
    assert 0 < sum(looks) < 0.1 * n * m and len(i) < 10 * m
    rows, places = tables.rows(q), tables.coarse.places(v)
    rough = tables.base[rows].sum(0)[:, None] + tables.factors[rows.T].reshape(m, -1).astype(float) @ tables.waves[places.T].reshape(n, -1).astype(float).T
    for k in range(m):
        exact = sum(np.argsort(np.argsort(np.abs(v[:, c] - q[k, c]))) for c in range(d))
        least = sums(tables, rows, places, np.full(n, k), np.arange(n))
        assert (least <= exact).all() and (rough[k] * n <= least + 1e-6).all()
        assert exact.argmin() in j[i == k] and (low[i == k] <= exact[j[i == k]]).all() and (exact[j[i == k]] <= high[i == k]).all()


def test_rank_sums_beyond_one_block(spark):
    n = (1 << 20) + 5000
    macro = spark.range(n).select("id", F.array(*((F.col("id") * k % 1_000_003).cast("double") for k in (7, 11))).alias("features"))
    micro = spark.createDataFrame([(1, [500.5, 900_000.2]), (2, [0.0, 0.0])], "id long, features array<double>")
    got = {r.micro_id: (r.macro_id, r.similarity) for r in matching.rank_sum(micro, macro).collect()}
    i = np.arange(n)
    for k, q in ((1, (500.5, 900_000.2)), (2, (0.0, 0.0))):
        sums = sum(np.argsort(np.lexsort((i, np.abs((i * m % 1_000_003).astype(float) - x)))) for m, x in zip((7, 11), q))
        assert got[k] == (int(sums.argmin()), float(sums.min()))


def test_vote_of_a_crowd_opens_few_pairs(spark):
    g = Geometry((0.5, 0.4, 0.25), (9, 11, 13))
    n, some = 20_000, [E.uniform(3, k, F.col("id")) for k in range(6)]
    crowd = F.col("id") % 10 < 9
    angle = [F.when(crowd, 0.02 * (u - 0.5)).otherwise(6 * u) for u in some[:3]]
    shift = [F.when(crowd, 1 + 0.05 * (u - 0.5)).otherwise(40 * u) for u in some[3:]]
    df = spark.range(n).select("id", F.array(*E.euler(*angle)).alias("r"), F.array(*shift).alias("t")).persist()
    work = {}
    won = density.vote(df, g, 0.002, work=work).first()
    assert sum(work.values()) < 0.01 * n * n
    whole = density.densities(df, g, 0.002).orderBy(F.desc("density"), "id").first()
    assert won.id == whole.id and won.density == pytest.approx(whole.density)
    df.unpersist()


def test_votes_under_other_metrics(spark):
    g = Geometry((0.5, 0.4, 0.25), (9, 11, 13))
    df = transforms.random_transforms(spark, 120, 4, 6.0).persist()
    loose = metric.Metric(metric.PLAIN.delta, metric.MIDDLE.coordinates, False)
    for m, spread in ((metric.MIDDLE, 0.001), (loose, 0.0005), (metric.PLAIN, 0.0005)):
        best = density.densities(df, g, spread, m=m).orderBy(F.desc("density"), "id").first()
        won = density.vote(df, g, spread, m=m).first()
        assert won.id == best.id and won.density == pytest.approx(best.density)
    same = density.densities(df, g, 0.0005, m=loose).orderBy("id").collect()
    assert [r.density for r in same] == pytest.approx([r.density for r in density.densities(df, g, 0.0005).orderBy("id").collect()])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 60, 700])
def test_median_of_all_pairs(spark, n, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", 64)
    monkeypatch.setattr(density, "BINS", 16)
    g = Geometry((0.5, 0.4, 0.25), (9, 11, 13))
    rows = transforms.random_transforms(spark, n, 8, 3.0).collect()
    rows += rows[: n // 3]
    df = spark.createDataFrame(rows, "id long, r array<double>, t array<double>")
    v = np.array([[math.sqrt(g.count) * c for c in np.array(x.r).reshape(3, 3) @ (np.array(g.bounds) / 2) + x.t] + [math.sqrt(s) * x.r[3 * j + i] for i, s in enumerate(metric.axis_sums(g)) for j in range(3)] for x in rows])
    want = [float(np.linalg.norm(v[i] - v[j])) for i in range(len(v)) for j in range(i)]
    assert density.median_distance(df, g, enough=10) == pytest.approx(float(np.median(want)) if want else 0.0)


def test_vote_of_one_of_none_and_of_equals(spark):
    g = Geometry((1.0,) * 3, (4, 4, 4))
    one = transforms.table(spark, [(np.eye(3).reshape(-1), [1, 2, 3])])
    assert density.vote(one, g).first().t == [1.0, 2.0, 3.0]
    assert density.vote(one.filter("false"), g).count() == 0
    same = transforms.table(spark, [(np.eye(3).reshape(-1), [1, 2, 3])] * 3)
    assert density.vote(same, g).first().density == pytest.approx(3)


def test_grid_field_both_routes_agree(spark):
    f = mocks.small()
    grid = GridField(f.geometry, f.voxels(spark).select(F.col("i").alias("x"), F.col("j").alias("y"), F.col("k").alias("z"), F.col("value").cast("int").alias("v")))
    p = np.array([[0.25, 0.5, 0.75], [-3, 0.5, 9], [1, 1, 1], [0.25, 0.5, 0.75]])
    points = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "id long, x double, y double, z double")
    joined = [r.value for r in grid.attach(points).orderBy("id").collect()]
    assert joined == pytest.approx([0.25 + 1 + 3, 1 + 4, 7, 4.25]) and grid.evaluator()(p).tolist() == pytest.approx(joined)
    with pytest.raises(ValueError):
        GridField(f.geometry, grid.table, ship_limit=1).evaluator()


@pytest.mark.parametrize("kind, order", [("MET_USHORT", "x"), ("MET_UCHAR", "y")])
def test_volume_files(spark, tmp_path, kind, order):
    g = Geometry((0.5, 0.25, 1.0), (3, 2, 4))
    v = np.arange(24)
    (tmp_path / "v.mhd").write_text(metaimage.header_text(g, "v.raw", kind).replace("0.25", "0,25"))
    (tmp_path / "v.raw").write_bytes(v.astype(metaimage.KINDS[kind]).tobytes())
    got, table = metaimage.read_volume(spark, str(tmp_path / "v.mhd"), str(tmp_path / "v.raw"))
    assert got == g
    for r in table.collect():
        assert r.v == r.z * 6 + (r.y * 3 + r.x if order == "x" else r.x * 2 + r.y)


def test_volume_round_trip_clamps(spark, tmp_path):
    g = Geometry((1.0,) * 3, (3, 2, 2))
    f = mocks.constant(g).voxels(spark).withColumn("value", F.col("x") * 40000 - 5)
    volumes.save(f.select(F.col("i").alias("x"), F.col("j").alias("y"), F.col("k").alias("z"), "value"), g, str(tmp_path / "out.mhd"), value="value")
    mapped = GridField(g, f, raw_path=str(tmp_path / "out.raw")).evaluator()
    assert mapped(np.array([[1.0, 0, 0], [0.5, 1, 1]])).tolist() == [39995, 39995 / 2]
    _, table = metaimage.read_volume(spark, str(tmp_path / "out.mhd"), str(tmp_path / "out.raw"))
    assert {(r.x, r.v) for r in table.collect()} == {(0, 0), (1, 39995), (2, 65535)}
    (tmp_path / "bad.mhd").write_text(metaimage.header_text(g, "out.raw", "MET_FLOAT"))
    with pytest.raises(ValueError):
        metaimage.read_volume(spark, str(tmp_path / "bad.mhd"), str(tmp_path / "out.raw"))


@pytest.mark.parametrize("kind", ["MET_USHORT", "MET_UCHAR"])
def test_volume_source_both_ways(spark, tmp_path, kind):
    g = Geometry((0.5, 0.25, 1.0), (7, 5, 11))
    rng = np.random.default_rng(2)
    v = rng.integers(-20, 70_000 if kind == "MET_USHORT" else 300, (7, 5, 11))
    rows = [(x, y, z, float(v[x, y, z]) + 0.5) for x, y, z in itertools.product(range(7), range(5), range(11)) if (x, y, z) != (3, 2, 1)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "x int, y int, z int, v double").repartition(6)
    path = str(tmp_path / "v.mhd")
    volumes.save(df, g, path, kind)
    top = 65535 if kind == "MET_USHORT" else 255
    want = {(x, y, z): min(max(int(w), 0), top) for x, y, z, w in rows} | {(3, 2, 1): 0}
    got_g, table = volumes.load(spark, path, group_bytes=100)
    assert got_g == g and {(r.x, r.y, r.z): r.v for r in table.collect()} == want
    assert {(r.x, r.y, r.z): r.v for r in metaimage.read_volume(spark, path, str(tmp_path / "v.raw"))[1].collect()} == want
    some = volumes.load(spark, path, group_bytes=100, from_z=3, to_z=5)[1].filter("x > 1")
    assert some.rdd.getNumPartitions() < table.rdd.getNumPartitions()
    assert {(r.x, r.y, r.z): r.v for r in some.collect()} == {k: w for k, w in want.items() if 3 <= k[2] < 5 and k[0] > 1}
    shipped = GridField(g, table).evaluator()
    there = GridField(g, table, raw_path=str(tmp_path / "v.raw"), element_type=kind).evaluator()
    p = rng.uniform(-1, 6, (50, 3))
    assert np.allclose(shipped(p), there(p))
    before = (tmp_path / "v.raw").read_bytes()
    with pytest.raises(Exception):
        volumes.save(df.withColumn("x", F.when(F.col("z") == 9, 70).otherwise(F.col("x"))), g, path, kind)
    assert (tmp_path / "v.raw").read_bytes() == before and len(list(tmp_path.iterdir())) == 2


def test_transform_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("R 3x3\n 0  1  0  -1  0  0  0  0  1 \nt 3\n 1,5 -2e-1 3 \n")
    (tmp_path / "b.txt").write_text("R 3x3\n 0 1 0 \n")
    got = {r.path[-5:]: r for r in texts.read_transforms(spark, str(tmp_path)).collect()}
    assert got["a.txt"].r == [0, -1, 0, 1, 0, 0, 0, 0, 1] and got["a.txt"].t == [1.5, -0.2, 3]
    assert got["b.txt"].r is None
    r = mocks.turn(0.1, 0.2, 0.3).reshape(-1).tolist()
    texts.write_transform(r, [1.0, -2.5, 3e-7], str(tmp_path / "a.txt"))
    back = texts.read_transforms(spark, str(tmp_path / "a.txt")).first()
    assert back.r == r and back.t == [1.0, -2.5, 3e-7]


def test_configurations(spark, tmp_path):
    c = [features.Computer("quantiles", {"quantiles": (0.0, 0.5)}), features.Computer("pca"), features.Computer("harmonics", {"l_max": 2, "radius": 1.5, "samples": 50})]
    assert features.computers_from_json(texts.config_text(c)) == c
    assert features.computers_from_json('{"configurations":[{"FeatureComputerType":3,"Parameters":{}},{"FeatureComputerType":99},{"FeatureComputerType":4}]}') == [features.Computer("value")]
    literal = """{"configurations": [
      {"FeatureComputerType": 1, "Parameters": {"BorderPercentage": {"Value": 0.001}, "Radius": {"Value": 3}, "Comment": {"Value": "Curvature"}}},
      {"FeatureComputerType": 0, "Parameters": {"BorderPercentage": {"Value": "0.05"}, "Radius": {"Value": 3}}},
      {"FeatureComputerType": 6, "Parameters": {"Radius": {"Value": 3}}},
      {"FeatureComputerType": 5, "Parameters": {"lMax": {"Value": 2}, "radius": {"Value": 1.5}}},
      {"FeatureComputerType": 5, "Parameters": {"lMax": {"Value": 2}, "radius": {"Value": 1.5}, "sampleCount": {"Value": 40}}}]}"""
    assert features.computers_from_json(literal) == [
        features.Computer("curvature", {"border": 0.001, "radius": 3}), features.Computer("gradient", {"border": 0.05, "radius": 3}), features.Computer("harmonics", {"l_max": 2, "radius": 1.5, "samples": 40}),
    ]
    assert features.computers_from_json(texts.config_text([features.Computer("shape")])) == [features.Computer("shape", {"border": 0.15, "radius": 0})]
    (tmp_path / "c.json").write_text(texts.config_text(c))
    rows = texts.read_configs(spark, str(tmp_path / "c.json")).orderBy("n").collect()
    assert [r.kind for r in rows] == ["quantiles", "pca", "harmonics"] and rows[0].parameters["QuantileValues"] == "[0.0,0.5]"


def test_the_border_of_a_configuration_changes_its_features(spark):
    points = spark.createDataFrame([(0, 1.0, 1.5, 2.0)], "id long, x double, y double, z double")
    one = [features.feature_vectors(points, mocks.sphere(), [features.Computer("curvature", {"border": b})], radius=0.8, least_step=0.0).first().features for b in (0.001, 0.1)]
    assert one[0] != one[1]


def test_an_oriented_cloud_has_its_spreads(spark):
    p = np.array([r[1:] for r in mocks.oriented_cloud(spark, 4000, 3, centre=(1.0, 2.0, 3.0)).collect()])
    sizes = np.sqrt(np.linalg.eigvalsh(np.cov(p.T)))[::-1]
    assert np.allclose(sizes, np.array([500, 50, 5]) / math.sqrt(3), rtol=0.1) and np.allclose(p.mean(0), [1, 2, 3], atol=25)


def test_lines(spark):
    df = spark.createDataFrame([(2.0, 3.0), (1.0, 5.0)], "a double, b double")
    assert [r.line for r in texts.point_lines(df, ["a", "b"], ["a"]).orderBy("n").collect()] == ["a; b", "1.0; 5.0", "2.0; 3.0"]
    results = spark.createDataFrame([("m", "t", float("nan"))], "macro string, test string, relative_distance double")
    assert [r.line for r in texts.experiment_lines(results).orderBy("n").collect()] == ["macro; test; relativeDistance; ", "m; t; NaN; "]


def test_experiments(spark):
    tests = spark.createDataFrame([("a", "1"), ("a", "2")], "macro string, test string")
    groups = spark.createDataFrame([("a",), ("b",)], "macro string")
    with pytest.raises(ValueError):
        experiment.cases(groups, tests)
    assert experiment.cases(groups.filter("macro = 'a'"), tests).count() == 2
    assert experiment.total_tests(tests).first().tests == 2
    r = spark.createDataFrame([("a", "1", float("nan")), ("b", "1", 0.5)], "macro string, test string, relative_distance double")
    got = {x.macro: x for x in experiment.summary(r).collect()}
    assert math.isnan(got["a"].mean) and got["b"].mean == 0.5 and experiment.finished(r).count() == 1


def test_samplers(spark):
    f = mocks.sphere()
    p = sampling.percentile_sampler(spark, f, 30, seed=1)
    rows = p.collect()
    assert len(rows) == 30 and [r.variance for r in rows] == sorted((r.variance for r in rows), reverse=True)
    assert {r.id for r in rows} == {r.id for r in sampling.percentile_sampler(spark, f, 30, seed=1).collect()}
    assert sampling.segmented_sampler(spark, f, 20, seed=2).count() <= 20
    assert all(r.gradient >= 100 for r in sampling.gradient_threshold(sampling.uniform_points(spark, f.geometry, 40, 5), f, 100.0, 10).collect())
    shell = sampling.shell_points(spark.sql("SELECT 0L id, 0D x, 0D y, 0D z"), 1.0, 2.0, 200, 3).select(E.norm(E.xyz()).alias("d")).collect()
    assert all(1 <= r.d <= 2 for r in shell) and sampling.shuffled(spark.range(50), 1).count() == 50


def test_slices(spark):
    assert slices.resolution(1.0) == (500, 500)
    g = Geometry((1.0,) * 3, (3, 3, 3))
    f = mocks.constant(g)
    assert {r.r for r in slices.grey_slice(slices.plane(spark, g, 7.0, 0, 4, 4), f, f.voxels(spark)).collect()} == {0}


def test_histogram_of_nothing(spark):
    h = histogram.histogram(spark.createDataFrame([], "v int"), "v")
    assert histogram.cdf(h).count() == 0


def test_diagnostics(spark):
    rng = np.random.default_rng(0)
    v = vectors(spark, rng.random((30, 3)))
    assert diagnostics.random_pairs(v, 20, 1).count() == 20
    assert diagnostics.two_nearest(v, vectors(spark, rng.random((2, 3)), 100), 2.0).count() == 30
    d = spark.createDataFrame([(0, 0, 1.0, 0.5), (0, 0, 3.0, 0.5), (0, 1, 2.0, 2.0)], "ref int, bin int, distance double, real double")
    row = diagnostics.closer_further(d, F.col("real"), 1.0).first()
    assert row.closer == 1.0 and row.further == 0.0 and {r.bin: r.n for r in diagnostics.by_bin(d).collect()} == {0: 2, 1: 1}
    pairs = v.select(F.lit(1).alias("ref"), F.lit(1).alias("bin"), "features", F.array(*[F.lit(0.0)] * 3).alias("ref_features"))
    assert diagnostics.difference_mean(pairs).first().mean > 0


def test_alignment_of_a_known_pair(spark):
    macro, micro = headless_pair()
    seen = []
    c = Config(micro_points=200, macro_points=400, quadric_radius=2.0, quadric_step=0.5, ball_radius=1.5, ball_step=0.3, median_share=0.2, progress=lambda k, n, name: seen.append(k))
    got = align(spark, micro, macro, c).first()
    r, t = mocks.turn(math.radians(12), math.radians(8), math.radians(20)).reshape(-1), [2.0, 0.5, 1.5]
    assert seen == list(range(1, len(STAGES) + 1))
    assert metaimage.is_rotation(got.r)
    assert rotation_error(got.r, r) < 15 and corner_error(micro.geometry.bounds, (got.r, got.t), (r, t)) < 0.25 * micro.geometry.diagonal
    assert identity(spark).first().t == [0.0, 0.0, 0.0]


def test_lattice_kernels_keep_the_steps_that_fit(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["lattice_kernels"](spark, sf).select("id", *(f"{side}_{c}" for side in ("below", "above") for c in "xyz")).collect()
    for r in got:
        place = [(r.id * m % n) / n * 4.8 for m, n in ((37, 1000), (91, 1009), (53, 997))]
        assert list(r)[1:] == [int(min(x / s, 4)) for x, s in zip(place, (0.5, 0.7, 0.3))] + [int(min((4.8 - x) / s, 4)) for x, s in zip(place, (0.5, 0.7, 0.3))]


def test_points_of_one_partition_go_to_all_cores(spark):
    points = spark.range(64).coalesce(1).select("id", *((F.col("id") % m / m * 2 + 1).alias(c) for c, m in (("x", 7.0), ("y", 5.0), ("z", 3.0))))
    fld, value = mocks.sphere(), (features.Computer("value"),)
    target = points.withColumn("target", F.array(F.lit(1.0)))
    ball = {"radius": 0.2, "step": 0.1}
    for made in (features.feature_vectors(points, fld, value), features.quadrics(points, fld, radius=0.4), features.descended(target, fld, value, steps=1), transforms.with_bases(points, fld, **ball), features.ball_values(points, fld, **ball)):
        assert made.rdd.getNumPartitions() > 1


def test_balls_are_grouped_where_they_are_made(spark):
    points = spark.range(64).select("id", *(F.lit(2.0).alias(c) for c in "xyz"))
    for made in (features.pca_moments(points, mocks.sphere(), 0.2, 0.1), features.quantiles_sql(points, mocks.sphere(), [0.5], 0.2, 0.1)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_tiles_meet_every_pair_once_and_copy_blocks_seldom(spark):
    a, b = (spark.range(60).select(F.col("id").alias(c), F.lit(b"x").alias("m")) for c in "ab")
    pairs = spark.range(60).crossJoin(spark.range(60).withColumnRenamed("id", "b")).select(F.col("id").alias("a"), "b").filter("(a + b) % 3 = 0")

    def run(left, right):
        held = set(right.column("b").to_pylist())
        met = [(x, y) for x, near in zip(left.column("a").to_pylist(), left.column("near").to_pylist()) for y in near or held if y in held]
        return pa.table({"a": pa.array([m[0] for m in met], pa.int64()), "b": pa.array([m[1] for m in met], pa.int64())})

    for some in (pairs, None):
        got = sorted(map(tuple, tiles.tiled(a, b, some, (4, 3), run, "a long, b long").collect()))
        assert got == sorted((x, y) for x in range(60) for y in range(60) if some is None or (x + y) % 3 == 0)
    h, g = tiles.groups_of((1200, 150 << 20), (1200, 150 << 20), 12)
    assert h + g <= 20 and h * g >= 48  # a block of either side was copied for each of up to 1200 blocks


def test_neighbours_hand_on_one_row_a_block_and_tile(spark):
    v = vectors(spark, np.random.default_rng(2).normal(size=(900, 5)))
    found = []
    keep = neighbours._best
    neighbours._best = lambda f, *more: (found.append(f.count()), keep(f, *more))[1]
    try:
        assert neighbours.knn(v, v, 50, same_set=True).count() == 900 * 50
    finally:
        neighbours._best = keep
    assert found[0] <= 200  # a row for each neighbour in each pair of blocks were 45,000 or more


def test_shell_variances_without_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, rng.normal(size=3).tolist()) for i in range(90)] + [(90, 0, [None] * 3), (91, 1, [1.0, None, 2.0]), (92, 1, [None] * 3)]
    e = spark.createDataFrame(rows, "id long, bin int, f array<double>")
    refs, others = e.filter("bin = 0").select(F.col("id").alias("ref"), "f"), e.filter("bin > 0").select("bin", "f")
    pairs = refs.withColumnRenamed("f", "ref_features").crossJoin(others.withColumnRenamed("f", "features")).filter("forall(features, v -> v IS NOT NULL)")
    want = {r.ref: list(r)[1:] for r in diagnostics.shell_matrix(diagnostics.feature_distances(pairs), [1, 2, 7]).collect()}
    made = diagnostics.shell_variances(refs, others, [1, 2, 7], 3)
    got = {r.ref: list(r)[1:] for r in made.collect()}
    assert got.keys() == want.keys() and got[90] == [None] * 3
    for k in range(0, 90, 3):
        assert got[k][:2] == pytest.approx(want[k][:2], abs=1e-12) and got[k][2] is None
    assert "CartesianProduct" not in made._jdf.queryExecution().toString()
    assert diagnostics.shell_variances(refs, others.filter("false"), [1, 2], 3).count() == 0


def test_densities_make_no_row_for_a_pair(spark):
    g = Geometry((0.5, 0.4, 0.25), (9, 11, 13))
    turn, t = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], 0.5
    df = spark.range(700).select("id", F.array(*map(F.lit, turn)).alias("r"), F.array(F.when(F.col("id") < 500, 0.0).otherwise(t), F.lit(0.0), F.lit(0.0)).alias("t"))
    for end in (t, 1.5 * t, 0.5 * t):
        delta = math.sqrt(g.count) * t
        spread = math.log(10) / (math.sqrt(g.count) * end) ** 2
        got = {r.id: r.density for r in density.densities(df, g, spread).collect()}
        want = density._radius(spread, 0.1) > delta * (1 + 1e-12)
        near = math.exp(-spread * delta**2) if want else 0.0
        if end != t:
            assert got[0] == pytest.approx(500 + 200 * near) and got[699] == pytest.approx(200 + 500 * near)
        assert len(got) == 700
    plan = density.densities(df, g, 0.002)._jdf.queryExecution().toString()
    assert "Generate explode" not in plan


def test_few_distances_are_made_about_a_window():
    rng = np.random.default_rng(2)
    blocks = [rng.normal(size=(40, 5)) + 3 * rng.normal(size=5) for _ in range(6)]
    pairs = [(x, y, i == j) for i, x in enumerate(blocks) for j, y in enumerate(blocks) if i <= j]
    every = np.concatenate([np.linalg.norm(x[:, None] - y[None], axis=2)[np.triu_indices(40, 1) if same else ...].ravel() for x, y, same in pairs])
    lo, hi = np.quantile(every, [0.499, 0.501])
    below, made = map(list, zip(*density._within(iter(pairs), lo, hi)))
    made = np.concatenate(made)
    assert sum(below) + (made < lo).sum() == (every < lo).sum()
    assert np.sort(made[(made >= lo) & (made < hi)]) == pytest.approx(np.sort(every[(every >= lo) & (every < hi)]))
    assert len(made) <= 0.01 * len(every)


@pytest.mark.parametrize("spread", [0.05, 0.5])
def test_bounds_of_cells_and_of_points_hold(spread):
    rng = np.random.default_rng(4)
    radius = math.sqrt(math.log(0.1) / -spread)
    q, v = rng.normal(size=(50, 4)) * 2, rng.normal(size=(300, 4)) * 2
    w, cell = rng.integers(1, 4, 300).astype(float), np.floor(v[:, 0]).astype(int) * 100 + np.floor(v[:, 1]).astype(int)
    d = np.linalg.norm(q[:, None] - v[None], axis=2)
    want = np.where(d < radius, np.exp(-spread * d * d), 0.0) @ w
    low, high = density._point_bounds(*density._squares(q, v), w, spread, radius)
    assert low == pytest.approx(want) and high == pytest.approx(want)
    parts = [cell == c for c in np.unique(cell)]
    n, centre = np.array([w[p].sum() for p in parts]), np.array([np.average(v[p], 0, w[p]) for p in parts])
    far = [((v[p] - c) ** 2).sum(1) for p, c in zip(parts, centre)]
    ms, r = np.array([np.average(f, weights=w[p]) for f, p in zip(far, parts)]), np.array([math.sqrt(f.max()) for f in far])
    low, high = density._cell_bounds(*density._squares(q, centre), n, ms, r, spread, radius)
    assert (low <= want + 1e-9).all() and (want <= high + 1e-9).all() and (low > 0).any()


@pytest.mark.parametrize("by", [[], ["s"]])
def test_ranks_in_a_reference_share_no_bucket_of_all_that_lie_beyond_it(spark, by, monkeypatch):
    monkeypatch.setattr(ranking, "IN_BUCKET", 50)
    held = []
    keyed = ranking._in_bucket
    monkeypatch.setattr(ranking, "_in_bucket", lambda *a: held.append(keyed(*a)) or held[-1])
    rng = np.random.default_rng(6)
    ref, asked = rng.integers(0, 400, 300) / 4.0, np.concatenate([rng.integers(0, 400, 200) / 4.0, 1000 + np.arange(6000.0)])
    table = lambda v: spark.createDataFrame([("a", float(x)) for x in v] + [("a", None)], "s string, v double")
    out = ranking.ecdf_of(table(asked), table(ref), by, "v").collect()
    got = {r.v: r.ecdf for r in out}
    assert len(out) == len(asked) + 1 and got.pop(None) is None
    assert got == pytest.approx({x: ((ref < x).sum() + (ref <= x).sum()) / 600 for x in asked})
    assert max(r["count"] for r in held[0].groupBy(*by, "bucket").count().collect()) <= 150
    alone = spark.createDataFrame([("b", 1.0)], "s string, v double")
    assert ranking.ecdf_of(alone, table(ref) if by else table([]), by, "v").first().ecdf is None
