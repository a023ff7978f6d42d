"""Named queries over the driver's tables and over synthetic volumes, each with SQL for an independent engine where SQL can say it."""

from __future__ import annotations

import itertools
import math
import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions import dense, metric
from strataline.functions import exprs as E
from strataline.operators import density, diagnostics, experiment, features, histogram, matching, normalize, ranking, sampling, slices, transforms
from strataline.sources import bricks, metaimage, mocks, texts, volumes
from strataline.sources.fields import AnalyticField, GridField, lattice
from strataline.shared import new_path
from strataline.types import Geometry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(c, d: int = 6):
    return F.round(c, d)


# ---------------------------------------------------------------------------------------- normalisers, order statistics


@query("""SELECT l_orderkey, l_linenumber, round(((rank() OVER w - 1) / CAST(count(*) OVER (PARTITION BY l_returnflag) AS DOUBLE) + cume_dist() OVER w) / 2, 9) AS ecdf
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_extendedprice)""")
def ecdf_rank_normalize(spark, sf):
    rows = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return ranking.ecdf(rows, ["l_returnflag"], "l_extendedprice").select("l_orderkey", "l_linenumber", _r("ecdf", 9).alias("ecdf"))


@query("""SELECT o_orderkey, round(((SELECT count(*) FROM customer WHERE c_acctbal < o_totalprice / 20) + (SELECT count(*) FROM customer WHERE c_acctbal <= o_totalprice / 20)) / 2.0 / (SELECT count(*) FROM customer), 9) AS ecdf FROM orders""")
def ecdf_of_reference(spark, sf):
    rows = _t(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 20).alias("v"))
    ref = _t(spark, sf, "customer").select(F.col("c_acctbal").alias("v"))
    return ranking.ecdf_of(rows, ref, [], "v").select("o_orderkey", _r("ecdf", 9).alias("ecdf"))


@query("""SELECT c_custkey, round(CASE WHEN stddev_pop(c_acctbal) OVER p = 0 THEN 0 ELSE (c_acctbal - avg(c_acctbal) OVER p) / stddev_pop(c_acctbal) OVER p END, 6) AS z
FROM customer WINDOW p AS (PARTITION BY c_mktsegment)""")
def zscore_normalize(spark, sf):
    rows = _t(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return normalize.zscore(rows, "c_acctbal", ["c_mktsegment"]).select("c_custkey", _r("z").alias("z"))


@query("""SELECT event_id, round((value - min(value) OVER p) / (max(value) OVER p - min(value) OVER p), 6) AS scaled FROM events WINDOW p AS (PARTITION BY event_type)""")
def minmax_normalize(spark, sf):
    rows = _t(spark, sf, "events").select("event_id", "event_type", "value")
    return normalize.min_max(rows, "value", ["event_type"]).select("event_id", _r("scaled").alias("scaled"))


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity / l_tax, 6) AS f0, l_discount AS f1 FROM lineitem WHERE l_tax <> 0 AND l_linenumber <> 3""")
def finite_feature_filter(spark, sf):
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    f0 = F.when(F.col("l_tax") == 0, inf).otherwise(F.col("l_quantity") / F.nullif("l_tax", F.lit(0.0)))
    rows = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array(f0, F.when(F.col("l_linenumber") == 3, nan).otherwise(F.col("l_discount"))).alias("features"))
    return normalize.finite_features(rows).select("l_orderkey", "l_linenumber", _r(F.get("features", F.lit(0))).alias("f0"), F.get("features", F.lit(1)).alias("f1"))


@query("""WITH s AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1), q AS (SELECT unnest([0.0, 0.25, 0.5, 0.7, 1.0]::DOUBLE[]) AS q)
SELECT l_returnflag, q, v[CAST(trunc(q * (len(v) - 1)) AS INT) + 1] AS value FROM s, q""")
def order_stat_quantiles(spark, sf):
    return ranking.order_statistics(_t(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.0, 0.25, 0.5, 0.7, 1.0])


@query("""WITH s AS (SELECT list_sort(list(value)) AS v FROM events), e AS (SELECT v[CAST(trunc(len(v) * 0.05) AS INT) + 1] AS lo, v[CAST(trunc(len(v) * 0.70) AS INT) + 1] AS hi FROM s)
SELECT event_id, round(least(greatest((value - lo) / (hi - lo), 0), 1), 6) AS stretched FROM events, e""")
def contrast_stretch(spark, sf):
    return normalize.contrast_stretch(_t(spark, sf, "events").select("event_id", "value"), "value").select("event_id", _r("stretched").alias("stretched"))


@query("""WITH h AS (SELECT CAST(p_size AS INT) AS value, count(*) AS cnt FROM part GROUP BY 1)
SELECT value, cnt, round(sum(cnt) OVER (ORDER BY value) / CAST(sum(cnt) OVER () AS DOUBLE), 9) AS cdf FROM h""")
def histogram_cdf(spark, sf):
    return histogram.cdf(histogram.histogram(_t(spark, sf, "part"), "p_size")).select("value", "cnt", _r("cdf", 9).alias("cdf")).filter("cnt > 0")


_GAPS = """h AS (SELECT CAST(2 * p_size + (p_size // 10) * 7 AS INT) AS value, count(*) AS cnt FROM part GROUP BY 1),
d AS (SELECT unnest(generate_series((SELECT min(value) FROM h), (SELECT max(value) FROM h))) AS value),
j AS (SELECT d.value, coalesce(h.cnt, 0) AS cnt,
  (SELECT max(a.value) FROM h a WHERE a.value <= d.value) AS pv, (SELECT min(a.value) FROM h a WHERE a.value >= d.value) AS nv,
  (SELECT sum(a.cnt) FROM h a WHERE a.value <= d.value) AS cum, (SELECT sum(cnt) FROM h) AS n FROM d LEFT JOIN h ON h.value = d.value),
c AS (SELECT CAST(j.value AS INT) AS value, cnt, CASE WHEN cnt > 0 THEN cum / CAST(n AS DOUBLE)
  ELSE (cum + (j.value - pv) / CAST(nv - pv AS DOUBLE) * (SELECT a.cnt FROM h a WHERE a.value = nv)) / CAST(n AS DOUBLE) END AS cdf FROM j)"""


def _gappy(spark, sf) -> DataFrame:
    return _t(spark, sf, "part").select((2 * F.col("p_size") + F.floor(F.col("p_size") / 10) * 7).cast("int").alias("v"))


@query(f"WITH {_GAPS} SELECT value, cnt, round(cdf, 9) AS cdf FROM c")
def cdf_gap_interpolated(spark, sf):
    return histogram.cdf(histogram.histogram(_gappy(spark, sf), "v")).select("value", "cnt", _r("cdf", 9).alias("cdf"))


@query(f"""WITH {_GAPS}, e AS (SELECT min(value) AS lo, max(value) AS hi FROM c)
SELECT l_orderkey, l_linenumber, round(CASE WHEN q < lo THEN 0 WHEN q > hi THEN 1 ELSE a.cdf + (q - floor(q)) * (b.cdf - a.cdf) END, 9) AS percentile
FROM (SELECT l_orderkey, l_linenumber, l_quantity * 2.7 - 1.1 AS q FROM lineitem) x CROSS JOIN e
LEFT JOIN c a ON a.value = CAST(floor(q) AS INT) LEFT JOIN c b ON b.value = CAST(ceil(q) AS INT)""")
def cdf_lookup(spark, sf):
    table = histogram.cdf(histogram.histogram(_gappy(spark, sf), "v"))
    rows = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2.7 - 1.1).alias("q"))
    return histogram.lookup(rows, "q", table).select("l_orderkey", "l_linenumber", _r("percentile", 9).alias("percentile"))


# --------------------------------------------------------------------------------------------------- features, matching


def _vectors(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Micro: labels below 5, macro: the others; the first three dimensions stand for the place."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", v.alias("features"))
    rows = rows.select("*", *(F.get("features", F.lit(k)).alias(c) for k, c in enumerate("xyz")))
    return rows.filter("label < 5").drop("label"), rows.filter("label >= 5").drop("label")


_SETS = """e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings),
mi AS (SELECT * FROM e WHERE label < 5), ma AS (SELECT * FROM e WHERE label >= 5),
p AS (SELECT mi.id AS micro_id, ma.id AS macro_id, mi.f AS a, ma.f AS b, sqrt(list_sum(list_transform(list_zip(mi.f, ma.f), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM mi, ma),
k AS (SELECT *, row_number() OVER (PARTITION BY micro_id ORDER BY d, macro_id) AS n FROM p)"""
_COS = "100 * list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(a, lambda z: z * z))) * sqrt(list_sum(list_transform(b, lambda z: z * z))))"


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings), p AS (SELECT x.vec_id, x.a, y.a AS b FROM e x JOIN e y ON y.vec_id = x.vec_id + 1)
SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS l2, round(sqrt(list_sum(list_transform(a, lambda z: z * z))), 6) AS magnitude,
round(greatest(0, """ + _COS + """), 6) AS cosine FROM p""")
def feature_distances(spark, sf):
    e = _t(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    a, b = F.col("a"), F.col("b")
    return pairs.select("vec_id", _r(E.l2(a, b)).alias("l2"), _r(E.magnitude(a)).alias("magnitude"), _r(E.cosine_score(a, b)).alias("cosine"))


@query(f"WITH {_SETS} SELECT micro_id, macro_id, n, round(d, 6) AS score FROM k WHERE n <= 5")
def knn_euclid(spark, sf):
    return matching.knn(*_vectors(spark, sf), 5).select("micro_id", "macro_id", F.col("n").cast("long").alias("n"), _r("score").alias("score"))


@query(f"""WITH {_SETS}, s AS (SELECT micro_id, macro_id, greatest(0, {_COS}) AS similarity FROM k WHERE n = 1)
SELECT micro_id, macro_id, round(similarity, 6) AS similarity FROM s QUALIFY row_number() OVER (ORDER BY similarity DESC, micro_id) <= trunc(0.1 * (SELECT count(*) FROM s))""")
def nn_cosine_topfrac(spark, sf):
    return matching.euclid_cosine(*_vectors(spark, sf), 0.1).withColumn("similarity", _r("similarity"))


@query(f"""WITH {_SETS}, r AS (SELECT micro_id, min(macro_id) FILTER (n = 1) AS macro_id, min(d) FILTER (n = 1) / min(d) FILTER (n = 2) AS ratio FROM k GROUP BY 1)
SELECT micro_id, macro_id, round(1 - ratio, 6) AS similarity FROM r WHERE ratio <= 0.95""")
def lowe_ratio(spark, sf):
    return matching.ratio_test(*_vectors(spark, sf), 0.95).withColumn("similarity", _r("similarity"))


def _position_sql(cutoff: float, cap: int, fraction: float) -> str:
    return f"""WITH {_SETS}, v AS (SELECT *, count(*) OVER w AS c, var_pop(d) OVER w AS var FROM k WHERE n <= {cap} WINDOW w AS (PARTITION BY micro_id ORDER BY n)),
h AS (SELECT *, max(CASE WHEN c > 1 AND var >= {cutoff} THEN 1 ELSE 0 END) OVER (PARTITION BY micro_id ORDER BY n) AS stop FROM v),
s AS (SELECT micro_id, arg_min(macro_id, n) AS macro_id, count(*) AS taken, -(var_pop(b[1]) + var_pop(b[2]) + var_pop(b[3])) AS similarity FROM h WHERE stop = 0 GROUP BY 1)
SELECT micro_id, macro_id, taken, round(similarity, 6) AS similarity FROM s QUALIFY row_number() OVER (ORDER BY similarity DESC, micro_id) <= ceil({fraction} * (SELECT count(*) FROM s))"""


@query(_position_sql(1.4, 100, 1.0))
def position_match(spark, sf):
    return matching.position(*_vectors(spark, sf)).withColumn("similarity", _r("similarity"))


@query(_position_sql(0.003, 100, 0.5))
def position_match_cut(spark, sf):
    return matching.position(*_vectors(spark, sf), cutoff=0.003, fraction=0.5).withColumn("similarity", _r("similarity"))


@query(f"""WITH {_SETS}, c AS (SELECT micro_id, macro_id, greatest(0, {_COS}) AS s FROM p),
o AS (SELECT (SELECT count(*) FROM ma) < (SELECT count(*) FROM mi) AS swap),
b AS (SELECT micro_id, macro_id, s FROM c, o QUALIFY row_number() OVER (PARTITION BY CASE WHEN swap THEN macro_id ELSE micro_id END ORDER BY s DESC, CASE WHEN swap THEN micro_id ELSE macro_id END) = 1)
SELECT micro_id, macro_id, round(s, 6) AS similarity FROM b QUALIFY row_number() OVER (ORDER BY s DESC, micro_id, macro_id) <= trunc(0.1 * (SELECT count(*) FROM b))""")
def naive_cosine_match(spark, sf):
    return matching.naive_cosine(*_vectors(spark, sf), 0.1).withColumn("similarity", _r("similarity"))


_HEAD3 = "e AS (SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), mi AS (SELECT * FROM e WHERE label < 5), ma AS (SELECT * FROM e WHERE label >= 5)"


@query(f"""WITH {_SETS}, x AS (SELECT micro_id, macro_id, unnest(range(1, len(a) + 1)) AS d, unnest(list_transform(list_zip(a, b), lambda z: abs(z[2] - z[1]))) AS gap FROM p),
w AS (SELECT micro_id, macro_id, row_number() OVER (PARTITION BY micro_id, d ORDER BY gap, macro_id) - 1 AS rank FROM x), s AS (SELECT micro_id, macro_id, sum(rank) AS s FROM w GROUP BY 1, 2)
SELECT micro_id, macro_id, CAST(s AS DOUBLE) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY micro_id ORDER BY s, macro_id) = 1""")
def relative_rank_match(spark, sf):
    return matching.rank_sum(*_vectors(spark, sf))


_TURN = mocks.turn(math.radians(12), math.radians(8), math.radians(20)).reshape(-1).tolist()
_MOVE = [0.1, -0.05, 0.02]


@query(f"""WITH {_HEAD3}, m AS (SELECT id, {_TURN[0]} * x + {_TURN[1]} * y + {_TURN[2]} * z + {_MOVE[0]} AS x, {_TURN[3]} * x + {_TURN[4]} * y + {_TURN[5]} * z + ({_MOVE[1]}) AS y, {_TURN[6]} * x + {_TURN[7]} * y + {_TURN[8]} * z + {_MOVE[2]} AS z FROM mi)
SELECT m.id AS micro_id, ma.id AS macro_id, round(-sqrt((m.x - ma.x) ** 2 + (m.y - ma.y) ** 2 + (m.z - ma.z) ** 2), 6) AS similarity FROM m, ma
QUALIFY row_number() OVER (PARTITION BY m.id ORDER BY (m.x - ma.x) ** 2 + (m.y - ma.y) ** 2 + (m.z - ma.z) ** 2, ma.id) = 1""")
def fake_match(spark, sf):
    return matching.transformed_distance(*_vectors(spark, sf), _TURN, _MOVE).withColumn("similarity", _r("similarity"))


@query(f"""WITH {_HEAD3}, a AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM mi), b AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM ma)
SELECT a.id AS micro_id, b.id AS macro_id, 100.0::DOUBLE AS similarity FROM a JOIN b USING (k) WHERE k <= trunc(0.25 * least((SELECT count(*) FROM mi), (SELECT count(*) FROM ma)))""")
def positional_match(spark, sf):
    return matching.positional(*_vectors(spark, sf), 0.25)


@query("""SELECT label, round(avg(CAST(embedding[1] AS DOUBLE)), 9) AS cx, round(avg(CAST(embedding[2] AS DOUBLE)), 9) AS cy, round(avg(CAST(embedding[3] AS DOUBLE)), 9) AS cz,
round(var_pop(CAST(embedding[1] AS DOUBLE)) + var_pop(CAST(embedding[2] AS DOUBLE)) + var_pop(CAST(embedding[3] AS DOUBLE)), 9) AS spread FROM embeddings GROUP BY 1""")
def centroid_variance(spark, sf):
    e = _t(spark, sf, "embeddings").select("label", *(F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate("xyz")))
    return e.groupBy("label").agg(*(_r(F.avg(c), 9).alias(f"c{c}") for c in "xyz"), _r(F.var_pop("x") + F.var_pop("y") + F.var_pop("z"), 9).alias("spread"))


_COV = ", ".join(f"round(covar_samp({a}, {b}), 9) AS c{a}{b}" for a, b in ("xx", "yy", "zz", "xy", "xz", "yz"))


@query(f"WITH {_HEAD3} SELECT label, {_COV}, count(*) AS n FROM e GROUP BY 1")
def cov3(spark, sf):
    e = _t(spark, sf, "embeddings").select("label", *(F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate("xyz")))
    out = features.covariance3(e, ["label"])
    return out.select("label", *(_r(c, 9).alias(c) for c in out.columns[1:-1]), "n")


@query(f"""SELECT {", ".join(f"round(covar_pop(CAST(embedding[{i}] AS DOUBLE), CAST(embedding[{j}] AS DOUBLE)) * count(*), 6) AS h{'xyz'[i - 1]}{'xyz'[j - 4]}" for i in (1, 2, 3) for j in (4, 5, 6))}, count(*) AS n_pairs FROM embeddings""")
def cross_covariance(spark, sf):
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    pairs = _t(spark, sf, "embeddings").select(*(at(k).alias(f"m{c}") for k, c in enumerate("xyz")), *(at(3 + k).alias(f"n{c}") for k, c in enumerate("xyz")))
    out = transforms.cross_covariance(pairs)
    return out.select(*(_r(f"h{a}{b}").alias(f"h{a}{b}") for a in "xyz" for b in "xyz"), "n_pairs")


@query(f"""WITH {_HEAD3}, p AS (SELECT mi.id AS ref, ma.label AS bin, sqrt((mi.x - ma.x) ** 2 + (mi.y - ma.y) ** 2 + (mi.z - ma.z) ** 2) AS d FROM mi, ma)
SELECT ref, {", ".join(f"round(var_pop(d) FILTER (bin = {k}), 9) AS b{k}" for k in range(5, 10))} FROM p GROUP BY 1""")
def shell_variance_pivot(spark, sf):
    e = _t(spark, sf, "embeddings").select("vec_id", "label", F.array(*(F.get("embedding", F.lit(k)).cast("double") for k in range(3))).alias("f"))
    out = diagnostics.shell_variances(e.filter("label < 5").select(F.col("vec_id").alias("ref"), "f"), e.filter("label >= 5").select(F.col("label").alias("bin"), "f"), range(5, 10), 3)
    return out.select("ref", *(_r(f"b{k}", 9).alias(f"b{k}") for k in range(5, 10)))


# ---------------------------------------------------------------------------------------------------- rigid transforms

_P = "(SELECT c_custkey, c_acctbal / 100 AS x, CAST(c_nationkey AS DOUBLE) AS y, c_custkey / 10.0 AS z FROM customer)"


def _customers(spark, sf) -> DataFrame:
    return _t(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").cast("double").alias("y"), (F.col("c_custkey") / 10.0).alias("z"))


def _rigid_sql(r, t, cols=("x", "y", "z")) -> list[str]:
    return [f"({r[3 * i]}) * {cols[0]} + ({r[3 * i + 1]}) * {cols[1]} + ({r[3 * i + 2]}) * {cols[2]} + ({t[i]})" for i in range(3)]


@query(f"SELECT c_custkey, round({_rigid_sql(_TURN, _MOVE)[0]}, 6) AS x, round({_rigid_sql(_TURN, _MOVE)[1]}, 6) AS y, round({_rigid_sql(_TURN, _MOVE)[2]}, 6) AS z FROM {_P} p")
def rigid_apply(spark, sf):
    return _customers(spark, sf).select("c_custkey", *(_r(v).alias(c) for v, c in zip(E.apply_rigid(_TURN, _MOVE, E.xyz()), "xyz")))


_SUPPLIERS = "s AS (SELECT s_suppkey AS id, (s_suppkey % 7) * 0.02 AS ax, (s_suppkey % 5) * 0.03 AS ay, (s_suppkey % 11) * 0.01 AS az, s_nationkey * 0.1 AS tx, (s_suppkey % 13) * 0.05 AS ty, s_acctbal / 5000 AS tz FROM supplier)"
_EULER = """cos(ay) * cos(az) AS r0, -cos(ay) * sin(az) AS r1, sin(ay) AS r2,
sin(ax) * sin(ay) * cos(az) + cos(ax) * sin(az) AS r3, -sin(ax) * sin(ay) * sin(az) + cos(ax) * cos(az) AS r4, -sin(ax) * cos(ay) AS r5,
-cos(ax) * sin(ay) * cos(az) + sin(ax) * sin(az) AS r6, cos(ax) * sin(ay) * sin(az) + sin(ax) * cos(az) AS r7, cos(ax) * cos(ay) AS r8"""
_TRANSFORMS = f"{_SUPPLIERS}, tr AS (SELECT id, {_EULER}, tx AS t0, ty AS t1, tz AS t2 FROM s)"


def _supplier_transforms(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    r = E.euler((k % 7) * 0.02, (k % 5) * 0.03, (k % 11) * 0.01)
    return _t(spark, sf, "supplier").select(k.alias("id"), F.array(*r).alias("r"), F.array(F.col("s_nationkey") * 0.1, (k % 13) * 0.05, F.col("s_acctbal") / 5000).alias("t"))


def _out(df: DataFrame) -> DataFrame:
    return df.select("id", *(_r(F.get("r", F.lit(i))).alias(f"r{i}") for i in range(9)), *(_r(F.get("t", F.lit(i))).alias(f"t{i}") for i in range(3)))


_ROUND12 = ", ".join(f"round({c}, 6) AS {c}" for c in [f"r{i}" for i in range(9)] + ["t0", "t1", "t2"])


@query(f"WITH {_TRANSFORMS} SELECT id, {_ROUND12} FROM tr")
def rotation_from_angles(spark, sf):
    return _out(_supplier_transforms(spark, sf))


@query(f"""WITH {_TRANSFORMS} SELECT id, {", ".join(f"round(r{3 * j + i}, 6) AS r{3 * i + j}" for i in range(3) for j in range(3))}, {", ".join(f"round(-(r{i} * t0 + r{3 + i} * t1 + r{6 + i} * t2), 6) AS t{i}" for i in range(3))} FROM tr""")
def rigid_inverse(spark, sf):
    return _out(transforms.inverted(_supplier_transforms(spark, sf)))


@query(f"""WITH {_TRANSFORMS} SELECT a.id, {", ".join(f"round({' + '.join(f'b.r{3 * i + k} * a.r{3 * k + j}' for k in range(3))}, 6) AS r{3 * i + j}" for i in range(3) for j in range(3))},
{", ".join(f"round({' + '.join(f'b.r{3 * i + k} * a.t{k}' for k in range(3))} + b.t{i}, 6) AS t{i}" for i in range(3))} FROM tr a JOIN tr b ON b.id = a.id + 1""")
def rigid_compose(spark, sf):
    a = _supplier_transforms(spark, sf)
    b = a.select((F.col("id") - 1).alias("id"), F.col("r").alias("r2"), F.col("t").alias("t2"))
    pair = lambda r, t: (E.elements(F.col(r), 9), E.elements(F.col(t), 3))
    r, t = E.compose(pair("r", "t"), pair("r2", "t2"))
    return _out(a.join(b, "id").select("id", F.array(*r).alias("r"), F.array(*t).alias("t")))


_STEP = ", ".join(f"{' + '.join(f'b.r{3 * i + k} * c.r{3 * k + j}' for k in range(3))}" for i in range(3) for j in range(3))
_SHIFT = ", ".join(f"{' + '.join(f'b.r{3 * i + k} * c.t{k}' for k in range(3))} + b.t{i}" for i in range(3))


@query(f"""WITH RECURSIVE {_TRANSFORMS}, b AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM tr),
c(n, {", ".join(f"r{i}" for i in range(9))}, t0, t1, t2) AS (SELECT 0::BIGINT, {", ".join(f"{float(i % 4 == 0)}::DOUBLE" for i in range(9))}, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE UNION ALL
SELECT b.n, {_STEP}, {_SHIFT} FROM c JOIN b ON b.n = c.n + 1)
SELECT 0 AS id, {_ROUND12} FROM c ORDER BY n DESC LIMIT 1""")
def transform_chain(spark, sf):
    """The supplier transforms applied one after another: an ordered fold over matrices."""
    steps = _supplier_transforms(spark, sf).select(F.col("id").alias("n"), "r", "t")
    return _out(transforms.chained(steps).withColumn("id", F.lit(0)))


_G = Geometry((0.5, 0.4, 0.25), (9, 11, 13))


def _closed_sql(g: Geometry) -> str:
    s, n, m = metric.axis_sums(g), g.count, [b / 2 for b in g.bounds]
    shift = [f"(a.t{i} - b.t{i} + {' + '.join(f'(a.r{3 * i + j} - b.r{3 * i + j}) * {m[j]}' for j in range(3))})" for i in range(3)]
    turn = " + ".join(f"{s[i]} * (a.r{i} * b.r{i} + a.r{3 + i} * b.r{3 + i} + a.r{6 + i} * b.r{6 + i})" for i in range(3))
    return f"({2 * sum(s)} + {n} * ({' + '.join(f'{x} * {x}' for x in shift)}) - 2 * ({turn}))"


_PAIRS = f"WITH {_TRANSFORMS}, ab AS (SELECT a.id, {_closed_sql(_G)} AS d FROM tr a JOIN tr b ON b.id = a.id + 1)"


def _next_pairs(spark, sf) -> DataFrame:
    a = _supplier_transforms(spark, sf)
    flat = lambda s, off: a.select((F.col("id") - off).alias("id"), *(F.get("r", F.lit(i)).alias(f"{s}_r{i}") for i in range(9)), *(F.get("t", F.lit(i)).alias(f"{s}_t{i}") for i in range(3)))
    return flat("a", 0).join(flat("b", 1), "id")


@query(f"{_PAIRS} SELECT id, round(d, 6) AS d, round(sqrt(abs(d) / {_G.count}) / {_G.diagonal}, 6) AS root_relative, round(d / {_G.count}, 6) AS mean_relative FROM ab")
def rigid_metric_closed(spark, sf):
    d = _next_pairs(spark, sf).select("id", density.pair_distance(_G, "a", "b").alias("d"))
    return d.select("id", _r("d").alias("d"), _r(metric.root_relative(_G, F.col("d"))).alias("root_relative"), _r(metric.mean_relative(_G, F.col("d"))).alias("mean_relative"))


def _vertices_sql(g: Geometry) -> str:
    return f"v AS (SELECT i * {g.spacing[0]} AS x, j * {g.spacing[1]} AS y, k * {g.spacing[2]} AS z FROM generate_series(0, {g.dims[0] - 1}) a(i), generate_series(0, {g.dims[1] - 1}) b(j), generate_series(0, {g.dims[2] - 1}) c(k))"


@query(f"""WITH {_TRANSFORMS}, {_vertices_sql(_G)} SELECT a.id, round(sum({" + ".join(f"((a.r{3 * i} - b.r{3 * i}) * x + (a.r{3 * i + 1} - b.r{3 * i + 1}) * y + (a.r{3 * i + 2} - b.r{3 * i + 2}) * z + a.t{i} - b.t{i}) ** 2" for i in range(3))}), 6) AS d
FROM tr a JOIN tr b ON b.id = a.id + 1 CROSS JOIN v GROUP BY 1""")
def rigid_metric_brute(spark, sf):
    """Vertex by vertex; rigid_metric_closed and rigid_metric_moments must agree with it."""
    v = lattice(spark, _G).select("x", "y", "z")
    pairs = _next_pairs(spark, sf).crossJoin(F.broadcast(v))
    parts = lambda s: ([F.col(f"{s}_r{i}") for i in range(9)], [F.col(f"{s}_t{i}") for i in range(3)])
    gap = E.sub(E.apply_rigid(*parts("a"), E.xyz()), E.apply_rigid(*parts("b"), E.xyz()))
    return pairs.groupBy("id").agg(_r(F.sum(E.dot(gap, gap))).alias("d"))


@query(f"{_PAIRS} SELECT id, round(d, 6) AS d FROM ab")
def rigid_metric_moments(spark, sf):
    pairs = ("xx", "yy", "zz", "xy", "xz", "yz")
    m = lattice(spark, _G).agg(F.count("*").cast("double").alias("n"), *(F.sum(c).alias(f"q{c}") for c in "xyz"), *(F.sum(F.col(p[0]) * F.col(p[1])).alias(f"q{p}") for p in pairs))
    rows = _next_pairs(spark, sf).crossJoin(F.broadcast(m))
    parts = lambda s: ([F.col(f"{s}_r{i}") for i in range(9)], [F.col(f"{s}_t{i}") for i in range(3)])
    d = metric.from_moments(F.col("n"), [F.col(f"q{c}") for c in "xyz"], [F.col(f"q{p}") for p in pairs], *parts("a"), *parts("b"))
    return rows.select("id", _r(d).alias("d"))


_SPREAD = 0.002
_RADIUS = math.sqrt(math.log(0.1) / -_SPREAD)
_DENSE = f"""WITH {_TRANSFORMS}, ab AS (SELECT a.id, a.id = b.id AS same, sqrt(abs({_closed_sql(_G)})) AS delta FROM tr a, tr b),
rho AS (SELECT id, sum(exp(-{_SPREAD} * delta * delta)) AS density FROM ab WHERE same OR delta < {_RADIUS!r} GROUP BY 1)"""


@query(f"{_DENSE} SELECT id, round(density, 6) AS density FROM rho")
def transform_density(spark, sf):
    return density.densities(_supplier_transforms(spark, sf), _G, _SPREAD).select("id", _r("density").alias("density"))


@query(f"{_DENSE} SELECT id, {_ROUND12}, round(density, 6) AS density FROM rho JOIN tr USING (id) ORDER BY rho.density DESC, id LIMIT 1")
def density_vote(spark, sf):
    won = density.vote(_supplier_transforms(spark, sf), _G, _SPREAD)
    return _out(won).join(won.select("id", _r("density").alias("density")), "id")


@query(f"""WITH {_TRANSFORMS}, ab AS (SELECT a.id, b.id AS other, sqrt(abs({_closed_sql(_G)})) AS delta FROM tr a, tr b),
m AS (SELECT ln(2) / greatest(median(delta), {1e-6 * _G.diagonal * math.sqrt(_G.count)!r}) ** 2 AS spread FROM ab WHERE id < other),
rho AS (SELECT id, sum(exp(-spread * delta * delta)) AS density FROM ab, m WHERE id = other OR delta < sqrt(ln(0.1) / -spread) GROUP BY 1)
SELECT id, {", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in (*(f"r{i}" for i in range(9)), "t0", "t1", "t2"))} FROM rho JOIN tr USING (id) ORDER BY rho.density DESC, id LIMIT 1""")
def density_vote_derived_spread(spark, sf):
    """The spread from the median of the pairwise distances of all candidates."""
    return _out(density.vote(_supplier_transforms(spark, sf), _G, median_sample=None))


# -------------------------------------------------------------------------------------------------- synthetic volumes


def _grid_sql(g: Geometry) -> str:
    a, b, c = g.dims
    return f"(SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(k AS INT) AS k, i * {g.spacing[0]} AS x, j * {g.spacing[1]} AS y, k * {g.spacing[2]} AS z FROM generate_series(0, {a - 1}) a(i), generate_series(0, {b - 1}) b(j), generate_series(0, {c - 1}) c(k))"


_SPHERE = "least(sqrt((x - 2.5) ** 2 + (y - 2.5) ** 2 + (z - 2.5) ** 2) / 2.5, 1) * 1000"
_ELL_Q = "(x * x / 900.0 + y * y / 400.0 + z * z / 225.0)"
_ELL = f"CASE WHEN {_ELL_Q} <= 1 THEN 4000 * {_ELL_Q} ELSE 5000.0 END"
_SHRINK = 10


_BOX = mocks.sphere().geometry.bounds
_PART = "(SELECT p_partkey AS id, (p_partkey * 37 % 1000) / 1000.0 * 4.8 AS x, (p_partkey * 91 % 1009) / 1009.0 * 4.8 AS y, (p_partkey * 53 % 997) / 997.0 * 4.8 AS z FROM part)"


def _part_points(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    return _t(spark, sf, "part").select(k.alias("id"), *(((k * m % n) / float(n) * 4.8).alias(c) for c, m, n in (("x", 37, 1000), ("y", 91, 1009), ("z", 53, 997))))


def _spots_sql(g: Geometry) -> str:
    """A place in the box for each part."""
    return f"(SELECT id, {', '.join(f'{c} * {b / 4.8!r} AS {c}' for b, c in zip(g.bounds, 'xyz'))} FROM {_PART} p)"


def _at_parts(fld, spark, sf) -> DataFrame:
    spots = _part_points(spark, sf).select("id", *((F.col(c) * (b / 4.8)).alias(c) for b, c in zip(fld.geometry.bounds, "xyz")))
    return fld.attach(spots, "value").select("id", _r("value").alias("value"))


@query(f"SELECT id, round({_SPHERE}, 6) AS value FROM {_spots_sql(mocks.sphere().geometry)} g")
def mock_sphere(spark, sf):
    return _at_parts(mocks.sphere(), spark, sf)


@query(f"SELECT id, round({_ELL}, 6) AS value FROM {_spots_sql(Geometry((1.0,) * 3, (35, 25, 17)))} g")
def mock_ellipsoid(spark, sf):
    return _at_parts(mocks.ellipsoid(30, 20, 15, (35, 25, 17)), spark, sf)


def _spheres_sql() -> str:
    each = []
    for cx, cy, cz, r in mocks.sphere_row(_SHRINK):
        d, rim = f"sqrt((x - {cx}) ** 2 + (y - {cy}) ** 2 + (z - {cz}) ** 2)", 10 / _SHRINK
        each.append(f"nullif(CASE WHEN {d} < {r - rim} THEN 1.0 WHEN {d} < {r} THEN ({r} - {d}) / {rim} ELSE 0.0 END, 0)")
    return f"coalesce({', '.join(each)}, 0.0) * 1000"


@query(f"SELECT id, round({_spheres_sql()}, 6) AS value FROM {_spots_sql(mocks.spheres(_SHRINK).geometry)} g")
def mock_spheres8(spark, sf):
    return _at_parts(mocks.spheres(_SHRINK), spark, sf)


@query(f"SELECT id, round(x + 2 * y + 4 * z, 6) AS value FROM {_spots_sql(mocks.small().geometry)} g")
def mock_small(spark, sf):
    return _at_parts(mocks.small(), spark, sf)


_CYL = Geometry((2.5,) * 3, (40, 40, 20))


@query(f"SELECT id, CASE WHEN sqrt((x - 50.0) ** 2 + (y - 50.0) ** 2) < 50 THEN 0.0 ELSE 127.0 END::DOUBLE AS value FROM {_spots_sql(_CYL)} g")
def mock_cylinder(spark, sf):
    return _at_parts(mocks.cylinder("z", g=_CYL), spark, sf)


_SEG = Geometry((0.25,) * 3, (14, 14, 14))
_SEG_T = [1.0, 0.5, 0.75]
_SEG_AT = _rigid_sql(_TURN, _SEG_T)


def _segment():
    return mocks.segment(mocks.sphere(), _TURN, _SEG_T, _SEG)


@query(f"""WITH g AS (SELECT id, {_SEG_AT[0]} AS x, {_SEG_AT[1]} AS y, {_SEG_AT[2]} AS z FROM {_spots_sql(_SEG)} q)
SELECT id, round(CASE WHEN x BETWEEN 0 AND {mocks.sphere().geometry.bounds[0]!r} AND y BETWEEN 0 AND {mocks.sphere().geometry.bounds[1]!r} AND z BETWEEN 0 AND {mocks.sphere().geometry.bounds[2]!r} THEN {_SPHERE} ELSE 5000.0 END, 6) AS value FROM g""")
def mock_segment(spark, sf):
    return _at_parts(_segment(), spark, sf)


_PD = Geometry((0.5,) * 3, (12, 10, 8))
_PD_SQL = "(SELECT r_regionkey * 1.1 AS a, (r_regionkey * 7 % 5) * 0.9 AS b, (r_regionkey * 3 % 4) * 0.8 AS e FROM region)"


@query(f"""WITH g AS (SELECT i, j, k, sum(sqrt((x - a) ** 2 + (y - b) ** 2 + (z - e) ** 2)) AS raw FROM {_grid_sql(_PD)} q, {_PD_SQL} r GROUP BY 1, 2, 3)
SELECT i, j, k, round((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()), 6) AS value FROM g""")
def mock_point_distance(spark, sf):
    """Distances to a point for each region (a table of a handful of rows)."""
    k = F.col("r_regionkey")
    points = _t(spark, sf, "region").select((k * 1.1).alias("a"), ((k * 7 % 5) * 0.9).alias("b"), ((k * 3 % 4) * 0.8).alias("e")).collect()
    return mocks.point_distances(spark, _PD, [tuple(p) for p in points]).select("i", "j", "k", _r("value").alias("value"))


def _grid(spark) -> GridField:
    """The sphere volume, truncated to whole numbers, as stored voxels."""
    fld = mocks.sphere()
    return GridField(fld.geometry, fld.voxels(spark).select(F.col("i").alias("x"), F.col("j").alias("y"), F.col("k").alias("z"), F.col("value").cast("int").alias("v")))


_STORED = f"vox AS (SELECT i, j, k, trunc({_SPHERE}) AS v FROM {_grid_sql(mocks.sphere().geometry)} g)"


@query(f"""WITH {_STORED}, f AS (SELECT id, least(greatest(x / 0.2, 0), 24) AS fx, least(greatest(y / 0.2, 0), 24) AS fy, least(greatest(z / 0.2, 0), 24) AS fz FROM {_PART} p),
c AS (SELECT id, fx, fy, fz, a.o AS ox, b.o AS oy, d.o AS oz FROM f, (VALUES (0), (1)) a(o), (VALUES (0), (1)) b(o), (VALUES (0), (1)) d(o)),
w AS (SELECT id, CAST(least(floor(fx) + ox, 24) AS INT) AS i, CAST(least(floor(fy) + oy, 24) AS INT) AS j, CAST(least(floor(fz) + oz, 24) AS INT) AS k,
 (CASE WHEN ox = 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) * (CASE WHEN oy = 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END) * (CASE WHEN oz = 1 THEN fz - floor(fz) ELSE 1 - fz + floor(fz) END) AS w FROM c)
SELECT id, round(sum(w * v), 6) AS value FROM w JOIN vox USING (i, j, k) GROUP BY 1""")
def trilinear_sample(spark, sf):
    return _grid(spark).attach(_part_points(spark, sf), "value").select("id", _r("value").alias("value"))


_BY_PART = "c AS (SELECT CAST(floor(max(p_partkey) / 80.0) AS INT) + 1 AS nz FROM part), spot AS (SELECT CAST(i AS INT) AS x, CAST(j AS INT) AS y, CAST(k AS INT) AS z FROM c, generate_series(0, 9) a(i), generate_series(0, 7) b(j), generate_series(0, nz - 1) d(k))"


def _part_volume(spark, sf, kind: str, value) -> tuple[Geometry, DataFrame]:
    """A volume of 10 x 8 samples a slab, one for each part, written by the data source and read back by it."""
    n = F.col("p_partkey")
    part = _t(spark, sf, "part")
    slabs = (part.agg(F.max("p_partkey")).head()[0] or 0) // 80 + 1
    g = Geometry((0.5, 0.25, 1.0), (10, 8, slabs))
    voxels = part.select((n % 10).alias("x"), (F.floor(n / 10) % 8).alias("y"), F.floor(n / 80).alias("z"), value.alias("v"))
    folder = new_path(spark, "volume")
    os.makedirs(volumes.local_path(folder))
    volumes.save(voxels, g, f"{folder}/part.mhd", kind)
    return volumes.load(spark, f"{folder}/part.mhd")


@query(f"""WITH {_BY_PART} SELECT x, y, z, CAST(trunc(least(coalesce(p_retailprice * 40, 0), 65535)) AS INT) AS v FROM spot LEFT JOIN part ON p_partkey = x + 10 * y + 80 * z""")
def volume_16_bit(spark, sf):
    return _part_volume(spark, sf, "MET_USHORT", F.col("p_retailprice") * 40)[1].drop("vol_id")


@query(f"""WITH {_BY_PART} SELECT x, y, z, CAST(least(coalesce(p_size * 7, 0), 255) AS INT) AS v FROM spot LEFT JOIN part ON p_partkey = x + 10 * y + 80 * z""")
def volume_8_bit(spark, sf):
    return _part_volume(spark, sf, "MET_UCHAR", F.col("p_size") * 7)[1].drop("vol_id")


def _part_grid(spark, sf) -> GridField:
    g, table = _part_volume(spark, sf, "MET_UCHAR", F.col("p_size") * 7)
    return GridField(g, table)


_PLACES = "(SELECT s_suppkey AS id, (s_suppkey * 37 % 1000) / 1000.0 * 6 - 0.5 AS x, (s_suppkey * 91 % 1009) / 1009.0 * 2 AS y, (s_suppkey * 53 % 997) / 997.0 * (nz - 1) AS z FROM supplier, c)"
_MIXED = """c8 AS (SELECT id, fx, fy, fz, a.o AS ox, b.o AS oy, d.o AS oz FROM f, (VALUES (0), (1)) a(o), (VALUES (0), (1)) b(o), (VALUES (0), (1)) d(o)),
w AS (SELECT id, CAST(least(floor(fx) + ox, 9) AS INT) AS x, CAST(least(floor(fy) + oy, 7) AS INT) AS y, CAST(least(floor(fz) + oz, (SELECT nz FROM c) - 1) AS INT) AS z,
 (CASE WHEN ox = 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) * (CASE WHEN oy = 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END) * (CASE WHEN oz = 1 THEN fz - floor(fz) ELSE 1 - fz + floor(fz) END) AS w FROM c8)
SELECT id, round(sum(w * v), 6) AS value FROM w JOIN vox USING (x, y, z) GROUP BY 1"""


@query(f"""WITH {_BY_PART}, vox AS (SELECT x, y, z, least(coalesce(p_size * 7, 0), 255) AS v FROM spot LEFT JOIN part ON p_partkey = x + 10 * y + 80 * z),
f AS (SELECT id, least(greatest(x / 0.5, 0), 9) AS fx, least(greatest(y / 0.25, 0), 7) AS fy, least(greatest(z, 0), (SELECT nz FROM c) - 1) AS fz FROM {_PLACES} p), {_MIXED}""")
def volume_samples(spark, sf):
    """Places between the samples of a stored volume that a table filled."""
    fld, k = _part_grid(spark, sf), F.col("s_suppkey")
    top = float(fld.geometry.dims[2] - 1)
    places = _t(spark, sf, "supplier").select(k.alias("id"), ((k * 37 % 1000) / 1000.0 * 6 - 0.5).alias("x"), ((k * 91 % 1009) / 1009.0 * 2).alias("y"), ((k * 53 % 997) / 997.0 * top).alias("z"))
    return fld.attach(places, "value").select("id", _r("value").alias("value"))


@query(f"""WITH {_BY_PART}, vox AS (SELECT x, y, z, least(coalesce(p_size * 7, 0), 255) AS v FROM spot LEFT JOIN part ON p_partkey = x + 10 * y + 80 * z),
t AS (SELECT i + 20 * j + 300 * k AS id, i * 0.3 + 0.4 AS x, j * 0.1 + 0.05 AS y, k * 0.7 - 0.2 AS z FROM generate_series(0, 19) a(i), generate_series(0, 14) b(j), generate_series(0, 9) d(k)),
f AS (SELECT id, least(greatest(x, 0), 4.5) / 0.5 AS fx, least(greatest(y, 0), 1.75) / 0.25 AS fy, least(greatest(z, 0), (SELECT nz FROM c) - 1) AS fz FROM t), {_MIXED}""")
def volume_resampled(spark, sf):
    """A stored volume on a finer grid, moved."""
    out = metaimage.resampled(spark, _part_grid(spark, sf), Geometry((0.3, 0.1, 0.7), (20, 15, 10)), [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0], [0.4, 0.05, -0.2])
    return out.select((F.col("i") + 20 * F.col("j") + 300 * F.col("k")).cast("long").alias("id"), _r("value").alias("value"))


_FILLED = "vox AS (SELECT x, y, z, least(coalesce(p_size * 7, 0), 255) AS v FROM spot LEFT JOIN part ON p_partkey = x + 10 * y + 80 * z)"


def _bricks(spark, sf) -> bricks.BrickField:
    grid = _part_grid(spark, sf)
    return bricks.BrickField.of(grid.geometry, grid.table, side=4)


def _supplier_places(spark, sf, top: float) -> DataFrame:
    k = F.col("s_suppkey")
    return _t(spark, sf, "supplier").select(k.alias("id"), ((k * 37 % 1000) / 1000.0 * 6 - 0.5).alias("x"), ((k * 91 % 1009) / 1009.0 * 2).alias("y"), ((k * 53 % 997) / 997.0 * top).alias("z"))


@query(f"""WITH {_BY_PART}, {_FILLED}, f AS (SELECT id, least(greatest(x / 0.5, 0), 9) AS fx, least(greatest(y / 0.25, 0), 7) AS fy, least(greatest(z, 0), (SELECT nz FROM c) - 1) AS fz FROM {_PLACES} p), {_MIXED}""")
def brick_samples(spark, sf):
    """Places between the samples of a stored volume, each met by one join with its brick."""
    fld = _bricks(spark, sf)
    return fld.attach(_supplier_places(spark, sf, fld.geometry.bounds[2])).select("id", _r("value").alias("value"))


_NINE = ", ".join(f"(VALUES (-1), (0), (1)) {n}(o)" for n in ("a", "b", "e"))


@query(f"""WITH {_BY_PART}, {_FILLED}, f AS (SELECT id * 27 + a.o * 9 + b.o * 3 + e.o + 13 AS id, least(greatest(x / 0.5 + a.o, 0), 9) AS fx, least(greatest(y / 0.25 + b.o, 0), 7) AS fy, least(greatest(z + e.o, 0), (SELECT nz FROM c) - 1) AS fz FROM {_PLACES} p, {_NINE}),
s AS (WITH {_MIXED.replace("round(sum(w * v), 6)", "sum(w * v)")}) SELECT id // 27 AS id, round(var_pop(value), 6) AS variance FROM s GROUP BY 1""")
def brick_variance(spark, sf):
    """The variance of the 27 values around each place, out of one brick."""
    fld = _bricks(spark, sf)
    return sampling.with_variance(_supplier_places(spark, sf, fld.geometry.bounds[2]), fld).select("id", _r("variance").alias("variance"))


def _slope_sum(axis: int) -> str:
    of = lambda n, k, a: f"{n}.p{k} * {n}.{'s' if a == axis else 'q'}{k}"
    return " + ".join(f"{of('a', i, 0)} * {of('b', j, 1)} * {of('e', k, 2)}" for i, j, k in itertools.product(range(3), repeat=3) if i + j + k <= 2 and (i, j, k)[axis])


@query(f"""WITH {_BY_PART}, {_FILLED}, ax AS (SELECT 0 AS axis, 0.5::DOUBLE AS s, 10 AS d UNION ALL SELECT 1, 0.25, 8 UNION ALL SELECT 2, 1.0, nz FROM c),
l AS (SELECT axis, CAST(n AS INT) AS n, CAST(o AS INT) AS o, o * s AS u, exp(ln(0.4) / 2 / s * (o * s) ** 2) AS w FROM ax, generate_series(0, d - 1) t(n), generate_series(-3, 3) r(o) WHERE n + o BETWEEN 0 AND d - 1),
m AS (SELECT axis, n, sum(w) AS m0, sum(w * u) AS m1, sum(w * u ** 2) AS m2, sum(w * u ** 3) AS m3, sum(w * u ** 4) AS m4 FROM l GROUP BY 1, 2),
h AS (SELECT *, m1 / m0 AS mid, sqrt(m2 - m1 * m1 / m0) AS n1, (m3 - m1 * m2 / m0) / (m2 - m1 * m1 / m0) AS tilt, sqrt(m4 - m2 * m2 / m0 - (m3 - m1 * m2 / m0) ** 2 / (m2 - m1 * m1 / m0)) AS n2 FROM m),
k AS (SELECT axis, n, o, w / sqrt(m0) AS p0, w * (u - mid) / n1 AS p1, w * (u * u - m2 / m0 - tilt * (u - mid)) / n2 AS p2, 1 / sqrt(m0) AS q0, -mid / n1 AS q1, (tilt * mid - m2 / m0) / n2 AS q2, 1 / n1 AS s1, -tilt / n2 AS s2 FROM l JOIN h USING (axis, n))
SELECT a.n AS x, b.n AS y, e.n AS z, {", ".join(f"round(sum(v * ({_slope_sum(i)})), 4) AS g{c}" for i, c in enumerate("xyz"))}
FROM vox JOIN k a ON a.axis = 0 AND vox.x = a.n + a.o JOIN k b ON b.axis = 1 AND vox.y = b.n + b.o JOIN k e ON e.axis = 2 AND vox.z = e.n + e.o GROUP BY 1, 2, 3""")
def local_slopes(spark, sf):
    """The gradient at every sample of a stored volume, of a quadric fitted to the box around it."""
    return _bricks(spark, sf).slopes().select("x", "y", "z", *(_r(f"g{c}", 4).alias(f"g{c}") for c in "xyz"))


_OFF = "(VALUES (-0.2), (0.0), (0.2))"
_VAR27 = f"""n AS (SELECT id, px, py, pz, least(greatest(px + a.o, 0), {_BOX[0]!r}) AS x, least(greatest(py + b.o, 0), {_BOX[1]!r}) AS y, least(greatest(pz + c.o, 0), {_BOX[2]!r}) AS z
 FROM (SELECT id, x AS px, y AS py, z AS pz FROM {_PART} q) p, {_OFF} a(o), {_OFF} b(o), {_OFF} c(o)),
vr AS (SELECT id, any_value(px) AS x, any_value(py) AS y, any_value(pz) AS z, var_pop({_SPHERE}) AS variance FROM n GROUP BY 1)"""


@query(f"WITH {_VAR27} SELECT id, round(variance, 6) AS variance FROM vr")
def box27_variance(spark, sf):
    return sampling.with_variance(_part_points(spark, sf), mocks.sphere()).select("id", _r("variance").alias("variance"))


@query(f"WITH {_VAR27} SELECT id, round(variance, 6) AS variance FROM vr ORDER BY vr.variance DESC, id LIMIT 50")
def variance_topn(spark, sf):
    return sampling.top_variance(_part_points(spark, sf), mocks.sphere(), 50).select("id", _r("variance").alias("variance"))


@query(f"WITH {_VAR27} SELECT id, round(variance, 6) AS variance FROM vr WHERE vr.variance >= 1000 ORDER BY id LIMIT 100")
def variance_filter(spark, sf):
    return sampling.variance_threshold(_part_points(spark, sf), mocks.sphere(), 1000.0, 100).select("id", _r("variance").alias("variance"))


@query(f"""WITH {_VAR27}, c AS (SELECT *, CAST(floor(x / 1.2) + 4 * floor(y / 1.2) + 16 * floor(z / 1.2) AS BIGINT) AS cell FROM vr),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY cell ORDER BY variance DESC, id) = 1)
SELECT cell, id, round(variance, 6) AS variance FROM b WHERE b.variance >= 100 ORDER BY b.variance DESC, cell LIMIT 40""")
def segmented_argmax(spark, sf):
    cell = sum((F.floor(F.col(c) / 1.2) * m for c, m in (("y", 4), ("z", 16))), F.floor(F.col("x") / 1.2)).cast("long")
    points = _part_points(spark, sf).withColumn("cell", cell)
    return sampling.best_per_cell(points, mocks.sphere(), 40).select("cell", "id", _r("variance").alias("variance"))


@query(f"""WITH s AS (SELECT c_mktsegment, x, y, z, x * 2 - y * 3 + 0.5 * z + sin(x) AS value FROM (SELECT c_mktsegment, c_acctbal / 1000 AS x, (c_custkey * 7 % 101) / 10.0 AS y, (c_custkey * 3 % 89) / 10.0 AS z FROM customer) q),
m AS (SELECT c_mktsegment, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(z, z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz, covar_pop(x, value) AS xv, covar_pop(y, value) AS yv, covar_pop(z, value) AS zv FROM s GROUP BY 1),
d AS (SELECT *, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS det FROM m)
SELECT c_mktsegment, round((xv * (yy * zz - yz * yz) - xy * (yv * zz - yz * zv) + xz * (yv * yz - yy * zv)) / det, 6) AS gx, round((xx * (yv * zz - yz * zv) - xv * (xy * zz - yz * xz) + xz * (xy * zv - yv * xz)) / det, 6) AS gy,
round((xx * (yy * zv - yv * yz) - xy * (xy * zv - yv * xz) + xv * (xy * yz - yy * xz)) / det, 6) AS gz FROM d""")
def linear_gradient_fit(spark, sf):
    k = F.col("c_custkey")
    s = _t(spark, sf, "customer").select("c_mktsegment", (F.col("c_acctbal") / 1000).alias("x"), ((k * 7 % 101) / 10.0).alias("y"), ((k * 3 % 89) / 10.0).alias("z"))
    s = s.withColumn("value", F.col("x") * 2 - F.col("y") * 3 + 0.5 * F.col("z") + F.sin("x"))
    out = features.linear_fit(s, ["c_mktsegment"])
    return out.select("c_mktsegment", *(_r(c).alias(c) for c in ("gx", "gy", "gz")))


_QUAD = [f"(p_size % {m} + 1) * {w}" for m, w in ((7, 0.11), (5, 0.07), (3, 0.13), (4, 0.02), (6, 0.03), (8, 0.01), (9, 0.2), (10, 0.1), (11, 0.05))]


@query(f"""WITH a AS (SELECT p_partkey AS id, {", ".join(f"{q} AS a{i}" for i, q in enumerate(_QUAD))}, (p_partkey % 17) * 0.1 AS x, (p_partkey % 13) * 0.1 AS y, (p_partkey % 19) * 0.1 AS z FROM part),
g AS (SELECT *, 2 * a0 * x + a3 * y + a4 * z + a6 AS gx, 2 * a1 * y + a3 * x + a5 * z + a7 AS gy, 2 * a2 * z + a4 * x + a5 * y + a8 AS gz FROM a),
c AS (SELECT id, gx * gx + gy * gy + gz * gz AS g2,
 (4 * a1 * a2 - a5 * a5) * gx * gx + (4 * a0 * a2 - a4 * a4) * gy * gy + (4 * a0 * a1 - a3 * a3) * gz * gz + 2 * ((a4 * a5 - 2 * a3 * a2) * gx * gy + (a3 * a5 - 2 * a4 * a1) * gx * gz + (a3 * a4 - 2 * a0 * a5) * gy * gz) AS ka,
 2 * a0 * gx * gx + 2 * a1 * gy * gy + 2 * a2 * gz * gz + 2 * (a3 * gx * gy + a4 * gx * gz + a5 * gy * gz) AS hg, 2 * (a0 + a1 + a2) AS tr FROM g),
k AS (SELECT id, ka / (g2 * g2) AS gauss, (hg - g2 * tr) / (2 * pow(g2, 1.5)) AS mean FROM c),
s AS (SELECT *, sqrt(greatest(0, mean * mean - gauss)) AS d FROM k)
SELECT id, round(gauss, 6) AS gauss, round(mean, 6) AS mean, round(2 / pi() * atan2(mean, d), 5) AS shape, round(sqrt(mean * mean + d * d), 6) AS curvedness FROM s""")
def curvature_shape_index(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    coef = [((s % m + 1) * w).alias(f"a{i}") for i, (m, w) in enumerate(((7, 0.11), (5, 0.07), (3, 0.13), (4, 0.02), (6, 0.03), (8, 0.01), (9, 0.2), (10, 0.1), (11, 0.05)))]
    rows = _t(spark, sf, "part").select(k.alias("id"), *coef, *(((k % m) * 0.1).alias(c) for c, m in (("x", 17), ("y", 13), ("z", 19))))
    g, h = E.curvature([F.col(f"a{i}") for i in range(9)], E.xyz())
    rows = rows.select("id", g.alias("gauss"), h.alias("mean"))
    shape, curved = E.shape_index(F.col("gauss"), F.col("mean"))
    return rows.select("id", _r("gauss").alias("gauss"), _r("mean").alias("mean"), _r(shape, 5).alias("shape"), _r(curved).alias("curvedness"))


_STEPS = (0.5, 0.7, 0.3)


@query(f"""SELECT id, {", ".join(f"round(floor({c} / {s} + 0.5) * {s}, 9) AS at_{c}" for c, s in zip("xyz", _STEPS))},
{", ".join(f"CAST(trunc(least({c} / {s}, 4.0)) AS INT) AS below_{c}, CAST(trunc(least((4.8 - {c}) / {s}, 4.0)) AS INT) AS above_{c}" for c, s in zip("xyz", _STEPS))},
round(exp({" + ".join(f"ln(0.4) / 2 / {s} * {c} * {c}" for c, s in zip("xyz", _STEPS))}), 9) AS gauss FROM {_PART} q""")
def lattice_kernels(spark, sf):
    """The nearest lattice point, the steps that fit on both sides of a point, and the kernel of unequal axes."""
    around = [E.extents(F.col(c), 4.8, s, 4) for c, s in zip("xyz", _STEPS)]
    fits = [v.alias(f"{side}_{c}") for c, two in zip("xyz", around) for side, v in zip(("below", "above"), two)]
    return _part_points(spark, sf).select("id", *(_r(E.to_lattice(F.col(c), s), 9).alias(f"at_{c}") for c, s in zip("xyz", _STEPS)), *fits, _r(E.gaussian_by_axis(E.xyz(), _STEPS), 9).alias("gauss"))


@query(f"""WITH p AS (SELECT id, x * 330 AS x FROM {_PART} q) SELECT id, CASE {" ".join(f"WHEN x BETWEEN {cx - r!r} AND {cx + r!r} THEN {i}" for i, (cx, _, _, r) in enumerate(mocks.sphere_row()))} END AS sphere FROM p""")
def sphere_of_place(spark, sf):
    return _part_points(spark, sf).select("id", mocks.sphere_index(F.col("x") * 330).alias("sphere"))


@query(f"""WITH p AS (SELECT id, x, y, z, abs(x) + abs(y) + abs(z) AS s FROM {_PART} q)
SELECT id, round(exp(ln(0.15) / 25 * (x * x + y * y + z * z)), 9) AS gauss, round(CASE WHEN s < 1e-3 THEN 1 ELSE (0.5 / 0.8 * abs(x) + 0.8 / 0.8 * abs(y) + 0.3 / 0.8 * abs(z)) / s END, 9) AS linear,
round(CASE WHEN s = 0 THEN 1 ELSE sqrt(x * x + y * y + z * z) / sqrt((x / 0.5) ** 2 + (y / 0.8) ** 2 + (z / 0.3) ** 2) / 0.8 END, 9) AS elliptical FROM p""")
def sampling_kernels(spark, sf):
    sp = (0.5, 0.8, 0.3)
    return _part_points(spark, sf).select("id", _r(E.gaussian(E.xyz(), 5, 0.15), 9).alias("gauss"), _r(E.linear_weight(E.xyz(), sp), 9).alias("linear"), _r(E.elliptical_weight(E.xyz(), sp), 9).alias("elliptical"))


# ------------------------------------------------------------------------------------------------------------- slices

_W, _H = 64, 48
_CUT = f"cut AS (SELECT CAST(n // {_W} AS INT) AS row, CAST(n % {_W} AS INT) AS col, (n % {_W}) / {_W - 1}.0 * {_BOX[0]!r} AS x, (n // {_W}) / {_H - 1}.0 * {_BOX[1]!r} AS y, 0.4 * {_BOX[2]!r} AS z FROM generate_series(0, {_W * _H - 1}) s(n))"
_ENDS = f"e AS (SELECT min({_SPHERE}) AS lo, max({_SPHERE}) AS hi FROM {_grid_sql(mocks.sphere().geometry)} g)"


def _grey_sql(v: str) -> str:
    return f"CAST(least(greatest(trunc(({v} - lo) / (hi - lo) * 255), 0), 255) AS INT)"


def _cut(spark) -> DataFrame:
    return slices.plane(spark, mocks.sphere().geometry, 0.4, 2, _W, _H)


_SHARE = 0.3719
_STORED_CUT = f"""{_BY_PART}, {_FILLED}, q AS (SELECT n AS id, (n % {_W}) / {_W - 1}.0 * 4.5 AS x, (n // {_W}) / {_H - 1}.0 * 1.75 AS y, {_SHARE}::DOUBLE * (nz - 1) AS z FROM c, generate_series(0, {_W * _H - 1}) s(n)),
f AS (SELECT id, x / 0.5 AS fx, y / 0.25 AS fy, z AS fz FROM q), met AS (WITH {_MIXED.replace("round(sum(w * v), 6)", "sum(w * v)")}),
cut AS (SELECT CAST(id // {_W} AS INT) AS row, CAST(id % {_W} AS INT) AS col, x, y, z, value FROM q JOIN met USING (id)), e AS (SELECT min(v) AS lo, max(v) AS hi FROM vox)"""


def _stored_cut(spark, sf) -> tuple[GridField, DataFrame]:
    fld = _part_grid(spark, sf)
    return fld, slices.plane(spark, fld.geometry, _SHARE, 2, _W, _H)


def _stored_values(fld: GridField) -> DataFrame:
    return fld.table.select(F.col("v").alias("value"))


@query(f"WITH {_STORED_CUT}, g AS (SELECT row, col, {_grey_sql('value')} AS v FROM cut, e) SELECT row, col, 255 AS a, v AS r, v AS g, v AS b FROM g")
def slice_gray(spark, sf):
    """A cut through a stored volume."""
    fld, cut = _stored_cut(spark, sf)
    return slices.grey_slice(cut, fld, _stored_values(fld))


_BACK_R = [_TURN[3 * j + i] for i in range(3) for j in range(3)]
_BACK_T = [-sum(_BACK_R[3 * i + k] * _SEG_T[k] for k in range(3)) for i in range(3)]
_BACK = _rigid_sql(_BACK_R, _BACK_T)


@query(f"""WITH {_STORED_CUT}, m AS (SELECT row, col, value AS mv, {_BACK[0]} AS x, {_BACK[1]} AS y, {_BACK[2]} AS z FROM cut),
s AS (SELECT row, col, mv, x BETWEEN 0 AND 3 AND y BETWEEN 0 AND 2 AND z BETWEEN 0 AND 2.5 AS seen, x + 10 * y + 100 * z AS uv FROM m),
g AS (SELECT row, col, seen, {_grey_sql("mv")} AS own, {_grey_sql("uv")} AS other FROM s, e)
SELECT row, col, 255 AS a, CASE WHEN seen THEN 0 ELSE own END AS r, CASE WHEN seen THEN other ELSE own END AS g, CASE WHEN seen THEN 0 ELSE own END AS b FROM g""")
def slice_overlay(spark, sf):
    """A field seen through a transform, over a cut through a stored volume."""
    macro, cut = _stored_cut(spark, sf)
    micro = AnalyticField(Geometry((0.5,) * 3, (7, 5, 6)), lambda x, y, z: x + 10 * y + 100 * z, lambda p: p @ [1.0, 10.0, 100.0])
    return slices.overlay_slice(cut, macro, micro, _TURN, _SEG_T, _stored_values(macro))


@query(f"""WITH {_CUT}, {_ENDS}, g AS (SELECT row, col, x, y, z, {_grey_sql(_SPHERE)} AS v FROM cut, e),
m AS (SELECT g.*, EXISTS (SELECT 1 FROM {_PART} p WHERE abs(p.x - g.x) <= 0.03 AND abs(p.y - g.y) <= 0.03 AND abs(p.z - g.z) <= 0.03) AS hit FROM g)
SELECT row, col, 255 AS a, CASE WHEN hit THEN 255 ELSE v END AS r, CASE WHEN hit THEN 0 ELSE v END AS g, CASE WHEN hit THEN 0 ELSE v END AS b FROM m""")
def slice_mark(spark, sf):
    fld, cut = mocks.sphere(), _cut(spark)
    return slices.marked_slice(slices.grey_slice(cut, fld, fld.voxels(spark)), cut, _part_points(spark, sf), 0.03)


@query(f"""WITH {_STORED_CUT}, s AS (SELECT list_sort(list(value)) AS v FROM cut),
h AS (SELECT v[CAST(trunc(len(v) * 0.05) AS INT) + 1] AS lo, v[CAST(trunc(len(v) * 0.70) AS INT) + 1] AS hi FROM s),
g AS (SELECT row, col, CAST(trunc(least(greatest((value - lo) / (hi - lo), 0), 1) * 255) AS INT) AS x FROM cut, h) SELECT row, col, 255 AS a, x AS r, x AS g, x AS b FROM g""")
def slice_stretched(spark, sf):
    fld, cut = _stored_cut(spark, sf)
    return slices.feature_slice(fld.attach(cut, "value"), "value")


# ------------------------------------------------------------------------------------------ experiments, files, UDFs


@query("""WITH r AS (SELECT c_mktsegment AS macro, CAST(c_custkey AS VARCHAR) AS test, CASE WHEN c_acctbal > 0 THEN c_acctbal / 10000 END AS d FROM customer)
SELECT macro, count(*) AS tests, count(d) AS finished, round(avg(d), 6) AS mean, round(min(d), 6) AS least, round(max(d), 6) AS largest FROM r GROUP BY 1""")
def experiment_summary(spark, sf):
    d = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 10000).otherwise(F.lit(float("nan")))
    results = _t(spark, sf, "customer").select(F.col("c_mktsegment").alias("macro"), F.col("c_custkey").cast("string").alias("test"), d.alias("relative_distance"))
    out = experiment.summary(results)
    return out.select("macro", "tests", "finished", *(_r(c).alias(c) for c in ("mean", "least", "largest")))


@query("""SELECT n_nationkey AS n, n_name || '; ' || CAST(n_regionkey AS VARCHAR) || '; ' AS line FROM nation""")
def cell_lines(spark, sf):
    out = texts.cell_lines(_t(spark, sf, "nation"), ["n_name", "n_regionkey"], ["n_nationkey"])
    return out.select((F.col("n") - 1).cast("int").alias("n"), "line")


_CONFIG = '{"configurations":[{"FeatureComputerType":1,"Parameters":{"BorderPercentage":{"Value":0.001},"Radius":{"Value":3}}},{"FeatureComputerType":3,"Parameters":{"QuantileValues":{"Value":[0.0,0.25,1.0]}}}]}'


@query(f"""WITH c AS (SELECT r_regionkey, '{_CONFIG}'::JSON AS j FROM region), n AS (SELECT r_regionkey, j, unnest([0, 1]) AS n FROM c)
SELECT r_regionkey, n, CAST(json_extract(j, '$.configurations[' || n || '].FeatureComputerType') AS INT) AS type FROM n""")
def config_parse(spark, sf):
    rows = _t(spark, sf, "region").select("r_regionkey", F.posexplode(texts.parse_config(F.lit(_CONFIG))).alias("n", "c"))
    return rows.select("r_regionkey", "n", F.col("c.FeatureComputerType").alias("type"))


@query(f"WITH {_TRANSFORMS} SELECT id, {_ROUND12} FROM tr")
def transform_text_round_trip(spark, sf):
    text = _supplier_transforms(spark, sf).select("id", texts.format_transform(F.col("r"), F.col("t")).alias("text"))
    return _out(text.select("id", texts.parse_transform(F.col("text")).alias("p")).select("id", "p.r", "p.t"))


_BALL = {"radius": 0.5, "step": 0.1}


_OFFSETS = ", ".join(f"({a!r}, {b!r}, {c!r})" for a, b, c in dense.ball_grid(**_BALL).tolist())
_AROUND = f"""o(dx, dy, dz) AS (VALUES {_OFFSETS}), b AS (SELECT id, x + dx AS x, y + dy AS y, z + dz AS z FROM {_PART} p, o),
v AS (SELECT id, x, y, z, {_SPHERE} AS value FROM b WHERE x BETWEEN 0 AND {_BOX[0]!r} AND y BETWEEN 0 AND {_BOX[1]!r} AND z BETWEEN 0 AND {_BOX[2]!r}), l AS (SELECT id, list_sort(list(value)) AS s FROM v GROUP BY 1)"""


@query(f"""WITH {_AROUND} SELECT id, {", ".join(f"round(CASE WHEN s[1] = s[len(s)] THEN 'nan'::DOUBLE ELSE s[CAST(trunc({q} * (len(s) - 1)) AS INT) + 1] END, 6) AS f{i}" for i, q in enumerate((0.0, 0.25, 0.5, 0.75, 1.0)))} FROM l""")
def ball_quantiles(spark, sf):
    out = features.quantiles_sql(_part_points(spark, sf), mocks.sphere(), [0.0, 0.25, 0.5, 0.75, 1.0], **_BALL)
    return out.select("id", *(_r(F.get("features", F.lit(i))).alias(f"f{i}") for i in range(5)))


@query(f"""WITH {_AROUND}, k AS (SELECT v.* FROM v JOIN l USING (id) WHERE s[1] < s[len(s)] AND value >= s[len(s) // 2 + 1]) SELECT id, {_COV}, count(*) AS n FROM k GROUP BY 1""")
def ball_covariance(spark, sf):
    out = features.pca_moments(_part_points(spark, sf), mocks.sphere(), **_BALL)
    return out.select("id", *(_r(c, 9).alias(c) for c in out.columns[1:-1]), "n")


_COMPUTERS = (features.Computer("value"), *features.DEFAULT, features.Computer("harmonics", {"l_max": 3, "radius": 0.5, "samples": 100}))


@query()
def feature_vectors(spark, sf):
    """Every computer on the sphere volume: quadric, curvature, principal axes, quantiles, harmonics."""
    out = features.feature_vectors(_part_points(spark, sf), mocks.sphere(), _COMPUTERS, radius=0.8, ball_radius=0.5, ball_step=0.1, least_step=0.0)
    return out.select("id", *(_r(F.get("features", F.lit(i))).alias(f"f{i}") for i in range(features.n_features(_COMPUTERS))))


#: Coefficients of a quadric: x2 y2 z2 xy xz yz x y z 1.
_QUADRIC = (30.0, 20.0, -10.0, 5.0, -7.0, 3.0, 40.0, -20.0, 10.0, 100.0)


def _quadric_field() -> AnalyticField:
    a = _QUADRIC
    return AnalyticField(Geometry((0.2,) * 3, (25, 25, 25)), lambda x, y, z: a[0] * x * x + a[1] * y * y + a[2] * z * z + a[3] * x * y + a[4] * x * z + a[5] * y * z + a[6] * x + a[7] * y + a[8] * z + a[9], lambda p: dense.quadric_terms(p) @ np.array(a))


def _slope_sql(x: str, y: str, z: str) -> list[str]:
    a = _QUADRIC
    return [f"(2 * {a[0]} * {x} + {a[3]} * {y} + ({a[4]}) * {z} + {a[6]})", f"(2 * {a[1]} * {y} + {a[3]} * {x} + {a[5]} * {z} + ({a[7]}))", f"(2 * ({a[2]}) * {z} + ({a[4]}) * {x} + {a[5]} * {y} + {a[8]})"]


@query(f"""WITH c AS (SELECT id, {", ".join(f"floor({c} / 0.2 + 0.5) * 0.2 AS {c}" for c in "xyz")} FROM {_PART} p)
SELECT id, {", ".join(f"round({v}::DOUBLE, 3) AS a{i}" for i, v in enumerate(_QUADRIC[:6]))}, {", ".join(f"round({v}, 3) AS a{6 + i}" for i, v in enumerate(_slope_sql("x", "y", "z")))},
round({" + ".join(f"({v}) * {t}" for v, t in zip(_QUADRIC, ("x * x", "y * y", "z * z", "x * y", "x * z", "y * z", "x", "y", "z", "1")))}, 3) AS a9 FROM c""")
def quadric_recovered(spark, sf):
    """Fits to a field that is a quadric: its own coefficients about each lattice point."""
    out = features.quadrics(_part_points(spark, sf), _quadric_field(), radius=0.8, least_step=0.0)
    return out.select("id", *(_r(F.get("coef", F.lit(i)), 3).alias(f"a{i}") for i in range(10)))


_ADJ = ("(b * c - f * f)", "(a * c - e * e)", "(a * b - d * d)", "(e * f - d * c)", "(d * f - e * b)", "(d * e - a * f)")


@query(f"""WITH g AS (SELECT id, {", ".join(f"{v} AS g{c}" for v, c in zip(_slope_sql("x", "y", "z"), "xyz"))}, {", ".join(f"{v}::DOUBLE AS {n}" for v, n in zip((2 * _QUADRIC[0], 2 * _QUADRIC[1], 2 * _QUADRIC[2], *_QUADRIC[3:6]), "abcdef"))} FROM {_PART} p),
n AS (SELECT *, gx * gx + gy * gy + gz * gz AS nn FROM g),
k AS (SELECT id, nn, ({" + ".join(f"{m} * {t}" for m, t in zip(_ADJ, ("gx * gx", "gy * gy", "gz * gz", "2 * gx * gy", "2 * gx * gz", "2 * gy * gz")))}) / (nn * nn) AS gauss,
(a * gx * gx + b * gy * gy + c * gz * gz + 2 * (d * gx * gy + e * gx * gz + f * gy * gz) - nn * (a + b + c)) / (2 * nn * sqrt(nn)) AS mean FROM n)
SELECT id, round(sqrt(nn), 3) AS f0, round(gauss, 4) AS f1, round(mean, 4) AS f2, round(2 / pi() * atan2(mean, sqrt(greatest(0, mean * mean - gauss))), 4) AS f3, round(sqrt(mean * mean + greatest(0, mean * mean - gauss)), 4) AS f4 FROM k""")
def fitted_features(spark, sf):
    """Gradient, curvature and shape of fits to a field that is a quadric, where all of them are known."""
    kinds = tuple(features.Computer(k) for k in features.FITTED)
    out = features.feature_vectors(_part_points(spark, sf), _quadric_field(), kinds, radius=0.8, least_step=0.0)
    return out.select("id", *(_r(F.get("features", F.lit(i)), 3 if i == 0 else 4).alias(f"f{i}") for i in range(5)))


_RISE = np.array([2.0, -1.0, 0.5])
_HESSIAN = np.eye(3) + np.outer(_RISE, _RISE)
_SHORT = (-0.05 / 2 * np.linalg.solve(_HESSIAN, np.diag(_HESSIAN))).tolist()  # where forward differences of 0.05 vanish
_WANTED = [f"1 + 0.58 * {c} + {v}" for c, v in zip("xyz", ("(id % 7 - 3) * 0.1", "(id % 5 - 2) * 0.1", "(id % 3 - 1) * 0.2"))]


@query(f"""SELECT id, {", ".join(f"round({v} + ({d!r}), 5) AS {c}" for c, v, d in zip("xyz", _WANTED, _SHORT))}, round({float(np.sqrt(_SHORT @ _HESSIAN @ np.array(_SHORT)))!r}::DOUBLE, 6) AS distance, 'converged' AS ended FROM {_PART} p""")
def descended_points(spark, sf):
    """Points moved to the features of other places: the place itself and the value of a linear field."""
    fld = AnalyticField(Geometry((0.2,) * 3, (25, 25, 25)), lambda x, y, z: 2.0 * x - y + 0.5 * z, lambda p: p @ _RISE)
    x, y, z = (F.expr(v) for v in _WANTED)
    points = _part_points(spark, sf).withColumn("target", F.array(x, y, z, fld.column(x, y, z))).select("id", *((1 + 0.58 * F.col(c)).alias(c) for c in "xyz"), "target")
    out = features.descended(points, fld, (features.Computer("position"), features.Computer("value")), enough=1e-13, steps=400)
    return out.select("id", *(_r(c, 5).alias(c) for c in "xyz"), _r("distance").alias("distance"), "ended")


@query()
def quadric_fit(spark, sf):
    out = features.quadrics(_part_points(spark, sf), mocks.sphere(), radius=0.8, least_step=0.0)
    return out.select("id", *(_r(F.get("coef", F.lit(i))).alias(f"a{i}") for i in range(10)))


@query()
def pca_rotation(spark, sf):
    out = transforms.with_bases(_part_points(spark, sf), mocks.sphere(), radius=0.5, step=0.1)
    return out.select("id", *(_r(F.get(F.get("bases", F.lit(k)), F.lit(i))).alias(f"b{k}{i}") for k in range(2) for i in range(9)))


_FINE = Geometry((0.4, 0.15, 0.6), (10, 9, 12))


@query(f"""WITH {_BY_PART}, {_FILLED}, t AS (SELECT CAST(i + 10 * j + 90 * k AS BIGINT) AS id, {", ".join(f"{v} AS {c}" for v, c in zip(_SEG_AT, "xyz"))} FROM {_grid_sql(_FINE)} q),
f AS (SELECT id, least(greatest(x, 0), 4.5) / 0.5 AS fx, least(greatest(y, 0), 1.75) / 0.25 AS fy, least(greatest(z, 0), (SELECT nz FROM c) - 1) AS fz FROM t), {_MIXED}""")
def resample_volume(spark, sf):
    """A stored volume on another grid, turned."""
    out = metaimage.resampled(spark, _part_grid(spark, sf), _FINE, _TURN, _SEG_T)
    return out.select((F.col("i") + 10 * F.col("j") + 90 * F.col("k")).cast("long").alias("id"), _r("value").alias("value"))


@query(f"WITH {_BY_PART} SELECT CAST(count(*) AS INT) AS n, max(x) * 0.5::DOUBLE AS x, max(y) * 0.25::DOUBLE AS y, max(z) * 1.0::DOUBLE AS z FROM spot")
def grid_bounds(spark, sf):
    """The grid that the header of a volume written from a table describes."""
    return lattice(spark, _part_grid(spark, sf).geometry).agg(F.count("*").cast("int").alias("n"), *(F.max(c).alias(c) for c in "xyz"))


@query()
def align_volumes(spark, sf):
    """The whole pipeline on a pair of volumes with a known transform: a bump for each nation (a table of fixed size)."""
    from strataline.plans.align import Config, align

    k = F.col("n_nationkey")
    rows = _t(spark, sf, "nation").select(*((2 + (k * m % 25) * 0.32).alias(c) for c, m in (("x", 7), ("y", 11), ("z", 3))), (0.8 + (k * 5 % 17) / 10).alias("s"), (300.0 + (k * 13 % 25) * 70).alias("h")).collect()
    macro, micro = headless_pair([((r.x, r.y, r.z), r.s, r.h) for r in rows])
    c = Config(micro_points=200, macro_points=400, quadric_radius=2.0, quadric_step=0.5, ball_radius=1.5, ball_step=0.3, median_share=0.2)
    return _out(align(spark, micro, macro, c).withColumn("id", F.lit(0)))


def headless_pair(bumps: list | None = None):
    """Bumps of different sizes and heights in a box, and the same seen through a rotation and shift."""
    rng = np.random.default_rng(3)
    bumps = bumps or [(tuple(rng.uniform(2, 10, 3)), float(rng.uniform(0.8, 2.5)), float(rng.uniform(300, 2000))) for _ in range(14)]

    def column(x, y, z):
        return sum((h * F.exp(-E.dot(d, d) / (2 * s * s)) for c, s, h in bumps for d in [E.sub((x, y, z), E.lit3(c))]), F.lit(0.0))

    def plain(p):
        return sum(h * np.exp(-((p - np.array(c)) ** 2).sum(-1) / (2 * s * s)) for c, s, h in bumps)

    macro = AnalyticField(Geometry((0.5,) * 3, (25, 25, 25)), column, plain)
    r, t = mocks.turn(math.radians(12), math.radians(8), math.radians(20)), [2.0, 0.5, 1.5]
    micro = mocks.segment(macro, r.reshape(-1).tolist(), t, Geometry((0.5,) * 3, (15, 15, 15)), outside=0.0)
    return macro, micro


