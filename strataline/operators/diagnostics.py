"""How features behave: against distance, by shell, in and out of a neighbourhood."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions import exprs as E
from strataline.operators import matching
from strataline.operators.tiles import groups_of, sized, tiled
from strataline.runtime import mapped
from strataline.shared import materialize

BLOCK, WIDE = 256, 4096


def feature_distances(pairs: DataFrame) -> DataFrame:
    """pairs of ref, bin, features, ref_features -> ref, bin, distance."""
    return pairs.select("ref", "bin", E.l2(F.col("features"), F.col("ref_features")).alias("distance"))


def by_bin(distances: DataFrame) -> DataFrame:
    """ref, bin: count, mean and population variance of the distances."""
    return distances.groupBy("ref", "bin").agg(F.count("*").alias("n"), F.avg("distance").alias("mean"), F.var_pop("distance").alias("variance"))


def shell_matrix(distances: DataFrame, bins: Sequence[int], what: str = "variance") -> DataFrame:
    """A row for each ref, a column b<k> for each bin."""
    agg = {"variance": F.var_pop("distance"), "mean": F.avg("distance")}[what]
    wide = distances.groupBy("ref").pivot("bin", list(bins)).agg(agg)
    return wide.select("ref", *(F.col(f"`{b}`").alias(f"b{b}") for b in bins))


def _packed(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Blocks of up to BLOCK rows (key long, f): number, keys and vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        for b in batches:
            if b.num_rows:
                m = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8")
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([b.column(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], [name, "keys", "m"])
                at += 1

    fine = rows.filter(F.col(key).isNotNull() & F.forall("f", F.isnotnull)).select(F.col(key).cast("long").alias("key"), "f")
    return mapped(fine, run, f"{name} long, keys binary, m binary", BLOCK)


def shell_variances(refs: DataFrame, others: DataFrame, bins: Sequence[int], dim: int) -> DataFrame:
    """A row for each ref with the population variance of its distances from the others of each bin, b<k>, as `shell_matrix` of all
    pairs gives it, without a row for a pair: blocks meet in tiles, and a tile hands on count, mean and sum of squares.

    refs: ref, f; others: bin, f (arrays of dim; null entries are no distance). Time is that of all pairs, which each have a part in the result.
    """
    a, b = materialize(_packed(refs, "ref", "a"), "shell-refs"), materialize(_packed(others.filter(F.col("bin").isin(list(bins))), "bin", "b"), "shell-others")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            of = np.concatenate([np.frombuffer(v, "<i8") for v in right.column("keys").to_pylist()])
            c = np.concatenate([np.frombuffer(v).reshape(-1, dim) for v in right.column("m").to_pylist()])
            shells = {int(k): c[of == k] for k in np.unique(of)}
            for keys, m in zip(*(left.column(n).to_pylist() for n in ("keys", "m"))):
                q, ids = np.frombuffer(m).reshape(-1, dim), np.frombuffer(keys, "<i8")
                for k, v in shells.items():
                    for some in (v[i : i + WIDE] for i in range(0, len(v), WIDE)):
                        d = np.sqrt(sum((q[:, j, None] - some[None, :, j]) ** 2 for j in range(dim)))
                        mean = d.mean(1)
                        for column, x in zip(out, (ids, np.full(len(q), k), np.full(len(q), float(len(some))), mean, ((d - mean[:, None]) ** 2).sum(1))):
                            column.append(x)
        kinds = np.int64, np.int64, float, float, float
        return pa.table({n: pa.array(np.concatenate(v) if v else np.zeros(0, t)) for n, v, t in zip(("ref", "bin", "n", "mean", "m2"), out, kinds)})

    groups = groups_of(sized(a, "m"), sized(b, "m"), refs.sparkSession.sparkContext.defaultParallelism)
    parts = tiled(a, b, None, groups, run, "ref long, bin long, n double, mean double, m2 double").select(F.col("ref").cast(refs.schema["ref"].dataType).alias("ref"), "bin", "n", "mean", "m2")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("bin", "long"), ("n", "double"), ("mean", "double"), ("m2", "double"))]
    every = refs.join(F.broadcast(others.limit(1).select(F.lit(1).alias("any"))), how="cross").select("ref", *nothing)
    made = []
    for k in bins:
        here = lambda v: F.sum(F.when(F.col("bin") == k, v))  # noqa: E731, B023
        n, first = here(F.col("n")), here(F.col("n") * F.col("mean"))
        made.append(((here(F.col("m2")) + here(F.col("n") * F.col("mean") * F.col("mean")) - first * first / n) / n).alias(f"b{k}"))
    return every.unionByName(parts).groupBy("ref").agg(*made)


def closer_further(distances: DataFrame, real: Column, threshold: float) -> DataFrame:
    """Variance of feature distances within the threshold and from there to three times it: ref, closer, further."""
    rows = distances.withColumn("part", F.when(real <= threshold, F.lit("closer")).when(real <= 3 * threshold, F.lit("further"))).filter("part IS NOT NULL")
    return rows.groupBy("ref").pivot("part", ["closer", "further"]).agg(F.var_pop("distance"))


def difference_mean(pairs: DataFrame) -> DataFrame:
    """Mean feature distance for each ref."""
    return feature_distances(pairs).groupBy("ref").agg(F.avg("distance").alias("mean"))


def random_pairs(vectors: DataFrame, n: int, seed: int) -> DataFrame:
    """real and squared feature distance of n random pairs; ids of the vectors are 0 .. count - 1."""
    size = vectors.count()
    drawn = vectors.sparkSession.range(n).select("id", *(F.floor(E.uniform(seed, k, F.col("id")) * size).alias(s) for k, s in enumerate("ab")))
    side = lambda s: vectors.select(F.col("id").alias(s), *(F.col(c).alias(f"{s}{c}") for c in "xyz"), F.col("features").alias(f"{s}f"))
    both = drawn.join(side("a"), "a").join(side("b"), "b")
    return both.select("id", E.distance(E.xyz("a"), E.xyz("b")).alias("real"), E.squared_l2(F.col("af"), F.col("bf")).alias("feature_squared"))


def two_nearest(micro: DataFrame, macro: DataFrame, diagonal: float) -> DataFrame:
    """Feature and real distance (over the diagonal) of each micro vector's two nearest; fewer than two: left out."""
    near = matching.knn(micro, macro, 2)
    side = lambda d, s: d.select(F.col("id").alias(f"{s}_id"), *(F.col(c).alias(f"{s}{c}") for c in "xyz"))
    rows = near.join(side(micro, "micro"), "micro_id").join(side(macro, "macro"), "macro_id")
    rows = rows.select("micro_id", "n", "score", (E.distance(E.xyz("micro"), E.xyz("macro")) / diagonal).alias("real"))
    wide = rows.groupBy("micro_id").agg(*(F.max(F.when(F.col("n") == k, F.col(c))).alias(f"{name}{k}") for k in (1, 2) for c, name in (("score", "feature"), ("real", "real"))))
    return wide.filter("feature2 IS NOT NULL")
