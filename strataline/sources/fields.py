"""Scalar fields over a grid's box: analytic ones as column expressions, stored ones as voxel tables.

A field gives its values to rows with x, y, z in two ways: `attach` adds a column by expressions and joins, for any size;
`evaluator` gives a picklable numpy function for Arrow batches. For a stored volume, that means a copy in every Python
worker, so it refuses volumes beyond `ship_limit` bytes; or, with `raw_path`, a memory-mapped raw file (of `element_type`,
which also decides the order of its axes) at a path that all executors mount, whose pages a machine's workers share.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions import exprs as E
from strataline.runtime import ship
from strataline.types import KINDS, Geometry


def lattice(spark: SparkSession, g: Geometry) -> DataFrame:
    """Index and position of every vertex: i, j, k, x, y, z."""
    a, b, _ = g.dims
    n = F.col("id")
    i, j, k = (n % a).cast("int"), (F.floor(n / a) % b).cast("int"), F.floor(n / (a * b)).cast("int")
    base = spark.range(g.count).select(i.alias("i"), j.alias("j"), k.alias("k"))
    return base.select("*", *((F.col(c) * s).alias(p) for c, s, p in zip("ijk", g.spacing, "xyz")))


@dataclass(frozen=True)
class AnalyticField:
    geometry: Geometry
    column: Callable[[Column, Column, Column], Column]
    numpy: Callable[[np.ndarray], np.ndarray] = field(compare=False)

    def attach(self, points: DataFrame, out: str = "value") -> DataFrame:
        return points.withColumn(out, self.column(*E.xyz()))

    def evaluator(self) -> Callable[[np.ndarray], np.ndarray]:
        return self.numpy

    def voxels(self, spark: SparkSession) -> DataFrame:
        """i, j, k, x, y, z, value of every vertex."""
        return self.attach(lattice(spark, self.geometry))


@dataclass(frozen=True)
class GridField:
    """Voxel table (x, y, z int indices, v); positions between vertices are interpolated linearly, those outside clamped."""

    geometry: Geometry
    table: DataFrame
    ship_limit: int = 256 << 20
    raw_path: str | None = None
    element_type: str = "MET_USHORT"

    def attach(self, points: DataFrame, out: str = "value") -> DataFrame:
        """The eight corners meet the voxels in an equality join, so the volume may be of any size."""
        near, far, share = [], [], []
        for c, s, d in zip("xyz", self.geometry.spacing, self.geometry.dims):
            f = E.clamp(F.col(c) / s, 0.0, float(d - 1))
            low = F.floor(f).cast("int")
            near.append(low)
            far.append(F.least(low + 1, F.lit(d - 1)))
            share.append(f - low)
        corners = [
            F.struct(*((far if bits >> a & 1 else near)[a].alias(f"c{c}") for a, c in enumerate("xyz")), _product([share[a] if bits >> a & 1 else 1 - share[a] for a in range(3)]).alias("w"))
            for bits in range(8)
        ]
        places = points.select("x", "y", "z").distinct()
        around = places.select("x", "y", "z", F.explode(F.array(*corners)).alias("c")).select("x", "y", "z", "c.*").filter("w > 0")
        stored = self.table.select(F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"), "v")
        values = around.join(stored, ["cx", "cy", "cz"]).groupBy("x", "y", "z").agg(F.sum(F.col("w") * F.col("v")).alias(out))
        return points.join(values, ["x", "y", "z"], "left").select(*points.columns, out)

    def evaluator(self) -> Callable[[np.ndarray], np.ndarray]:
        g = self.geometry
        if self.raw_path:
            return _Trilinear(None, g, self.raw_path, self.element_type)
        if 4 * g.count > self.ship_limit:
            raise ValueError("the volume is too large to ship to every executor; use attach() or a raw_path")
        spark = self.table.sparkSession
        ship(spark)
        a, b, c = g.dims

        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            out = np.zeros(a * b, "<f4")
            out[rows["at"].to_numpy()] = rows["v"].to_numpy()
            return pd.DataFrame({"z": [int(key[0])], "payload": [out.tobytes()]})

        slabs = self.table.select("z", (F.col("y") * a + F.col("x")).cast("int").alias("at"), F.col("v").cast("float").alias("v")).groupBy("z").applyInPandas(run, "z int, payload binary")
        flat = np.zeros((c, a * b), np.float32)
        for r in slabs.toLocalIterator():
            flat[r.z] = np.frombuffer(r.payload, "<f4")
        return _Trilinear(spark.sparkContext.broadcast(flat.reshape(-1)), g)


def _product(factors: list[Column]) -> Column:
    return factors[0] * factors[1] * factors[2]


@dataclass(frozen=True)
class _Trilinear:
    volume: object
    geometry: Geometry
    raw_path: str | None = None
    element_type: str = "MET_USHORT"

    def __call__(self, p: np.ndarray) -> np.ndarray:
        a, b, _ = self.geometry.dims
        kind = KINDS[self.element_type]
        v = np.memmap(self.raw_path, kind, "r", shape=(self.geometry.count,)) if self.raw_path else self.volume.value
        y_first = bool(self.raw_path) and kind.itemsize == 1
        top = np.array(self.geometry.dims) - 1
        f = np.clip(p / np.array(self.geometry.spacing), 0, top)
        low = np.floor(f).astype(np.int64)
        high, s = np.minimum(low + 1, top), f - low
        out = np.zeros(p.shape[:-1])
        for bits in range(8):
            at = [(high if bits >> k & 1 else low)[..., k] for k in range(3)]
            w = np.prod([s[..., k] if bits >> k & 1 else 1 - s[..., k] for k in range(3)], axis=0)
            out += w * v[at[2] * (a * b) + (at[0] * b + at[1] if y_first else at[1] * a + at[0])]
        return out
