"""Planar cuts of a volume as pixel tables, and overlays of two volumes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions import exprs as E
from strataline.operators import normalize
from strataline.types import Geometry


def plane(spark: SparkSession, g: Geometry, share: float, axis: int, width: int, height: int) -> DataFrame:
    """row, col and x, y, z of a cut at `share` (0..1) of the box along `axis`. Columns run along the first other axis, rows along the second."""
    share = min(max(share, 0.0), 1.0)
    across, along = (1 if axis == 0 else 0), (1 if axis == 2 else 2)
    row, col = F.floor(F.col("id") / width).cast("int"), (F.col("id") % width).cast("int")
    pixels = spark.range(width * height).select(row.alias("row"), col.alias("col"))
    at = {axis: F.lit(share * g.bounds[axis]), across: F.col("col") / max(width - 1, 1) * g.bounds[across], along: F.col("row") / max(height - 1, 1) * g.bounds[along]}
    return pixels.select("row", "col", *(at[i].cast("double").alias(c) for i, c in enumerate("xyz")))


def resolution(ratio: float, pixels: int = 250_000) -> tuple[int, int]:
    """Width and height of about so many pixels at height / width = ratio."""
    w = int(math.sqrt(pixels / ratio))
    return w, int(ratio * w)


def _ends(values: DataFrame) -> DataFrame:
    return values.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def grey_slice(cut: DataFrame, fld, values: DataFrame) -> DataFrame:
    """row, col, a, r, g, b. `values` (value) gives the range; a constant volume is black."""
    seen = fld.attach(cut, "value").crossJoin(F.broadcast(_ends(values)))
    grey = E.grey(E.min_max(F.col("value"), F.col("lo"), F.col("hi")))
    return seen.select("row", "col", F.lit(255).alias("a"), grey.alias("r"), grey.alias("g"), grey.alias("b"))


def overlay_slice(cut: DataFrame, macro, micro, r: Sequence[float], t: Sequence[float], values: DataFrame) -> DataFrame:
    """The macro cut in grey; where the inverse of (r, t) leads into the micro volume, the micro value in green, scaled by the macro's range."""
    ri, ti = E.inverse([F.lit(float(v)) for v in r], [F.lit(float(v)) for v in t])
    base = macro.attach(cut, "value").withColumnsRenamed({c: f"m{c}" for c in "xyz"})
    moved = E.apply_rigid(ri, ti, E.xyz("m"))
    placed = base.select("row", "col", F.col("value").alias("macro_value"), *(v.alias(c) for v, c in zip(moved, "xyz")))
    inside = E.in_bounds(E.xyz(), micro.geometry.bounds)
    both = micro.attach(placed, "value").withColumn("micro_value", F.when(inside, F.col("value"))).crossJoin(F.broadcast(_ends(values)))
    grey = lambda c: E.grey(E.min_max(F.col(c), F.col("lo"), F.col("hi")))
    own, seen = grey("macro_value"), F.col("micro_value").isNotNull()
    return both.select("row", "col", F.lit(255).alias("a"), F.when(seen, F.lit(0)).otherwise(own).alias("r"), F.when(seen, grey("micro_value")).otherwise(own).alias("g"), F.when(seen, F.lit(0)).otherwise(own).alias("b"))


def marked_slice(grey: DataFrame, cut: DataFrame, samples: DataFrame, reach: float) -> DataFrame:
    """The grey cut with red pixels wherever a sample lies within `reach` on every axis.

    Pixels meet samples by grid cells as wide as the reach, an equality join; a pixel is marked once.
    """
    cells = [F.floor(F.col(c) / reach) for c in "xyz"]
    near = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"o{c}") for v, c in zip((i, j, k), "xyz"))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))))
    pixels = cut.withColumn("o", near).select("row", "col", "x", "y", "z", *((c + F.col(f"o.o{n}")).alias(f"c{n}") for c, n in zip(cells, "xyz")))
    marks = samples.select(*(F.col(c).alias(f"s{c}") for c in "xyz"), *(F.floor(F.col(c) / reach).alias(f"c{c}") for c in "xyz"))
    close = (F.abs(F.col("x") - F.col("sx")) <= reach) & (F.abs(F.col("y") - F.col("sy")) <= reach) & (F.abs(F.col("z") - F.col("sz")) <= reach)
    hit = pixels.join(marks, ["cx", "cy", "cz"]).filter(close).select("row", "col").distinct().withColumn("hit", F.lit(True))
    joined = grey.join(hit, ["row", "col"], "left")
    on = F.coalesce("hit", F.lit(False))
    return joined.select("row", "col", "a", F.when(on, F.lit(255)).otherwise(F.col("r")).alias("r"), F.when(on, F.lit(0)).otherwise(F.col("g")).alias("g"), F.when(on, F.lit(0)).otherwise(F.col("b")).alias("b"))


def feature_slice(pixels: DataFrame, value: str) -> DataFrame:
    """A feature's values over a cut (row, col, value), stretched between its order statistics and shown in grey."""
    stretched = normalize.contrast_stretch(pixels, value)
    grey = E.grey(F.col("stretched"))
    return stretched.select("row", "col", F.lit(255).alias("a"), grey.alias("r"), grey.alias("g"), grey.alias("b"))
