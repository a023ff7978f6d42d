"""Pairs of blocks, met tile by tile: bounded memory, and few copies of a block whatever the number of pairs.

Left and right blocks are dealt into groups of up to TILE bytes; a task gets one group of each side and does all pairs of
blocks of it. So a block is shuffled once for each group of the other side, not once for each block it meets: for
n vectors of b bytes that is n b times the number of groups, which does not grow until a group is full.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.runtime import ship
from strataline.shared import materialize

TILE = 32 << 20


def _dealt(column: str, groups: int):
    return F.pmod(F.xxhash64(column), F.lit(groups)).cast("int")


def groups_of(left: tuple[int, int], right: tuple[int, int], cores: int) -> tuple[int, int]:
    """How many groups of the left and of the right side, of which (blocks, bytes) are given: as few as memory allows, but work for all cores."""
    g = max(1, min(right[0], -(-right[1] // TILE)))
    h = max(1, min(left[0], max(-(-left[1] // TILE), -(-4 * cores // g))))
    if g * h < 4 * cores:
        g = max(1, min(right[0], -(-4 * cores // h)))
    return h, g


def sized(blocks: DataFrame, payload: str) -> tuple[int, int]:
    """Number of blocks and bytes of their vectors."""
    n, size = blocks.agg(F.count("*"), F.sum(F.octet_length(payload))).head()
    return int(n), int(size or 0)


def tiled(left: DataFrame, right: DataFrame, pairs: DataFrame | None, groups: tuple[int, int], run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run(left rows, right rows) of each tile. left has the block's number a, right b; `pairs` (a, b) says which meet: left rows
    get `near`, the list of their b (None: all meet all, and near is null). The frame is to be used once."""
    spark = left.sparkSession
    ship(spark)
    h, g = groups
    if pairs is None:
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        one = left.withColumn("near", F.lit(None).cast("array<long>")).withColumn("h", _dealt("a", h)).withColumn("g", every(g))
        two = right.withColumn("g", _dealt("b", g)).withColumn("h", every(h))
    else:
        met = materialize(pairs.withColumn("g", _dealt("b", g)).groupBy("a", "g").agg(F.collect_list("b").alias("near")), "tiles")
        one = left.join(met, "a").withColumn("h", _dealt("a", h))
        two = right.join(met.select(F.explode("near").alias("b"), _dealt("a", h).alias("h"), "g").distinct(), "b")
    tile = (F.col("h") * g + F.col("g")).alias("tile")
    # Numbers of partitions are given, so that small ones are not joined: few bytes are much work here.
    parts = h * g
    # Aliases, as both sides may come from one table.
    one, two = (d.select(tile, *(F.col(c).alias(c) for c in d.columns if c not in ("h", "g"))).repartition(parts, "tile") for d in (one, two))
    return one.groupBy("tile").cogroup(two.groupBy("tile")).applyInArrow(run, schema)
