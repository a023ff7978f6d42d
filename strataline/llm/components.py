"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), all in joins and sums.

Each step's frames are tables in the shared folder, so lineage stays short and a hub's rows can be dealt anew by the
skew join; the driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import materialize, temporary


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> (node, root): root is the smallest node of the component. Nodes without a link are absent.

    Defined results: null ends and loops are left out; repeated and reversed links count once; no links, no rows.
    """
    spark = edges.sparkSession
    with temporary(spark):
        links = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        links = materialize(links, "cc-links")
        before = None
        for _ in range(max_rounds):
            with temporary(spark):
                links = materialize(_small_star(materialize(_large_star(links), "cc-large")), "cc-small", outlive=True)
            state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
            if (state.n, state.h) == before:
                break
            before = (state.n, state.h)
        else:
            raise RuntimeError("components did not settle")
        out = links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        return materialize(out, "cc-roots", outlive=True)


def _large_star(links: DataFrame) -> DataFrame:
    """Each neighbour above a node is linked to the node's least neighbour instead."""
    both = materialize(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), "cc-both")
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
    out = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    return out.filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them. Every link has u > v."""
    least = materialize(links.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
    out = links.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.filter("u <> v").distinct()
