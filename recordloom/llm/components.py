"""Connected components of an edge table by alternating large-star and small-star steps.

Only minima are aggregated (combined on the map side) and joined back, so a
node with very many neighbours is no group of its own anywhere: the aggregate
sees one row per task, and Spark splits the join's large partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v): neighbours move to the smallest node around u."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # Written, so that the join reads plain tables and Spark can split the rows of a node with many neighbours.
    least = common.materialise(
        around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components-least"
    )
    moved = around.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node with an edge, except the smallest of its component, and that smallest node.

    ``edges`` has two columns u, v of one type; loops, repeats and null ends
    are ignored. Each step is a written table, so a lost executor costs one step at most.
    """
    now = common.materialise(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components"
    )
    mark = None
    while True:
        now = common.materialise(_star(_star(now, large=True), large=False), "components")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now
        mark = tuple(seen)
