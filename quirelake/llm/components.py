"""Connected components by alternating large-star and small-star rounds.

No node's neighbours are ever collected: each round takes minima (combined before the shuffle) and joins them
back, and every round is written to the shared folder, so a hub with a third of all edges stays spread out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import scratch, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).head())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``, stored; root is the smallest node it reaches.

    Self loops, repeated and null-ended edges are ignored; no edges give no rows.
    """
    with scratch(edges.sparkSession):
        return stored(_components(edges), "roots", outer=True)


def _components(edges: DataFrame) -> DataFrame:
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stored(e, "edges")
    state = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        if (now := _state(e)) == state:
            break
        state = now
    return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
