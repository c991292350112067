"""Connected components of an edge table by alternating large and small stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each
round hangs the neighbours of every node below the smallest node around it; the
edges end as one star for each component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.llm.common import discard, join_counted, materialize


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("times")).withColumn("m", F.least("u", "m"))
    return join_counted(both.where("v > u"), low, ["u"], "times", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("times"))
    lowered = join_counted(down, low, ["u"], "times", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lowered.unionAll(low.select("u", F.col("m").alias("v")))


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or below exactly one."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionAll(edges.select(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    odd = ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where(F.col("below") + F.col("above") > 1)
    return odd.isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of the edges, two columns; component is the smallest node reachable.

    Edges are 64-bit integers, in either direction, repeated or not; those with
    a null end or both ends equal are ignored. Nodes without edges don't occur.
    Every round is written to the shared folder. Nodes with a large share of the
    edges are joined by broadcast, so no task gets all edges of such a centre.
    """
    edges = edges.toDF("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, name)
    while not _stars(edges):
        n = edges.count()
        old, edges = edges, materialize(_small_star(_large_star(edges, n), n).distinct(), name)
        discard(old)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
