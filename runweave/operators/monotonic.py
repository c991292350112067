"""Whether a metric only rises or only falls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runweave.operators.points import RANGE_ROWS, step_ranges


def direction(points: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """(run, metric, monotonic): `inc`, `dec` or null, in order of pos.

    Equal neighbours break neither, so a constant metric is `inc`. A NaN breaks
    both, and JSON metrics have no direction. Neighbours are compared within
    ranges of positions and then from range to range, so that a metric of any
    size is spread over tasks.
    """
    keys = ["run", "metric"]
    value = F.coalesce(F.struct(F.col("num").alias("num"), F.col("ival").alias("ival")))
    flat = points.select(*keys, "pos", value.alias("v"), F.col("json").isNotNull().alias("text"), F.coalesce(F.isnan("num"), F.lit(False)).alias("odd"))
    ranged = step_ranges(flat, keys, "pos", rows)
    prev = F.lag("v").over(Window.partitionBy("__keys", "__range").orderBy("pos"))
    marked = ranged.withColumn("falls", F.coalesce(F.col("v") < prev, F.lit(False))).withColumn("rises", F.coalesce(F.col("v") > prev, F.lit(False)))
    parts = marked.groupBy("__keys", "__range", *keys).agg(
        F.bool_or("falls").alias("falls"), F.bool_or("rises").alias("rises"), F.bool_or("odd").alias("odd"), F.bool_or("text").alias("text"), F.min_by("v", "pos").alias("first"), F.max_by("v", "pos").alias("last")
    )
    across = F.lag("last").over(Window.partitionBy("__keys").orderBy("__range"))
    met = parts.withColumn("down", F.coalesce(F.col("first") < across, F.lit(False))).withColumn("up", F.coalesce(F.col("first") > across, F.lit(False)))
    found = met.groupBy("__keys", *keys).agg(F.bool_or(F.col("falls") | F.col("down")).alias("falls"), F.bool_or(F.col("rises") | F.col("up")).alias("rises"), F.bool_or(F.col("odd") | F.col("text")).alias("broken"))
    return found.select(*keys, F.when(F.col("broken"), F.lit(None)).when(~F.col("falls"), "inc").when(~F.col("rises"), "dec").alias("monotonic"))
