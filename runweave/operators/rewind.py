"""Going back in a log: truncation, recovery after a crash, and rewinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runweave.operators.points import RANGE_ROWS, step_ranges, with_range


def truncate_to_step(points: DataFrame, step: int, allow_empty: bool = False) -> DataFrame:
    """Points below a step. Step 0 deletes everything, so it must be allowed explicitly."""
    if step <= 0 and not allow_empty:
        raise ValueError("step 0 would delete every point; pass allow_empty=True")
    return points.where(F.col("step") < step)


def recover(cold: DataFrame, hot: DataFrame, step: int, allow_empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """Compacted and hot points of a run that goes on at `step`.

    Hot points from that step on go. Compacted points go from the first hot
    step that is left on: what both have is kept in the log alone.
    """
    kept = hot.where(F.col("step") < step)
    first = kept.groupBy("run").agg(F.min("step").alias("first")).select(F.col("run").alias("r"), "first")
    below = truncate_to_step(cold, step, allow_empty).join(first, F.col("run") == F.col("r"), "left").where(F.col("first").isNull() | (F.col("step") < F.col("first")))
    return below.select(*cold.columns), kept


def resolve_rewinds(log: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """The rows of (run, line, step, ...) that no later row goes back over.

    A row stays if every later row has a larger step. The least step of what
    follows is taken over ranges of lines, so a run is spread over tasks.
    """
    ranged = step_ranges(log, ["run"], "line", rows)
    least = ranged.groupBy("__keys", "__range").agg(F.min("step").alias("least"))
    after = F.min("least").over(Window.partitionBy("__keys").orderBy("__range").rowsBetween(1, Window.unboundedFollowing))
    later = least.select("__keys", "__range", after.alias("__later"))
    # read from the last line on, as a frame that begins at the current row costs a pass for each
    soon = F.min("step").over(Window.partitionBy("__keys", "__range").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1))
    joined = with_range(ranged, later).withColumn("__soon", soon)
    return joined.where(F.coalesce(F.col("__soon") > F.col("step"), F.lit(True)) & F.coalesce(F.col("__later") > F.col("step"), F.lit(True))).select(*log.columns)


def repeated_steps(log: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """(run, line, step) of rows with the step of the row before, which is an error even where rewinds are allowed."""
    ranged = step_ranges(log.select("run", "line", "step"), ["run"], "line", rows)
    ends = ranged.groupBy("__keys", "__range").agg(F.max_by("step", "line").alias("end"))
    before = ends.select("__keys", "__range", F.lag("end").over(Window.partitionBy("__keys").orderBy("__range")).alias("before"))
    prev = F.lag("step").over(Window.partitionBy("__keys", "__range").orderBy("line"))
    joined = with_range(ranged, before).withColumn("prev", prev)
    return joined.where(F.col("step") == F.coalesce("prev", "before")).select("run", "line", "step")
