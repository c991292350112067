"""The recent row-wise log and the compacted columns of a run, read as one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runweave.operators.points import RANGE_ROWS, rows_per_metric, step_ranges, with_range


def explode_rows(hot: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """(run, ord, step, metric, json) of log rows (run, ord, step, values map<string,string>); names in `skip` are left out."""
    rows = hot.select("run", "ord", "step", F.explode("values").alias("metric", "json"))
    return rows.where(~F.col("metric").isin("step", *skip))


def without(points: DataFrame, skip: tuple[str, ...]) -> DataFrame:
    """The points of metrics that no pattern of `skip` matches as a whole name; patterns are Java regular expressions."""
    return points.where(~F.col("metric").rlike(f"^(?:{'|'.join(f'(?:{p})' for p in skip)})\\z")) if skip else points


def last_cold(cold: DataFrame) -> DataFrame:
    """(run, metric, last_step, n): the step at the last position of each metric, and its rows."""
    return cold.groupBy("run", "metric").agg(F.max_by("step", "pos").alias("last_step"), F.count(F.lit(1)).alias("n"))


def _met(cold: DataFrame, hot: DataFrame, by: str, rows: int) -> DataFrame:
    """Hot points in ranges of `by` with their metric's `last_step` and `n`, null where nothing is compacted.

    The ranges of a metric, not its points, are joined to its last step, so that
    a metric that has most of the log is spread over tasks.
    """
    ranged = step_ranges(hot, ["run", "metric"], by, rows)
    last = last_cold(cold).select(F.struct("run", "metric").alias("__last"), "last_step", "n")
    ranges = ranged.select("__keys", "__range").distinct()
    return with_range(ranged, ranges.join(last, F.col("__keys") == F.col("__last"), "left").drop("__last"))


_FRESH = "last_step is null or step > last_step"


def late(cold: DataFrame, hot: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """Hot points that are not after their metric's last compacted step."""
    return _met(cold, hot, "step", rows).where("step <= last_step").select(*hot.columns)


def merge(cold: DataFrame, hot: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """Compacted points, then hot ones after each metric's last compacted step, with `pos` carried on.

    Both have (run, metric, pos, step, ...) and the same columns; a hot point's
    pos only tells its order in the log, and is distinct in a metric. A metric
    without compacted points has all of its hot ones. That a row was compacted
    but not yet taken from the log is hidden by this, so the log must be read
    before the columns are.
    """
    fresh = _met(cold, hot, "pos", rows).where(_FRESH)
    before = Window.partitionBy("__keys").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = fresh.groupBy("__keys", "__range").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__keys", "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__keys", "__range").orderBy("pos")
    placed = with_range(fresh, offsets).withColumn("pos", F.coalesce("n", F.lit(0)) + F.col("__offset") + F.row_number().over(inside) - 1)
    return cold.unionByName(placed.select(*cold.columns))


def merged_rows(cold: DataFrame, hot: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """(run, metric, n) of the merged points."""
    fresh = _met(cold, hot, "step", rows).where(_FRESH).select("run", "metric")
    return rows_per_metric(cold).unionByName(rows_per_metric(fresh)).groupBy("run", "metric").agg(F.sum("n").alias("n"))


def latest_rows(log: DataFrame, order: str = "seq") -> DataFrame:
    """Of rows that were written again for the same (run, step), the last one."""
    return log.groupBy("run", "step").agg(F.max_by(F.struct(*log.columns), order).alias("row")).select("row.*")


def compaction_batch(log: DataFrame, hotsize: int, current_step: int) -> DataFrame:
    """The oldest `hotsize` rows with a step below the current one; none while there are fewer."""
    ready = log.where(F.col("step") < current_step).orderBy("step").limit(hotsize)
    return ready.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).where(F.col("__n") >= hotsize).drop("__n")  # hotsize rows at most in one task
