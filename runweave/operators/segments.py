"""Step indices as arithmetic segments {start, stop, step}."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runweave.operators.points import RANGE_ROWS, step_ranges, with_range

KEYS = ("run", "metric")
#: Segments are kept if there are at most MOST, or one for each PER points.
MOST, PER = 4, 10


def segment(points: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """(run, metric, start, stop, stride): the greedy segmentation of each metric's steps.

    From the left, a segment takes points while their distance stays equal; the
    next one begins at the point after it, and the distance between the two is
    no segment's. A single last point is {v, v + 1, 1}. Steps must be distinct
    within a metric.

    A distance is inside a segment or a bridge behind one. Behind a bridge a
    segment begins; a distance equal to the one before is inside of it, and
    another one turns inside into bridge. So the state flips with every unequal
    distance since the last equal one, and a range of steps passes a state on
    or sets it. Each range is worked on alone; what is ordered over a metric is
    one row for each of its ranges.
    """
    keys = list(KEYS)
    ranged = step_ranges(points.select(*KEYS, "step"), keys, "step", rows)
    inside, over = Window.partitionBy("__keys", "__range").orderBy("step"), Window.partitionBy("__keys").orderBy("__range")
    before, behind = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(1, Window.unboundedFollowing)

    ends = ranged.groupBy("__keys", "__range").agg(F.min("step").alias("first"), F.max("step").alias("last"))
    border = ends.select("__keys", "__range", F.lead("first").over(over).alias("after"), F.lag("last").over(over).alias("ahead"))
    near = with_range(ranged, border).withColumn("diff", F.coalesce(F.lead("step").over(inside), F.col("after")) - F.col("step"))
    near = near.withColumn("equal", F.coalesce(F.col("diff") == F.col("step") - F.coalesce(F.lag("step").over(inside), F.col("ahead")), F.lit(False))).drop("after", "ahead")
    flips = near.withColumn("flips", F.sum((F.col("diff").isNotNull() & ~F.col("equal")).cast("long")).over(inside))
    flips = flips.withColumn("at_equal", F.max(F.when(F.col("equal"), F.col("flips"))).over(inside))

    known = F.col("at_equal").isNotNull()
    state = lambda entry: F.when(known, (1 + F.col("flips") - F.col("at_equal")) % 2).otherwise((entry + F.col("flips")) % 2)
    end = lambda entry: F.when((state(entry) == 0) | F.col("diff").isNull(), F.col("step"))

    # of each range: whether it sets the state, whether it flips it since or in all, and its first end for either state before it
    found = flips.groupBy("__keys", "__range").agg(F.max("flips").alias("flips"), F.max("at_equal").alias("at_equal"), F.min(end(F.lit(0))).alias("end0"), F.min(end(F.lit(1))).alias("end1"))
    found = found.withColumn("flip", (F.col("flips") - F.coalesce("at_equal", F.lit(0))) % 2).withColumn("passed", F.when(known, F.lit(0)).otherwise(F.col("flip")))
    found = found.withColumn("sum", F.sum("passed").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.last(F.when(known, F.struct("sum", "flip")), ignorenulls=True).over(before)
    found = found.withColumn("held", held).withColumn("total", F.coalesce(F.sum("passed").over(before), F.lit(0)))
    found = found.withColumn("entry", F.when(F.col("held").isNull(), F.col("total") % 2).otherwise((1 - F.col("held.flip") + F.col("total") - F.col("held.sum")) % 2))
    later = F.min(F.when(F.col("entry") == 0, F.col("end0")).otherwise(F.col("end1"))).over(behind)
    known_all = with_range(flips, found.select("__keys", "__range", "entry", later.alias("later"))).withColumn("state", state(F.col("entry")))
    known_all = known_all.withColumn("starts", F.coalesce(F.lag("state").over(inside), F.col("entry")) == 0).withColumn("end", end(F.col("entry")))

    # a segment that begins here ends at the next end behind it, in this range or a later one
    # read from the last step on, as a frame that begins at the current row costs a pass for each
    soon = F.min("end").over(Window.partitionBy("__keys", "__range").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1))
    whole = known_all.withColumn("until", F.coalesce(soon, F.col("later"))).where("starts")
    alone = F.col("diff").isNull()
    stride = F.when(alone, F.lit(1)).otherwise(F.col("diff")).cast("bigint")
    return whole.select(*keys, F.col("step").alias("start"), (F.when(alone, F.col("step")).otherwise(F.col("until")) + stride).alias("stop"), stride.alias("stride"))


def segment_count(start: Column, stop: Column, stride: Column) -> Column:
    """Points of a segment."""
    return F.floor((stop - start + stride - 1) / stride)


def expand(segments: DataFrame) -> DataFrame:
    """(run, metric, step) of every point."""
    return segments.where("stop > start").select(*KEYS, F.explode(F.sequence("start", F.col("stop") - 1, "stride")).alias("step"))


def close_tail(segments: DataFrame, counts: DataFrame) -> DataFrame:
    """Segments whose last one may have a null stop, closed by the number of values (run, metric, n); empty ones go."""
    order = Window.partitionBy(*KEYS).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = segments.withColumn("held", F.coalesce(F.sum(F.when(F.col("stop").isNotNull(), segment_count(F.col("start"), F.col("stop"), F.col("stride")))).over(order), F.lit(0)))
    joined = known.join(counts, list(KEYS))
    left = F.col("n") - F.col("held")
    checked = F.when(left < 0, F.raise_error(F.lit("fewer values than closed segments")).cast("bigint")).otherwise(F.col("start") + left * F.col("stride"))
    return joined.withColumn("stop", F.coalesce("stop", checked)).where("stop > start").select(*KEYS, "start", "stop", "stride")


def truncate(segments: DataFrame, step: int) -> DataFrame:
    """What segments hold below a step; strides stay, also of a segment cut to one point."""
    last = F.col("start") + F.floor((F.lit(step) - 1 - F.col("start")) / F.col("stride")) * F.col("stride")
    stop = F.when(F.col("stop") <= step, F.col("stop")).otherwise(last + F.col("stride"))
    return segments.where(F.col("start") < step).withColumn("stop", stop)


def index_mode(segments: DataFrame) -> DataFrame:
    """(run, metric, n_points, n_segments, mode): `segments`, or `indices` where they are too many or the points fewer than 2."""
    sized = segments.groupBy(*KEYS).agg(F.sum(segment_count(F.col("start"), F.col("stop"), F.col("stride"))).alias("n_points"), F.count(F.lit(1)).alias("n_segments"))
    few = (F.col("n_points") >= 2) & (F.col("n_segments") <= F.greatest(F.lit(MOST), F.floor(F.col("n_points") / PER)))
    return sized.withColumn("mode", F.when(few, "segments").otherwise("indices"))


def validated(segments: list[dict]) -> list[dict]:
    """Segments of a manifest, raising if one is malformed, out of order, or open before the last."""
    last = None
    for i, s in enumerate(segments):
        if not isinstance(s, dict) or not {"start", "step"} <= set(s):
            raise ValueError(f"not a segment: {s}")
        start, stride, stop = int(s["start"]), int(s["step"]), s.get("stop")
        if start < 0 or stride <= 0 or (stop is not None and int(stop) <= start) or (last is not None and start <= last):
            raise ValueError(f"segment out of range or order: {s}")
        if stop is None and i < len(segments) - 1:
            raise ValueError(f"only the last segment may be open: {s}")
        if stop is not None:
            last = start + (int(stop) - start - 1) // stride * stride
    return segments
