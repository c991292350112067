"""The canonical relation of metric points, and what must hold of it.

points(run, metric, pos, step, dtype, num, ival, json): a row for each value
written. `pos` is the point's place in its metric, from 0. Of num (floats), ival
(integers) and json (everything else, as JSON text) one has the value. A metric
that was not written at a step has no row there; a JSON null is a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runweave.functions.types import JSON, KINDS, LAST_STEP

SCHEMA = "run string, metric string, pos bigint, step bigint, dtype string, num double, ival decimal(20,0), json string"
COLUMNS = ("run", "metric", "pos", "step", "dtype", "num", "ival", "json")
#: Steps, and so rows at most, of one range where a metric is cut for ordering.
RANGE_ROWS = 1 << 20


def from_long(df: DataFrame, run: Column, metric: Column, step: Column, value: Column, dtype: str) -> DataFrame:
    """Points, without pos, of a table with a row for each value."""
    none = lambda kind: F.lit(None).cast(kind)
    return df.select(
        run.alias("run"),
        metric.alias("metric"),
        step.cast("bigint").alias("step"),
        F.lit(dtype).alias("dtype"),
        (value.cast("float" if dtype == "f32" else "double").cast("double") if dtype[0] == "f" else none("double")).alias("num"),
        (value.cast("decimal(20,0)") if dtype in KINDS and dtype[0] != "f" else none("decimal(20,0)")).alias("ival"),
        (value.cast("string") if dtype == JSON else none("string")).alias("json"),
    )


def from_wide(df: DataFrame, run: Column, step: Column, metrics: dict[str, tuple[Column, str]]) -> DataFrame:
    """Points, without pos, of a table with a column for each metric; null is not written.

    `metrics` maps a name to its column and dtype. All are unpivoted in one
    pass over the table.
    """
    row = []
    for name, (value, dtype) in metrics.items():
        row.append(
            F.struct(
                F.lit(name).alias("metric"),
                F.lit(dtype).alias("dtype"),
                (value.cast("float" if dtype == "f32" else "double").cast("double") if dtype[0] == "f" else F.lit(None).cast("double")).alias("num"),
                (value.cast("decimal(20,0)") if dtype in KINDS and dtype[0] != "f" else F.lit(None).cast("decimal(20,0)")).alias("ival"),
                (value.cast("string") if dtype == JSON else F.lit(None).cast("string")).alias("json"),
                value.isNotNull().alias("written"),
            )
        )
    out = df.select(run.alias("run"), step.cast("bigint").alias("step"), F.explode(F.array(*row)).alias("p")).where("p.written")
    return out.select("run", "p.metric", "step", "p.dtype", "p.num", "p.ival", "p.json")


def to_wide(points: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """A row for each (run, step) with a typed column for each named metric, null where it wasn't written."""
    chosen = points.where(F.col("metric").isin(*metrics))
    return chosen.groupBy("run", "step").agg(*(F.max(F.when(F.col("metric") == name, typed_value(dtype))).alias(name) for name, dtype in metrics.items()))


def typed_value(dtype: str) -> Column:
    """The value column of a metric in its own type."""
    if dtype == JSON:
        return F.col("json")
    if dtype not in KINDS:
        raise ValueError(f"unknown dtype {dtype}")
    return F.col("num" if dtype[0] == "f" else "ival").cast(KINDS[dtype].spark)


def step_ranges(df: DataFrame, keys: list[str], by: str = "step", rows: int = RANGE_ROWS) -> DataFrame:
    """`df` with `__keys`, its keys as one value that nulls are equal in, and `__range`.

    That numbers ranges of `rows` values of the integer column `by`. As values
    are distinct in a key, a range has at most so many rows, and a metric of any
    size is ordered in many tasks instead of one. A key has as many ranges as
    its largest value has multiples of `rows`: 4,096 for all of 32 bits. It is
    told by the row alone, which needs no pass over the table.
    """
    return df.withColumn("__keys", F.struct(*keys)).withColumn("__range", F.floor(F.col(by) / F.lit(rows)))


def with_range(ranged: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of `step_ranges` with the columns of `found`, which has a row for each (__keys, __range).

    The rows are dealt by these two, as windows within a range need them, too.
    """
    other = found.withColumnRenamed("__keys", "__found").withColumnRenamed("__range", "__at")
    return ranged.join(other, (F.col("__keys") == F.col("__found")) & (F.col("__range") == F.col("__at"))).drop("__found", "__at")


def with_pos(df: DataFrame, keys: tuple[str, ...] = ("run", "metric"), by: str = "step", rows: int = RANGE_ROWS) -> DataFrame:
    """`df` with `pos`, its place in each key by `by`.

    Counts of ranges of steps are summed up first, so no task gets all of a
    large metric. `by` must tell the rows of a key apart.
    """
    ranged = step_ranges(df, list(keys), by, rows)
    before = Window.partitionBy("__keys").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("__keys", "__range").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__keys", "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__keys", "__range").orderBy(by)
    return with_range(ranged, offsets).withColumn("pos", F.col("__offset") + F.row_number().over(inside) - 1).drop("__offset", "__keys", "__range")


def duplicates(points: DataFrame) -> DataFrame:
    """(run, metric, step, times) of every step that a metric has more than once."""
    return points.groupBy("run", "metric", "step").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def out_of_order(points: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """(run, metric, pos, step, before) of points whose step is not above that of the point before, by pos."""
    ranged = step_ranges(points.select("run", "metric", "pos", "step"), ["run", "metric"], "pos", rows)
    ends = ranged.groupBy("__keys", "__range").agg(F.max_by("step", "pos").alias("end"))
    border = ends.select("__keys", "__range", F.lag("end").over(Window.partitionBy("__keys").orderBy("__range")).alias("border"))
    inside = F.lag("step").over(Window.partitionBy("__keys", "__range").orderBy("pos"))
    met = with_range(ranged, border).withColumn("before", F.coalesce(inside, F.col("border")))
    return met.where(F.col("step") <= F.col("before")).select("run", "metric", "pos", "step", "before")


def increasing(points: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """The points, raising when it runs if a metric's steps don't increase strictly by pos."""
    bad = out_of_order(points, rows).agg(F.first(F.concat_ws(" ", "metric", "step", "before")).alias("__bad"))  # one row
    text = F.concat(F.lit("step doesn't increase (metric, step, step before): "), F.col("__bad"))
    guarded = F.when(F.col("__bad").isNotNull(), F.raise_error(text).cast("bigint")).otherwise(F.col("step"))
    return points.crossJoin(F.broadcast(bad)).withColumn("step", guarded).drop("__bad")


def checked(points: DataFrame) -> DataFrame:
    """The points, raising when it runs on a step out of range or a reserved or missing name."""
    bad = F.col("step").isNull() | (F.col("step") < 0) | (F.col("step") > LAST_STEP)
    name = F.col("metric").isNull() | (F.col("metric") == "step") | (F.col("metric") == "")
    guarded = F.when(bad, F.raise_error(F.concat(F.lit("step out of range: "), F.coalesce(F.col("step").cast("string"), F.lit("null")))).cast("bigint"))
    guarded = guarded.when(name, F.raise_error(F.concat(F.lit("not a metric name: "), F.coalesce(F.col("metric"), F.lit("null")))).cast("bigint"))
    return points.withColumn("step", guarded.otherwise(F.col("step")))


def metric_names(*relations: DataFrame) -> DataFrame:
    """(run, metric) of all points in any of the relations."""
    out = relations[0].select("run", "metric")
    for r in relations[1:]:
        out = out.unionByName(r.select("run", "metric"))
    return out.distinct()


def rows_per_metric(points: DataFrame) -> DataFrame:
    return points.groupBy("run", "metric").agg(F.count(F.lit(1)).alias("n"))


def run_rows(points: DataFrame) -> DataFrame:
    """(run, run_rows): the rows of its longest metric."""
    return rows_per_metric(points).groupBy("run").agg(F.max("n").alias("run_rows"))
