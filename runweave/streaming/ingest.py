"""Live logs as a stream: rows arrive as JSON files and become points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runweave.operators.merge import last_cold
from runweave.operators.points import COLUMNS, RANGE_ROWS, SCHEMA, step_ranges, with_pos, with_range

ROWS = "run string, step bigint, values array<struct<metric:string,dtype:string,num:double,ival:decimal(20,0),json:string>>"


def read_rows(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The stream of log rows (run, step, values, file) of a folder of JSON files."""
    reader = spark.readStream.schema(ROWS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder).select("*", F.col("_metadata.file_path").alias("file"))


def fresh_points(batch: DataFrame, last: DataFrame, rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """New points of a batch and late ones, which are not after their metric's last compacted step.

    `last` is (run, metric, last_step, n). Of a step that comes twice in a
    batch, the last row stays, by file and place in it. New points get the
    positions after those that there are.
    """
    at = F.struct(F.col("file") if "file" in batch.columns else F.lit(""), F.monotonically_increasing_id())
    values = batch.select("run", "step", at.alias("at"), F.explode("values").alias("v"))
    values = values.groupBy("run", "v.metric", "step").agg(F.max_by("v", "at").alias("v")).select("run", "v.metric", "step", "v.dtype", "v.num", "v.ival", "v.json")
    ranged = step_ranges(values, ["run", "metric"], "step", rows)
    known = last.select(F.struct("run", "metric").alias("__last"), "last_step", "n")
    # the ranges of a metric, not its points, are joined to its last step
    found = ranged.select("__keys", "__range").distinct().join(known, F.col("__keys") == F.col("__last"), "left").drop("__last")
    met = with_range(ranged, found)
    new = F.col("last_step").isNull() | (F.col("step") > F.col("last_step"))
    placed = with_pos(met.where(new).drop("__keys", "__range"), rows=rows)
    fresh = placed.withColumn("pos", F.coalesce("n", F.lit(0)) + F.col("pos")).select(*COLUMNS)
    return fresh, met.where(~new).select("run", "metric", "step", "dtype", "num", "ival", "json")


def _last(spark: SparkSession, table: str, number: int) -> DataFrame:
    """(run, metric, last_step, n) before a batch: as the batch before has left it, else from the table itself."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}.last/batch={number - 1}/_SUCCESS")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(_LAST).parquet(f"{table}.last/batch={number - 1}")
    return last_cold(points_before(spark, table, number))


_LAST = "run string, metric string, last_step bigint, n bigint"


def start_ingest(rows: DataFrame, table: str, checkpoint: str, late: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream of log rows to a Parquet table of points; late points go to the table `late`, if given.

    A batch is written under its number, over what an interrupted try left, so
    that replaying it changes nothing. Beside the table stands where each metric
    ends after each of the last batches, so that a batch needn't read the table.
    """
    spark = rows.sparkSession
    # batch is a column of the path, so that a replayed batch replaces itself
    write = lambda df, path, number: df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    def take(batch: DataFrame, number: int) -> None:
        before = _last(spark, table, number)
        fresh, old = fresh_points(batch.persist(), before)
        write(fresh, table, number)
        if late is not None:
            write(old, late, number)
        written = spark.read.schema(SCHEMA).parquet(f"{table}/batch={number}")
        ends = before.unionByName(last_cold(written)).groupBy("run", "metric").agg(F.max("last_step").alias("last_step"), F.sum("n").alias("n"))
        write(ends, f"{table}.last", number)
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{table}.last/batch={number - 3}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
        batch.unpersist()

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def points_before(spark: SparkSession, table: str, number: int | None = None) -> DataFrame:
    """The points of a table, of batches below `number` if it is given."""
    try:
        found = spark.read.schema(f"{SCHEMA}, batch bigint").option("basePath", table).parquet(table)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], SCHEMA)
    return (found if number is None else found.where(F.col("batch") < number)).select(*COLUMNS)
