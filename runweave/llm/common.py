"""Table access and lineage cutting shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a batch that is sent to a Python worker, unless the session says otherwise; by rows alone, long texts make large ones.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given data folder; only Spark's own reader opens the path."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; where it is unset and all runs on this machine, as in tests, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    application = spark.sparkContext.applicationId
    if application not in _own:
        _own[application] = "file://" + tempfile.mkdtemp(prefix="shared-")
    return _own[application]


_scopes: list[list[DataFrame]] = []


def materialize(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    This cuts the lineage with files that every executor can reach, so a lost
    executor never forces the steps before it to run again. `small` says that
    the rows are few for the tasks that make them: they are dealt anew, so that
    the table has few files. No marker file is written: who reads the table is
    given it after the job has ended.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.hint("rebalance") if small else df).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of `materialize` that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._shared_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(*kept: str) -> Iterator[None]:
    """Tables that are materialized inside are deleted at the end, but for those of a name in `kept`."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.pop()
        for df in made:
            if any(df._shared_path.rsplit("/", 1)[-1].startswith(f"{name}-") for name in kept):
                if _scopes:
                    _scopes[-1].append(df)
            else:
                discard(df)


def join_counted(rows: DataFrame, found: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """`rows` joined to `found`, which has one row for each key and in `count` how many of `rows` have it, `total` in all.

    Keys with more than a shuffle partition's share of the rows are broadcast,
    of which there can't be more than partitions; so no task gets all rows of
    such a key. `how` is inner or left.
    """
    share = max(1, total // partitions(rows.sparkSession))
    many = found.where(F.col(count) > share)
    few = found.where(F.col(count) <= share).hint("merge")
    rest = rows.join(F.broadcast(many.select(*keys)), keys, "left_anti").join(few, keys, how)
    return rows.join(F.broadcast(many), keys).select(*rest.columns).unionAll(rest)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of a bitmap: 16 for each value that is put in, within these limits.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30


def bitmap(values: DataFrame, count: int) -> np.ndarray:
    """Bytes of a bitmap of `count` 64-bit values, the one column of `values`; nulls count as 0.

    A value sets the bit of its lowest bits, so values must be hashes. The size
    is a power of two and at most MOST_BITS, which bounds what is gathered here
    and broadcast; fuller bitmaps let more through, never less.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * count).bit_length()))
    # in Spark's bitmaps value v > 0 is bit v - 1, counted from bucket 1 on
    bit = F.coalesce(F.col(values.columns[0]), F.lit(0)).bitwiseAND(F.lit(bits - 1)) + 1
    maps = values.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    full = np.zeros(bits // 8, dtype=np.uint8)
    for r in maps.toLocalIterator():
        at = (r["bucket"] - 1) * 4096
        full[at : at + 4096] = np.frombuffer(r["map"], dtype=np.uint8)
    return full


def in_bitmap(full: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the 64-bit values may have been put into a bitmap."""
    spots = values.astype(np.int64) & np.int64(8 * len(full) - 1)
    return (full[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1 == 1
