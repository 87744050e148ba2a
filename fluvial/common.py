"""Helpers shared by all operators: table access, shared storage, size-checked and skew-proof joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows fit in this many bytes.
BROADCAST_BYTES = 32 << 20
#: A key is hot if it holds more than 1 / HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000
#: Where tables are dealt out by their counted rows, so many go to one task.
TASK_ROWS = 500_000

_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Let Arrow batches of whole texts hold at most so many rows and bytes, so that workers need little memory."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if int(spark.conf.get(name).rstrip("b")) > most:
            spark.conf.set(name, most)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, for a local master only, one of our own."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _own_dir:
        _own_dir[sc.applicationId] = tempfile.mkdtemp(prefix="fluvial-")
        sc.setCheckpointDir(_own_dir[sc.applicationId])
    return _own_dir[sc.applicationId]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/fluvial/{name}-{uuid.uuid4().hex}"


#: For tables with rows of megabytes: look at the size of pages and row groups after each row, not after each hundred, and
#: compress in a stream, not with buffers as large as a page.
LARGE_ROWS = {"compression": "zstd", "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(16 << 20)}


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives the loss of executors.

    The table goes when the application ends, or with the scratch() block in which it was written.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    file_system, at = _file_system(spark, path)
    file_system.deleteOnExit(at)
    if _scratch:
        _scratch[-1].append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_scratch: list[list[str]] = []


def _file_system(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """A block whose written tables are deleted at its end, but for those written by what it yields, a materialize()."""
    kept: list[str] = []

    def keep(df: DataFrame, name: str, **options: str) -> DataFrame:
        out = materialize(df, name, **options)
        kept.append(_scratch[-1].pop())
        return out

    _scratch.append([])
    try:
        yield keep
    finally:
        for path in _scratch.pop():
            file_system, at = _file_system(spark, path)
            file_system.delete(at, True)
        if _scratch:
            _scratch[-1].extend(kept)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """A block in which the files of a query's shuffles are deleted when the query is done, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df, counted, fits in limit. Counting stops as soon as the limit is passed."""
    most = limit // row_bytes
    return df.select(F.lit(1)).limit(most + 1).count() <= most


def shuffled_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join that shuffles and sorts both sides, whatever their estimated sizes: estimates are those of compressed files, of which a
    broadcast table takes fifty times as much in the driver and in each executor."""
    return left.join(right.hint("merge"), on, how)


def checked_join(left: DataFrame, right: DataFrame, on, how: str, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join that broadcasts right if its counted size is below the limit and shuffles both sides otherwise."""
    return left.join(F.broadcast(right), on, how) if small_enough(right, row_bytes, limit) else shuffled_join(left, right, on, how)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """How many tasks take so many rows: as many as the session shuffles to, or more if those would have more than TASK_ROWS each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df as it is while a shuffle by the session's partitions leaves at most TASK_ROWS rows a task; else shuffled by keys into more. Sums by
    the keys then take the memory of TASK_ROWS rows a task, however large df is; before, both sides of their shuffle grew with it. df is
    counted, so it should be cheap to count: a table, not a sum."""
    n = tasks_for(df.sparkSession, df.count())
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def skew_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, share: int = HOT_SHARE) -> DataFrame:
    """Left join on one key that stays even when a few keys hold most rows of left.

    right has one row for each key, and in column `weight` how many rows of left have that key; total is the number of
    rows of left. Keys with more than total / share rows number fewer than share, so their rows of right are broadcast;
    the rest go through a shuffled join in which no key holds more than total / share rows. The weight column is dropped.
    """
    hot = right.where(F.col(weight) * share > total).drop(weight)
    cold = right.where(F.col(weight) * share <= total).drop(weight)
    heated = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    rest = heated.where(F.col("_hot").isNull()).select(*left.columns).join(cold, key, "left")
    return heated.where(F.col("_hot")).drop("_hot").unionByName(rest)


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "number", group: str | None = None) -> DataFrame:
    """df with a gapless number from 0 in the given order; with `group`, the first column of the order, from 0 in each group, and
    the group's size as `{name}_of`.

    No task gets more than a range of the order, however large a group is: rows are range-partitioned, sorted and written, so that
    their places can't change any more, and each partition's rows (of each group) start where those before it end. Those
    starts are one row for each partition (and group in it). Rows that are equal in the whole order get numbers in any order.
    """
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    keys = [part.alias("_part"), *([F.col(group).alias("_group")] if group else [])]
    starts = placed.groupBy(*keys).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy("_group") if group else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(within.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(starts.select("_part", *(["_group"] if group else []), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(within).alias(f"{name}_of")), "starts")
    on = [part == F.col("_part"), *([F.col(group).eqNullSafe(F.col("_group"))] if group else [])]
    out = checked_join(placed, starts if group else starts.drop(f"{name}_of"), on, "inner", row_bytes=128)
    return out.withColumn(name, (F.col("_at") + F.col("_shift")).cast("bigint")).select(*df.columns, name, *([f"{name}_of"] if group else []))
