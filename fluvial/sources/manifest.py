"""A manifest of forcing files that grows: each file is read once, when it is new or has changed.

A row has path, length, modified, start_time, end_time, n_steps and step_seconds (the median distance of its times). A file is known by path, length and time of
modification; update() lists the files, which reads none of them, and reads the times of those that the manifest doesn't know. stream() does the same as a stream
of files: each batch's rows go to a folder of the batch's number, so a batch that runs again replaces its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluvial.functions.columns import file_timestamp
from fluvial.operators.windows import median_step_seconds

COLUMNS = ("path", "length", "modified", "start_time", "end_time", "n_steps", "step_seconds")
DDL = "path string, length bigint, modified timestamp, start_time timestamp_ntz, end_time timestamp_ntz, n_steps bigint, step_seconds double"
#: Files whose times are read together; their names are what the driver holds.
FILES = 10_000


def listed(spark: SparkSession, directory: str, pattern: str = "*.parquet") -> DataFrame:
    """path, length, modified of the files below a directory."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(directory)
    return d.select("path", "length", F.col("modificationTime").alias("modified"))


def described(files: DataFrame, time: str = "time") -> DataFrame:
    """Rows of a manifest for at most FILES files, from their times; a file without rows stands for the time in its name."""
    spark = files.sparkSession
    paths = [r.path for r in files.select("path").limit(FILES).collect()]
    if not paths:
        return spark.createDataFrame([], DDL)
    d = spark.read.parquet(*paths).select(F.col("_metadata.file_path").alias("path"), F.col(time).cast("timestamp_ntz").alias("time"))
    times = median_step_seconds(d.where("time IS NOT NULL"), ["path"]).withColumnRenamed("path", "_path")
    name = file_timestamp(F.regexp_extract("path", r"([^/]*)$", 1))
    j = files.join(times, _same_path("path", "_path"), "left")
    return j.select("path", "length", "modified", *[F.coalesce(F.col(c).cast("timestamp_ntz"), name).alias(c) for c in ("start_time", "end_time")], F.coalesce("n_steps", F.lit(1)).cast("bigint").alias("n_steps"), F.col("step_seconds").cast("double").alias("step_seconds"))


def _same_path(a: str, b: str):
    """Paths of listings and of metadata differ in the slashes after the scheme and in escapes."""
    plain = lambda c: F.url_decode(F.regexp_replace(F.replace(F.col(c), F.lit("+"), F.lit("%2B")), "^file:/+", "/"))
    return plain(a) == plain(b)


def load(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a manifest, also of files that have changed or gone since; a table that isn't one is an error."""
    try:
        d = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return spark.createDataFrame([], DDL)
        raise
    missing = [c for c in COLUMNS if c not in d.columns]
    if missing:
        raise ValueError(f"{path} is no manifest: it lacks {missing}")
    return d.select(*COLUMNS)


def update(spark: SparkSession, directory: str, path: str, pattern: str = "*.parquet", time: str = "time") -> int:
    """Add the files that the manifest doesn't know, in blocks of FILES; how many there were."""
    known = ["path", "length", "modified"]
    added = 0
    while True:
        new = listed(spark, directory, pattern).join(load(spark, path).select(*known), known, "left_anti").orderBy("path").limit(FILES)
        rows = described(new, time).collect()
        if not rows:
            return added
        spark.createDataFrame(rows, DDL).write.mode("append").parquet(path)
        added += len(rows)


def stream(spark: SparkSession, directory: str, path: str, checkpoint: str, pattern: str = "*.parquet", time: str = "time") -> None:
    """Add the files that have come since the last run, and stop."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", FILES).load(directory)
    files = files.select("path", "length", F.col("modificationTime").alias("modified"))

    def add(batch: DataFrame, number: int) -> None:
        described(batch, time).write.mode("overwrite").parquet(f"{path}/batch={number}")

    files.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(add).start().awaitTermination()


def current(spark: SparkSession, directory: str, path: str, pattern: str = "*.parquet") -> DataFrame:
    """The manifest's rows of the files as they are now."""
    known = ["path", "length", "modified"]
    d = load(spark, path).join(listed(spark, directory, pattern), known, "left_semi")
    latest = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("modified"), "start_time"))
    return d.withColumn("_k", latest).where("_k = 1").drop("_k")
