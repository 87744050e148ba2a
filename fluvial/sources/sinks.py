"""Writers: partitioned tables, reports, scalers, graphs, histories."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What to do where there is a table already.
MODES = {"overwrite": "overwrite", "skip": "ignore", "fail": "errorifexists", "append": "append"}


def write_yearly(df: DataFrame, path: str, time: str = "time", mode: str = "fail", sort: tuple[str, ...] = ("flat_index",)) -> None:
    """A folder for each year. overwrite replaces only the years of df; skip leaves years that are there as they are."""
    d = df.withColumn("year", F.year(time))
    spark = df.sparkSession
    if mode == "skip":
        d = d.join(F.broadcast(existing_years(spark, path)), "year", "left_anti")
        mode = "append"
    # rows of a year meet in as many tasks as are needed, sorted so that row groups can be skipped
    d = d.repartitionByRange("year", *[c for c in sort if c in df.columns]).sortWithinPartitions("year", *[c for c in (*sort, time) if c in df.columns])
    d.write.mode(MODES[mode]).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year").parquet(path)


def existing_years(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path).select("year").distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return spark.createDataFrame([], "year int")
        raise


def write_report(df: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """A report of a few rows for each gauge as one CSV file with a header."""
    d = df.orderBy(*order) if order else df
    d.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def append_history(df: DataFrame, path: str) -> None:
    """Rows added to a history; columns may come and go from run to run."""
    df.write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def write_graph(tables: Mapping[str, DataFrame], path: str, metadata: Mapping | None = None) -> None:
    """Each table of a graph, and its metadata as JSON."""
    import json

    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(dict(metadata or {}), default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def read_graph(spark: SparkSession, path: str, names=("nodes", "edges", "gauges", "source_map")) -> dict:
    import json

    out = {}
    for name in names:
        try:
            out[name] = spark.read.parquet(f"{path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    out["metadata"] = json.loads(spark.read.text(f"{path}/metadata").first().value)
    return out


def scaler_mapping(scaler: DataFrame, key: str = "variable") -> dict:
    """A scaler of a row for each variable as nested dicts, for a YAML file."""
    return {r[key]: {"mean": r["mean"], "std": r["std"]} for r in scaler.collect()}


def read_scaler(spark: SparkSession, path: str, key: str = "variable") -> DataFrame:
    """key, mean, std of a scaler file; an entry that isn't a pair of finite numbers is an error."""
    import math

    rows = []
    for name, entry in read_yaml(path).items():
        try:
            mean, std = float(entry["mean"]), float(entry["std"])
        except (KeyError, TypeError, ValueError):
            mean = std = math.nan
        if not (math.isfinite(mean) and math.isfinite(std)):
            raise ValueError(f"{path}: {name!r} needs a mean and a std, got {entry!r}")
        rows.append((str(name), mean, std))
    return spark.createDataFrame(rows, f"`{key}` string, mean double, std double")


#: Blocks of a split file; the search for a split takes no more.
SPLIT_BLOCKS = 20_000


def write_split(assigned: DataFrame, path: str, metadata: Mapping | None = None) -> None:
    """A split (block_id, block_start, block_end, period) as a file that read_split() and loaders of blocks take: metadata with the number of blocks of each
    period, and blocks in the order of time. More than SPLIT_BLOCKS blocks are an error."""
    rows = assigned.select("block_id", F.col("block_start").cast("date").alias("start"), F.col("block_end").cast("date").alias("end"), "period").limit(SPLIT_BLOCKS + 1).collect()
    if len(rows) > SPLIT_BLOCKS:
        raise ValueError(f"a split file holds {SPLIT_BLOCKS} blocks at most")
    blocks = [{"block_id": int(r.block_id), "start": r.start.isoformat(), "end": r.end.isoformat(), "period": r.period} for r in sorted(rows, key=lambda r: (r.start, r.end, r.block_id))]
    counts = {p: sum(b["period"] == p for b in blocks) for p in sorted({b["period"] for b in blocks})}
    write_yaml({"type": "precomputed_blocks", "metadata": {**(metadata or {}), "assignment_summary": counts}, "blocks": blocks}, path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """block_id, start, end, period of a split file, for splits.load_blocks(); blocks without an id are numbered in the order of the file, dates that aren't are null."""
    import datetime as dt

    def day(value):
        try:
            return value if isinstance(value, dt.date) and not isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value)).date()
        except ValueError:
            return None

    blocks = read_yaml(path).get("blocks")
    if not isinstance(blocks, list) or not all(isinstance(b, Mapping) for b in blocks):
        raise ValueError(f"{path} needs a list of mappings named blocks")
    rows = [(int(b.get("block_id", b.get("id", k))), day(b.get("start")), day(b.get("end")), str(b.get("period", ""))) for k, b in enumerate(blocks)]
    return spark.createDataFrame(rows, "block_id bigint, start date, end date, period string")


def write_yaml(mapping: Mapping, path: str) -> None:
    """At any path that pyarrow knows."""
    import yaml

    from fluvial.sources.arrays import write_bytes

    write_bytes(path, yaml.safe_dump(dict(mapping), sort_keys=False, allow_unicode=True).encode())


def read_yaml(path: str) -> dict:
    import yaml

    from fluvial.sources.arrays import read_bytes

    data = read_bytes(path)
    if data is None:
        raise FileNotFoundError(path)
    return yaml.safe_load(data.decode()) or {}
