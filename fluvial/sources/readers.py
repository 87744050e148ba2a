"""Readers for forcing, static grids, targets, gauges and graphs. Parquet is the working format; text formats are read with
explicit schemas, so that ids keep their leading zeros."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvial.common import materialize
from fluvial.functions.columns import CFS_TO_M3S, SECONDS_PER_DAY, file_timestamp, finite, first_given, number, sentinel_to_null

#: Names of a time column, in the order in which they are looked for.
TIME_NAMES = ("time", "date", "datetime")
#: Variables that files carry along and nobody reads.
DROPPED = ("reference_time", "crs")
FORMATS = {"parquet": "parquet", "orc": "orc", "json": "json", "csv": "csv"}


def time_column(df: DataFrame, preferred: str | None = None) -> str:
    """The preferred column if there is one, else the first of a time type, else one with a usual name."""
    if preferred and preferred in df.columns:
        return preferred
    typed = [f.name for f in df.schema if f.dataType.typeName() in ("timestamp", "timestamp_ntz", "date")]
    named = [c for c in TIME_NAMES if c in df.columns]
    if not typed and not named:
        raise KeyError(f"no time column among {df.columns}")
    return (typed or named)[0]


def project(df: DataFrame, variables: Sequence[str] | None, keys: Sequence[str]) -> DataFrame:
    df = df.drop(*DROPPED)
    if variables is None:
        return df
    missing = [v for v in variables if v not in df.columns]
    if missing:
        raise KeyError(f"missing variables {missing}; there are {df.columns}")
    return df.select(*keys, *variables)


def read_table(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    return spark.read.format(FORMATS[format]).options(**options).load(path)


def read_files(spark: SparkSession, directory: str, pattern: str = "*.parquet", start=None, end=None, format: str = "parquet") -> DataFrame:
    """All files below a directory that match the pattern. With a period, only folders named after its years, if any are named
    after years, and only files whose names hold a time within it, or none. Nothing of the others is read."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("mergeSchema", "true").format(FORMATS[format]).load(directory)
    if start is None or end is None:
        return df
    return df.where(in_file_period(F.col("_metadata.file_path"), start, end))


def in_file_period(path: Column, start, end) -> Column:
    folder = F.regexp_extract(path, r"/([0-9]{4})/[^/]*$", 1)
    year_ok = (folder == "") | F.try_to_number(folder, F.lit("9999")).between(F.year(F.lit(start)), F.year(F.lit(end)))
    t = file_timestamp(F.regexp_extract(path, r"([^/]*)$", 1))
    return year_ok & (t.isNull() | t.between(F.lit(start), F.lit(end)))


def list_files(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """path, length, name, time (in the name) of files below a directory; their contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(directory).select("path", "length")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return df.withColumns({"name": name, "time": file_timestamp(name)})


def read_yearly(spark: SparkSession, path: str, variables: Sequence[str] | None, start, end, time: str = "time", keys: Sequence[str] = ("flat_index",)) -> DataFrame:
    """A table that is partitioned by year, within [start, end]: other years' folders aren't touched."""
    df = spark.read.parquet(path)
    if "year" in df.columns:
        df = df.where(F.col("year").between(F.year(F.lit(start)), F.year(F.lit(end))))
    return project(df.where(F.col(time).between(F.lit(start), F.lit(end))), variables, [*keys, time])


def merge_static(parts: Sequence[DataFrame], keys: Sequence[str] = ("flat_index",)) -> DataFrame:
    """Static tables of the same grid side by side; a cell that one of them lacks is an error when run."""
    def exact(left: DataFrame, right: DataFrame) -> DataFrame:
        j = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), list(keys), "full")
        bad = F.raise_error(F.lit("static tables cover different cells"))
        return j.where(F.when(F.col("_l").isNull() | F.col("_r").isNull(), bad).otherwise(F.lit(True))).drop("_l", "_r")

    return reduce(exact, parts)


def open_source(spark: SparkSession, spec: Mapping, kind: str = "forcing", start=None, end=None) -> DataFrame:
    """A source by its mode: single_file, zarr (a folder of one table), multi_file, multi_zarr_yearly, per_variable, or auto.

    spec: file_mode, path, variables, and files (variable to path) for per_variable. Tables have the key columns
    flat_index and, for forcing, time. With format zarr or netcdf, path is a container or a folder of them (files, or a store for each year), of
    which only chunks and years within the period are opened.
    """
    if spec.get("format") in ("zarr", "netcdf"):
        from fluvial.sources.arrays import read_arrays

        forcing = kind == "forcing"
        return read_arrays(spark, spec["path"], spec.get("variables"), start if forcing else None, end if forcing else None, spec["format"], **spec.get("options", {}))
    mode, variables, keys = spec.get("file_mode", "auto"), spec.get("variables"), list(spec.get("keys", ["flat_index"]))
    if mode == "auto":
        mode = "per_variable" if spec.get("files") else "multi_zarr_yearly" if spec.get("yearly") else "multi_file" if spec.get("pattern") else "single_file"
    if kind == "static" and mode in ("multi_file", "multi_zarr_yearly"):
        if mode == "multi_zarr_yearly":
            raise ValueError("static sources aren't yearly")
        return project(merge_static([read_table(spark, p) for p in spec["paths"]], keys), variables, keys)
    if mode in ("single_file", "zarr"):
        df = read_table(spark, spec["path"], spec.get("format", "parquet"))
    elif mode == "multi_file":
        df = read_files(spark, spec["path"], spec.get("pattern", "*.parquet"), start, end)
    elif mode == "multi_zarr_yearly":
        return read_yearly(spark, spec["path"], variables, start, end, spec.get("time", "time"), keys)
    elif mode == "per_variable":
        time = [spec.get("time", "time")] if kind == "forcing" else []
        each = []
        for v, p in spec["files"].items():
            d = read_table(spark, p)
            only = [c for c in d.columns if c not in (*keys, *time)]
            if v not in d.columns and len(only) == 1:  # a file with one variable may name it otherwise
                d = d.withColumnRenamed(only[0], v)
            each.append(project(d, [v], [*keys, *time]))
        df = merge_static(each, [*keys, *time]) if kind == "static" else reduce(lambda a, b: a.join(b, [*keys, *time], "full"), each)
        return df.select(*keys, *time, *(variables or spec["files"]))
    else:
        raise ValueError(f"unknown file mode {mode!r}")
    if kind == "static":
        return project(df, variables, keys)
    t = time_column(df, spec.get("time"))
    df = project(df, variables, [*keys, t])
    return df if start is None or end is None else df.where(F.col(t).between(F.lit(start), F.lit(end)))


def wide_to_long(df: DataFrame, variables: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys, variable, value; not finite values are missing."""
    return df.select(*keys, *[finite(v).alias(v) for v in variables]).unpivot(list(keys), list(variables), "variable", "value")


def read_targets(spark: SparkSession, path: str, variables: Sequence[str] = ("QQobs",), date: str = "datetime", sep: str = ",", units: str = "auto", skip_second_line: bool = True) -> DataFrame:
    """file, date, variables from CSV files of daily flow, in m3/s.

    The second line of each file describes the columns' formats and is skipped; files without one need
    skip_second_line=False. The date column is the candidate of which most values are dates. A column with 00060 in its
    name that isn't a quality code is the discharge, in cubic feet. units: auto, none or cfs_to_cms.
    """
    df = spark.read.option("header", "true").option("sep", sep).csv(path).withColumn("file", F.col("_metadata.file_path"))
    lower = {c.lower(): c for c in reversed(df.columns)}
    candidates = list(dict.fromkeys(lower[c.lower()] for c in (date, "datetime", "date") if c.lower() in lower))
    if skip_second_line:
        # the line that follows the header: every other line has a date
        formats = reduce(lambda a, b: a & b, [F.try_to_date(c).isNull() for c in candidates], F.lit(True)) & F.col(df.columns[0]).rlike("^[0-9]+[sdn]$")
        df = df.where(~F.coalesce(formats, F.lit(False)))
    scores = df.agg(*[F.count(F.try_to_date(F.substring(c, 1, 10))).alias(c) for c in candidates]).first() if candidates else {}
    best = max(candidates, key=lambda c: scores[c], default=None)
    if best is None or not scores[best]:
        raise KeyError(f"no date column like {date!r} in {path}")
    flow = next((c for c in df.columns if "00060" in c and not c.lower().endswith("_cd")), None) if "QQobs" not in df.columns else None
    if flow:
        df = df.withColumnRenamed(flow, "QQobs")
    convert = {"auto": flow is not None, "none": False, "identity": False, "cfs_to_cms": True}.get(units)
    if convert is None:
        raise ValueError(f"unknown unit conversion {units!r}")
    missing = [v for v in variables if v not in df.columns]
    if missing:
        raise KeyError(f"missing targets {missing} in {path}")
    return df.select("file", F.try_to_date(F.substring(best, 1, 10)).alias("date"), *[(number(v) * (CFS_TO_M3S if convert else 1.0)).alias(v) for v in variables])


def read_basins(spark: SparkSession, path: str) -> DataFrame:
    """gauge_id, one for each line that isn't blank; a list without any is an error."""
    d = spark.read.text(path).select(F.trim("value").alias("gauge_id")).where(F.length("gauge_id") > 0)
    if d.isEmpty():
        raise ValueError(f"no gauges in {path}")
    return d


def read_gauges(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """gauge_id, lat, lon, x, y from CSV, or JSON with a list, one object, or {"gauges": [...]}."""
    if path.endswith(".json"):
        df = spark.read.option("multiLine", "true").option("primitivesAsString", "true").json(path)
        df = df.select(F.explode("gauges").alias("g")).select("g.*") if "gauges" in df.columns else df
    else:
        df = spark.read.option("header", "true").option("sep", sep).csv(path)
    names = [c for c in ("gauge_id", "basin_id", "site_no", "id", "name") if c in df.columns]
    pick = lambda *cs: next((number(c) for c in cs if c in df.columns), F.lit(None).cast("double"))
    return df.select(first_given(*names).alias("gauge_id"), pick("lat", "latitude").alias("lat"), pick("lon", "longitude").alias("lon"), pick("x").alias("x"), pick("y").alias("y"))


def read_runoff_days(spark: SparkSession, directory: str, pattern: str = "*.parquet", sentinels: Sequence[float] = (-9999.0, 1e20), variables: Sequence[str] = ("RUNSF", "RUNSB"), keys: Sequence[str] = ("flat_index",)) -> DataFrame:
    """Daily files whose names hold their date; rates per second become depths per day, sentinels missing, and the total of
    both components is added."""
    from fluvial.operators.prepare import total_runoff

    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).parquet(directory)
    date = F.to_date(file_timestamp(F.col("_metadata.file_name")))
    return total_runoff(df.select(*keys, date.alias("date"), *[(sentinel_to_null(v, *sentinels) * SECONDS_PER_DAY).alias(v) for v in variables]))


def first_wins(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of several layers, the first layer's for each key, and of that the first in its order by all columns."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("_k", F.lit(k)) for k, p in enumerate(parts)])
    rest = [c for c in every.columns if c not in (key, "_k")]
    best = every.groupBy(key).agg(F.min(F.struct("_k", *rest)).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in rest])


# Other names of the parts of a stored graph.
GRAPH_NAMES = {
    "edge_index": ("edges",), "edge_weight": ("edge_weights", "weights"), "edge_attr": ("edge_features",), "node_features": ("features",),
    "gauge_index": ("gauge_indices", "outlet_index", "outlet_indices"), "flat_index": ("node_flat_index",),
}


def resolve_names(df: DataFrame, names: Mapping[str, Sequence[str]] = GRAPH_NAMES) -> DataFrame:
    """Columns under their usual names."""
    found = {a: n for n, others in names.items() if n not in df.columns for a in others if a in df.columns}
    return df.withColumnsRenamed(found)


def read_graph_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes, edges and gauges of a graph in one JSON file with edge_index [[src...], [dst...]] and optional vectors."""
    df = resolve_names(spark.read.option("multiLine", "true").json(path))
    z = F.arrays_zip(F.col("edge_index")[0].alias("src"), F.col("edge_index")[1].alias("dst"))
    edges = df.select(F.posexplode(z).alias("edge", "e"), *([F.col("edge_weight")] if "edge_weight" in df.columns else []))
    weight = F.get("edge_weight", F.col("edge")).cast("double") if "edge_weight" in df.columns else F.lit(1.0)
    edges = materialize(edges.select(F.col("e.src").alias("src"), F.col("e.dst").alias("dst"), weight.alias("weight")), "graph-edges")
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    top = F.max("node")
    if "flat_index" in df.columns:
        nodes = df.select(F.posexplode("flat_index").alias("node", "flat_index"))
    else:
        nodes = ends.agg(top.alias("m")).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m"))).alias("node"))
    gauges = df.select(F.posexplode("gauge_index").alias("gauge_pos", "node")) if "gauge_index" in df.columns else nodes.select(F.lit(0).alias("gauge_pos"), "node").limit(0)
    return {"nodes": nodes, "edges": edges, "gauges": gauges}


def decode_metadata(c: Column | str) -> Column:
    """A map from JSON text; text that isn't JSON comes back under the name "raw"."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map(F.lit("raw"), c))


def read_sqlite(spark: SparkSession, path: str, name: str) -> DataFrame:
    """path, attributes (a map of texts) and blobs (a map of binary values, as geometries are) for each row of a table of SQLite
    files, as GeoPackages are; a file without the table gives no rows. Each file is opened in memory by the task that reads it."""
    import pyarrow as pa

    def run(batches):
        import sqlite3

        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                con = sqlite3.connect(":memory:")
                try:
                    con.deserialize(data.as_py())
                    cur = con.execute('SELECT * FROM "' + name.replace('"', '""') + '"')
                    columns = [c[0] for c in cur.description]
                    rows = [([(c, None if v is None else str(v)) for c, v in zip(columns, r) if not isinstance(v, bytes)], [(c, v) for c, v in zip(columns, r) if isinstance(v, bytes)]) for r in cur]
                except sqlite3.Error:
                    rows = []
                finally:
                    con.close()
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.map_(pa.string(), pa.string())), pa.array([r[1] for r in rows], pa.map_(pa.string(), pa.binary()))], ["path", "attributes", "blobs"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, attributes map<string,string>, blobs map<string,binary>")


def river_series(flow: DataFrame, stations: DataFrame, river: str = "comid", time: str = "time", value: str = "value") -> DataFrame:
    """gauge_id, river, date, value: the daily mean flow of the rivers that stations (gauge_id, river) lie on."""
    from fluvial.operators.compare import daily_mean

    return daily_mean(flow.join(stations.select("gauge_id", river), river), ["gauge_id", river], time, value)


def river_ids(stations: DataFrame, *sources: tuple[str, DataFrame], key: str = "gauge_id", river: str = "comid") -> DataFrame:
    """stations with the first known river of named sources (gauge_id, river), and which source that is."""
    d = stations
    for name, df in sources:
        d = d.join(df.select(key, F.col(river).alias(f"_{name}")), key, "left")
    chosen = F.coalesce(*[F.col(f"_{n}") for n, _ in sources])
    label = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), F.lit(n)) for n, _ in sources], F.lit("none"))
    return d.select(*stations.columns, chosen.alias(river), label.alias(f"{river}_source"))
