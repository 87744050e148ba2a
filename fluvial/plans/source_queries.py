"""Queries that write tables to the shared folder in the forms sources have, and read them back; and on columns and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluvial.common import shared_path, table
from fluvial.functions import columns as C
from fluvial.functions import projections
from fluvial.operators import checks, prepare, splits, windows
from fluvial.plans import views as V
from fluvial.plans.registry import query, rounded
from fluvial.sources import arrays, geometry, manifest, readers, sinks

# A grid of customers: a forcing with two variables for each nation (flat_index) and day.
FORCING_SQL = """forcing AS (SELECT o_custkey % 25 AS flat_index, o_orderdate::DATE AS time, round(sum(o_totalprice), 2) AS rain, count(*)::DOUBLE AS temp FROM orders GROUP BY 1, 2)"""


def _forcing(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy((F.col("o_custkey") % 25).alias("flat_index"), F.to_date("o_orderdate").alias("time")).agg(F.round(F.sum("o_totalprice"), 2).alias("rain"), F.count(F.lit(1)).cast("double").alias("temp"))


def _static(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("flat_index"), (F.col("n_regionkey") * 10.0).alias("elevation"), F.length("n_name").cast("double").alias("slope"))


@query(f"WITH {FORCING_SQL} SELECT flat_index, time, rain FROM forcing")
def q70_source_single_file(spark, sf):
    """A source in one file, found by auto; only the wanted variables."""
    path = shared_path(spark, "single")
    _forcing(spark, sf).withColumn("crs", F.lit(0)).write.parquet(path)
    return readers.open_source(spark, {"path": path, "variables": ["rain"]})


@query(f"WITH {FORCING_SQL} SELECT flat_index, time::TIMESTAMP AS time, rain, temp FROM forcing")
def q70b_source_formats(spark, sf):
    """CSV with ids that keep their types, as JSON and ORC are read, too; the same rows from each, once."""
    f = _forcing(spark, sf).withColumn("time", F.col("time").cast("timestamp"))
    parts = []
    for kind in ("csv", "json", "orc"):
        path = shared_path(spark, kind)
        f.write.option("header", "true").format(kind).save(path)
        extra = {"schema": f.schema} if kind != "orc" else {}
        d = spark.read.schema(extra["schema"]).options(header="true").format(kind).load(path) if extra else readers.read_table(spark, path, kind)
        parts.append(d.select("flat_index", "time", "rain", "temp"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@query(f"WITH {FORCING_SQL} SELECT flat_index, time, rain, temp FROM forcing WHERE time BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
def q70c_source_many_files(spark, sf):
    """A file for each month with its date in the name, of which only those within the period are read."""
    path = shared_path(spark, "many")
    f = _forcing(spark, sf).withColumn("year", F.year("time"))
    f.repartition(4, "year").write.partitionBy("year").parquet(path)
    spec = {"file_mode": "multi_file", "path": path, "variables": ["rain", "temp"]}
    return readers.open_source(spark, spec, start="1995-01-01", end="1996-12-31")


@query(f"WITH {FORCING_SQL} SELECT flat_index, time, rain FROM forcing WHERE time BETWEEN DATE '1995-03-01' AND DATE '1997-02-28'")
def q70d_source_yearly(spark, sf):
    """A table with a folder for each year: only the folders of the period are read."""
    path = shared_path(spark, "yearly")
    sinks.write_yearly(_forcing(spark, sf), path)
    return readers.open_source(spark, {"yearly": True, "path": path, "variables": ["rain"]}, start="1995-03-01", end="1997-02-28")


@query(f"WITH {FORCING_SQL} SELECT flat_index, time::TIMESTAMP AS time, rain, temp FROM forcing WHERE time BETWEEN DATE '1995-03-01' AND DATE '1997-02-28' AND flat_index < 12")
def q70h_source_zarr(spark, sf):
    """A Zarr store written as chunks; only the chunks of the period and the cells are opened."""
    path = shared_path(spark, "store")
    arrays.write_zarr(_forcing(spark, sf), path, {"time": 180, "flat_index": 6}, ["rain", "temp"])
    spec = {"format": "zarr", "path": path, "variables": ["rain", "temp"], "options": {"missing": "drop"}}
    return readers.open_source(spark, spec, start="1995-03-01", end="1997-02-28").where("flat_index < 12").select("flat_index", "time", "rain", "temp")


@query(f"WITH {FORCING_SQL}, d AS (SELECT DISTINCT time FROM forcing) SELECT c.i::BIGINT AS flat_index, d.time::TIMESTAMP AS time, f.rain FROM d CROSS JOIN range(25) c(i) LEFT JOIN forcing f ON f.time = d.time AND f.flat_index = c.i WHERE d.time >= DATE '1996-06-01'")
def q70i_source_yearly_stores(spark, sf):
    """A store for each year, the later half of the days appended; cells without a value are there, as in a dense cube."""
    root = shared_path(spark, "stores")
    f = _forcing(spark, sf).where("time >= '1996-01-01'")
    cells = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("flat_index"))
    cube = f.select("time").distinct().join(cells).join(f, ["time", "flat_index"], "left").withColumn("year", F.year("time"))
    for y in sorted(r.year for r in f.select(F.year("time").alias("year")).distinct().collect()):  # a few years
        days = cube.where(F.col("year") == y)
        arrays.write_zarr(days, f"{root}/{y}.zarr", {"time": 30, "flat_index": 25}, ["rain"])
    return arrays.read_arrays(spark, root, ["rain"], start="1996-06-01", end="2100-01-01").select("flat_index", "time", "rain")


@query(f"WITH {FORCING_SQL} SELECT flat_index, time::TIMESTAMP AS time, rain, temp FROM forcing WHERE time BETWEEN DATE '1995-03-01' AND DATE '1997-02-28'")
def q70j_source_netcdf(spark, sf):
    """Classic NetCDF files, one for each year, of which those of the period are opened."""
    path = shared_path(spark, "netcdf")
    arrays.write_netcdf(_forcing(spark, sf).withColumn("file", F.concat(F.year("time"), F.lit(".nc"))), path, "file", ["time", "flat_index"], ["rain", "temp"])
    spec = {"format": "netcdf", "path": path, "variables": ["rain", "temp"], "options": {"missing": "drop"}}
    return readers.open_source(spark, spec, start="1995-03-01", end="1997-02-28").select("flat_index", "time", "rain", "temp")


@query(f"WITH {FORCING_SQL} SELECT flat_index, time, rain, temp FROM forcing")
def q70e_source_per_variable(spark, sf):
    """A file for each variable, one of which names it otherwise."""
    f, files = _forcing(spark, sf), {v: shared_path(spark, v) for v in ("rain", "temp")}
    f.select("flat_index", "time", "rain").write.parquet(files["rain"])
    f.select("flat_index", "time", F.col("temp").alias("T2D")).write.parquet(files["temp"])
    return readers.open_source(spark, {"files": files, "variables": ["rain", "temp"]})


@query("SELECT n_nationkey::BIGINT AS flat_index, n_regionkey * 10.0::DOUBLE AS elevation, length(n_name)::DOUBLE AS slope FROM nation")
def q70f_static_merge(spark, sf):
    """Static tables of one grid side by side."""
    paths = [shared_path(spark, "static") for _ in range(2)]
    s = _static(spark, sf)
    s.select("flat_index", "elevation").write.parquet(paths[0])
    s.select("flat_index", "slope").write.parquet(paths[1])
    return readers.open_source(spark, {"file_mode": "multi_file", "paths": paths}, "static")


@query(f"WITH {FORCING_SQL} SELECT flat_index, time, 'rain' AS variable, rain AS value FROM forcing UNION ALL SELECT flat_index, time, 'temp', temp FROM forcing")
def q70g_wide_to_long(spark, sf):
    return readers.wide_to_long(_forcing(spark, sf), ["rain", "temp"], ["flat_index", "time"])


@query("SELECT o_orderdate::DATE AS date, round(sum(o_totalprice) * 0.028316846592, 3) AS \"QQobs\" FROM orders GROUP BY 1")
def q71_targets_csv(spark, sf):
    """Daily discharge in cubic feet from CSV with a line of formats, found by its column's number."""
    path = shared_path(spark, "targets")
    d = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("q"))
    rows = d.select(F.lit("USGS").alias("agency"), F.date_format("d", "yyyy-MM-dd").alias("datetime"), F.col("q").cast("string").alias("1_00060_00003"), F.lit("A").alias("1_00060_00003_cd"))
    formats = spark.createDataFrame([("5s", "20d", "14n", "10s")], rows.schema)
    formats.unionByName(rows).write.option("header", "true").csv(path)
    return rounded(readers.read_targets(spark, path).groupBy("date").agg(F.sum("QQobs").alias("QQobs")), 3)


@query("SELECT lpad(s_suppkey::VARCHAR, 8, '0') AS gauge_id FROM supplier WHERE s_suppkey % 3 <> 0 AND NOT s_name LIKE '%7'")
def q71b_basins_without_some(spark, sf):
    """A list of gauges with leading zeros and blank lines, without those of another list and of a pattern."""
    path = shared_path(spark, "basins")
    s = table(spark, sf, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("id"), "s_suppkey", "s_name")
    s.select(F.concat(F.lit(" "), "id", F.lit("  ")).alias("value")).unionByName(spark.createDataFrame([("",), ("   ",)], "value string")).write.text(path)
    gauges = prepare.exclude(readers.read_basins(spark, path), s.where("s_suppkey % 3 = 0").select(F.col("id").alias("gauge_id")))
    return prepare.exclude(gauges, s.where("s_name LIKE '%7'").select(F.col("id").alias("gauge_id")))


@query("SELECT s_suppkey::VARCHAR AS gauge_id, s_acctbal / 1000.0 AS lat, -s_acctbal / 500.0 AS lon, NULL::DOUBLE AS x, NULL::DOUBLE AS y FROM supplier")
def q71c_gauges_csv(spark, sf):
    path = shared_path(spark, "gauges")
    s = table(spark, sf, "supplier")
    s.select(F.col("s_suppkey").alias("site_no"), (F.col("s_acctbal") / 1000.0).alias("latitude"), (-F.col("s_acctbal") / 500.0).alias("longitude")).write.option("header", "true").csv(path)
    return readers.read_gauges(spark, path)


@query("SELECT n_nationkey::BIGINT AS flat_index, DATE '2001-02-03' + (n_regionkey)::INT AS date, CASE WHEN n_nationkey % 4 <> 0 THEN 86400::DOUBLE * n_nationkey END AS \"RUNSF\", 86400::DOUBLE AS \"RUNSB\", 86400::DOUBLE + CASE WHEN n_nationkey % 4 <> 0 THEN 86400::DOUBLE * n_nationkey ELSE 0 END AS runoff_total FROM nation")
def q71d_daily_runoff_files(spark, sf):
    """Files whose names hold their day; a sentinel is missing; the total of both components counts it as 0."""
    n = table(spark, sf, "nation")
    root = shared_path(spark, "runoff")
    for r in range(5):
        d = n.where(F.col("n_regionkey") == r).select(F.col("n_nationkey").cast("bigint").alias("flat_index"), F.when(F.col("n_nationkey") % 4 == 0, -9999.0).otherwise(F.col("n_nationkey").cast("double")).alias("RUNSF"), F.lit(1.0).alias("RUNSB"))
        _write_named(d, f"{root}/2001020{3 + r}00.parquet")
    return readers.read_runoff_days(spark, root)


def _write_named(df, path):
    """One Parquet file of that very name."""
    spark, folder = df.sparkSession, path + "-parts"
    df.coalesce(1).write.parquet(folder)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(conf)
    part = next(f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-"))
    fs.rename(part, jvm.org.apache.hadoop.fs.Path(path))
    fs.delete(at, True)


@query("SELECT '2001020' || (3 + r_regionkey)::VARCHAR || '00.parquet' AS name, TIMESTAMP '2001-02-03 00:00:00' + INTERVAL (r_regionkey) DAY AS time, true AS has_bytes FROM region")
def q71e_listed_files(spark, sf):
    root = shared_path(spark, "listed")
    for r in range(5):
        _write_named(table(spark, sf, "region").where(F.col("r_regionkey") == r), f"{root}/2001020{3 + r}00.parquet")
    return readers.list_files(spark, root, "*.parquet").select("name", "time", (F.col("length") > 0).alias("has_bytes"))


@query("SELECT c_nationkey::BIGINT AS id, max(layer) AS layer, count(*) AS n FROM (SELECT c_nationkey, CASE WHEN c_nationkey < 15 THEN 'a' ELSE 'b' END AS layer FROM customer GROUP BY 1, 2) GROUP BY 1")
def q72_first_layer_wins(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").cast("bigint").alias("id")).distinct()
    one = c.where("id < 15").withColumn("layer", F.lit("a"))
    two = c.withColumns({"layer": F.lit("b"), "more": F.lit(1)})
    return readers.first_wins([one, two], "id").groupBy("id").agg(F.max("layer").alias("layer"), F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey::VARCHAR AS gauge_id, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey::BIGINT WHEN s_suppkey % 3 = 0 THEN s_suppkey::BIGINT END AS comid, CASE WHEN s_suppkey % 2 = 0 THEN 'lookup' WHEN s_suppkey % 3 = 0 THEN 'nearest' ELSE 'none' END AS comid_source FROM supplier")
def q72b_river_ids(spark, sf):
    s = table(spark, sf, "supplier")
    gauge = F.col("s_suppkey").cast("string").alias("gauge_id")
    lookup = s.where("s_suppkey % 2 = 0").select(gauge, F.col("s_nationkey").cast("bigint").alias("comid"))
    near = s.where("s_suppkey % 3 = 0").select(gauge, F.col("s_suppkey").cast("bigint").alias("comid"))
    return readers.river_ids(s.select(gauge), ("lookup", lookup), ("nearest", near))


@query(f"WITH {V.SAMPLES_SQL} SELECT s_suppkey::VARCHAR AS gauge_id, cell AS comid, time::DATE AS date, round(avg(value), 6) AS value FROM samples JOIN supplier ON s_suppkey = cell GROUP BY 1, 2, 3")
def q72c_river_series(spark, sf):
    stations = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("gauge_id"), F.col("s_suppkey").alias("comid"))
    return rounded(readers.river_series(V.samples(spark, sf).withColumnRenamed("cell", "comid"), stations))


@query("SELECT event_type AS path, min(ts) AS start_time, max(ts) AS end_time, count(DISTINCT ts) AS n_steps FROM events GROUP BY 1")
def q72d_manifest(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("path"), F.col("ts").alias("time"))
    return windows.median_step_seconds(e, ["path"]).select("path", "start_time", "end_time", F.col("n_steps").cast("bigint").alias("n_steps"))


@query("SELECT c_custkey::BIGINT AS id, TIMESTAMP '2000-01-01' + INTERVAL (3600 * k) SECOND AS time FROM customer, (SELECT unnest(range(4)) AS k)")
def q72e_manifest_times(spark, sf):
    """Times that rows of a manifest stand for; a step of 0 becomes the mean step."""
    m = table(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("id"), F.lit("2000-01-01 00:00:00").cast("timestamp").alias("start_time"), F.lit("2000-01-01 03:00:00").cast("timestamp").alias("end_time"), F.lit(4).cast("bigint").alias("n_steps"), F.when(F.col("c_custkey") % 2 == 0, 0.0).otherwise(3600.0).alias("step_seconds"))
    return windows.manifest_times(m, ["id"])


# -- sinks ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {FORCING_SQL} SELECT flat_index, time, CASE WHEN year(time) = 1995 THEN -1.0 ELSE rain END AS rain, year(time)::BIGINT AS year FROM forcing WHERE year(time) BETWEEN 1994 AND 1996")
def q73_yearly_modes(spark, sf):
    """overwrite replaces the years it has; skip leaves years that are there; append adds."""
    path = shared_path(spark, "modes")
    f = _forcing(spark, sf).select("flat_index", "time", "rain")
    year = lambda y: f.where(F.year("time") == y)
    sinks.write_yearly(year(1994).unionByName(year(1995)), path)
    sinks.write_yearly(year(1995).withColumn("rain", F.lit(-1.0)), path, mode="overwrite")
    sinks.write_yearly(year(1995).withColumn("rain", F.lit(-2.0)), path, mode="skip")
    sinks.write_yearly(year(1996), path, mode="append")
    return spark.read.parquet(path).withColumn("year", F.col("year").cast("bigint"))


@query("SELECT n_name AS name, n_regionkey::BIGINT AS region, (row_number() OVER (ORDER BY n_regionkey, n_name) - 1) AS line FROM nation")
def q73b_report_in_order(spark, sf):
    """A report in one file, whose lines keep their order."""
    path = shared_path(spark, "report")
    sinks.write_report(table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), path, ("region", "name"))
    d = spark.read.option("header", "true").csv(path).coalesce(1).withColumn("line", F.monotonically_increasing_id())
    return d.select("name", F.col("region").cast("bigint").alias("region"), "line")


@query("SELECT n_nationkey::BIGINT AS epoch, n_regionkey::DOUBLE AS loss, CASE WHEN n_nationkey >= 10 THEN length(n_name)::DOUBLE END AS extra FROM nation")
def q73c_history_append(spark, sf):
    """A history to which runs add rows, and one a column."""
    path = shared_path(spark, "history")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("epoch"), F.col("n_regionkey").cast("double").alias("loss"), F.length("n_name").cast("double").alias("extra"))
    sinks.append_history(n.where("epoch < 10").drop("extra"), path)
    sinks.append_history(n.where("epoch >= 10"), path)
    return sinks.read_history(spark, path).select("epoch", "loss", "extra")


@query(f"WITH {V.TREE_SQL} SELECT id AS src, toid AS dst, round(length_m, 6) AS weight, 'demo' AS builder FROM flow WHERE toid IS NOT NULL")
def q73d_graph_written_and_read(spark, sf):
    path = shared_path(spark, "graph")
    f = V.flow(spark, sf)
    sinks.write_graph({"nodes": f.select(F.col("id").alias("node")), "edges": f.where("toid IS NOT NULL").select(F.col("id").alias("src"), F.col("toid").alias("dst"), F.col("length_m").alias("weight"))}, path, {"builder": "demo"})
    g = sinks.read_graph(spark, path)
    return rounded(g["edges"].withColumn("builder", F.lit(g["metadata"]["builder"])))


@query("SELECT n_nationkey::BIGINT AS src, (n_nationkey + 1)::BIGINT AS dst, n_regionkey::DOUBLE AS weight FROM nation WHERE n_nationkey < 24")
def q73e_graph_json(spark, sf):
    """A graph in one JSON file, under other names of its parts."""
    path = shared_path(spark, "graph-json")
    n = table(spark, sf, "nation").where("n_nationkey < 24").orderBy("n_nationkey")
    one = n.agg(F.sort_array(F.collect_list(F.struct("n_nationkey", F.col("n_regionkey").cast("double").alias("w")))).alias("e"))
    one.select(F.array(F.col("e.n_nationkey"), F.transform("e", lambda x: x["n_nationkey"] + 1)).alias("edges"), F.col("e.w").alias("weights")).coalesce(1).write.json(path)
    return readers.read_graph_json(spark, path)["edges"].select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), "weight")


# -- columns -------------------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey::BIGINT AS id, strftime(DATE '2000-01-01' + INTERVAL (s_suppkey) DAY, '%b') AS month, CASE WHEN s_suppkey % 3 = 0 THEN lpad(s_suppkey::VARCHAR, 8, '0') WHEN s_suppkey % 3 = 1 THEN s_suppkey::VARCHAR END AS gauge FROM supplier")
def q74_months_and_gauges(spark, sf):
    s = table(spark, sf, "supplier").withColumn("k", F.col("s_suppkey") % 3)
    s = s.withColumns({"ref": F.when(F.col("k") == 0, "gages").otherwise("dams"), "uri": F.when(F.col("k") == 0, F.concat(F.lit("gages-"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0"))), "link": F.when(F.col("k") == 1, F.col("s_suppkey").cast("string")).otherwise("none")})
    return s.select(F.col("s_suppkey").cast("bigint").alias("id"), C.month_name(F.date_add(F.lit("2000-01-01").cast("date"), F.col("s_suppkey").cast("int"))).alias("month"), C.gauge_of_location("ref", "uri", "link").alias("gauge"))


@query("""WITH layers AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM (SELECT DISTINCT p_brand, p_size FROM part))
SELECT p_brand AS variable, (i * 2 + k)::BIGINT AS pos, p_brand || '__layer_' || CASE (p_size - 25) % 2 WHEN 0 THEN ((p_size - 25) // 2)::VARCHAR ELSE replace(((p_size - 25) / 2)::VARCHAR, '.', 'p') END || '__kind' || k AS name FROM layers, (SELECT unnest(range(2)) AS k)""")
def q74b_channel_names(spark, sf):
    """A channel for each layer, whole, half and negative ones, and kind; kinds have no coordinates."""
    v = table(spark, sf, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set((F.col("p_size") - 25) / 2)).alias("layers"), F.lit(2).alias("kinds"))
    return prepare.channels(v, "p_brand", {"layer": "layers", "kind": "kinds"})


@query("SELECT p_partkey::BIGINT AS id, p_retailprice * 0.028316846592 AS cms, CASE WHEN p_size <> 7 THEN p_size::DOUBLE END AS size, CASE WHEN p_size <> 7 THEN p_size::DOUBLE ELSE 0 END AS filled FROM part")
def q74c_units_and_sentinels(spark, sf):
    size = C.sentinel_to_null(F.col("p_size").cast("double"), 7.0)
    return table(spark, sf, "part").select(F.col("p_partkey").cast("bigint").alias("id"), (F.col("p_retailprice") * C.CFS_TO_M3S).alias("cms"), size.alias("size"), C.or_zero(size).alias("filled"))


@query("SELECT p_partkey::BIGINT AS id, coalesce(CASE WHEN p_size > 25 THEN p_name END, p_brand) AS given, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey::VARCHAR END AS number, CASE WHEN p_size % 2 = 0 THEN ((p_size - 20) // 2)::VARCHAR ELSE replace(((p_size - 20) / 2)::VARCHAR, '.', 'p') END AS label, regexp_replace(regexp_replace(p_brand, '[^A-Za-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS safe FROM part")
def q74d_ids(spark, sf):
    """First given, numbers as ids, numbers as labels, and names of letters and digits only."""
    k = F.col("p_partkey").cast("string")
    p = table(spark, sf, "part").withColumns({"a": F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(" "), "w": F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("wb-"), k)).otherwise(F.concat(k, F.lit(".0")))})
    return p.select(F.col("p_partkey").cast("bigint").alias("id"), C.first_given("a", "p_brand").alias("given"), C.numeric_id("w").alias("number"), C.number_label((F.col("p_size") - 20) / 2).alias("label"), C.safe_name("p_brand").alias("safe"))


@query("SELECT s_suppkey::BIGINT AS id FROM supplier WHERE s_name LIKE '%1' OR s_name LIKE 'Supplier#00000000_'")
def q74e_glob(spark, sf):
    return table(spark, sf, "supplier").where(C.glob("s_name", "*1", "Supplier#00000000?")).select(F.col("s_suppkey").cast("bigint").alias("id"))


# -- binary layers -------------------------------------------------------------------------------------------------------


def _write_bytes(spark, path, data):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(data))
    out.close()


def _layer(spark, sf, kind):
    """A shapefile with a line (kind 3) or polygon (kind 5) of k + 2 points for each of the nations, and its attributes."""
    import struct

    path = shared_path(spark, "layer")
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()  # 25 rows
    shapes, table_rows = b"\0" * 100, b""
    for k, r in enumerate(rows, 1):
        points = [(r.n_nationkey + i, 0.5 * i) for i in range(r.n_regionkey + 2)]
        body = struct.pack("<i4d2i", kind, 0, 0, 0, 0, 1, len(points)) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in points)
        shapes += struct.pack(">2i", k, len(body) // 2) + body
        table_rows += b" " + r.n_name.encode().ljust(25) + (b"Against" if r.n_regionkey == 2 else b"With").ljust(7)
    field = lambda name, size: name.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([size, 0]) + b"\0" * 14
    fields = field("NAME", 25) + field("FLOWDIR", 7)
    _write_bytes(spark, f"{path}/r.shp", shapes)
    _write_bytes(spark, f"{path}/r.dbf", struct.pack("<4BIHH20x", 3, 0, 0, 0, len(rows), 32 + len(fields) + 1, 33) + fields + b"\r" + table_rows)
    return path


LAYER_SQL = "SELECT n_nationkey + 1::BIGINT AS record, n_name AS name, n_regionkey = 2 AS against, (n_regionkey + 2)::BIGINT AS n_points, n_nationkey::DOUBLE AS x, 0.5::DOUBLE * (n_regionkey + 1) AS y FROM nation"


def _read_layer(spark, sf, kind):
    from fluvial.sources import shapes

    d = shapes.read_shapefile(spark, _layer(spark, sf, kind), polygons=kind == 5)
    last = F.element_at("points", -1)
    return d.select(F.col("record").cast("bigint").alias("record"), F.col("attributes")["NAME"].alias("name"), shapes.against_flow().alias("against"), F.size("points").cast("bigint").alias("n_points"), F.get("points", F.lit(0))["x"].alias("x"), last["y"].alias("y"))


@query(LAYER_SQL)
def q75_shapefile_lines(spark, sf):
    """Lines of a shapefile with their attributes, and which of them are drawn against the flow."""
    return _read_layer(spark, sf, 3)


@query(LAYER_SQL)
def q75b_shapefile_polygons(spark, sf):
    return _read_layer(spark, sf, 5)


def _layer_file(root):
    """Writes the .shp, .shx and .dbf of some customers, in the order of their keys, each a line of 2 to 6 points."""
    import struct

    import numpy as np
    import pandas as pd

    from fluvial.sources import arrays

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c_custkey")
        name, shp, shx, rows, at = f"{root}/{pdf.file.iloc[0]}", [b"\0" * 100], [b"\0" * 100], [], 100
        for k, r in enumerate(pdf.itertuples(), 1):
            n = int(r.c_custkey % 5 + 2)
            points = np.column_stack([np.arange(n) + r.c_nationkey, 0.5 * np.arange(n)]).astype("<f8")
            body = struct.pack("<i4d3i", 3, 0, 0, 0, 0, 1, n, 0) + points.tobytes()
            shp.append(struct.pack(">2i", k, len(body) // 2) + body)
            shx.append(struct.pack(">2i", at // 2, len(body) // 2))
            at += len(shp[-1])
            rows.append(b" " + str(r.c_custkey).rjust(18).encode() + (b"Against" if r.c_nationkey == 2 else b"With   "))
        field = lambda n, kind, size: n.ljust(11, b"\0") + kind + b"\0" * 4 + bytes([size]) + b"\0" * 15
        head = struct.pack("<4BIHH20x", 3, 0, 0, 0, len(rows), 97, 26) + field(b"COMID", b"N", 18) + field(b"FLOWDIR", b"C", 7) + b"\r"
        for ending, data in ((".shp", shp), (".shx", shx), (".dbf", [head, *rows])):
            arrays.write_bytes(name + ending, b"".join(data))
        return pd.DataFrame({"rows": [len(rows)]})

    return write


@query("SELECT c_custkey::BIGINT AS comid, (row_number() OVER (PARTITION BY c_custkey // 2000 ORDER BY c_custkey))::BIGINT AS record, c_nationkey = 2 AS against, (c_custkey % 5 + 2)::BIGINT AS n_points, c_nationkey::DOUBLE AS x, 0.5::DOUBLE * (c_custkey % 5 + 1) AS y FROM customer")
def q75d_shapefile_pieces(spark, sf):
    """Lines of many files of 2000 keys each, every file read in pieces of 16 kB that its index tells."""
    from fluvial.sources import shapes

    path = shared_path(spark, "layers")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.floor(F.col("c_custkey") / 2000).cast("bigint").alias("file"))
    c.groupBy("file").applyInPandas(_layer_file(path), "rows long").write.format("noop").mode("overwrite").save()
    d = shapes.read_shapefile(spark, path, piece=1 << 14)
    return d.select(F.col("attributes")["COMID"].cast("bigint").alias("comid"), F.col("record").cast("bigint").alias("record"), shapes.against_flow().alias("against"), F.size("points").cast("bigint").alias("n_points"), F.get("points", F.lit(0))["x"].alias("x"), F.element_at("points", -1)["y"].alias("y"))


@query("SELECT n_nationkey::VARCHAR AS id, CASE WHEN n_regionkey > 0 THEN n_name END AS name, (n_regionkey + 1)::BIGINT AS geometry_bytes FROM nation")
def q75c_sqlite_layer(spark, sf):
    """A table of a SQLite file, as GeoPackages are, with a geometry as binary; a file without the table gives no rows."""
    import sqlite3

    path = shared_path(spark, "geopackage")
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()  # 25 rows
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE flowpaths (id INTEGER, name TEXT, geom BLOB)")
    con.executemany("INSERT INTO flowpaths VALUES (?, ?, ?)", [(int(r.n_nationkey), r.n_name if r.n_regionkey else None, b"x" * (int(r.n_regionkey) + 1)) for r in rows])
    con.commit()
    _write_bytes(spark, f"{path}/one.gpkg", con.serialize())
    other = sqlite3.connect(":memory:")
    other.execute("CREATE TABLE divides (id INTEGER)")
    other.commit()
    _write_bytes(spark, f"{path}/two.gpkg", other.serialize())
    d = readers.read_sqlite(spark, path, "flowpaths")
    return d.select(F.col("attributes")["id"].alias("id"), F.col("attributes")["name"].alias("name"), F.length(F.col("blobs")["geom"]).cast("bigint").alias("geometry_bytes"))


@query("""SELECT c_custkey::BIGINT AS id, 'polygon' AS kind, 5070 AS srid, k::BIGINT AS k, round(-120 + c_nationkey + 0.01::DOUBLE * (k % 2), 6) AS lon, round(30 + (c_custkey % 100) / 10 + 0.01::DOUBLE * (k // 2), 6) AS lat FROM customer, (SELECT unnest([0, 1, 2]) AS k)""")
def q76_geometry_layer(spark, sf):
    """A layer of polygons in degrees, projected and written as GeoPackage blobs; read, decoded and projected back."""
    path = shared_path(spark, "layer")
    lon, lat = (-120.0 + F.col("c_nationkey")), (30.0 + (F.col("c_custkey") % 100) / 10)
    corner = lambda k: F.struct((lon + 0.01 * (k % 2)).alias("x"), (lat + 0.01 * (k // 2)).alias("y"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("id"), F.array(F.array(*map(corner, range(3)))).alias("rings"))
    albers = projections.Albers()
    c.select("id", geometry.encoded(F.lit("polygon"), projections.reproject("rings", None, albers), F.lit(5070)).alias("geom")).write.parquet(path)
    g = spark.read.parquet(path).select("id", geometry.decoded("geom").alias("g"))
    d = g.select("id", "g.kind", "g.srid", F.posexplode(projections.reproject("g.rings", albers)[0]).alias("k", "p"))
    return rounded(d.select("id", "kind", "srid", F.col("k").cast("bigint").alias("k"), F.col("p.x").alias("lon"), F.col("p.y").alias("lat")))


@query("""WITH t AS (SELECT DISTINCT year(o_orderdate) AS year, o_orderdate::TIMESTAMP AS time FROM orders), s AS (SELECT *, epoch(lead(time) OVER (PARTITION BY year ORDER BY time)) - epoch(time) AS step FROM t)
SELECT year, min(time) AS start_time, max(time) AS end_time, count(*) AS n_steps, median(step) AS step_seconds FROM s GROUP BY 1""")
def q72f_incremental_manifest(spark, sf):
    """A file for each year; the later ones arrive after the manifest was made, and only they are read then."""
    root, path = shared_path(spark, "files"), shared_path(spark, "manifest")
    f = table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("time"), F.year("o_orderdate").alias("year"))
    for late in (False, True):
        f.where((F.col("year") >= 1996) == F.lit(late)).coalesce(1).write.mode("append").partitionBy("year").parquet(root)
        manifest.update(spark, root, path)
    d = manifest.current(spark, root, path)
    return d.select(F.regexp_extract("path", "year=([0-9]+)", 1).cast("bigint").alias("year"), "start_time", "end_time", "n_steps", "step_seconds")


@query(f"WITH {FORCING_SQL}, s AS (SELECT n_nationkey AS flat_index, n_regionkey * 10.0::DOUBLE AS elevation FROM nation) SELECT f.flat_index, f.time, f.rain, s.elevation FROM forcing f JOIN s ON s.flat_index = f.flat_index")
def q73f_aligned_while_written(spark, sf):
    """Forcing joined with its cells; that each row has its cell is observed in the pass that writes it."""
    path = shared_path(spark, "aligned")
    cells = _static(spark, sf).select("flat_index", "elevation")
    checks.aligned(_forcing(spark, sf).select("flat_index", "time", "rain"), cells, ["flat_index"], path)
    return spark.read.parquet(path)


@query("""SELECT 'nodes' AS "table", 'node twice' AS rule, 0::BIGINT AS broken, count(*) AS rows FROM customer UNION ALL SELECT 'edges', 'dst without a node', count(*) FILTER (WHERE o_custkey % 50 = 0), count(*) FROM orders
UNION ALL SELECT 'edges', 'loop', count(*) FILTER (WHERE o_custkey % 50 <> 0 AND o_custkey = o_orderkey % 100), count(*) FROM orders UNION ALL SELECT 'gauges', 'node without a node', count(*) FILTER (WHERE s_suppkey % 10 = 0), count(*) FROM supplier""")
def q73g_graph_rules(spark, sf):
    """A graph with faults; what its rules find while its tables are written."""
    key = lambda c: F.col(c).cast("bigint")
    nodes = table(spark, sf, "customer").select(key("c_custkey").alias("node"))
    edges = table(spark, sf, "orders").select((key("o_orderkey") % 100).alias("src"), F.when(F.col("o_custkey") % 50 != 0, key("o_custkey")).otherwise(F.lit(-1)).alias("dst"))
    gauges = table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 10 != 0, key("s_suppkey")).otherwise(F.lit(-5)).alias("node"))
    found = checks.write_graph_checked({"nodes": nodes, "edges": edges, "gauges": gauges}, shared_path(spark, "graph-checked"), strict=False)
    shown = (("nodes", "node twice"), ("edges", "dst without a node"), ("edges", "loop"), ("gauges", "node without a node"))
    return spark.createDataFrame([(t, r, found[t][r], found[t]["rows"]) for t, r in shown], "table string, rule string, broken bigint, rows bigint")


@query("SELECT o_custkey::BIGINT AS gauge, coalesce(n, 0) AS n_late, coalesce(m, 0) AS n_early FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1998-01-01' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS m FROM orders WHERE o_orderdate < DATE '1993-01-01' GROUP BY 1) b ON a.o_custkey = b.k WHERE o_custkey IS NOT NULL UNION ALL SELECT k, 0, m FROM (SELECT o_custkey AS k, count(*) AS m FROM orders WHERE o_orderdate < DATE '1993-01-01' GROUP BY 1) WHERE k NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '1998-01-01')")
def q10c_metrics_full_join(spark, sf):
    """Metrics of two runs side by side; gauges that only one of them has stay."""
    o = table(spark, sf, "orders")
    count = lambda d, name: d.groupBy(F.col("o_custkey").cast("bigint").alias("gauge")).agg(F.count(F.lit(1)).alias(name))
    late, early = count(o.where("o_orderdate >= '1998-01-01'"), "n_late"), count(o.where("o_orderdate < '1993-01-01'"), "n_early")
    return late.join(early, "gauge", "full").na.fill(0, ["n_late", "n_early"])


@query("SELECT o_orderpriority AS variable, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std FROM orders GROUP BY 1")
def q73h_scaler_file(spark, sf):
    """A scaler of each variable, written to a file and read again."""
    path = f"{shared_path(spark, 'scaler')}.yml"
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("variable"), F.col("o_totalprice").cast("double").alias("value"))
    sinks.write_yaml(sinks.scaler_mapping(prepare.scaler_from_sums(prepare.scaler_sums(o, ["variable"]), ["variable"])), path)
    return rounded(sinks.read_scaler(spark, path), 4)


@query("""SELECT (year(d) * 12 + month(d))::BIGINT AS block_id, d AS start, (d + INTERVAL 1 MONTH)::DATE AS "end", 'validation' AS period FROM (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS d FROM orders) WHERE month(d) % 3 = 1""")
def q73i_split_file(spark, sf):
    """A block for each month, dealt to periods, written to a split file; the blocks of one period that a loader takes from it."""
    path = f"{shared_path(spark, 'split')}.yml"
    d = table(spark, sf, "orders").select(F.trunc("o_orderdate", "MM").alias("block_start")).distinct()
    period = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (1 + F.month("block_start") % 3).cast("int"))
    blocks = d.select((F.year("block_start") * 12 + F.month("block_start")).cast("bigint").alias("block_id"), "block_start", F.add_months("block_start", 1).alias("block_end"), period.alias("period"))
    sinks.write_split(blocks, path, {"seed": 42})
    return splits.load_blocks(sinks.read_split(spark, path), "validation")
