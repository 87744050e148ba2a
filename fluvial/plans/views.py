"""The star-schema tables seen as series, grids, networks and mappings, in Spark and, for the oracle, in DuckDB SQL.

Each SQL constant is a list of common table expressions without WITH, to be put before a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvial.common import spread, table

SERIES_SQL = """series AS (SELECT l_suppkey::VARCHAR AS gauge_id, l_shipdate::DATE AS date, sum(l_extendedprice * (1 - l_discount)) AS prediction,
  sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END) AS observation FROM lineitem GROUP BY 1, 2)"""


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Daily predictions and observations of each gauge; days with returns only have no observation."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("gauge_id"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("prediction"), F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("observation")
    )
    return spread(li, "gauge_id", "date").groupBy("gauge_id", "date").agg(F.sum("prediction").alias("prediction"), F.sum("observation").alias("observation"))


COMPARED_SQL = """compared AS (SELECT l_suppkey::VARCHAR AS gauge_id, l_shipdate::DATE AS date, sum(l_extendedprice * (1 - l_discount)) AS gnn,
  sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END) AS observed, 1500 * sum(l_quantity * (1 + l_tax)) AS other FROM lineitem GROUP BY 1, 2)"""


def compared(spark: SparkSession, sf: str) -> DataFrame:
    """Two models and observations."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("gauge_id"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("gnn"), F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("observed"),
        (F.col("l_quantity") * (1 + F.col("l_tax"))).alias("other"),
    )
    return spread(li, "gauge_id", "date").groupBy("gauge_id", "date").agg(F.sum("gnn").alias("gnn"), F.sum("observed").alias("observed"), (1500 * F.sum("other")).alias("other"))


SAMPLES_SQL = "samples AS (SELECT user_id AS cell, ts AS time, event_type AS variable, value, event_id FROM events)"


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Values of several variables at irregular times of the day in each cell."""
    return table(spark, sf, "events").select(F.col("user_id").alias("cell"), F.col("ts").alias("time"), F.col("event_type").alias("variable"), "value", "event_id")


DAILY_SQL = f"{SAMPLES_SQL}, daily AS (SELECT cell, time::DATE AS date, avg(value) AS value FROM samples GROUP BY 1, 2)"


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """The daily mean of each cell, on days that have values."""
    return samples(spark, sf).groupBy("cell", F.to_date("time").alias("date")).agg(F.avg("value").alias("value"))


DENSE_SQL = f"""{DAILY_SQL}, dense AS (SELECT c.cell, d.date, daily.value FROM (SELECT DISTINCT cell FROM daily) c CROSS JOIN (SELECT DISTINCT date FROM daily) d
  LEFT JOIN daily ON daily.cell = c.cell AND daily.date = d.date)"""


def dense(spark: SparkSession, sf: str) -> DataFrame:
    """Every cell on every day; missing values are NULL."""
    from fluvial.operators.prepare import reindex

    return reindex(daily(spark, sf), "cell")


GRID_WIDTH = 50
GRID_SQL = """cells AS (SELECT p_partkey AS flat_index, p_partkey // 50 AS y, p_partkey % 50 AS x, p_retailprice AS elevation, p_size > 5 AS active, (2 ** (p_partkey % 8))::BIGINT AS code FROM part)"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """A grid with elevation, an active mask and flow-direction codes."""
    key = F.col("p_partkey").cast("bigint")
    return table(spark, sf, "part").select(
        key.alias("flat_index"), F.floor(key / GRID_WIDTH).alias("y"), (key % GRID_WIDTH).alias("x"), F.col("p_retailprice").alias("elevation"), (F.col("p_size") > 5).alias("active"), F.pow(F.lit(2), key % 8).cast("bigint").alias("code")
    )


TREE_SQL = """flow AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 0 THEN (c_custkey - 1) // 2 END AS toid, 1 + abs(c_acctbal) AS length_m, (1 + c_nationkey)::DOUBLE AS area FROM customer)"""


def flow(spark: SparkSession, sf: str) -> DataFrame:
    """A network in which each node flows to one other, and 0 is the outlet."""
    k = F.col("c_custkey").cast("bigint")
    return table(spark, sf, "customer").select(k.alias("id"), F.when(k > 0, F.floor((k - 1) / 2)).alias("toid"), (1 + F.abs("c_acctbal")).alias("length_m"), (1 + F.col("c_nationkey")).cast("double").alias("area"))


MAP_SQL = """sources AS (SELECT l_partkey AS source, l_suppkey AS target, sum(l_quantity) AS weight, any_value(p_size)::DOUBLE AS cell_area, any_value(p_retailprice) AS source_elevation,
  any_value(s_acctbal) AS target_elevation, 100.0 + (l_partkey * 7 + l_suppkey * 13) % 500 AS distance FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"""


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """A sparse mapping of grid cells to network nodes with weights and features."""
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), "l_quantity")
    li = spread(li, "source", "target").groupBy("source", "target").agg(F.sum("l_quantity").alias("weight"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("source"), F.col("p_size").cast("double").alias("cell_area"), F.col("p_retailprice").alias("source_elevation"))
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("target"), F.col("s_acctbal").alias("target_elevation"))
    return li.join(part, "source").join(supplier, "target").withColumn("distance", 100.0 + (F.col("source") * 7 + F.col("target") * 13) % 500)


RUNOFF_SQL = "runoff AS (SELECT l_partkey AS source, date_trunc('month', l_shipdate)::DATE AS date, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2)"


def runoff(spark: SparkSession, sf: str) -> DataFrame:
    """A value for each source cell and month."""
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("source"), F.trunc("l_shipdate", "MM").alias("date"), "l_extendedprice")
    return spread(li, "source", "date").groupBy("source", "date").agg(F.sum("l_extendedprice").alias("value"))


EMBEDDED_SQL = "feats AS (SELECT vec_id AS node, label, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS feature FROM embeddings)"


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Node features in long form."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), "label", F.posexplode("embedding").alias("feature", "value")).withColumns({"value": F.col("value").cast("double"), "feature": F.col("feature").cast("bigint")})
