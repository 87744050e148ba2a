"""Queries on networks built from layers, gauges, polygons, inputs of routing models, and further joins and sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluvial.common import table
from fluvial.functions import columns as C
from fluvial.operators import assembly, compare, history, network, prepare, routing, skill, spatial, splits, windows
from fluvial.plans import views as V
from fluvial.plans.network_queries import ACTIVE_SQL, MB, MW, NODES_SQL, OB, OW, STATE, UB, UW, _active, _demo, _graph, _sql_dense, _sql_heads
from fluvial.plans.registry import query, rounded
from fluvial.plans.series_queries import E32

# -- hydrofabric ---------------------------------------------------------------------------------------------------------

#: Flowpaths are customers, each of which flows to a junction (wb to nexus to wb); attributes are of orders.
PATHS_SQL = """paths AS (SELECT c_custkey AS n, lpad(c_custkey::VARCHAR, 9, '0') AS id, 'nex-' || ((c_custkey - 1) // 2)::VARCHAR AS toid, c_nationkey::VARCHAR AS divide_id, c_acctbal AS length FROM customer),
junctions AS (SELECT DISTINCT 'nex-' || c_custkey::VARCHAR AS id, lpad(c_custkey::VARCHAR, 9, '0') AS toid FROM customer),
attrs AS (SELECT lpad(o_custkey::VARCHAR, 9, '0') AS id, count(*)::DOUBLE AS "MusK", min(o_totalprice) AS length FROM orders GROUP BY 1)"""


def _layers(spark, sf):
    c = table(spark, sf, "customer")
    wb = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    nexus = F.concat(F.lit("nex-"), F.floor((F.col("c_custkey") - 1) / 2).cast("string"))
    paths = c.select(wb.alias("id"), nexus.alias("toid"), F.col("c_nationkey").cast("string").alias("divide_id"), F.col("c_acctbal").alias("length"))
    junctions = c.select(F.concat(F.lit("nex-"), F.col("c_custkey").cast("string")).alias("id"), wb.alias("toid"))
    o = table(spark, sf, "orders").groupBy(F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("MusK"), F.min("o_totalprice").alias("length"))
    divides = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("divide_id"), (F.col("n_regionkey") * 1.5).alias("mean.slope"), F.lit("x").alias("other"))
    return paths, junctions, o, divides


@query(f"""WITH {PATHS_SQL} SELECT p.id, p.length, a.length AS length_attr, a."MusK" FROM paths p LEFT JOIN attrs a USING (id)""")
def q80_enriched_with_suffix(spark, sf):
    paths, _, attrs, _ = _layers(spark, sf)
    return assembly.enrich(paths.select("id", "length"), attrs, "id")


@query(f"""WITH {PATHS_SQL}, numbered AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS node FROM paths)
SELECT DISTINCT a.node AS src, b.node AS dst, 0::DOUBLE AS length_m, (n_regionkey * 1.5)::DOUBLE AS slope, round(1 / greatest(coalesce("MusK", 0), 1e-6), 6) AS weight
FROM numbered a JOIN junctions j ON j.id = a.toid JOIN numbered b ON b.id = j.toid LEFT JOIN attrs ON attrs.id = a.id JOIN nation ON n_nationkey::VARCHAR = a.divide_id WHERE a.node <> b.node""")
def q80b_hydrofabric(spark, sf):
    """Edges over junctions with the slope of their divide and weights by Muskingum K, which varies."""
    paths, junctions, attrs, divides = _layers(spark, sf)
    return rounded(assembly.hydrofabric(paths, junctions, attrs, divides)[1].select("src", "dst", "length_m", "slope", "weight"))


@query(f"""WITH {PATHS_SQL}, numbered AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS node FROM paths), e AS (SELECT DISTINCT a.node AS src, b.node AS dst, a.id, a.divide_id FROM numbered a JOIN junctions j ON j.id = a.toid JOIN numbered b ON b.id = j.toid WHERE a.node <> b.node),
v AS (SELECT src, dst, coalesce("MusK", 0)::DOUBLE AS musk, coalesce(a.length, 0) AS len, 0.001::DOUBLE * n_regionkey AS so, 0.01::DOUBLE * (1 + n_nationkey % 4) AS n, CASE WHEN n_nationkey % 5 <> 0 THEN 2.0::DOUBLE + n_regionkey END AS b, 3.0::DOUBLE + n_nationkey AS t FROM e LEFT JOIN attrs a ON a.id = e.id JOIN nation ON n_nationkey::VARCHAR = e.divide_id),
h AS (SELECT *, max(musk) OVER () > 0 AND stddev_pop(musk) OVER () > 1e-6 AS vary, sqrt(greatest(abs(so), 1e-6)) AS root FROM v)
SELECT src, dst, round(len, 6) AS length_m, round(so, 6) AS slope, round(n, 6) AS n, coalesce(b, 0)::DOUBLE AS "BtmWdth", t AS "TopWdth", round(musk, 6) AS "MusK", round(1 / CASE WHEN vary THEN greatest(musk, 1e-6) ELSE greatest(len, 1) END, 6) AS weight,
  round(CASE WHEN vary THEN greatest(musk, 1e-6) ELSE greatest(len, 1) / root END, 6) AS travel_time_proxy, round(root / n, 6) AS velocity_proxy, round(greatest(len, 1) / (root / n), 6) AS manning_travel_time_proxy, round(1 / (greatest(len, 1) / (root / n)), 6) AS inverse_manning_travel_time_proxy,
  round(greatest(len, 1) * t, 6) AS storage_proxy, round(t * root / n, 6) AS conveyance_proxy, round(t / greatest(coalesce(b, 0), 1e-6), 6) AS width_ratio_proxy FROM h""")
def q80d_hydrofabric_edges(spark, sf):
    """The whole table of edges: widths, roughness, Muskingum parameters, travel times and hydraulic proxies."""
    paths, junctions, attrs, _ = _layers(spark, sf)
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    divides = table(spark, sf, "nation").select(k.cast("string").alias("divide_id"), (0.001 * r).alias("So"), (0.01 * (1 + k % 4)).alias("n"), F.when(k % 5 != 0, 2.0 + r).alias("BtmWdth"), (3.0 + k).alias("TopWdth"))
    whole = assembly.enrich(paths.drop("length"), divides, "divide_id")
    return rounded(assembly.hydrofabric(whole, junctions, attrs.withColumnRenamed("length", "Length_m"))[1])


@query(f"""WITH RECURSIVE {V.TREE_SQL}, nxt AS (SELECT id AS node, CASE WHEN id = 0 AND (SELECT count(*) FROM flow) > 5 THEN 5 WHEN id > 5 AND id % 97 = 0 THEN NULL ELSE toid END AS next FROM flow),
walk AS (SELECT node AS start, next AS node, 1 AS step FROM nxt WHERE next IS NOT NULL UNION ALL SELECT start, nxt.next, step + 1 FROM walk JOIN nxt ON nxt.node = walk.node WHERE nxt.next IS NOT NULL AND step < 40),
cyc AS (SELECT DISTINCT start AS node FROM walk WHERE start = node), far AS (SELECT node, max(step) AS far FROM walk GROUP BY 1),
d AS (SELECT n.node, CASE WHEN cyc.node IS NULL THEN coalesce(far, 0) END AS level, cyc.node IS NOT NULL AS on_cycle FROM nxt n LEFT JOIN cyc ON cyc.node = n.node LEFT JOIN far ON far.node = n.node)
SELECT node::BIGINT AS node, level::BIGINT AS level, on_cycle, (row_number() OVER (ORDER BY on_cycle, level, node) - 1)::BIGINT AS position FROM d""")
def q81k_topological_order(spark, sf):
    """Upstream first, with outlets within the network, and a cycle (0, 5, 2) whose nodes come last."""
    f = V.flow(spark, sf)
    cut = F.when(F.col("id") == 0, F.lit(5).cast("bigint")).when((F.col("id") > 5) & (F.col("id") % 97 == 0), F.lit(None)).otherwise(F.col("toid"))
    return network.topological_order(f.select(F.col("id").alias("node")), f.select(F.col("id").alias("node"), cut.alias("next")).where("next IS NOT NULL"))


@query("SELECT count(DISTINCT n_regionkey) AS geometries FROM nation")
def q80c_unique_geometries(spark, sf):
    n = table(spark, sf, "nation").select(F.encode(F.concat(F.lit("LINE"), F.col("n_regionkey").cast("string")), "utf-8").alias("geometry"))
    return assembly.unique_geometry(n).agg(F.count(F.lit(1)).alias("geometries"))


# Lines run along the rows of the grid, from x = 0.2 to 6.8, in steps of half a cell; every third is drawn against the flow.
LINES_SQL = f"""{V.GRID_SQL}, lines AS (SELECT DISTINCT y AS line FROM cells), pts AS (SELECT line, i, 0.2 + 6.6 * i / 14 AS x FROM lines, (SELECT unnest(range(15)) AS i)),
spot AS (SELECT line, i, flat_index, active FROM (SELECT pts.line, i, flat_index, active, row_number() OVER (PARTITION BY pts.line, i ORDER BY (c.x - pts.x) ** 2 + (c.y - pts.line) ** 2, flat_index) AS r FROM pts JOIN cells c ON c.y BETWEEN pts.line - 1 AND pts.line + 1 AND c.x BETWEEN 0 AND 9) WHERE r = 1),
kept AS (SELECT line, CASE WHEN line % 3 = 0 THEN -i ELSE i END AS i, flat_index FROM spot WHERE active), own AS (SELECT line, lag(flat_index) OVER (PARTITION BY line ORDER BY i) AS src, flat_index AS dst FROM kept),
ends AS (SELECT line, min_by(flat_index, i) AS first, max_by(flat_index, i) AS last FROM kept GROUP BY 1), links AS (SELECT a.last AS src, b.first AS dst, a.line * 0.5 AS w FROM ends a JOIN ends b ON b.line = a.line + 1)
SELECT src, dst, round(avg(w), 6) AS slope FROM (SELECT src, dst, line * 0.5 AS w FROM own WHERE src IS NOT NULL AND src <> dst UNION ALL SELECT src, dst, w FROM links WHERE src <> dst) GROUP BY 1, 2"""


@query(f"WITH {LINES_SQL}")
def q81_flowline_network(spark, sf):
    """Lines put in dense points, nearest cells, runs of one cell, direction, links to the line below, mean attributes."""
    g = V.cells(spark, sf)
    ends = F.array(F.struct(F.lit(0.2).alias("x"), F.col("line").cast("double").alias("y")), F.struct(F.lit(6.8).alias("x"), F.col("line").cast("double").alias("y")))
    lines = g.select(F.col("y").alias("line")).distinct().select("line", ends.alias("points"), F.col("line").cast("string").alias("id"), (F.col("line") + 1).cast("string").alias("down"), F.when(F.col("line") % 3 == 0, "drawn Against flow").otherwise("with").alias("direction"), (F.col("line") * 0.5).alias("slope"))
    return rounded(assembly.flowline_network(lines, g, 6.6 / 14 + 1e-9, attributes=["slope"]))


@query("SELECT n_nationkey::BIGINT AS line, k::BIGINT AS k, round(n_regionkey + 3.0 * k / 6, 6) AS x, round(4.0 * k / 6, 6) AS y FROM nation, (SELECT unnest(range(7)) AS k)")
def q81b_densified_lines(spark, sf):
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    lines = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("line"), F.array(point(F.col("n_regionkey"), F.lit(0)), point(F.col("n_regionkey") + 3, F.lit(4))).alias("points"))
    d = network.densify_lines(lines, 5 / 6 + 1e-9)
    return rounded(d.select("line", (F.shiftright("pos", 32) * 6 + F.col("pos") % (1 << 32)).cast("bigint").alias("k"), "x", "y"))


@query("SELECT src, dst, round(avg(w), 6) AS w FROM (SELECT o_custkey % 100 AS src, o_custkey % 7 AS dst, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice ELSE 0 END AS w FROM orders) GROUP BY 1, 2")
def q81c_edges_once(spark, sf):
    e = table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("src"), (F.col("o_custkey") % 7).alias("dst"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("w"))
    return rounded(network.unique_edges(e, ["w"]))


@query(f"WITH {V.TREE_SQL} SELECT id AS src, toid AS dst FROM flow WHERE toid IS NOT NULL AND id <> toid UNION SELECT id, id FROM flow")
def q81d_self_loops(spark, sf):
    f = V.flow(spark, sf)
    return network.with_self_loops(f.where("toid IS NOT NULL").select(F.col("id").alias("src"), F.col("toid").alias("dst")), f.select(F.col("id").alias("node")))


@query("SELECT 'dst without a node' AS what, count(*) AS n FROM orders WHERE o_custkey % 100 >= 50 UNION ALL SELECT 'node twice', count(*) FROM customer WHERE c_custkey < 50 AND c_custkey % 10 = 0")
def q81e_checked_graph(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").where("c_custkey < 50")
    ids = c.select(F.col("c_custkey").alias("node"))
    return network.check_graph(ids.unionByName(ids.where("node % 10 = 0")).unionByName(spark.range(0, 50).toDF("node").join(ids, "node", "left_anti")), o.select(F.lit(1).cast("bigint").alias("src"), (F.col("o_custkey") % 100).alias("dst")))


@query(f"WITH {V.TREE_SQL} SELECT toid AS node, count(*) AS indegree FROM flow WHERE toid IS NOT NULL GROUP BY 1")
def q81f_indegree(spark, sf):
    return network.indegree(V.flow(spark, sf).where("toid IS NOT NULL").select(F.col("id").alias("src"), F.col("toid").alias("dst")))


@query(f"WITH RECURSIVE {V.TREE_SQL}, up AS (SELECT id AS node, id AS anc FROM flow UNION ALL SELECT up.node, flow.toid FROM up JOIN flow ON flow.id = up.anc WHERE flow.toid IS NOT NULL) SELECT node, count(*) AS hops FROM up GROUP BY 1")
def q81g_levels(spark, sf):
    f = V.flow(spark, sf)
    return network.levels(f.select(F.col("id").alias("node")), f.where("toid IS NOT NULL").select(F.col("id").alias("node"), F.col("toid").alias("next")))


@query("""WITH e AS (SELECT c_custkey AS src, (c_custkey + 1) AS dst, abs(c_acctbal) AS length_m, c_nationkey / 1000.0 AS slope, 1 + c_nationkey / 10.0 AS w, 0.5 + c_nationkey / 20.0 AS b FROM customer),
v AS (SELECT *, sqrt(greatest(abs(slope), 1e-6)) / 0.05 AS velocity_proxy FROM e), t AS (SELECT *, greatest(length_m, 1) / greatest(velocity_proxy, 1e-6) AS t FROM v)
SELECT src, dst, round(velocity_proxy, 6) AS velocity_proxy, round(t, 4) AS manning_travel_time_proxy, round(1 / greatest(t, 1e-6), 6) AS inverse_manning_travel_time_proxy, round(greatest(length_m, 1) * w, 4) AS storage_proxy, round(w * sqrt(greatest(abs(slope), 1e-6)) / 0.05, 6) AS conveyance_proxy, round(w / b, 6) AS width_ratio_proxy FROM t""")
def q81h_hydraulics(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") + 1).alias("dst"), F.abs("c_acctbal").alias("length_m"), (F.col("c_nationkey") / 1000.0).alias("slope"), (1 + F.col("c_nationkey") / 10.0).alias("w"), (0.5 + F.col("c_nationkey") / 20.0).alias("b"))
    h = network.hydraulic_features(c, top="w", bottom="b").drop("length_m", "slope", "w", "b")
    return rounded(h.withColumns({k: F.round(k, 4) for k in ("manning_travel_time_proxy", "storage_proxy")}))


@query(f"WITH {V.GRID_SQL} SELECT flat_index FROM cells WHERE elevation >= 950 AND elevation <= 1200 UNION ALL SELECT flat_index + 1000000 FROM cells WHERE NOT (x IN (3, 4, 5))")
def q81i_active_cells(spark, sf):
    """By limits, and by a list that is inverted."""
    g = V.cells(spark, sf)
    return g.where(network.active("elevation", low=950, high=1200)).select("flat_index").unionByName(g.where(network.active(F.col("x").cast("double"), include=[3, 4, 5], invert=True)).select((F.col("flat_index") + 1000000).alias("flat_index")))


@query(f"WITH {V.GRID_SQL} SELECT median(d) AS spacing FROM (SELECT elevation - lag(elevation) OVER (ORDER BY elevation) AS d FROM (SELECT DISTINCT elevation FROM cells))")
def q81j_median_spacing(spark, sf):
    return network.median_spacing(V.cells(spark, sf), "elevation")


# -- gauges and polygons -------------------------------------------------------------------------------------------------


@query(f"WITH {V.GRID_SQL}, ax AS (SELECT DISTINCT x FROM cells WHERE x % 3 = 0) SELECT s_suppkey::BIGINT AS gauge, arg_min(x, (abs(x - v), x)) AS x FROM (SELECT s_suppkey, (s_suppkey * 37 % 499) / 10.0 AS v FROM supplier), ax GROUP BY 1")
def q82_nearest_on_axis(spark, sf):
    g = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("bigint").alias("gauge"), (F.col("s_suppkey") * 37 % 499 / 10.0).alias("v"))
    return network.nearest_on_axis(g, V.cells(spark, sf).where("x % 3 = 0"), "v", "x").select("gauge", "x")


@query(f"""WITH {ACTIVE_SQL}, g AS (SELECT s_suppkey AS gauge, (s_suppkey * 37 % 499) / 10.0 AS lon, (s_suppkey * 53 % 399) / 10.0 AS lat FROM supplier), d AS (SELECT gauge, flat_index, ((act.x - lon) * cos(radians(lat))) ** 2 + (act.y - lat) ** 2 AS d FROM g CROSS JOIN act)
SELECT gauge, flat_index, round(111.32 * sqrt(d), 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY gauge ORDER BY d, flat_index) AS r FROM d) WHERE r = 1""")
def q82b_nearest_geographic(spark, sf):
    g = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("gauge"), (F.col("s_suppkey") * 37 % 499 / 10.0).alias("x"), (F.col("s_suppkey") * 53 % 399 / 10.0).alias("y"))
    return rounded(network.nearest(g, _active(spark, sf), "gauge", geographic=True), 4)


@query("SELECT (s_suppkey - 1)::BIGINT AS gauge_pos, s_name AS name FROM supplier WHERE s_suppkey <= 20")
def q82c_matched_gauges(spark, sf):
    """A list of gauges in its order, matched without leading zeros."""
    s = table(spark, sf, "supplier").where("s_suppkey <= 20")
    order = s.select((F.col("s_suppkey") - 1).cast("bigint").alias("gauge_pos"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("gauge_id"))
    return network.match_gauges(s.select(F.col("s_suppkey").cast("string").alias("gauge_id"), F.col("s_name").alias("name")), order).select("gauge_pos", "name")


@query(f"""WITH {V.GRID_SQL} SELECT s_suppkey::BIGINT AS gauge_id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey ELSE c.flat_index END::BIGINT AS flat_index, CASE WHEN s_suppkey % 3 = 0 THEN 'flat_index' ELSE 'grid' END AS method
FROM supplier LEFT JOIN cells c ON s_suppkey % 3 = 1 AND c.y = s_suppkey % 2 AND c.x = s_suppkey % 40 + 1 WHERE s_suppkey % 3 = 0 OR c.flat_index IS NOT NULL""")
def q82d_resolved_gauges(spark, sf):
    """Gauges by their cell, else by row and column."""
    k = F.col("s_suppkey")
    g = table(spark, sf, "supplier").select(k.cast("bigint").alias("gauge_id"), F.when(k % 3 == 0, k.cast("bigint")).alias("flat_index"), F.when(k % 3 == 1, k % 2).alias("row"), F.when(k % 3 == 1, k % 40 + 1).alias("col"))
    return network.resolve_gauges(g, V.cells(spark, sf))


@query("SELECT s_suppkey::BIGINT AS gauge_id, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey + 500 WHEN s_suppkey % 2 = 0 THEN s_suppkey + 100 ELSE s_suppkey + 300 END::BIGINT AS node, CASE WHEN s_suppkey % 5 = 0 THEN 'containing' WHEN s_suppkey % 2 = 0 THEN 'location' ELSE 'nearest' END AS method FROM supplier")
def q82e_gauge_cascade(spark, sf):
    """The containing area overrides, then the own location, then the nearest node."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("bigint").alias("gauge_id"))
    at = lambda df, k: df.withColumn("node", F.col("gauge_id") + k)
    return network.gauge_cascade([("location", at(s.where("gauge_id % 2 = 0"), 100)), ("nearest", at(s, 300)), ("containing", at(s.where("gauge_id % 5 = 0"), 500))], "gauge_id", policy="override")


def _squares(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("zone"), (F.col("n_nationkey") % 5 * 9.0 + 0.25).alias("x0"), (F.floor(F.col("n_nationkey") / 5) * 0.8 - 0.25).alias("y0"))
    p = lambda x, y: F.struct((F.col("x0") + x).alias("x"), (F.col("y0") + y).alias("y"))
    return n.select("zone", F.array(p(0, 0), p(6.5, 0), p(6.5, 1.75), p(0, 1.75)).alias("ring"))


SQUARES_SQL = f"{V.GRID_SQL}, sq AS (SELECT n_nationkey::BIGINT AS zone, n_nationkey % 5 * 9 + 0.25 AS x0, (n_nationkey // 5) * 0.8 - 0.25 AS y0 FROM nation)"


@query(f"WITH {SQUARES_SQL} SELECT flat_index, min(zone) AS zone FROM cells JOIN sq ON x > x0 AND x < x0 + 6.5 AND y > y0 AND y < y0 + 1.75 GROUP BY 1")
def q82f_cells_in_polygons(spark, sf):
    return spatial.cells_in_polygons(V.cells(spark, sf), _squares(spark, sf), "zone")


@query(f"""WITH {SQUARES_SQL}, o AS (SELECT flat_index, zone, greatest(least(x + 0.5, x0 + 6.5) - greatest(x - 0.5, x0), 0) * greatest(least(y + 0.5, y0 + 1.75) - greatest(y - 0.5, y0), 0) AS a FROM cells, sq)
SELECT flat_index, zone, round(a, 6)::DOUBLE AS fraction FROM o WHERE a >= 0.3""")
def q82g_overlaps(spark, sf):
    return rounded(spatial.overlap(V.cells(spark, sf), _squares(spark, sf), "zone", 1.0, 1.0, min_fraction=0.3).select("flat_index", "zone", "fraction"))


@query(f"WITH {V.MAP_SQL}, s AS (SELECT source, sum(weight) AS s FROM sources GROUP BY 1) SELECT round(min(s), 4) AS least, round(avg(s), 4) AS mean, round(max(s), 4) AS most, count(*) AS sources FROM s")
def q82h_fraction_check(spark, sf):
    from fluvial.operators import transfer

    return rounded(transfer.fraction_check(V.sources(spark, sf)), 4)


# A divide a nation, as squares that overlap; of every fifth none has a path, and each third has two.
SOURCE_SQL = f"""{SQUARES_SQL}, paths AS (SELECT zone + 100 AS id, zone, x0, y0 FROM sq WHERE zone % 5 <> 4 UNION ALL SELECT zone + 200, zone, x0 + 1, y0 FROM sq WHERE zone % 3 = 0 AND zone % 5 <> 4), known AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS node FROM paths),
one AS (SELECT zone, min(id) AS id FROM paths GROUP BY 1), target AS (SELECT zone, node AS target, x0, y0 FROM one JOIN known USING (id) JOIN sq USING (zone)), live AS (SELECT * FROM cells WHERE active),
far AS (SELECT flat_index AS source, target, zone, x::DOUBLE AS x, y::DOUBLE AS y, elevation, x0, y0, sqrt(least((x - x0 - 1) ** 2 + (y - greatest(least(y, y0 + 1), y0)) ** 2, (x - greatest(least(x, x0 + 4), x0 + 1)) ** 2 + (y - y0 - 1) ** 2)) AS distance FROM live, target)"""


def _source_map(spark, sf, method, features, **options):
    n = _squares(spark, sf).withColumnRenamed("zone", "divide_id")
    p = lambda x, y: F.struct((F.col("ring")[0]["x"] + x).alias("x"), (F.col("ring")[0]["y"] + y).alias("y"))
    line = lambda k: F.array(p(k, 0), p(k, 1), p(k + 3, 1))
    some = n.where("divide_id % 5 <> 4")
    paths = some.select((F.col("divide_id") + 100).alias("id"), "divide_id", line(1).alias("points")).unionByName(some.where("divide_id % 3 = 0").select((F.col("divide_id") + 200).alias("id"), "divide_id", line(2).alias("points")))
    return assembly.source_map(V.cells(spark, sf), n, paths, network.dense_index(paths, ["id"]).select("id", "node"), 1.0, 1.0, method, features=features, **options)


@query(f"""WITH {SOURCE_SQL}, o AS (SELECT *, greatest(least(x + 0.5, x0 + 6.5) - greatest(x - 0.5, x0), 0) * greatest(least(y + 0.5, y0 + 1.75) - greatest(y - 0.5, y0), 0) AS a FROM far)
SELECT source, target, round(a, 6)::DOUBLE AS weight, round(a, 6)::DOUBLE AS fraction, elevation, 1.0::DOUBLE AS cell_area, x, y, round(distance, 6) AS distance_to_path FROM o WHERE a >= 0.105""")
def q82i_source_map_by_area(spark, sf):
    """Cells shared out among divides by area, divides to their paths' nodes, with what is known of each."""
    return rounded(_source_map(spark, sf, "fractional_area", ["elevation", "cell_area", "x", "y", "distance_to_path"], min_fraction=0.105))  # shares are multiples of 1/80, so none is at the limit


@query(f"""WITH {SOURCE_SQL}, c AS (SELECT flat_index, min(zone) AS zone FROM live JOIN sq ON x > x0 AND x < x0 + 6.5 AND y > y0 AND y < y0 + 1.75 GROUP BY 1), m AS (SELECT flat_index AS source, target FROM c JOIN target USING (zone))
SELECT target, count(*) AS cells, count(*)::DOUBLE AS weight, 1.0::DOUBLE AS fraction FROM m GROUP BY 1""")
def q82j_source_map_by_centre(spark, sf):
    """What each node gets if a cell goes whole to the divide that its centre lies in."""
    return _source_map(spark, sf, "center", []).groupBy(F.col("target").cast("bigint").alias("target")).agg(F.count(F.lit(1)).alias("cells"), F.sum("weight").alias("weight"), F.max("fraction").alias("fraction"))


@query("""WITH d AS (SELECT (p_partkey % 50 * 1.5)::DOUBLE AS x, (p_partkey // 50 * 2)::DOUBLE AS y, CASE WHEN p_size > 5 THEN p_retailprice END AS e FROM part WHERE p_partkey % 11 <> 0), xs AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS col FROM (SELECT DISTINCT x FROM d)), ys AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS row FROM (SELECT DISTINCT y FROM d)),
step AS (SELECT (SELECT median(n) FROM (SELECT lead(x) OVER (ORDER BY x) - x AS n FROM xs)) * (SELECT median(n) FROM (SELECT lead(y) OVER (ORDER BY y) - y AS n FROM ys)) AS area, (SELECT count(*) FROM xs) AS wide)
SELECT ys.row * wide + col AS flat_index, ys.row AS "row", col, xs.x, ys.y, e AS elevation, e IS NOT NULL AS active, area AS cell_area FROM xs CROSS JOIN ys CROSS JOIN step LEFT JOIN d ON d.x = xs.x AND d.y = ys.y""")
def q81m_dem_grid(spark, sf):
    """The full grid of an elevation model that lacks some cells, with areas."""
    k = F.col("p_partkey").cast("bigint")
    dem = table(spark, sf, "part").where("p_partkey % 11 <> 0").select((k % 50 * 1.5).alias("x"), (F.floor(k / 50) * 2.0).alias("y"), F.when(F.col("p_size") > 5, F.col("p_retailprice")).alias("elevation"))
    return network.dem_grid(dem)


# -- series --------------------------------------------------------------------------------------------------------------


@query(f"WITH {V.DAILY_SQL}, keep AS (SELECT DISTINCT date FROM daily WHERE cell % 2 = 0 INTERSECT SELECT DISTINCT date FROM daily WHERE cell % 2 = 1) SELECT cell, date FROM daily WHERE cell % 2 = 0 AND date IN (SELECT date FROM keep)")
def q83_common_days(spark, sf):
    d = V.daily(spark, sf).select("cell", "date")
    return prepare.common_days(d.where("cell % 2 = 0"), d.where("cell % 2 = 1"))[0]


@query(f"WITH {V.SERIES_SQL} SELECT gauge_id, date FROM series WHERE date BETWEEN DATE '1995-01-01' AND DATE '1996-06-30'")
def q83b_in_period(spark, sf):
    return prepare.in_period(V.series(spark, sf).select("gauge_id", "date"), "1995-01-01", "1996-06-30")


@query("SELECT p_partkey::BIGINT AS id, p_size::DOUBLE AS first, CASE WHEN p_size > 10 THEN p_size::DOUBLE ELSE 0 END + coalesce(p_retailprice, 0) AS runoff_total FROM part")
def q83c_first_present_and_total(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("bigint").alias("id"), "p_size", F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("runsf"), F.col("p_retailprice").alias("RUNSB"))
    return prepare.total_runoff(p.withColumn("first", prepare.first_present(p, ["nothing", "p_size"]))).select("id", "first", "runoff_total")


@query("SELECT c_nationkey::BIGINT AS cell, (2000 + c_nationkey)::BIGINT AS year, (8760 + CASE WHEN c_nationkey % 4 = 0 THEN 24 ELSE 0 END)::BIGINT AS n FROM (SELECT DISTINCT c_nationkey FROM customer) WHERE c_nationkey % 3 <> 0")
def q83d_complete_years(spark, sf):
    """Years with all their hours, a leap day's included; every third nation lacks an hour."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").cast("bigint").alias("cell")).distinct()
    y = F.concat((F.lit(2000) + F.col("cell")).cast("string"), F.lit("-01-01")).cast("timestamp")
    hours = F.when(F.col("cell") % 4 == 0, 8784).otherwise(8760) - F.when(F.col("cell") % 3 == 0, 1).otherwise(0)
    t = c.select("cell", y.alias("y"), F.explode(F.sequence(F.lit(0), hours - 1)).alias("h")).select("cell", F.timestamp_seconds(F.unix_timestamp("y") + F.col("h") * 3600).alias("time"))
    return prepare.complete_years(t, ["cell"]).select("cell", F.col("year").cast("bigint").alias("year"), "n")


@query(f"WITH {V.SAMPLES_SQL} SELECT variable, round(avg(value), 6) AS mean, round(CASE WHEN stddev_pop(value) > 1e-6 THEN stddev_pop(value) ELSE 1 END, 6) AS std, round(greatest(sqrt(greatest(avg(value ** 2) - avg(value) ** 2, 0)), 1e-6), 4) AS from_sums FROM samples GROUP BY 1")
def q83e_scalers(spark, sf):
    """The scaler of the data, and that from sums of its parts."""
    s = V.samples(spark, sf)
    parts = prepare.scaler_from_sums(prepare.scaler_sums(s.withColumn("part", F.col("cell") % 5), ["variable", "part"]), ["variable"])
    return rounded(prepare.standard_scaler(s, ["variable"]).join(parts.select("variable", F.round("std", 4).alias("from_sums")), "variable"))


@query(f"WITH {V.SAMPLES_SQL} SELECT cell, time::DATE AS date, round(avg(value), 6) AS value FROM samples GROUP BY 1, 2")
def q83f_daily_mean(spark, sf):
    return rounded(compare.daily_mean(V.samples(spark, sf), ["cell"], "time", "value"))


@query(f"WITH {V.DAILY_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY date) AS r FROM daily) SELECT cell, date FROM n WHERE r > 5")
def q83g_warm_up_dropped(spark, sf):
    return windows.drop_first(V.daily(spark, sf), 5, ["cell"], "date").select("cell", "date")


@query(f"WITH {V.SERIES_SQL} SELECT gauge_id, 0::BIGINT AS window_id, min(date) AS start, max(date) + 1 AS \"end\" FROM series GROUP BY 1")
def q83h_whole_period(spark, sf):
    spans = V.series(spark, sf).groupBy("gauge_id").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return windows.whole_period(spans, by=["gauge_id"])


BLOCKS_SQL = """blocks AS (SELECT n_nationkey::BIGINT AS block_id, DATE '2000-01-01' + (n_nationkey * 30 + CASE WHEN n_nationkey >= 10 THEN 100 ELSE 0 END)::INT AS start, DATE '2000-01-01' + (n_nationkey * 30 + 30 + CASE WHEN n_nationkey >= 10 THEN 100 ELSE 0 END)::INT AS end_,
  CASE n_regionkey WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'Train' END AS period FROM nation)"""


def _blocks(spark, sf):
    k, shift = F.col("n_nationkey").cast("int"), F.when(F.col("n_nationkey") >= 10, 100).otherwise(0)
    day = lambda n: F.date_add(F.lit("2000-01-01").cast("date"), n)
    return table(spark, sf, "nation").select(k.cast("bigint").alias("block_id"), day(k * 30 + shift).alias("start"), day(k * 30 + 30 + shift).alias("end"), F.when(F.col("n_regionkey") == 0, "val").when(F.col("n_regionkey") == 1, "test").otherwise("Train").alias("period"))


@query(f"WITH {BLOCKS_SQL} SELECT block_id, start, end_ AS \"end\", 'validation' AS period FROM blocks WHERE period = 'val'")
def q83i_loaded_blocks(spark, sf):
    return splits.load_blocks(_blocks(spark, sf), "validation")


@query(f"""WITH {BLOCKS_SQL}, seg AS (SELECT min(start) AS a, max(end_) AS b FROM blocks GROUP BY block_id >= 10), w AS (SELECT a, unnest(generate_series(a::TIMESTAMP, (b - 60)::TIMESTAMP, INTERVAL 45 DAY))::DATE AS s FROM seg)
SELECT a AS segment_start, row_number() OVER (PARTITION BY a ORDER BY s) - 1 AS window_id, s AS start, s + 60 AS "end" FROM w""")
def q83j_windows_in_segments(spark, sf):
    b = _blocks(spark, sf).withColumn("all", F.lit(1))
    return windows.segment_windows(b, 60, 45, by=["all"]).select("segment_start", "window_id", "start", "end")


@query(f"WITH {BLOCKS_SQL} SELECT period, count(*) AS blocks, min(start) AS first, max(end_) AS last, round(avg(block_id), 6) AS level FROM blocks GROUP BY 1")
def q83k_period_summary(spark, sf):
    b = _blocks(spark, sf).withColumnsRenamed({"start": "block_start", "end": "block_end"}).withColumn("level", F.col("block_id").cast("double"))
    return rounded(splits.period_summary(b, ["level"]))


@query("SELECT s_suppkey::VARCHAR AS gauge_id, CASE WHEN s_suppkey = 3 THEN 2.5 WHEN s_suppkey = 5 THEN 4.0 ELSE 1.0 END::DOUBLE AS weight FROM supplier WHERE s_suppkey BETWEEN 1 AND 6")
def q83l_stage_weights(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("gauge_id"))
    return history.gauge_weights(s, {"3": 2.5}, [str(k) for k in range(1, 7)], ["5"], 4.0)


@query("SELECT c_custkey::BIGINT AS id, c_acctbal AS balance FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def q83m_head(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("id"), F.col("c_acctbal").alias("balance"))
    return prepare.head(c, 25, [F.desc("balance"), "id"])


@query(f"""WITH {V.SERIES_SQL}, logs AS (SELECT gauge_id, date, ln(1 + greatest(prediction, 0)) AS lp, ln(1 + greatest(observation, 0)) AS lo FROM series WHERE observation IS NOT NULL),
sc AS (SELECT gauge_id, avg(lo) AS m, greatest(stddev_pop(lo), 1e-6) AS s FROM logs GROUP BY 1), scaled AS (SELECT logs.gauge_id, 'scaled' AS space, (lp - m) / s AS p, (lo - m) / s AS o FROM logs JOIN sc ON sc.gauge_id = logs.gauge_id),
spaces AS (SELECT * FROM scaled UNION ALL SELECT scaled.gauge_id, 'physical', exp(p * s + m) - 1, exp(o * s + m) - 1 FROM scaled JOIN sc ON sc.gauge_id = scaled.gauge_id),
k AS (SELECT gauge_id, space, count(*)::DOUBLE AS n, avg(p) AS mp, avg(o) AS mo, var_pop(p) AS vp, var_pop(o) AS vo, covar_pop(p, o) AS cov, avg((p - o) ** 2) AS mse FROM spaces GROUP BY 1, 2 HAVING count(*) > 1),
c AS (SELECT gauge_id, space, mse, n * cov / (sqrt(n * vp * n * vo + {E32}) + {E32}) AS r, sqrt(vp + {E32}) / (sqrt(vo + {E32}) + {E32}) AS a, (mp + {E32}) / (mo + {E32}) AS b FROM k)
SELECT gauge_id, space, round(CASE WHEN space = 'physical' THEN mse / 1e6 ELSE mse END, 4) AS mse, round(r, 6) AS r, round(a, 6) AS alpha, CASE WHEN space = 'physical' THEN round(b, 6) END AS beta FROM c""")
def q83n_loss_in_physical_space(spark, sf):
    """Errors and the components of KGE on scaled logarithms, and on flow as a loss in physical space takes it. (In scaled space the mean observation is 0, up to
    rounding, so beta says nothing.)"""
    logs = V.series(spark, sf).where("observation IS NOT NULL").withColumns({c: C.log_flow(c) for c in ("prediction", "observation")})
    scaler = logs.groupBy("gauge_id").agg(F.avg("observation").alias("mean"), F.greatest(F.stddev_pop("observation"), F.lit(1e-6)).alias("std"))
    scaled = logs.join(scaler, "gauge_id").withColumns({c: (F.col(c) - F.col("mean")) / F.col("std") for c in ("prediction", "observation")}).drop("mean", "std")
    out = None
    for space, unit in (("scaled", 1.0), ("physical", 1e6)):
        d = assembly.physical(scaled, scaler, ["gauge_id"], space, "log1p")
        error = d.groupBy("gauge_id").agg(F.round(F.avg(F.pow(F.col("prediction") - F.col("observation"), F.lit(2))) / unit, 4).alias("mse"))
        beta = F.round("beta", 6) if space == "physical" else F.lit(None).cast("double")
        part = skill.kge_components(d, ["gauge_id"]).join(error, "gauge_id").select("gauge_id", F.lit(space).alias("space"), "mse", F.round("r", 6).alias("r"), F.round("alpha", 6).alias("alpha"), beta.alias("beta"))
        out = part if out is None else out.unionByName(part)
    return out


# -- models --------------------------------------------------------------------------------------------------------------

NW, NS, NB = _demo(41, 4, 2), _demo(42, 4, 2), _demo(43, 2)


@query(f"""WITH {NODES_SQL}, m AS (SELECT dst, {", ".join(f"avg({c}) AS {c}" for c in STATE)} FROM edges JOIN nodes ON node = src GROUP BY 1), b AS (SELECT node, {", ".join(f"coalesce(m.{c}, 0) AS a{k}, nodes.{c} AS {c}" for k, c in enumerate(STATE))} FROM nodes LEFT JOIN m ON dst = node)
SELECT node, {", ".join(f"round({' + '.join([str(float(NB[j]))] + [f'{float(NW[k, j])} * a{k} + {float(NS[k, j])} * {c}' for k, c in enumerate(STATE)])}, 6) AS s{j}" for j in range(2))} FROM b""")
def q84_sage_layer(spark, sf):
    nodes, edges = _graph(spark, sf)
    return rounded(routing.sage_layer(nodes, edges, STATE, NW, NS, NB, ["s0", "s1"]))


INPUTS_SQL = f"""{V.MAP_SQL}, {V.RUNOFF_SQL}, moved AS (SELECT target AS node, date, sum(value * weight) AS v FROM runoff JOIN sources USING (source) GROUP BY 1, 2), targets AS (SELECT DISTINCT s_suppkey AS node FROM supplier), times AS (SELECT DISTINCT date FROM runoff),
full_ AS (SELECT t.node, d.date, ln(1 + coalesce(v, 0)) / 10 AS r FROM targets t CROSS JOIN times d LEFT JOIN moved USING (node, date)),
given AS (SELECT node, date, least(greatest(r, -3), 3) AS l0, least(greatest(coalesce(lag(r) OVER (PARTITION BY node ORDER BY date), 0), -3), 3) AS l1, least(greatest((s_acctbal / 1000)::DOUBLE, -3), 3) AS b FROM full_ JOIN supplier ON s_suppkey = node)"""


def _at_nodes(spark, sf):
    from fluvial.operators import transfer

    nodes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"))
    return transfer.transfer(V.runoff(spark, sf), V.sources(spark, sf), nodes.select(F.col("node").alias("target"))).withColumnRenamed("target", "node"), nodes


@query(f"WITH {INPUTS_SQL} SELECT node, date, round(l0, 6) AS runoff_lag0, round(l1, 6) AS runoff_lag1, round(b, 6) AS balance FROM given")
def q84b_node_inputs(spark, sf):
    """Lagged, transformed and scaled runoff beside node features, cut to a limit."""
    runoff, _ = _at_nodes(spark, sf)
    features = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_acctbal") / 1000).alias("balance"))
    return rounded(assembly.node_inputs(runoff, (0, 1), node_features=features, scaler=(0.0, 10.0), transform="log1p", limit=3.0))


LW, LB, HW, HB = _demo(51, 3, 2), _demo(52, 2), _demo(53, 2, 1), _demo(54, 1)
_LOOPS = "e AS (SELECT s_suppkey AS src, s_suppkey // 2 AS dst FROM supplier WHERE s_suppkey // 2 >= 1 UNION ALL SELECT s_suppkey, s_suppkey FROM supplier), deg AS (SELECT dst AS node, count(*) AS d FROM e GROUP BY 1)"


@query(f"""WITH {INPUTS_SQL}, {_LOOPS}, z AS (SELECT node, date, {", ".join(f"{float(LW[0, j])} * l0 + {float(LW[1, j])} * l1 + {float(LW[2, j])} * b AS c{j}" for j in range(2))} FROM given),
c AS (SELECT e.dst AS node, date, {", ".join(f"sum(c{j} / sqrt(a.d * q.d)) + {float(LB[j])} AS c{j}" for j in range(2))} FROM e JOIN z ON z.node = e.src JOIN deg a ON a.node = e.src JOIN deg q ON q.node = e.dst GROUP BY 1, 2),
n AS (SELECT *, (c0 + c1) / 2 AS m FROM c), w AS (SELECT node, date, {", ".join(f"greatest((c{j} - m) / sqrt(((c0 - m) ** 2 + (c1 - m) ** 2) / 2 + 1e-5), 0) AS h{j}" for j in range(2))} FROM n),
o AS (SELECT node, date, {float(HB[0])} + {float(HW[0, 0])} * h0 + {float(HW[1, 0])} * h1 AS y FROM w), r AS (SELECT node, date, y, row_number() OVER (PARTITION BY node ORDER BY date) AS k FROM o)
SELECT node::VARCHAR AS gauge_id, date, round(ln(1 + exp(y)), 4) AS prediction FROM r WHERE k > 2 AND node <= 5""")
def q84c_runoff_to_gauges(spark, sf):
    """The whole chain: runoff of cells, transfer to nodes, lags, a graph layer, the gauges, without the context."""
    nodes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"))
    edges = nodes.select(F.col("node").alias("src"), F.floor(F.col("node") / 2).alias("dst")).where("dst >= 1")
    gauges = nodes.where("node <= 5").select(F.col("node").cast("string").alias("gauge_id"), "node")
    features = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_acctbal") / 1000).alias("balance"))
    out = assembly.routed(V.runoff(spark, sf), V.sources(spark, sf), nodes, edges, gauges, [{"kind": "gcn", "weights": LW, "bias": LB}], (HW, HB), (0, 1), 2, node_features=features, scaler=(0.0, 10.0), transform="log1p", limit=3.0)
    return rounded(out, 4)


AW, AB, AS, AD, AE, AH, AC = _demo(55, 3, 4), _demo(56, 4), _demo(57, 4), _demo(58, 4), _demo(59, 2, 2), _demo(60, 4, 1), _demo(61, 1)
T1, TB1, T2, TB2 = _demo(62, 2, 1, 3), _demo(63, 2), _demo(64, 1, 2, 3), _demo(65, 1)


def _sql_conv(kernel, bias, ins: list[str]) -> str:
    """A centred convolution of three steps along each node's series."""
    at = {0: "coalesce(lag({}) OVER w, 0)", 1: "{}", 2: "coalesce(lead({}) OVER w, 0)"}
    return " + ".join([f"({float(bias)})"] + [f"({float(kernel[i, k])}) * {at[k].format(c)}" for i, c in enumerate(ins) for k in range(3)])


ACTS = [f"c{j}" for j in range(4)]


@query(f"""WITH {INPUTS_SQL}, ef AS (SELECT s_suppkey AS src, s_suppkey // 2 AS dst, (s_suppkey % 3)::DOUBLE AS w0, s_acctbal::DOUBLE / 10000 AS w1 FROM supplier WHERE s_suppkey // 2 >= 1),
x AS (SELECT node, date, {", ".join(f"({float(AW[0, j])}) * l0 + ({float(AW[1, j])}) * l1 + ({float(AW[2, j])}) * b AS c{j}" for j in range(4))} FROM given),
{_sql_heads("a", "ef", "x", ACTS, 2, [(AS[2 * h : 2 * h + 2], AD[2 * h : 2 * h + 2], AE[h]) for h in range(2)], "node, date")},
g AS (SELECT node, date, {", ".join(f"c{j} + ({float(AB[j])}) AS c{j}" for j in range(4))} FROM attended), m AS (SELECT *, (c0 + c1 + c2 + c3) / 4 AS m FROM g), v AS (SELECT *, ({" + ".join(f"(c{j} - m) ** 2" for j in range(4))}) / 4 AS v FROM m),
y AS (SELECT node, date, ln(1 + exp({" + ".join([f"({float(AC[0])})"] + [f"({float(AH[j, 0])}) * greatest((c{j} - m) / sqrt(v + 1e-5), 0)" for j in range(4)])})) AS y FROM v WHERE (SELECT count(*) % 2 FROM times) = 0 OR date < (SELECT max(date) FROM times)),
t1 AS (SELECT node, date, y, {", ".join(f"greatest({_sql_conv(T1[o], TB1[o], ['y'])}, 0) AS t{o}" for o in range(2))} FROM y WINDOW w AS (PARTITION BY node ORDER BY date)),
t2 AS (SELECT node, date, y + {_sql_conv(T2[0], TB2[0], ["t0", "t1"])} AS y, row_number() OVER w - 1 AS k FROM t1 WINDOW w AS (PARTITION BY node ORDER BY date)),
r AS (SELECT node, k // 2 AS step, min(date) AS date, avg(y) AS y FROM t2 GROUP BY 1, 2) SELECT node::VARCHAR AS gauge_id, date, round(y, 4) AS prediction FROM r WHERE step >= 1""")
def q84d_attention_to_gauges(spark, sf):
    """The whole chain with a gauge at every node: two attention heads with features of edges, a temporal head, means of two steps, without the context."""
    nodes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"))
    supplier = table(spark, sf, "supplier")
    edges = supplier.select(F.col("s_suppkey").alias("src"), F.floor(F.col("s_suppkey") / 2).alias("dst"), (F.col("s_suppkey") % 3).cast("double").alias("turn"), (F.col("s_acctbal").cast("double") / 10000).alias("slope")).where("dst >= 1")
    gauges = nodes.select(F.col("node").cast("string").alias("gauge_id"), "node")
    features = supplier.select(F.col("s_suppkey").alias("node"), (F.col("s_acctbal") / 1000).alias("balance"))
    runoff = V.runoff(spark, sf)
    dates = table(spark, sf, "lineitem").select(F.trunc("l_shipdate", "MM").alias("date")).distinct()  # those of runoff, without its sums
    if dates.count() % 2:  # an odd last month has no pair
        runoff = runoff.join(F.broadcast(dates.agg(F.max("date").alias("_last"))), F.col("date") < F.col("_last")).drop("_last")
    layers = [{"kind": "gat", "weights": AW, "bias": AB, "attend_src": AS, "attend_dst": AD, "heads": 2, "edge_features": ["turn", "slope"], "attend_edge": AE}]
    out = assembly.routed(runoff, V.sources(spark, sf), nodes, edges, gauges, layers, (AH, AC), (0, 1), 1, node_features=features, scaler=(0.0, 10.0), transform="log1p", limit=3.0, temporal=[(T1, TB1), (T2, TB2)], reduction=("mean", 2))
    return rounded(out, 4)


@query(f"""WITH {V.SERIES_SQL}, m AS (SELECT gauge_id, count(*) AS n, sum(prediction) AS sum_p, sum((prediction - observation) ** 2) AS sse FROM series WHERE prediction IS NOT NULL AND observation IS NOT NULL GROUP BY 1) SELECT gauge_id, n, round(sum_p, 2) AS sum_p, round(sse, 0) AS sse FROM m""")
def q85_moment_stream(spark, sf):
    """Sums of metrics over a stream of files, in complete mode."""
    from fluvial.common import shared_path
    from fluvial.streaming import daily

    path, out = shared_path(spark, "moments"), shared_path(spark, "moments-out")
    s = V.series(spark, sf)
    for k in range(2):
        s.where(F.month("date") % 2 == k).write.mode("append").parquet(path)
    daily.run_once(daily.moment_stream(spark.readStream.schema(s.schema).parquet(path), ["gauge_id"]), out, shared_path(spark, "moments-state"), "complete")
    d = spark.read.parquet(out).where("n > 0").select("gauge_id", "n", F.round("sum_p", 2).alias("sum_p"), F.round("sse", 0).alias("sse"))
    return d
