"""Queries on grids, flow networks, transfer and message passing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fluvial.common import shared_path, shuffled_join, table
from fluvial.operators import compare, network, prepare, routing, transfer
from fluvial.plans import views as V
from fluvial.plans.registry import query, rounded
from fluvial.streaming import daily

ACTIVE_SQL = f"{V.GRID_SQL}, act AS (SELECT * FROM cells WHERE active)"
OFFSETS = "(VALUES " + ", ".join(f"({k}, {dy}, {dx})" for k, (dy, dx) in enumerate(network.EIGHT)) + ") o(k, dy, dx)"


def _active(spark, sf):
    return V.cells(spark, sf).where("active")


def _grid_sql(where: str) -> str:
    return f"WITH {ACTIVE_SQL} SELECT a.flat_index AS src, b.flat_index AS dst FROM act a CROSS JOIN {OFFSETS} JOIN act b ON b.y = a.y + dy AND b.x = a.x + dx WHERE {where}"


@query(_grid_sql("dy = 0 OR dx = 0"))
def q31_grid4(spark, sf):
    return network.grid_edges(_active(spark, sf), 4)


@query(_grid_sql("true"))
def q32_grid8(spark, sf):
    return network.grid_edges(_active(spark, sf), 8, directed=True)


@query(f"""WITH {ACTIVE_SQL}, codes AS (SELECT * FROM (VALUES {", ".join(f"({c}, {dy}, {dx})" for c, (dy, dx) in network.D8_CODES["arcgis"].items())}) t(code, dy, dx))
SELECT a.flat_index AS src, b.flat_index AS dst FROM act a JOIN codes USING (code) JOIN act b ON b.y = a.y + dy AND b.x = a.x + dx""")
def q33_d8(spark, sf):
    return network.d8_edges(_active(spark, sf))


DOWN_SQL = f"""{ACTIVE_SQL}, near AS (SELECT a.flat_index AS src, b.flat_index AS dst, b.elevation AS e, k FROM act a CROSS JOIN {OFFSETS} JOIN act b ON b.y = a.y + dy AND b.x = a.x + dx WHERE b.elevation < a.elevation),
down AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY e, k) AS r FROM near) WHERE r = 1)"""


@query(f"WITH {DOWN_SQL} SELECT * FROM down")
def q34_dem_downhill(spark, sf):
    return network.downhill_edges(_active(spark, sf))


ENDED_SQL = f"""{DOWN_SQL}, ended AS (SELECT src, dst, (1000 * (b.x - a.x))::DOUBLE AS dx, (1000 * (b.y - a.y))::DOUBLE AS dy, a.elevation AS source_elevation, b.elevation AS target_elevation FROM down JOIN act a ON a.flat_index = src JOIN act b ON b.flat_index = dst),
f1 AS (SELECT *, sqrt(dx ** 2 + dy ** 2) AS distance, source_elevation - target_elevation AS elevation_drop FROM ended), f2 AS (SELECT *, elevation_drop / greatest(distance, 1e-6) AS slope FROM f1),
f3 AS (SELECT *, 0.01947 * greatest(distance, 1) ** 0.77 * greatest(slope, 1e-6) ** -0.385 AS travel_time_kirpich FROM f2)"""


def _ended(spark, sf):
    cells = _active(spark, sf).select(F.col("flat_index").alias("node"), (1000.0 * F.col("x")).alias("x"), (1000.0 * F.col("y")).alias("y"), "elevation")
    return network.with_ends(network.downhill_edges(_active(spark, sf)), cells, ["x", "y", "elevation"])


ALL_FEATURES = ["distance", "dx", "dy", "source_elevation", "target_elevation", "elevation_drop", "slope", "travel_time_kirpich", "inverse_travel_time_kirpich"]


@query(f"WITH {ENDED_SQL} SELECT src, dst, " + ", ".join(f"round({c}, 6) AS {c}" for c in ALL_FEATURES[:-1]) + ", round(1 / greatest(travel_time_kirpich, 1e-6), 6) AS inverse_travel_time_kirpich FROM f3")
def q35_edge_features(spark, sf):
    return rounded(network.edge_features(_ended(spark, sf), ALL_FEATURES))


@query(f"""WITH {ACTIVE_SQL}, e AS (SELECT a.flat_index AS src, b.flat_index AS dst, 1 / (1000.0 * sqrt(dx ** 2 + dy ** 2)) AS w FROM act a CROSS JOIN {OFFSETS} JOIN act b ON b.y = a.y + dy AND b.x = a.x + dx)
SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS weight FROM e""")
def q36_edge_weight_source_sum(spark, sf):
    cells = _active(spark, sf).select(F.col("flat_index").alias("node"), (1000.0 * F.col("x")).alias("x"), (1000.0 * F.col("y")).alias("y"), "elevation")
    ended = network.with_ends(network.grid_edges(_active(spark, sf)), cells, ["x", "y", "elevation"])
    e = network.edge_weights(network.edge_features(ended, ["distance"]), "distance", "source_sum")
    return rounded(e.select("src", "dst", "weight"))


CLOSURE_SQL = f"""{V.TREE_SQL}, up AS (SELECT id AS node, id AS anc FROM flow UNION ALL SELECT up.node, flow.toid FROM up JOIN flow ON flow.id = up.anc WHERE flow.toid IS NOT NULL)"""


def _tree(spark, sf):
    f = V.flow(spark, sf)
    return f.withColumnRenamed("id", "node"), f.where("toid IS NOT NULL").select(F.col("id").alias("node"), F.col("toid").alias("next"))


@query(f"WITH RECURSIVE {CLOSURE_SQL} SELECT anc AS node, count(*) AS upstream_count, round(sum(area), 4) AS upstream_area FROM up JOIN flow ON flow.id = up.node GROUP BY 1")
def q37_upstream_accumulation(spark, sf):
    nodes, nxt = _tree(spark, sf)
    a = network.accumulate(nodes.withColumn("one", F.lit(1.0)), nxt, upstream=["one", "area"])
    return rounded(a.select("node", F.col("up_one").cast("bigint").alias("upstream_count"), F.col("up_area").alias("upstream_area")), 4)


@query(f"WITH RECURSIVE {CLOSURE_SQL} SELECT up.node, count(*) AS hops, round(sum(length_m), 4) AS distance_to_outlet FROM up JOIN flow ON flow.id = up.anc GROUP BY 1")
def q38_path_to_outlet(spark, sf):
    nodes, nxt = _tree(spark, sf)
    a = network.accumulate(nodes.withColumn("one", F.lit(1.0)), nxt, downstream=["one", "length_m"])
    return rounded(a.select("node", F.col("down_one").cast("bigint").alias("hops"), F.col("down_length_m").alias("distance_to_outlet")), 4)


FOREST_SQL = f"""{V.TREE_SQL}, cut AS (SELECT id, CASE WHEN id % 97 <> 0 THEN toid END AS toid FROM flow), top AS (SELECT id AS node, id AS anc FROM cut UNION ALL SELECT top.node, cut.toid FROM top JOIN cut ON cut.id = top.anc WHERE cut.toid IS NOT NULL),
root AS (SELECT node, min(anc) AS root FROM top GROUP BY 1)"""


@query(f"WITH RECURSIVE {FOREST_SQL} SELECT node, dense_rank() OVER (ORDER BY root) - 1 AS component FROM root")
def q39_components(spark, sf):
    f = V.flow(spark, sf)
    edges = f.where("toid IS NOT NULL AND id % 97 <> 0").select(F.col("id").alias("src"), F.col("toid").alias("dst"))
    return network.component_ids(f.select(F.col("id").alias("node")), edges)


@query(f"""WITH RECURSIVE {CLOSURE_SQL}, ups AS (SELECT anc AS node, count(*) AS c, sum(area) AS a FROM up JOIN flow ON flow.id = up.node GROUP BY 1), downs AS (SELECT up.node, sum(length_m) AS d, sum(length_m / sqrt(0.001 + area / 1000)) AS t FROM up JOIN flow ON flow.id = up.anc GROUP BY 1)
SELECT id AS node, round(d, 4) AS distance_to_outlet_m, round(t, 3) AS travel_time_proxy_to_outlet, c::DOUBLE AS upstream_flowpath_count, round(a, 4) AS upstream_area_km2_topologic, round(least(area / greatest(a, 1e-6), 1), 6) AS incremental_area_fraction,
  round(least(greatest(a - area, 0) / greatest(a, 1e-6), 1), 6) AS upstream_area_ratio, round(area / (SELECT max(area) FROM flow), 6) AS normalized_stream_order, CASE WHEN toid IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_outlet_node, 0::BIGINT AS component
FROM flow JOIN ups ON ups.node = id JOIN downs ON downs.node = id""")
def q39b_hydrology_features(spark, sf):
    f = V.flow(spark, sf)
    nodes, nxt = _tree(spark, sf)
    total = network.accumulate(nodes, nxt, upstream=["area"]).select("node", F.col("up_area").alias("total_area"))
    n = shuffled_join(nodes, total, "node").withColumns({"slope": 0.001 + F.col("area") / 1000, "stream_order": F.col("area")})
    h = network.hydrology_features(n, f.where("toid IS NOT NULL").select(F.col("id").alias("src"), F.col("toid").alias("dst")))
    h = h.withColumns({"travel_time_proxy_to_outlet": F.round("travel_time_proxy_to_outlet", 3), "distance_to_outlet_m": F.round("distance_to_outlet_m", 4), "upstream_area_km2_topologic": F.round("upstream_area_km2_topologic", 4)})
    return rounded(h.drop("local_length_m", "local_travel_time_proxy"))


@query(f"WITH {V.MAP_SQL}, {V.RUNOFF_SQL} SELECT target, date, round(sum(value * weight), 2) AS value FROM runoff JOIN sources USING (source) GROUP BY 1, 2")
def q40_runoff_transfer(spark, sf):
    return rounded(transfer.transfer(V.runoff(spark, sf), V.sources(spark, sf)), 2)


def _weights_sql(new: str) -> str:
    return f"""WITH {V.MAP_SQL}, d AS (SELECT *, greatest(distance, sqrt(cell_area)) AS far FROM sources), scale AS (SELECT quantile_disc(far, 0.5) AS m FROM d), n AS (SELECT *, {new} AS new FROM d, scale), s AS (SELECT *, sum(new) OVER (PARTITION BY target) AS ns, sum(weight) OVER (PARTITION BY target) AS ws FROM n)
SELECT source, target, round(CASE WHEN ns <= 2.220446049250313e-16 THEN weight ELSE new * ws / ns END, 6) AS weight FROM s"""


def _weights(spark, sf, strategy):
    return rounded(transfer.transfer_weights(V.sources(spark, sf), strategy).select("source", "target", "weight"))


@query(_weights_sql("cell_area"))
def q41_transfer_weights_preserve_sum(spark, sf):
    return _weights(spark, sf, "cell_area")


@query(_weights_sql("cell_area / far"))
def q41b_weights_inverse_distance(spark, sf):
    return _weights(spark, sf, "inverse_distance")


@query(_weights_sql("cell_area * exp(-far / m)"))
def q41c_weights_exp_distance(spark, sf):
    return _weights(spark, sf, "exp_distance")


@query(_weights_sql("cell_area * greatest(source_elevation - target_elevation, 0)"))
def q41d_weights_downhill(spark, sf):
    return _weights(spark, sf, "downhill")


@query(_weights_sql("cell_area * greatest(source_elevation - target_elevation, 0) / far"))
def q41e_weights_downhill_distance(spark, sf):
    return _weights(spark, sf, "downhill_distance")


@query(f"WITH {V.MAP_SQL} SELECT source, target, round(weight / sum(weight) OVER (PARTITION BY target), 6) AS weight FROM sources")
def q42_normalize_by_target(spark, sf):
    return rounded(transfer.normalise_by_target(V.sources(spark, sf)).select("source", "target", "weight"))


@query(f"""WITH {V.MAP_SQL} SELECT source, target, round(weight * 2 / (1 + exp(-(0.1 + 0.02 * cell_area - 0.001 * distance))), 6) AS weight FROM sources""")
def q42b_weight_multipliers(spark, sf):
    return rounded(transfer.multipliers(V.sources(spark, sf), {"cell_area": 0.02, "distance": -0.001}, 0.1).select("source", "target", "weight"))


STATE = [f"x{k}" for k in range(4)]
NODES_SQL = f"""{V.TREE_SQL}, vectors AS MATERIALIZED (SELECT count(*) AS n FROM embeddings), keyed AS MATERIALIZED (SELECT id, id % n AS v FROM flow, vectors), nodes AS MATERIALIZED (SELECT id AS node, {", ".join(f"embedding[{k + 1}]::DOUBLE AS x{k}" for k in range(4))} FROM keyed JOIN embeddings ON vec_id = v), edges AS MATERIALIZED (SELECT id AS src, toid AS dst, 100 / length_m AS weight FROM flow WHERE toid IS NOT NULL)"""


def _graph(spark, sf):
    f = V.flow(spark, sf)
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("_v"), *[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate(STATE)])
    nodes = f.select(F.col("id").alias("node"), (F.col("id") % emb.count()).alias("_v")).join(emb, "_v").select("node", *STATE)
    return nodes, f.where("toid IS NOT NULL").select(F.col("id").alias("src"), F.col("toid").alias("dst"), (100 / F.col("length_m")).alias("weight"))


def _message_sql(f: str, w: str = "1") -> str:
    return f"WITH {NODES_SQL}, m AS (SELECT dst, {', '.join(f'{f}({c} * {w}) AS {c}' for c in STATE)} FROM edges JOIN nodes ON node = src GROUP BY 1) SELECT node, {', '.join(f'round(coalesce(m.{c}, 0), 6) AS agg_{c}' for c in STATE)} FROM nodes LEFT JOIN m ON dst = node"


@query(_message_sql("sum", "weight"))
def q43_message_passing_sum(spark, sf):
    nodes, edges = _graph(spark, sf)
    return rounded(routing.sum_layer(nodes, edges, STATE, weight="weight").drop(*STATE))


@query(_message_sql("avg"))
def q43b_message_passing_mean(spark, sf):
    nodes, edges = _graph(spark, sf)
    return rounded(routing.sum_layer(nodes, edges, STATE, how="mean").drop(*STATE))


@query(f"""WITH {NODES_SQL}, e AS (SELECT src, dst, weight AS w FROM edges UNION ALL SELECT node, node, 1 FROM nodes), d AS (SELECT dst AS node, sum(w) AS d FROM e GROUP BY 1), x AS (SELECT dst, {", ".join(f"sum({c} * w / sqrt(a.d * b.d)) AS {c}" for c in STATE)} FROM e JOIN nodes n ON n.node = src JOIN d a ON a.node = src JOIN d b ON b.node = dst GROUP BY 1)
SELECT dst AS node, {", ".join(f"round({c}, 6) AS {c}" for c in STATE)} FROM x""")
def q43c_gcn_layer(spark, sf):
    nodes, edges = _graph(spark, sf)
    return rounded(routing.gcn_layer(nodes, edges, STATE, weight="weight"))


@query(f"""WITH {NODES_SQL}, m AS (SELECT dst, {", ".join(f"sum({c}) AS {c}" for c in STATE)} FROM edges JOIN nodes ON node = src GROUP BY 1) SELECT node, {", ".join(f"round(nodes.{c} + coalesce(m.{c}, 0), 6) AS {c}" for c in STATE)} FROM nodes LEFT JOIN m ON dst = node""")
def q43d_gin_layer(spark, sf):
    nodes, edges = _graph(spark, sf)
    return rounded(routing.gin_layer(nodes, edges, STATE))


ATTEND = ((0.3, -0.2, 0.5, 0.1), (0.2, 0.4, -0.1, 0.3))


@query(f"""WITH {NODES_SQL}, s AS (SELECT *, {" + ".join(f"{a} * {c}" for a, c in zip(ATTEND[0], STATE))} AS a, {" + ".join(f"{a} * {c}" for a, c in zip(ATTEND[1], STATE))} AS b FROM nodes), e AS (SELECT src, dst FROM edges UNION ALL SELECT node, node FROM nodes),
z AS (SELECT dst, p.*, CASE WHEN p.a + q.b > 0 THEN p.a + q.b ELSE 0.2 * (p.a + q.b) END AS z FROM e JOIN s p ON p.node = src JOIN s q ON q.node = dst), w AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY dst) AS p FROM z)
SELECT dst AS node, {", ".join(f"round(sum({c} * p), 6) AS {c}" for c in STATE)} FROM w GROUP BY 1""")
def q43e_gat_layer(spark, sf):
    nodes, edges = _graph(spark, sf)
    return rounded(routing.gat_layer(nodes, edges, STATE, *ATTEND))


EDGE_ATTEND = ((0.4, -0.3), (-0.2, 0.1))


def _sql_heads(z: str, edges: str, nodes: str, state: list[str], width: int, heads: list[tuple], keys: str = "node") -> str:
    """CTEs up to `attended`: heads of attention (weights of src, of dst, of w0 and w1) over edges (src, dst, w0, w1) on states."""
    of = lambda w, h, t: " + ".join(f"({float(a)}) * {t}.{state[h * width + k]}" for k, a in enumerate(w))
    other = [k for k in keys.split(", ") if k != "node"]
    same, extra = "".join(f" AND p.{k} = q.{k}" for k in other), "".join(f", {k}" for k in other)
    score = lambda h: f"{of(heads[h][0], h, 'p')} + {of(heads[h][1], h, 'q')} + ({float(heads[h][2][0])}) * w0 + ({float(heads[h][2][1])}) * w1"
    return f"""ee AS (SELECT src, dst, w0, w1 FROM {edges} WHERE src <> dst UNION ALL SELECT n.node, n.node, coalesce(avg(w0), 0), coalesce(avg(w1), 0) FROM (SELECT DISTINCT node FROM {nodes}) n LEFT JOIN (SELECT * FROM {edges} WHERE src <> dst) x ON x.dst = n.node GROUP BY 1),
{z}z AS (SELECT dst, p.*, {", ".join(f"{score(h)} AS s{h}" for h in range(len(heads)))} FROM ee JOIN {nodes} p ON p.node = src JOIN {nodes} q ON q.node = dst{same}),
{z}w AS (SELECT *, {", ".join(f"exp(greatest(s{h}, 0.2 * s{h})) / sum(exp(greatest(s{h}, 0.2 * s{h}))) OVER (PARTITION BY dst{extra}) AS p{h}" for h in range(len(heads)))} FROM {z}z),
attended AS (SELECT dst AS node{extra}, {", ".join(f"sum({c} * p{k // width}) AS {c}" for k, c in enumerate(state))} FROM {z}w GROUP BY dst{extra})"""


@query(f"""WITH {NODES_SQL}, ef AS (SELECT src, dst, weight AS w0, (src % 7 - 3)::DOUBLE AS w1 FROM edges), {_sql_heads("h", "ef", "nodes", STATE, 2, [(ATTEND[0][2 * h : 2 * h + 2], ATTEND[1][2 * h : 2 * h + 2], EDGE_ATTEND[h]) for h in range(2)])}
SELECT node, {", ".join(f"round({c}, 6) AS {c}" for c in STATE)} FROM attended""")
def q43h_gat_heads(spark, sf):
    """Two attention heads whose scores also weigh features of the edges; loops have the mean of their node's edges."""
    nodes, edges = _graph(spark, sf)
    edges = edges.withColumn("turn", (F.col("src") % 7 - 3).cast("double"))
    return rounded(routing.gat_layer(nodes, edges, STATE, *ATTEND, heads=2, edge_features=["weight", "turn"], attend_edge=EDGE_ATTEND))


def _demo(seed: int, *shape: int) -> np.ndarray:
    return np.round(np.random.default_rng(seed).normal(0, 0.5, shape), 3)


def _sql_dense(w, b, ins, act="{}"):
    return [act.format(" + ".join([str(float(b[j]))] + [f"{float(w[i, j])} * {c}" for i, c in enumerate(ins)])) for j in range(w.shape[1])]


MW, MB, OW, OB, UW, UB = _demo(1, 5, 2), _demo(2, 2), _demo(3, 4, 2), _demo(4, 2), _demo(5, 4, 2), _demo(6, 2)


@query(f"""WITH {NODES_SQL}, m AS (SELECT dst, {", ".join(f"sum(greatest({x}, 0)) AS h{k}" for k, x in enumerate(_sql_dense(MW, MB, [*STATE, "weight"])))} FROM edges JOIN nodes ON node = src GROUP BY 1),
b AS (SELECT node, {", ".join(f"greatest({x}, 0) AS o{k}" for k, x in enumerate(_sql_dense(OW, OB, STATE)))}, coalesce(h0, 0) AS h0, coalesce(h1, 0) AS h1 FROM nodes LEFT JOIN m ON dst = node)
SELECT node, {", ".join(f"round({x}, 6) AS h{k}" for k, x in enumerate(_sql_dense(UW, UB, ["o0", "o1", "h0", "h1"])))} FROM b""")
def q43f_mpnn_layer(spark, sf):
    nodes, edges = _graph(spark, sf)
    return rounded(routing.mpnn_layer(nodes, edges, STATE, ["weight"], [(MW, MB, "relu")], [(OW, OB, "relu")], [(UW, UB, "none")], 2))


def _sql_norm(columns: list[str], of: str) -> str:
    """Layer normalisation and ReLU of columns c0, c1, ... as r0, r1, ..., from a table `of` with node."""
    n = len(columns)
    return f"""SELECT node, {", ".join(f"greatest(({c} - m) / sqrt(v + 1e-5), 0) AS r{k}" for k, c in enumerate(columns))} FROM (SELECT *, ({" + ".join(f"({c} - m) ** 2" for c in columns)}) / {n} AS v FROM (SELECT *, ({" + ".join(columns)}) / {n} AS m FROM {of}))"""


G1, G2, S1, S2, G3, H1, H2 = _demo(7, 4, 8), _demo(8, 8), _demo(9, 8, 8), _demo(10, 8, 8), _demo(11, 8), _demo(12, 8, 1), _demo(13, 1)
EIGHTH = range(8)


@query(f"""WITH {NODES_SQL}, z AS (SELECT node, {", ".join(f"{x} AS c{j}" for j, x in enumerate(_sql_dense(G1, np.zeros(8), STATE)))} FROM nodes), e AS (SELECT src, dst, weight AS w FROM edges UNION ALL SELECT node, node, 1 FROM nodes), d AS (SELECT dst AS node, sum(w) AS d FROM e GROUP BY 1),
g AS (SELECT dst AS node, {", ".join(f"sum(c{j} * w / sqrt(a.d * b.d)) + {float(G2[j])} AS c{j}" for j in EIGHTH)} FROM e JOIN z ON z.node = src JOIN d a ON a.node = src JOIN d b ON b.node = dst GROUP BY 1), r AS ({_sql_norm([f"c{j}" for j in EIGHTH], "g")}),
m AS (SELECT dst AS node, {", ".join(f"avg(r{j}) AS a{j}" for j in EIGHTH)} FROM edges JOIN r ON node = src GROUP BY 1), b AS (SELECT r.*, {", ".join(f"coalesce(a{j}, 0) AS a{j}" for j in EIGHTH)} FROM r LEFT JOIN m USING (node)),
s AS (SELECT node, {", ".join(" + ".join([str(float(G3[j]))] + [f"{float(S1[i, j])} * a{i} + {float(S2[i, j])} * r{i}" for i in EIGHTH]) + f" AS c{j}" for j in EIGHTH)} FROM b), t AS ({_sql_norm([f"c{j}" for j in EIGHTH], "s")})
SELECT node, round(ln(1 + exp({" + ".join([str(float(H2[0]))] + [f"{float(H1[j, 0])} * r{j}" for j in EIGHTH])})), 6) AS value FROM t""")
def q43g_graph_forward(spark, sf):
    nodes, edges = _graph(spark, sf)
    layers = [{"kind": "gcn", "weights": G1, "bias": G2, "weight": "weight"}, {"kind": "sage", "weights": S1, "self_weights": S2, "bias": G3}]
    return rounded(routing.graph_forward(nodes, edges, STATE, layers, (H1, H2), by=()))


@query(f"""WITH {V.EMBEDDED_SQL}, s AS (SELECT feature, avg(value) AS m, greatest(stddev_samp(value), 1.1920928955078125e-07) AS d FROM feats GROUP BY 1) SELECT node, feature, round((value - m) / d, 5) AS value FROM feats JOIN s USING (feature)""")
def q44_node_feature_zscore(spark, sf):
    f = V.features(spark, sf)
    return rounded(prepare.scale(f, prepare.sample_scaler(f, ["feature"]), ["feature"]).select("node", "feature", "value"), 5)


@query(f"""WITH {ENDED_SQL}, s AS (SELECT avg(slope) AS ms, stddev_pop(slope) AS ds, avg(elevation_drop) AS me, stddev_pop(elevation_drop) AS de FROM f3) SELECT src, dst, round((slope - ms) / ds, 6) AS slope, round((elevation_drop - me) / de, 6) AS elevation_drop FROM f3, s""")
def q45_edge_feature_select(spark, sf):
    e = network.edge_features(_ended(spark, sf), ["distance", "slope", "elevation_drop"]).withColumn("constant", F.lit(3.0))
    return rounded(network.select_features(e, ["distance", "slope", "elevation_drop", "constant"], exclude=["distance"], drop_constant=True, normalise=True))


@query(f"""WITH {ACTIVE_SQL}, g AS (SELECT s_suppkey AS gauge, (s_suppkey * 37 % 4999) / 100.0 AS x, (s_suppkey * 53 % 3999) / 100.0 AS y FROM supplier), d AS (SELECT gauge, flat_index, (act.x - g.x) ** 2 + (act.y - g.y) ** 2 AS d FROM g CROSS JOIN act)
SELECT gauge, flat_index, round(sqrt(d), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY gauge ORDER BY d, flat_index) AS r FROM d) WHERE r = 1""")
def q46_nearest_cell(spark, sf):
    g = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("gauge"), (F.col("s_suppkey") * 37 % 4999 / 100.0).alias("x"), (F.col("s_suppkey") * 53 % 3999 / 100.0).alias("y"))
    return rounded(network.nearest(g, _active(spark, sf), "gauge"))


@query("""SELECT DISTINCT o_custkey % 1000 AS src, c_nationkey::BIGINT AS dst FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 1000 <> c_nationkey AND c_nationkey IN (SELECT o_custkey % 1000 FROM orders)""")
def q47_two_hop_edges(spark, sf):
    paths = table(spark, sf, "orders").select((F.col("o_custkey") % 1000).alias("id"), F.col("o_custkey").alias("toid"))
    hops = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("toid"))
    return network.two_hop_edges(paths, hops)


@query(f"""WITH {V.GRID_SQL}, m AS (SELECT DISTINCT l_partkey AS flat_index FROM lineitem WHERE l_quantity > 45) SELECT coalesce(a.flat_index, m.flat_index) AS flat_index, CASE WHEN a.flat_index IS NULL THEN 'outside' WHEN m.flat_index IS NULL THEN 'unmapped' ELSE 'mapped' END AS class
FROM (SELECT * FROM cells WHERE active) a FULL JOIN m ON a.flat_index = m.flat_index""")
def q47b_mapped_cells(spark, sf):
    mapped = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("flat_index"))
    return compare.mapped_cells(_active(spark, sf), mapped)


@query(f"""WITH {ACTIVE_SQL}, n AS (SELECT flat_index, row_number() OVER (ORDER BY flat_index) - 1 AS node FROM act) SELECT a.node AS src, b.node AS dst FROM act JOIN (SELECT a.flat_index AS src, b.flat_index AS dst FROM act a CROSS JOIN {OFFSETS} JOIN act b ON b.y = a.y + dy AND b.x = a.x + dx WHERE dy = 0 OR dx = 0) e ON e.src = act.flat_index JOIN n a ON a.flat_index = e.src JOIN n b ON b.flat_index = e.dst""")
def q47c_compaction(spark, sf):
    a = _active(spark, sf)
    return network.compact(a, network.grid_edges(a, 4))[1]


LW = {"w_ih": _demo(21, 16, 1), "w_hh": _demo(22, 16, 4), "b_ih": _demo(23, 16), "b_hh": _demo(24, 16), "head": _demo(25, 4), "head_bias": 0.1}


def _sql_gate(k: int) -> str:
    return " + ".join([str(float(LW["b_ih"][k] + LW["b_hh"][k])), f"{float(LW['w_ih'][k, 0])} * x", *[f"{float(LW['w_hh'][k, j])} * h{j}" for j in range(4)]])


def _sql_tanh(x: str) -> str:
    return f"(2 / (1 + exp(-2 * ({x}))) - 1)"


LSTM_SQL = f"""WITH RECURSIVE {V.DENSE_SQL}, x AS (SELECT cell AS node, date, coalesce(value / 100, 0) AS x, row_number() OVER (PARTITION BY cell ORDER BY date) AS k FROM dense),
s AS (SELECT DISTINCT node, 0::BIGINT AS k, NULL::DATE AS date, {", ".join(f"0::DOUBLE AS h{j}, 0::DOUBLE AS c{j}" for j in range(4))} FROM x
UNION ALL SELECT node, k, date, {", ".join(f"o{j} * {_sql_tanh(f'n{j}')} AS h{j}, n{j} AS c{j}" for j in range(4))} FROM
 (SELECT node, k, date, {", ".join(f"c{j} / (1 + exp(-f{j})) + {_sql_tanh(f'g{j}')} / (1 + exp(-i{j})) AS n{j}, 1 / (1 + exp(-u{j})) AS o{j}" for j in range(4))} FROM
  (SELECT x.node, x.k, x.date, {", ".join(f"c{j}, {_sql_gate(j)} AS i{j}, {_sql_gate(4 + j)} AS f{j}, {_sql_gate(8 + j)} AS g{j}, {_sql_gate(12 + j)} AS u{j}" for j in range(4))} FROM s JOIN x ON x.node = s.node AND x.k = s.k + 1)))
SELECT node, date, round(ln(1 + exp({" + ".join(["0.1", *[f"{float(LW['head'][j])} * h{j}" for j in range(4)]])})), 6) AS value FROM s WHERE k > 0"""


@query(LSTM_SQL)
def q59_lstm_forward(spark, sf):
    d = V.dense(spark, sf).select(F.col("cell").alias("node"), "date", F.coalesce(F.col("value") / 100, F.lit(0.0)).alias("x"))
    return rounded(routing.lstm(d, ["x"], LW))


@query(LSTM_SQL)
def q59c_lstm_in_chunks(spark, sf):
    """Ten days at a time; states are carried from chunk to chunk."""
    d = V.dense(spark, sf).select(F.col("cell").alias("node"), "date", F.coalesce(F.col("value") / 100, F.lit(0.0)).alias("x"))
    return rounded(routing.lstm_in_chunks(d, ["x"], LW, F.floor(F.dayofmonth("date") / 10)))


@query(LSTM_SQL)
def q59d_lstm_stream(spark, sf):
    """The same as a stream that is run three times, each time with the days that have arrived since."""
    d = V.dense(spark, sf).select(F.col("cell").alias("node"), "date", F.coalesce(F.col("value") / 100, F.lit(0.0)).alias("x"))
    arrived, out, checkpoint = (shared_path(spark, f"lstm-{k}") for k in ("in", "out", "state"))
    for low, high in ((0, 10), (10, 20), (20, 99)):
        d.where((F.dayofmonth("date") > low) & (F.dayofmonth("date") <= high)).write.mode("append").parquet(arrived)
        daily.run_once(daily.lstm_stream(spark.readStream.schema(d.schema).parquet(arrived), ["x"], LW), out, checkpoint)
    return rounded(spark.read.parquet(out))


K1 = _demo(31, 1, 1, 2)


@query(f"""WITH {V.DENSE_SQL}, x AS (SELECT cell AS node, date, coalesce(value / 100, 0) AS x FROM dense), z AS (SELECT node, date, x, 0.1 + {float(K1[0, 0, 0])} * coalesce(lag(x, 2) OVER (PARTITION BY node ORDER BY date), 0) + {float(K1[0, 0, 1])} * x AS z FROM x) SELECT node, date, round(z / (1 + exp(-z)) + x, 6) AS t0 FROM z""")
def q59b_causal_layer(spark, sf):
    d = V.dense(spark, sf).select(F.col("cell").alias("node"), "date", F.coalesce(F.col("value") / 100, F.lit(0.0)).alias("x"))
    return rounded(routing.causal_layer(d, ["x"], K1, [0.1], 2))
