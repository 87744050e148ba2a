"""Directed flow networks: edges from grids and terrain, edge features and weights, accumulation, components, gauges.

Networks are tables: nodes (node, ...), edges (src, dst, ...). Everything along paths is done by pointer doubling: after
k rounds each node knows its 2 ** k-th successor, so a network of any depth takes a number of joins that grows with the
logarithm of its depth, and never more rows than it has nodes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvial.common import checked_join, materialize, numbered, shuffled_join
from fluvial.functions.columns import canonical_id, clip, col, finite, kirpich_minutes, numeric_id, or_zero, ratio
from fluvial.operators import quadtree
from fluvial.operators.quantiles import quantiles

#: Row and column steps to the eight neighbours, row by row.
EIGHT = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]
FOUR = [(dy, dx) for dy, dx in EIGHT if dy == 0 or dx == 0]

# Flow-direction codes, from east clockwise (y grows downwards).
CLOCKWISE = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
D8_CODES = {"arcgis": {2**k: step for k, step in enumerate(CLOCKWISE)}, "1to8": {k + 1: step for k, step in enumerate(CLOCKWISE)}}
D8_CODES["esri"] = D8_CODES["arcgis"]


def active(c, include: Sequence | None = None, exclude: Sequence | None = None, low=None, high=None, invert: bool = False) -> Column:
    """Whether a cell takes part. A list to include comes first, then one to exclude, else all finite values but 0, or with
    limits those within them. Inverted, cells without a value become active."""
    x = finite(c)
    ok = x.isNotNull()
    if include is not None:
        ok = ok & x.isin(list(include))
    elif exclude is not None:
        ok = ok & ~x.isin(list(exclude))
    elif low is None and high is None:
        ok = ok & (x != 0)
    if include is None and low is not None:
        ok = ok & (x >= low)
    if include is None and high is not None:
        ok = ok & (x <= high)
    ok = F.coalesce(ok, F.lit(False))
    return ~ok if invert else ok


def _steps(offsets: Sequence[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for k, (dy, dx) in enumerate(offsets)])


def _toward(cells: DataFrame, offsets: Sequence[tuple[int, int]], *extra: str) -> DataFrame:
    """src, ty, tx, k and extra columns: the place that each step from each cell leads to."""
    d = cells.select(F.col("flat_index").alias("src"), "y", "x", *[F.col(c).alias(f"src_{c}") for c in extra], F.explode(_steps(offsets)).alias("s"))
    return d.select("src", *[f"src_{c}" for c in extra], F.col("s.k").alias("k"), (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))


def grid_edges(cells: DataFrame, neighbours: int = 8, directed: bool = False, reverse: bool = True) -> DataFrame:
    """src, dst between neighbouring active cells (flat_index, y, x). Undirected: each pair once, and the other way with reverse."""
    offsets = {4: FOUR, 8: EIGHT}[neighbours]
    if not directed:
        offsets = [s for s in offsets if s > (0, 0)]
    pairs = shuffled_join(_toward(cells, offsets), cells.select("y", "x", F.col("flat_index").alias("dst")), ["y", "x"]).select("src", "dst")
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if reverse and not directed else pairs


def d8_edges(cells: DataFrame, code: str = "code", encoding: str = "arcgis") -> DataFrame:
    """src, dst along flow-direction codes; codes that are no direction, and targets that aren't active, give no edge."""
    codes = D8_CODES[encoding.lower()]
    step = F.create_map(*[x for c, (dy, dx) in codes.items() for x in (F.lit(c).cast("bigint"), F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")))])
    d = cells.withColumn("_s", F.try_element_at(step, F.col(code).cast("bigint"))).where("_s IS NOT NULL")
    d = d.select(F.col("flat_index").alias("src"), (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"))
    return shuffled_join(d, cells.select("y", "x", F.col("flat_index").alias("dst")), ["y", "x"]).select("src", "dst")


def downhill_edges(cells: DataFrame, elevation: str = "elevation", neighbours: int = 8) -> DataFrame:
    """src, dst: from each cell to its lowest strictly lower neighbour; of equally low ones the first, row by row."""
    offsets = {4: FOUR, 8: EIGHT}[neighbours]
    near = shuffled_join(_toward(cells, offsets, elevation), cells.select("y", "x", F.col("flat_index").alias("dst"), F.col(elevation).alias("e")), ["y", "x"])
    near = near.where(F.col("e") < F.col(f"src_{elevation}"))
    return near.groupBy("src").agg(F.min_by("dst", F.struct("e", "k")).alias("dst"))


def unique_edges(edges: DataFrame, attributes: Sequence[str] = ()) -> DataFrame:
    """Each edge once, with the mean of each attribute; missing ones count as 0."""
    if not attributes:
        return edges.select("src", "dst").distinct()
    return edges.groupBy("src", "dst").agg(*[F.avg(or_zero(a)).alias(a) for a in attributes])


def with_self_loops(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    return edges.select("src", "dst").unionByName(nodes.select(F.col(node).alias("src"), F.col(node).alias("dst"))).distinct()


def with_ends(edges: DataFrame, nodes: DataFrame, columns: Sequence[str], node: str = "node") -> DataFrame:
    """Edges with the columns of both their nodes, as src_... and dst_...; edges without a node at an end are left out."""
    of = lambda side: nodes.select(F.col(node).alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])
    return shuffled_join(shuffled_join(edges, of("src"), "src"), of("dst"), "dst")


EDGE_FEATURES = {
    "distance": lambda: F.sqrt(F.pow(F.col("dst_x") - F.col("src_x"), F.lit(2)) + F.pow(F.col("dst_y") - F.col("src_y"), F.lit(2))),
    "dx": lambda: F.col("dst_x") - F.col("src_x"),
    "dy": lambda: F.col("dst_y") - F.col("src_y"),
    "source_elevation": lambda: F.col("src_elevation"),
    "target_elevation": lambda: F.col("dst_elevation"),
    "elevation_drop": lambda: F.col("src_elevation") - F.col("dst_elevation"),
    "slope": lambda: EDGE_FEATURES["elevation_drop"]() / F.greatest(EDGE_FEATURES["distance"](), F.lit(1e-6)),
    "travel_time_kirpich": lambda: kirpich_minutes(EDGE_FEATURES["distance"](), EDGE_FEATURES["slope"]()),
    "inverse_travel_time_kirpich": lambda: 1 / F.greatest(EDGE_FEATURES["travel_time_kirpich"](), F.lit(1e-6)),
}


def edge_features(ended: DataFrame, names: Sequence[str]) -> DataFrame:
    """ended: edges with src_x, src_y, src_elevation and the same of dst. Missing results are 0."""
    unknown = set(names) - set(EDGE_FEATURES)
    if unknown:
        raise ValueError(f"unknown edge features {sorted(unknown)}; some of {sorted(EDGE_FEATURES)}")
    return ended.select("src", "dst", *[or_zero(EDGE_FEATURES[n]()).alias(n) for n in names])


def edge_weights(edges: DataFrame, feature: str, normalise: str = "none") -> DataFrame:
    """edges with weight: the inverse of distances and travel times, else the feature if positive; optionally over the sum of
    the weights that leave the same source."""
    x = or_zero(feature)
    w = F.when(x > 0, 1 / F.greatest(x, F.lit(1e-6))).otherwise(0.0) if feature in ("distance", "travel_time_kirpich") else F.greatest(x, F.lit(0.0))
    out = edges.withColumn("weight", w)
    if normalise in ("source_sum", "row_sum", "outgoing_sum"):
        total = F.sum("weight").over(Window.partitionBy("src"))
        out = out.withColumn("weight", F.when(total > 0, F.col("weight") / F.greatest(total, F.lit(1e-12))).otherwise(0.0))
    elif normalise not in ("none", ""):
        raise ValueError(f"unknown normalisation {normalise!r}")
    return out


def select_features(edges: DataFrame, names: Sequence[str], include: Sequence[str] | None = None, exclude: Sequence[str] = (), drop_constant: bool = False, normalise: bool = False, tolerance: float = 1e-12) -> DataFrame:
    """src, dst and the chosen features; constant ones can be dropped, the others scaled to mean 0 and deviation 1."""
    chosen = [n for n in (include or names) if n in names and n not in exclude]
    s = edges.agg(*[f(finite(n)).alias(f"{k}_{n}") for n in chosen for k, f in (("m", F.avg), ("d", F.stddev_pop))]).first() if chosen and (drop_constant or normalise) else None
    if drop_constant:
        chosen = [n for n in chosen if (s[f"d_{n}"] or 0.0) > tolerance]
    return edges.select("src", "dst", *[((F.col(n) - s[f"m_{n}"]) / max(s[f"d_{n}"] or 0.0, tolerance) if normalise and (s[f"d_{n}"] or 0.0) > tolerance else F.col(n) - (s[f"m_{n}"] if normalise else 0.0)).alias(n) for n in chosen])


def dense_index(df: DataFrame, order: Sequence[str], name: str = "node") -> DataFrame:
    """df with a gapless number from 0 in the given order, without sorting in one task: rows are range-partitioned, each
    partition numbers its own and starts where those before it end (one count for each partition goes to the driver)."""
    parts = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "dense-index")
    starts, at = {}, 0
    for r in sorted(parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):
        starts[r[0]], at = at, at + r.n
    if not starts:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    begin = F.element_at(F.create_map(*[F.lit(v).cast("bigint") if k % 2 else F.lit(v) for pair in starts.items() for k, v in enumerate(pair)]), F.col("_part"))
    n = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn(name, begin + n).drop("_part")


def compact(nodes: DataFrame, edges: DataFrame, key: str = "flat_index") -> tuple[DataFrame, DataFrame]:
    """Nodes numbered from 0 by key, and edges between them by number; edges to other cells are left out."""
    numbered = dense_index(nodes, [key])
    of = lambda side: numbered.select(F.col(key).alias(side), F.col("node").alias(f"_{side}"))
    e = shuffled_join(shuffled_join(edges, of("src"), "src"), of("dst"), "dst")
    return numbered, e.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


# -- along the flow ----------------------------------------------------------------------------------------------------


def successors(edges: DataFrame) -> DataFrame:
    """node, next: one successor for each source, the smallest if there are several."""
    return edges.where("src <> dst").groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("next"))


def accumulate(nodes: DataFrame, next_of: DataFrame, upstream: Sequence[str] = (), downstream: Sequence[str] = (), max_rounds: int = 40) -> DataFrame:
    """node, up_{c} for each upstream column (its sum over the node and all that flow to it), down_{c} for each downstream
    column (its sum over the node and all on its way to the outlet).

    nodes: node and the columns; next_of: node, next. In round k every node has the sums over fewer than 2 ** k steps and
    its 2 ** k-th successor. A cycle never runs out of successors; after max_rounds rounds that is an error.
    """
    ups, downs = [f"up_{c}" for c in upstream], [f"down_{c}" for c in downstream]
    cols = [*[F.coalesce(col(c), F.lit(0.0)).cast("double").alias(f"up_{c}") for c in upstream], *[F.coalesce(col(c), F.lit(0.0)).cast("double").alias(f"down_{c}") for c in downstream]]
    state = materialize(shuffled_join(nodes.select("node", *cols), next_of, "node", "left"), "flow")
    late = []  # what still arrives at nodes, round by round; those that have reached the outlet take part in no join
    done = state.where("next IS NULL").select("node", *ups, *downs)
    running = state.where("next IS NOT NULL")
    for _ in range(max_rounds):
        if running.isEmpty():
            out = done
            if ups and late:
                more = reduce(lambda a, b: a.unionByName(b), late).groupBy("node").agg(*[F.sum(f"_{c}").alias(f"_{c}") for c in ups])
                out = shuffled_join(done, more, "node", "left").select("node", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0.0))).alias(c) for c in ups], *downs)
            return out
        arriving = materialize(running.groupBy(F.col("next").alias("node")).agg(*[F.sum(c).alias(f"_{c}") for c in ups], F.lit(1).alias("_")).drop("_"), "flow")
        ahead = done.withColumn("_next", F.lit(None).cast(state.schema["next"].dataType)).unionByName(running.withColumnRenamed("next", "_next"))
        ahead = ahead.select(F.col("node").alias("next"), *[F.col(c).alias(f"_{c}") for c in downs], "_next")
        if ups:
            late.append(shuffled_join(arriving, running.select("node"), "node", "left_anti"))
        s = shuffled_join(shuffled_join(running, arriving, "node", "left"), ahead, "next", "left")
        s = materialize(s.select("node", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0.0))).alias(c) for c in [*ups, *downs]], F.col("_next").alias("next")), "flow")
        running, done = s.where("next IS NOT NULL"), done.unionByName(s.where("next IS NULL").drop("next"))
    raise ValueError("the network has a cycle")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, label: the smallest node that can be reached, edges (src, dst) taken both ways, for nodes with an edge to another.

    Alternating steps: each node's larger neighbours are hung on its smallest one, then its smaller ones. Smallest neighbours
    are written before they are joined back, so that both sides of the join are exchanged and a node with many edges can
    be split by the adaptive skew join.
    """

    def hung(pairs: DataFrame, larger: bool) -> DataFrame:
        if larger:
            pairs = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        joined = shuffled_join(pairs.where("v > u") if larger else pairs, least, "u")
        down = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        return down if larger else down.unionByName(least.select("u", F.col("m").alias("v")))

    def tidy(pairs: DataFrame) -> DataFrame:
        return materialize(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)

    edge = tidy(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    was, now = None, mark(edge)
    while was != now:
        edge = tidy(hung(tidy(hung(edge, True)), False))
        was, now = now, mark(edge)
    return edge.select(F.col("u").alias("node"), F.col("v").alias("label"))


def component_ids(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component: 0 for the component of the smallest node, and so on."""
    labels = components(edges)
    named = shuffled_join(nodes.select("node"), labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    numbers = dense_index(named.select("label").distinct(), ["label"], "component")
    return shuffled_join(named, numbers, "label").select("node", "component")


def levels(nodes: DataFrame, next_of: DataFrame) -> DataFrame:
    """node, hops: nodes on the way to the outlet, itself included. Descending hops are an upstream-first order."""
    return accumulate(nodes.withColumn("one", F.lit(1.0)), next_of, downstream=["one"]).select("node", F.col("down_one").cast("bigint").alias("hops"))


def topological_order(nodes: DataFrame, next_of: DataFrame) -> DataFrame:
    """node, level, position, on_cycle: an order in which every node comes before its successor (next_of: node, next).

    level: the longest way from a node without predecessors; positions go by level, then node, and the nodes of cycles, which have no
    level, come last. Levels and cycles are found by pointer doubling: in round k a node learns of the longest way among those of fewer than
    2 ** k steps. When 2 ** k is the number of nodes, only nodes that run into a cycle still have a 2 ** k-th successor, and
    these successors are the nodes of the cycles.
    """
    d = shuffled_join(nodes.select("node").distinct(), next_of.select("node", "next"), "node", "left").withColumn("level", F.lit(0).cast("bigint"))
    state = materialize(d, "order")
    n, step = state.count(), 1
    while step < n and not state.where("next IS NOT NULL").isEmpty():
        running = state.where("next IS NOT NULL")
        arriving = running.groupBy(F.col("next").alias("node")).agg((F.max("level") + step).alias("_far"))
        ahead = running.select(F.col("node").alias("next"), F.col("next").alias("_next"))
        s = shuffled_join(shuffled_join(state, arriving, "node", "left"), ahead, "next", "left")
        state = materialize(s.select("node", F.col("_next").alias("next"), F.greatest("level", F.coalesce("_far", "level")).alias("level")), "order")
        step *= 2
    looped = state.where("next IS NOT NULL").select(F.col("next").alias("node")).distinct().withColumn("on_cycle", F.lit(True))
    if n == 1:  # no round was needed: a node that flows to itself
        looped = state.where("next = node").select("node", F.lit(True).alias("on_cycle"))
    d = shuffled_join(state, looped, "node", "left").select("node", "level", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))
    d = d.withColumn("level", F.when(~F.col("on_cycle"), F.col("level")))
    return numbered(d, ["on_cycle", "level", "node"], "position")


def hydrology_features(nodes: DataFrame, edges: DataFrame, musk: bool | None = None) -> DataFrame:
    """Features of a flow network from node, length_m, slope, area, total_area, stream_order (and MusK).

    Travel times are Muskingum K if it varies (musk=None: looked up), else length over the root of slope.
    """
    if musk is None:
        s = nodes.agg(F.max(finite("MusK")).alias("m"), F.stddev_pop(finite("MusK")).alias("d")).first() if "MusK" in nodes.columns else None
        musk = bool(s and s.m and s.m > 0 and (s.d or 0) > 1e-6)
    travel = F.greatest(or_zero("MusK"), F.lit(1e-6)) if musk else F.greatest(or_zero("length_m"), F.lit(1.0)) / F.sqrt(F.greatest(or_zero("slope"), F.lit(1e-6)))
    n = nodes.withColumns({"length": F.greatest(or_zero("length_m"), F.lit(0.0)), "travel": travel, "one": F.lit(1.0), "own_area": F.greatest(or_zero("area"), F.lit(0.0))})
    nxt = successors(edges)
    sums = accumulate(n, nxt, ["one", "own_area"], ["length", "travel"])
    total = F.greatest(or_zero("total_area"), F.lit(1e-6))
    d = shuffled_join(shuffled_join(shuffled_join(n, sums, "node"), component_ids(nodes, edges), "node"), nxt, "node", "left")
    top = F.max("stream_order").over(Window.partitionBy("component"))
    return d.select(
        "node", F.col("length").alias("local_length_m"), F.col("down_length").alias("distance_to_outlet_m"), F.col("travel").alias("local_travel_time_proxy"), F.col("down_travel").alias("travel_time_proxy_to_outlet"),
        clip(F.col("own_area") / total, 0.0, 1.0).alias("incremental_area_fraction"), clip(F.greatest(or_zero("total_area") - or_zero("area"), F.lit(0.0)) / total, 0.0, 1.0).alias("upstream_area_ratio"),
        F.col("up_one").alias("upstream_flowpath_count"), F.col("up_own_area").alias("upstream_area_km2_topologic"),
        F.when(top > 0, F.col("stream_order") / top).otherwise(0.0).alias("normalized_stream_order"), F.col("next").isNull().cast("double").alias("is_outlet_node"), "component",
    )


def hydraulic_features(edges: DataFrame, n: str | None = None, top: str | None = None, bottom: str | None = None) -> DataFrame:
    """edges (with length_m, slope) with velocity, Manning travel time and its inverse, storage, conveyance, width ratio.
    Defaults: roughness 0.05, top width the bottom width or 1, bottom width the top width."""
    least = lambda c: F.greatest(c, F.lit(1e-6))
    root = F.sqrt(least(F.abs(or_zero("slope"))))
    rough = least(or_zero(n) if n else F.lit(0.05))
    width = least(or_zero(top or bottom) if top or bottom else F.lit(1.0))
    below = least(or_zero(bottom)) if bottom else width
    length = F.greatest(or_zero("length_m"), F.lit(1.0))
    d = edges.withColumn("velocity_proxy", root / rough)
    d = d.withColumn("manning_travel_time_proxy", length / least(F.col("velocity_proxy")))
    return d.withColumns({"inverse_manning_travel_time_proxy": 1 / least(F.col("manning_travel_time_proxy")), "storage_proxy": length * width, "conveyance_proxy": width * root / rough, "width_ratio_proxy": width / below})


def two_hop_edges(paths: DataFrame, junctions: DataFrame) -> DataFrame:
    """src, dst between flowpaths (id, toid) over junctions (id, toid); loops to itself are left out, each edge once."""
    j = junctions.select(F.col("id").alias("toid"), F.col("toid").alias("dst"))
    known = paths.select(F.col("id").alias("dst")).distinct()
    return paths.select(F.col("id").alias("src"), "toid").join(j, "toid").where("src <> dst").join(known, "dst", "left_semi").select("src", "dst").distinct()


def chain_edges(visits: DataFrame, line: str = "line", order: str = "pos", cell: str = "flat_index", against: str | None = None) -> DataFrame:
    """src, dst along each line's cells in order, repeats of the same cell left out; `against`: a flag for lines that are
    drawn against the flow."""
    w = Window.partitionBy(line).orderBy(order)
    d = visits.withColumn("_before", F.lag(cell).over(w)).where(F.col("_before").isNotNull() & (F.col("_before") != F.col(cell)))
    flip = F.coalesce(F.col(against), F.lit(False)) if against else F.lit(False)
    return d.select(F.when(flip, F.col(cell)).otherwise(F.col("_before")).alias("src"), F.when(flip, F.col("_before")).otherwise(F.col(cell)).alias("dst"), line)


def line_links(visits: DataFrame, lines: DataFrame, line: str = "line", order: str = "pos", cell: str = "flat_index", attributes: Sequence[str] = ()) -> DataFrame:
    """src, dst and the attributes of the upper line, from the last cell of each line (id, down) to the first one of the line that its `down`
    names, once for each line. Ids are any text; numbers are compared without decimals; no `down`, or 0, is none."""
    ends = visits.groupBy(line).agg(F.min_by(cell, order).alias("first"), F.max_by(cell, order).alias("last")).join(lines, line)
    named = lambda c: F.coalesce(numeric_id(c), F.col(c).cast("string"))
    down = ends.select(named("id").alias("_id"), F.col("first").alias("dst"))
    upper = ends.where(~named("down").isin("", "0")).select(named("down").alias("_id"), F.col("last").alias("src"), *attributes)
    return upper.join(down, "_id").where("src <> dst").select("src", "dst", *attributes)


def densify_lines(lines: DataFrame, step: float, points: str = "points", line: str = "line") -> DataFrame:
    """line, pos (in order, with room for 2 ** 32 between two points), x, y: the points (structs x, y) of each line and as many between as keep steps at most `step` long."""
    d = lines.select(line, F.posexplode(points).alias("i", "a"), F.col(points).alias("_p")).withColumn("b", F.get("_p", F.col("i") + 1)).drop("_p")
    length = F.sqrt(F.pow(F.col("b.x") - F.col("a.x"), F.lit(2)) + F.pow(F.col("b.y") - F.col("a.y"), F.lit(2)))
    n = F.greatest(F.ceil(F.coalesce(length, F.lit(0.0)) / step), F.lit(1)).cast("int")
    d = d.withColumn("n", F.when(F.col("b").isNull(), 1).otherwise(n)).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda c: F.col(f"a.{c}") + F.coalesce(F.col(f"b.{c}") - F.col(f"a.{c}"), F.lit(0.0)) * F.col("k") / F.col("n")
    return d.select(line, (F.shiftleft(F.col("i").cast("bigint"), 32) + F.col("k")).alias("pos"), at("x").alias("x"), at("y").alias("y"))


# -- nearest cells and gauges ------------------------------------------------------------------------------------------


def nearest(points: DataFrame, cells: DataFrame, key: str, cell: str = "flat_index", geographic: bool = False) -> DataFrame:
    """key, cell, distance: the nearest cell (x, y) of each point (x, y); of equally near ones the smallest cell. geographic: x and y are degrees, and the
    distance is in km on a plane around each point. Cells are indexed by a quadtree."""
    return quadtree.nearest(points, cells, key, cell, geographic)


def nearest_on_axis(points: DataFrame, axis: DataFrame, value: str, coordinate: str) -> DataFrame:
    """points with the nearest coordinate of an axis table; of two equally near ones the lower. The axis is one array, sorted;
    it has as many entries as the grid has rows or columns."""
    a = axis.agg(F.sort_array(F.collect_set(coordinate)).alias("_axis")).scalar()
    steps = 32  # halvings of an array of any length

    def halve(s, _):
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.get("_axis", middle) <= F.col(value)
        return F.struct(F.when(s["hi"] - s["lo"] <= 1, s["lo"]).when(right, middle).otherwise(s["lo"]).alias("lo"), F.when(s["hi"] - s["lo"] <= 1, s["hi"]).when(right, s["hi"]).otherwise(middle).alias("hi"))

    begin = F.struct(F.lit(0).alias("lo"), F.size("_axis").alias("hi"))
    low = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, halve)["lo"]
    d = points.withColumn("_axis", a).withColumn("_lo", low)
    below, above = F.get("_axis", F.col("_lo")), F.get("_axis", F.col("_lo") + 1)
    near = F.when(above.isNull() | (F.abs(F.col(value) - below) <= F.abs(above - F.col(value))), below).otherwise(above)
    return d.withColumn(coordinate, near).drop("_axis", "_lo")


def match_gauges(gauges: DataFrame, order: DataFrame, gauge: str = "gauge_id") -> DataFrame:
    """gauge_pos and the gauges of a list, in its order, matched by id without leading zeros; one that is missing is an error."""
    left = order.select(F.col("gauge_pos"), F.col(gauge).alias("_wanted"), canonical_id(gauge).alias("_id"))
    right = gauges.withColumn("_id", canonical_id(gauge)).withColumn("_hit", F.lit(True))
    j = left.join(right, "_id", "left").where(F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit("no gauge "), F.col("_wanted")))).otherwise(F.lit(True)))
    return j.drop("_id", "_hit", "_wanted")


def resolve_gauges(gauges: DataFrame, cells: DataFrame, gauge: str = "gauge_id") -> DataFrame:
    """gauge, flat_index, method of gauges that say where they are by flat_index, by row and col, by projected x and y, or by
    lon and lat, the first of these that is given. cells: flat_index and what is used of y, x (row and column), xc, yc, lon, lat."""
    have = set(gauges.columns)
    parts = []
    if "flat_index" in have:
        parts.append(("flat_index", gauges.where("flat_index IS NOT NULL").select(gauge, F.col("flat_index").alias("node"))))
    if {"row", "col"} <= have:
        at = cells.select(F.col("y").alias("row"), F.col("x").alias("col"), F.col("flat_index").alias("node"))
        parts.append(("grid", gauges.where("row IS NOT NULL AND col IS NOT NULL").select(gauge, "row", "col").join(at, ["row", "col"]).select(gauge, "node")))
    for name, (px, py), (cx, cy) in (("projected", ("x", "y"), ("xc", "yc")), ("geographic", ("lon", "lat"), ("lon", "lat"))):
        if {px, py} <= have and {cx, cy} <= set(cells.columns):
            points = gauges.where(F.col(px).isNotNull() & F.col(py).isNotNull()).select(gauge, F.col(px).alias("x"), F.col(py).alias("y"))
            near = nearest(points, cells.select("flat_index", F.col(cx).alias("x"), F.col(cy).alias("y")), gauge, geographic=name == "geographic")
            parts.append((name, near.select(gauge, F.col("flat_index").alias("node"))))
    if not parts:
        raise ValueError(f"gauges say nowhere where they are; there are {gauges.columns}")
    return gauge_cascade(parts, gauge).withColumnRenamed("node", "flat_index")


def gauge_cascade(candidates: Mapping[str, DataFrame] | Sequence[tuple[str, DataFrame]], gauge: str = "gauge_id", node: str = "node", policy: str = "priority") -> DataFrame:
    """gauge, node, method: the first source of (name, table) that knows the gauge. policy="override": a source named
    "containing" comes before all others."""
    items = list(candidates.items() if isinstance(candidates, Mapping) else candidates)
    if policy == "override":
        items.sort(key=lambda kv: kv[0] != "containing")
    every = None
    for k, (name, df) in enumerate(items):
        d = df.select(gauge, F.col(node).alias("node"), F.lit(name).alias("method"), F.lit(k).alias("_k"))
        every = d if every is None else every.unionByName(d)
    return every.groupBy(gauge).agg(F.min(F.struct("_k", "node", "method")).alias("b")).select(gauge, "b.node", "b.method")


def check_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what, n: what is wrong with a graph: edges that end nowhere, nodes that occur twice. Empty if nothing is."""
    known = nodes.select("node").distinct()
    loose = lambda side: edges.join(known.withColumnRenamed("node", side), side, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"{side} without a node").alias("what"), "n")
    twice = nodes.groupBy("node").count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node twice").alias("what"), "n")
    return loose("src").unionByName(loose("dst")).unionByName(twice).where("n > 0")


def indegree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("indegree"))


def stale(metadata: Mapping, wanted: Mapping, keys: Sequence[str] = ("builder", "edge_features", "edge_weight", "normalization")) -> bool:
    """Whether a stored graph was built in another way than is wanted."""
    return any(metadata.get(k) != wanted.get(k) for k in keys)


def median_spacing(cells: DataFrame, axis: str) -> DataFrame:
    """spacing: the median distance of neighbouring coordinates of a grid's axis (as many as it has rows or columns)."""
    placed = numbered(cells.select(finite(axis).alias("c")).where("c IS NOT NULL").distinct(), ["c"], "k")
    after = placed.select((F.col("k") - 1).alias("k"), F.col("c").alias("next"))
    return quantiles(placed.join(after, "k").select((F.col("next") - F.col("c")).alias("d")), [], "d", {"spacing": 0.5})


def dem_grid(dem: DataFrame, value: str = "elevation") -> DataFrame:
    """flat_index, row, col, x, y, elevation, active, cell_area of an elevation model (x, y, value), one row a cell of the full grid.

    Rows go by y and columns by x, both upwards; a cell is active if its elevation is a finite number, and cells that the model lacks aren't. The area is the
    product of the median distances of neighbouring coordinates, null if an axis has but one. Of several rows for one cell the lowest elevation counts. The axes are numbered and
    measured apart; they are broadcast if they are small, cells aren't.
    """
    d = dem.select(finite("x").alias("x"), finite("y").alias("y"), finite(value).alias("elevation")).where("x IS NOT NULL AND y IS NOT NULL")
    d = d.groupBy("x", "y").agg(F.min("elevation").alias("elevation"))
    axis = lambda c, name: materialize(numbered(d.select(c).distinct(), [c], name), f"axis-{c}")
    xs, ys = axis("x", "col"), axis("y", "row")
    wide, tall = xs.count(), ys.count()
    area = reduce(lambda a, b: None if a is None or b is None else a * b, [median_spacing(a, c).first()[0] for a, c in ((xs, "x"), (ys, "y"))])
    every = dem.sparkSession.range(wide * tall).select(F.col("id").alias("flat_index"), (F.col("id") % max(wide, 1)).alias("col"), F.floor(F.col("id") / max(wide, 1)).alias("row"))
    cells = checked_join(checked_join(every, xs, "col", "inner", row_bytes=32), ys, "row", "inner", row_bytes=32).join(d, ["x", "y"], "left")
    return cells.select("flat_index", "row", "col", "x", "y", "elevation", F.col("elevation").isNotNull().alias("active"), F.lit(area).cast("double").alias("cell_area"))
