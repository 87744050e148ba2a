"""What the other operators are the parts of: networks built from layers of flowpaths or lines, inputs of a routing model, and
the chain from runoff to gauges. All are compositions of joins; nothing goes through the driver but a few statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluvial.common import checked_join, materialize, tasks_for
from fluvial.functions.columns import INVERSE_TRANSFORMS, TRANSFORMS, clip, finite, or_zero
from fluvial.operators import network, prepare, routing, spatial, transfer, windows


def enrich(left: DataFrame, attributes: DataFrame, key: str, suffix: str = "_attr", columns: Sequence[str] | None = None) -> DataFrame:
    """left with the attributes of its key where there are some; a column that left has, too, gets the suffix. columns: the
    attributes to take, as far as they exist."""
    taken = [c for c in (columns or attributes.columns) if c in attributes.columns and c != key]
    named = attributes.select(key, *[F.col(f"`{c}`").alias(c + suffix if c in left.columns else c) for c in taken])
    return left.join(named, key, "left")


def unique_geometry(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One row for each distinct geometry (binary or text), the first by the other columns."""
    rest = [c for c in df.columns if c != geometry]
    if not rest:
        return df.distinct()
    best = df.groupBy(geometry).agg(F.min(F.struct(*rest)).alias("_b"))
    return best.select(*[F.col(c) if c == geometry else F.col("_b")[c].alias(c) for c in df.columns])


def varies(df: DataFrame, column: str) -> bool:
    """Whether a column is there, is positive somewhere and isn't the same everywhere; missing values count as 0."""
    if column not in df.columns:
        return False
    s = df.agg(F.max(or_zero(column)).alias("m"), F.stddev_pop(or_zero(column)).alias("d")).first()
    return bool(s.m and s.m > 0 and (s.d or 0.0) > 1e-6)


# Columns of flowpaths that edges carry.
EDGE_COLUMNS = ("n", "nCC", "BtmWdth", "TopWdth", "TopWdthCC", "MusX", "MusK")


def hydrofabric(paths: DataFrame, junctions: DataFrame, path_attributes: DataFrame | None = None, divide_attributes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a network of flowpaths (id, toid, divide_id, attributes) that meet at junctions (id, toid).

    nodes: node (from 0, in the order of ids) and all attributes. edges: src, dst (nodes), length_m, slope and weight of the source, of which the weight
    is the inverse of MusK if that varies among edges, else of the length; the columns of EDGE_COLUMNS that there are; a proxy of the travel
    time (MusK if it varies, else length over the root of the slope); and the hydraulic features.
    """
    p = paths if path_attributes is None else enrich(paths, path_attributes, "id")
    if divide_attributes is not None and "divide_id" in p.columns:
        p = enrich(p, divide_attributes, "divide_id", columns=("mean.elevation", "mean.slope", "mean.impervious", "mode.ISLTYP", "mode.IVGTYP"))
    nodes = network.dense_index(p, ["id"])
    numbers = nodes.select(F.col("id").alias("src"), F.col("node").alias("_s")), nodes.select(F.col("id").alias("dst"), F.col("node").alias("_d"))
    e = network.two_hop_edges(paths, junctions).join(numbers[0], "src").join(numbers[1], "dst")
    length = or_zero("Length_m") if "Length_m" in p.columns else or_zero("lengthkm") * 1000.0 if "lengthkm" in p.columns else F.lit(0.0)
    slope = next((or_zero(f"`{c}`") for c in ("So", "ChSlp", "mean.slope") if c in p.columns), F.lit(0.0))
    given = [c for c in EDGE_COLUMNS if c in p.columns]
    own = nodes.select(F.col("node").alias("_s"), length.alias("length_m"), slope.alias("slope"), *[or_zero(c).alias(c) for c in given])
    edges = materialize(e.join(own, "_s").select(F.col("_s").alias("src"), F.col("_d").alias("dst"), "length_m", "slope", *given), "hydrofabric-edges")
    by_musk = varies(edges, "MusK")
    musk, far = F.greatest("MusK", F.lit(1e-6)) if by_musk else None, F.greatest("length_m", F.lit(1.0))
    travel = musk if by_musk else far / F.sqrt(F.greatest(F.abs("slope"), F.lit(1e-6)))
    edges = edges.withColumns({"weight": 1 / (musk if by_musk else far), "travel_time_proxy": travel})
    named = {part: c if c in given else None for part, c in (("n", "n"), ("top", "TopWdth"), ("bottom", "BtmWdth"))}
    return nodes, network.hydraulic_features(edges, **named)


def flowline_network(lines: DataFrame, cells: DataFrame, step: float, attributes: Sequence[str] = (), reverse: bool = False) -> DataFrame:
    """src, dst and the mean of each attribute, between the active cells that lines pass one after the other.

    lines: line, points (an array of x, y), id, down (the id of the line below), direction, attributes. Points are put in at
    most `step` apart; each takes its nearest cell; cells that aren't active are left out. A line whose direction has
    "against" in it is drawn against the flow. The last cell of a line flows to the first one of the line below, with the
    attributes of the upper line. reverse: each edge also in the other direction.
    """
    placed = network.densify_lines(lines, step).withColumn("at", F.struct("line", "pos"))
    near = network.nearest(placed.select("at", "x", "y"), cells.select("flat_index", "x", "y"), "at")
    visits = near.select("at.line", "at.pos", "flat_index").join(cells.where("active").select("flat_index"), "flat_index", "left_semi")
    marked = visits.join(lines.select("line", F.lower(F.coalesce("direction", F.lit(""))).contains("against").alias("against")), "line")
    # the order of the flow, so that the ends of lines are the right ones, too
    marked = marked.withColumn("pos", F.when(F.col("against"), -F.col("pos")).otherwise(F.col("pos")))
    own = network.chain_edges(marked.drop("against")).join(lines.select("line", *attributes), "line").select("src", "dst", *attributes)
    links = network.line_links(marked.drop("against"), lines.select("line", "id", "down", *attributes), attributes=attributes)
    every = own.unionByName(links)
    if reverse:
        every = every.unionByName(every.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *attributes))
    return network.unique_edges(every, attributes)


#: What a source map can tell of a cell and its target.
SOURCE_FEATURES = ("elevation", "cell_area", "overlap_area", "overlap_fraction", "x", "y", "distance_to_path")


def source_map(cells: DataFrame, divides: DataFrame, paths: DataFrame, nodes: DataFrame, width: float, height: float, method: str = "center", min_fraction: float = 1e-8, features: Sequence[str] = ()) -> DataFrame:
    """source, target, weight, fraction and features: which cells of a grid give their runoff to which nodes.

    cells: flat_index, x, y, and, if there are such, active and elevation; divides: divide_id, ring or rings; paths: id, divide_id, and points for the distance;
    nodes: id, node. method "center": a cell goes whole to the divide that its centre lies in (of several the smallest id); "fractional_area": by the
    area that it shares with each divide, from min_fraction of the cell on. A divide has the smallest of its paths; cells of divides without a path
    among the nodes stay away, and if no cell has a target that is an error. Missing elevations, and distances to paths without points, are 0.
    """
    unknown = set(features) - set(SOURCE_FEATURES)
    if unknown or method not in ("center", "fractional_area"):
        raise ValueError(f"unknown method {method!r} or features {sorted(unknown)}")
    if "active" in cells.columns:
        cells = cells.where("active")
    if method == "center":
        met = spatial.cells_in_polygons(cells, divides, "divide_id").select("flat_index", "divide_id", F.lit(width * height).alias("weight"), F.lit(1.0).alias("fraction"))
    else:
        met = spatial.overlap(cells, divides, "divide_id", width, height, min_fraction=min_fraction).withColumnRenamed("area", "weight")
    points = [F.col("points")] if "distance_to_path" in features else []
    targets = paths.where("divide_id IS NOT NULL").select("divide_id", F.struct("id", *points).alias("p"))
    targets = targets.groupBy("divide_id").agg(F.min_by("p", "p.id").alias("p")).select("divide_id", "p.*").join(nodes.select("id", F.col("node").alias("target")), "id")
    out = checked_join(met.select("flat_index", "divide_id", "weight", "fraction"), targets.drop("id"), "divide_id", "inner", row_bytes=4096)
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    told = {
        "elevation": or_zero("elevation") if "elevation" in cells.columns else F.lit(0.0), "cell_area": F.lit(width * height), "overlap_area": F.col("weight"),
        "overlap_fraction": F.col("fraction"), "x": x, "y": y, "distance_to_path": F.coalesce(spatial.distance_to_line(F.col("points"), x, y), F.lit(0.0)),
    }
    if features:
        of_cell = [c for c in ("x", "y", "elevation") if c in cells.columns]
        out = out.join(cells.select("flat_index", *of_cell), "flat_index")
    out = materialize(out.select(F.col("flat_index").alias("source"), "target", "weight", "fraction", *[told[c].alias(c) for c in features]), "source-map")
    if out.isEmpty():
        raise ValueError("no cell lies in a divide that has a path among the nodes")
    return out


def physical(df: DataFrame, scaler: DataFrame, by: Sequence[str], space: str = "scaled", transform: str = "none", values: Sequence[str] = ("prediction", "observation")) -> DataFrame:
    """Predictions and observations as a loss in `space` takes them: scaled back, and with the transform undone, only for
    physical, original or unscaled. Without any scaler they stay as they are; a series that the scaler lacks is an error when run."""
    if space not in ("physical", "original", "unscaled") or scaler.isEmpty():
        return df
    j = df.join(scaler.select(*by, F.col("mean").alias("_mean"), F.greatest("std", F.lit(1e-6)).alias("_std"), F.lit(True).alias("_known")), list(by), "left")
    lacking = F.raise_error(F.concat(F.lit("no scaler for "), F.to_json(F.struct(*by))))
    j = j.where(F.when(F.col("_known"), F.lit(True)).otherwise(lacking.cast("boolean"))).drop("_known")
    return j.withColumns({v: INVERSE_TRANSFORMS[transform](finite(v) * F.col("_std") + F.col("_mean")) for v in values}).drop("_mean", "_std")


def node_inputs(runoff: DataFrame, lags: Sequence[int], dynamic: DataFrame | None = None, static: DataFrame | None = None, node_features: DataFrame | None = None, scaler: tuple[float, float] | None = None, transform: str = "none", normalise: bool = False, limit: float | None = None, fill: str = "zero", time: str = "date") -> DataFrame:
    """node, time and the inputs of a routing model: lagged runoff (node, time, value), transformed and scaled; dynamic columns
    (node, time, ...); static ones and node features (node, ...), the latter scaled by their sample deviation if normalise.
    Missing and infinite inputs are 0; all are cut to [-limit, limit]."""
    x = TRANSFORMS[transform](or_zero("value"))
    x = (x - scaler[0]) / max(scaler[1], 1e-6) if scaler else x
    d = windows.lags(runoff.select("node", time, x.alias("runoff")), "runoff", lags, ["node"], time, fill)
    d = d.select("node", time, *[F.col(f"runoff_lag{k}") for k in lags])
    if dynamic is not None:
        d = d.join(dynamic, ["node", time], "left")
    if static is not None:
        d = d.join(static, "node", "left")
    if node_features is not None:
        names = [c for c in node_features.columns if c != "node"]
        if normalise:
            f = node_features.select("node", *[or_zero(c).alias(c) for c in names]).unpivot("node", names, "feature", "value")
            scaled = prepare.scale(f, prepare.sample_scaler(f, ["feature"]), ["feature"])
            node_features = scaled.groupBy("node").pivot("feature", names).agg(F.first("value"))
        d = d.join(node_features, "node", "left")
    low = None if limit is None else -limit
    return d.select("node", time, *[clip(or_zero(f"`{c}`"), low, limit).alias(c) for c in d.columns if c not in ("node", time)])


def routed(runoff: DataFrame, mapping: DataFrame, nodes: DataFrame, edges: DataFrame, gauges: DataFrame, layers: Sequence[Mapping], head: tuple, lags: Sequence[int] = (0, 1), context: int = 0, time: str = "date", temporal: Sequence[tuple] = (), residual: bool = True, reduction: tuple[str, int | None] | None = None, **inputs) -> DataFrame:
    """gauge_id, time, prediction: runoff of cells (source, time, value) carried to nodes, lagged, routed by graph layers, and
    read at the gauges (gauge_id, node).

    temporal: layers of a temporal head (routing.temporal_head) along each gauge's series. reduction: ("sum" or "mean", steps) over so many steps, which
    must divide the series, or over all if None; the time is that of the first. The first `context` steps of what then is there are left out.
    """
    at_nodes = transfer.transfer(runoff, mapping, nodes.select(F.col("node").alias("target")), time=time).withColumnRenamed("target", "node")
    given = materialize(node_inputs(at_nodes, lags, time=time, **inputs), "routed-inputs")
    state = [c for c in given.columns if c not in ("node", time)]
    states = given.count()
    messages = states + states * edges.count() // max(nodes.count(), 1)
    tasks = tasks_for(given.sparkSession, messages)
    tasks = tasks if tasks > tasks_for(given.sparkSession, 0) else None
    out = routing.graph_forward(given, edges, state, layers, head, by=(time,), tasks=tasks)
    read = out.join(gauges.select("gauge_id", "node"), "node").select("gauge_id", time, F.col("value").alias("prediction"))
    if temporal:
        read = routing.temporal_head(read, "prediction", temporal, ["gauge_id"], time, residual)
    if reduction and reduction[1] is None:
        read = read.groupBy("gauge_id").agg(F.min(time).alias(time), {"sum": F.sum, "mean": F.avg}[reduction[0]]("prediction").alias("prediction"))
    elif reduction:
        read = windows.reduce_steps(read, "prediction", reduction[1], ["gauge_id"], time, reduction[0], start=True).select("gauge_id", time, "prediction")
    n = F.row_number().over(Window.partitionBy("gauge_id").orderBy(time))
    return read.withColumn("_n", n).where(F.col("_n") > context).drop("_n")
