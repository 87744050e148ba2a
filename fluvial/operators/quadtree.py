"""An adaptive spatial index: a quadtree over points, whose nodes are prefixes of Morton codes.

A node with more than LEAF points is cut into the 4 ** STEP squares below it, so dense places are cut finer than sparse ones and no leaf is
large, however the points lie (points at one place can't be cut: MOST_DEPTH ends it). Each level is one aggregation over
the points that are still in large nodes; each node has the bounds of its points.

Queries go from the root down: a query meets the children of the nodes that it can't exclude by their bounds. The upper levels' tables are
small and broadcast; deeper ones are joined by code. So neither a bucket of a million points nor a polygon over many empty squares costs
more than what lies near the query.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvial.common import checked_join, materialize

LEAF = 64
#: Levels that a node is cut by at a time, and the deepest level: squares of the extent over 2 ** 24.
STEP, MOST_DEPTH = 3, 24
BOUNDS = ("x0", "x1", "y0", "y1")


def _spread(v: Column) -> Column:
    """The 24 low bits of v, with a zero between any two."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return v


def morton(x: Column, y: Column, left: float, low: float, side: float) -> Column:
    """The code of a point at the deepest level: bits of x and y in turns."""
    cut = lambda v, origin: F.greatest(F.least(F.floor((v - origin) / side * (1 << MOST_DEPTH)), F.lit((1 << MOST_DEPTH) - 1)), F.lit(0)).cast("bigint")
    return _spread(cut(x, left)).bitwiseOR(F.shiftleft(_spread(cut(y, low)), 1))


@dataclass
class Tree:
    """points: the indexed rows, with node and depth of their leaf. levels: for each depth a table of node, parent, n, leaf and bounds."""

    points: DataFrame
    levels: list[tuple[int, DataFrame]]


def build(points: DataFrame, leaf: int = LEAF, step: int = STEP) -> Tree:
    """points: x, y and other columns; those without x or y are left out."""
    d = points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    e = d.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    side = max((e.x1 or 0.0) - (e.x0 or 0.0), (e.y1 or 0.0) - (e.y0 or 0.0)) * (1 + 1e-9) or 1.0
    open_ = d.withColumn("_code", morton(F.col("x").cast("double"), F.col("y").cast("double"), float(e.x0 or 0.0), float(e.y0 or 0.0), float(side)))
    done, levels, depth = None, [], 0
    while True:
        node = F.shiftright("_code", 2 * (MOST_DEPTH - depth))
        placed = open_.withColumn("_node", node)
        n = F.count(F.lit(1))
        nodes = placed.groupBy(F.col("_node").alias("node")).agg(n.alias("n"), F.min("x").cast("double").alias("x0"), F.max("x").cast("double").alias("x1"), F.min("y").cast("double").alias("y0"), F.max("y").cast("double").alias("y1"))
        nodes = nodes.withColumns({"leaf": (F.col("n") <= leaf) if depth < MOST_DEPTH else F.lit(True), "parent": F.shiftright("node", 2 * step) if depth else F.lit(None).cast("bigint")})
        nodes = materialize(nodes.select("node", "parent", "n", "leaf", *BOUNDS), "quadtree-nodes")
        levels.append((depth, nodes))
        split = materialize(checked_join(placed, nodes.select(F.col("node").alias("_node"), F.col("leaf").alias("_leaf")), "_node", "inner", row_bytes=24), "quadtree-points")
        settled = split.where("_leaf").select(*points.columns, F.lit(depth).alias("_depth"), "_node")
        done = settled if done is None else done.unionByName(settled)
        open_ = split.where("NOT _leaf").drop("_leaf", "_node")
        if depth == MOST_DEPTH or open_.isEmpty():
            return Tree(done, levels)
        depth = min(depth + step, MOST_DEPTH)


def descend(tree: Tree, queries: DataFrame, may_hold: Column, bound: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Queries with the leaves (_depth, _node) that they can't exclude. may_hold: by the query's columns and a node's bounds x0, x1, y0, y1;
    bound: a further test over all nodes that a query still has at a level."""
    current = queries.withColumn("_parent", F.lit(0).cast("bigint"))
    found = None
    for k, (depth, nodes) in enumerate(tree.levels):
        named = nodes.select(F.coalesce("parent", F.lit(0).cast("bigint")).alias("_parent"), F.col("node").alias("_node"), "leaf", *BOUNDS)
        met = checked_join(current, named, "_parent", "inner", row_bytes=64).where(may_hold)
        met = materialize(bound(met) if bound else met, "quadtree-search")
        leaves = met.where("leaf").select(*queries.columns, F.lit(depth).alias("_depth"), "_node")
        found = leaves if found is None else found.unionByName(leaves)
        current = met.where("NOT leaf").select(*queries.columns, F.col("_node").alias("_parent"))
    return found


def _gap(v: Column, low: str, high: str) -> Column:
    """How far a coordinate lies outside of bounds."""
    return F.greatest(F.col(low) - v, v - F.col(high), F.lit(0.0))


def nearest(points: DataFrame, cells: DataFrame, key: str, cell: str = "flat_index", geographic: bool = False, leaf: int = LEAF) -> DataFrame:
    """key, cell, distance: the nearest cell (x, y) of each point (x, y); of equally near ones the smallest cell. geographic: x and y are degrees, and
    differences of x shrink with the cosine of the point's y; distances are km.

    Without cells there is no result; points without a coordinate have none.
    """
    places = cells.select(cell, "x", "y").groupBy("x", "y").agg(F.min(cell).alias(cell))
    tree = build(places, leaf)
    narrow = F.cos(F.radians("_qy")) if geographic else F.lit(1.0)
    q = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(key, F.col("x").cast("double").alias("_qx"), F.col("y").cast("double").alias("_qy"))
    square = lambda dx, dy: F.pow(dx * narrow, F.lit(2)) + F.pow(dy, F.lit(2))
    near = square(_gap(F.col("_qx"), "x0", "x1"), _gap(F.col("_qy"), "y0", "y1"))
    far = square(F.greatest(F.abs(F.col("_qx") - F.col("x0")), F.abs(F.col("_qx") - F.col("x1"))), F.greatest(F.abs(F.col("_qy") - F.col("y0")), F.abs(F.col("_qy") - F.col("y1"))))

    def bound(met: DataFrame) -> DataFrame:
        # no cell is farther than the farthest corner of any node's bounds, also of those met before
        least = F.col("_most")
        d = met.withColumns({"_near": near, "_far": F.least(far, least)})
        best = d.groupBy(key, "_qx", "_qy").agg(F.min("_far").alias("_best"), F.collect_list(F.struct("_node", "leaf", "_near")).alias("_n"))
        kept = best.select(key, "_qx", "_qy", F.col("_best").alias("_most"), F.explode(F.filter("_n", lambda s: s["_near"] <= F.col("_best") * (1 + 1e-12))).alias("s"))
        return kept.select(key, "_qx", "_qy", "_most", F.col("s._node").alias("_node"), F.col("s.leaf").alias("leaf"))

    leaves = descend(tree, q.withColumn("_most", F.lit(float("inf"))), near <= F.col("_most"), bound)
    # a leaf's cells come as one array (those of a deepest square, of which there may be many, as several), so that a query meets a row
    # a leaf, not a row a cell, and only its best cell goes on
    place = Window.partitionBy("_depth", "_node").orderBy(cell)
    held = tree.points.withColumn("_chunk", F.floor((F.row_number().over(place) - 1) / leaf))
    held = held.groupBy("_depth", "_node", "_chunk").agg(F.collect_list(F.struct("x", "y", cell)).alias("_cells"))
    held = materialize(held.drop("_chunk"), "quadtree-leaves")
    met = checked_join(leaves, held, ["_depth", "_node"], "inner", row_bytes=32 * leaf)
    d2 = lambda c: square(c["x"] - F.col("_qx"), c["y"] - F.col("_qy"))
    met = met.select(key, F.array_min(F.transform("_cells", lambda c: F.struct(d2(c).alias("d2"), c[cell].alias(cell)))).alias("b"))
    best = met.groupBy(key).agg(F.min("b").alias("b"))
    return best.select(key, F.col(f"b.{cell}").alias(cell), (F.sqrt("b.d2") * (111.32 if geographic else 1.0)).alias("distance"))


def within(polygons: DataFrame, cells: DataFrame, keys: Sequence[str], inside: Column, leaf: int = LEAF, margin_x: float = 0.0, margin_y: float = 0.0) -> DataFrame:
    """Pairs of polygons (keys, other columns, and bounds px0, px1, py0, py1) and cells (x, y, other columns) whose centres lie within the polygon's bounds, widened by the margins, that pass `inside`."""
    tree = build(cells, leaf)
    meets = (F.col("px0") - margin_x <= F.col("x1")) & (F.col("px1") + margin_x >= F.col("x0")) & (F.col("py0") - margin_y <= F.col("y1")) & (F.col("py1") + margin_y >= F.col("y0"))
    light = polygons.select(*keys, "px0", "px1", "py0", "py1")
    leaves = descend(tree, light, meets)
    near = F.col("x").between(F.col("px0") - margin_x, F.col("px1") + margin_x) & F.col("y").between(F.col("py0") - margin_y, F.col("py1") + margin_y)
    met = leaves.join(tree.points, ["_depth", "_node"]).where(near).drop("_depth", "_node", "px0", "px1", "py0", "py1")
    return met.join(polygons.drop("px0", "px1", "py0", "py1"), list(keys)).where(inside)
