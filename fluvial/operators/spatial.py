"""Cells and polygons. Cells are indexed by a quadtree that is finer where they lie denser (quadtree.py), so a polygon meets only the
leaves that it overlaps; the geometry of points is array expressions; clipping goes through Arrow batches.

Polygons: a key and ring, an array of structs (x, y), its last point not repeated; or rings, an array of such, of which holes and further
parts are some: a point is inside if it lies in an odd number of them. Cells are axis-aligned rectangles given
by their centre (x, y) and sides.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.common import materialize
from fluvial.operators.quadtree import within


def _rings(polygons: DataFrame, key: str) -> DataFrame:
    """key, rings and the bounds px0, px1, py0, py1."""
    rings = F.col("rings") if "rings" in polygons.columns else F.array("ring")
    d = polygons.select(key, rings.alias("rings")).withColumn("_p", F.flatten("rings"))
    v = lambda c: F.transform("_p", lambda p: p[c].cast("double"))
    d = d.select(key, "rings", F.array_min(v("x")).alias("px0"), F.array_max(v("x")).alias("px1"), F.array_min(v("y")).alias("py0"), F.array_max(v("y")).alias("py1"))
    return d.where("px0 IS NOT NULL")


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ray from the point crosses the ring an odd number of times."""
    n = F.size(ring)
    step = lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get(ring, (i + 1) % n)["x"].alias("x2"), F.get(ring, (i + 1) % n)["y"].alias("y2"))
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < e["x1"] + F.try_divide((y - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"]))
    return F.size(F.filter(F.transform(ring, step), crosses)) % 2 == 1


def on_border(ring: Column, x: Column, y: Column) -> Column:
    """Whether the point lies on an edge of the ring."""
    n = F.size(ring)
    step = lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get(ring, (i + 1) % n)["x"].alias("x2"), F.get(ring, (i + 1) % n)["y"].alias("y2"))
    turn = lambda e: (x - e["x1"]) * (e["y2"] - e["y1"]) - (y - e["y1"]) * (e["x2"] - e["x1"])
    beside = lambda e: x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    return F.exists(F.transform(ring, step), lambda e: (turn(e) == 0) & beside(e))


def cells_in_polygons(cells: DataFrame, polygons: DataFrame, key: str, cell: str = "flat_index", retry: bool = True) -> DataFrame:
    """cell, key for each cell whose centre lies in a polygon, not on its border; of several the smallest key. retry: if no cell at all lies in
    a polygon, those on borders count."""
    c, p = cells.select(cell, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), _rings(polygons, key)
    x, y = F.col("x"), F.col("y")
    crossings = F.aggregate(F.transform("rings", lambda r: contains(r, x, y).cast("int")), F.lit(0), lambda a, b: a + b)
    border = F.exists("rings", lambda r: on_border(r, x, y))
    out = materialize(within(p, c, [key], (crossings % 2 == 1) & ~border).groupBy(cell).agg(F.min(key).alias(key)), "cells-within")
    if retry and out.isEmpty():
        return within(p, c, [key], (crossings % 2 == 1) | border).groupBy(cell).agg(F.min(key).alias(key))
    return out


def _clip(ring: list, axis: int, limit: float, above: bool) -> list:
    """The part of a ring on one side of an axis-parallel line."""
    out = []
    for p, q in zip(ring, ring[1:] + ring[:1]):
        p_in, q_in = ((p[axis] >= limit, q[axis] >= limit) if above else (p[axis] <= limit, q[axis] <= limit))
        if p_in:
            out.append(p)
        if p_in != q_in:
            t = (limit - p[axis]) / (q[axis] - p[axis])
            out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return out


def _area(ring: list) -> float:
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))) / 2


def overlap(cells: DataFrame, polygons: DataFrame, key: str, width: float, height: float, cell: str = "flat_index", min_fraction: float = 0.0) -> DataFrame:
    """cell, key, area, fraction: how much of each cell lies in each polygon; shares of at least min_fraction and above 0.

    Convex and concave rings are clipped alike; a concave ring that falls into pieces keeps the right area, since the
    edges between the pieces lie on the cell's border and cancel out. Of several rings, areas are signed by how many others they lie in: holes count
    against the part around them.
    """
    c = cells.select(cell, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    met = within(_rings(polygons, key), c, [key], F.lit(True), margin_x=width / 2, margin_y=height / 2)

    @F.pandas_udf("double")
    def shared(rings: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for parts, cx, cy in zip(rings, x, y):
            total, every = 0.0, [[(p["x"], p["y"]) for p in points] for points in parts]
            for k, whole in enumerate(every):
                r = whole
                for axis, centre, half in ((0, cx, width / 2), (1, cy, height / 2)):
                    r = _clip(_clip(r, axis, centre - half, True), axis, centre + half, False)
                depth = sum(_inside(other, *whole[0]) for j, other in enumerate(every) if j != k) if len(every) > 1 else 0
                total += _area(r) * (-1) ** depth
            out.append(total)
        return pd.Series(out, dtype=float)

    out = met.select(cell, key, shared("rings", "x", "y").alias("area")).withColumn("fraction", F.col("area") / (width * height))
    return out.where((F.col("area") > 0) & (F.col("fraction") >= min_fraction))


def _inside(ring: list, x: float, y: float) -> bool:
    return sum((p[1] > y) != (q[1] > y) and x < p[0] + (y - p[1]) * (q[0] - p[0]) / (q[1] - p[1]) for p, q in zip(ring, ring[1:] + ring[:1])) % 2 == 1


def distance_to_line(points: Column, x: Column, y: Column) -> Column:
    """From (x, y) to the nearest place of a line of points; null if it has none."""

    def far(k):
        a = F.get(points, k)
        b = F.coalesce(F.get(points, k + 1), a)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.coalesce(F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return F.hypot(x - a["x"] - t * dx, y - a["y"] - t * dy)

    # the last point is a segment of its own
    return F.when(F.size(points) > 0, F.array_min(F.transform(F.sequence(F.lit(0), F.size(points) - 1), far)))
