"""The adaptive spatial index on skewed coordinates, against comparing everything with everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvial.operators import quadtree, spatial


@pytest.fixture(scope="module")
def skewed(spark):
    """Most cells in one thousandth of the square, some alone, ten at one place."""
    rng = np.random.default_rng(4)
    at = np.concatenate([rng.random((1500, 2)) * 1e-3 + 0.5, rng.random((200, 2)) * 10 - 5, np.full((10, 2), 7.0)])
    return at, spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "flat_index int, x double, y double").repartition(4)


def test_no_leaf_is_large(skewed):
    at, cells = skewed
    tree = quadtree.build(cells, leaf=16)
    sizes = {(r._depth, r._node): r.n for r in tree.points.groupBy("_depth", "_node").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(sizes.values()) == len(at) and max(sizes.values()) <= 16 and len({d for d, _ in sizes}) > 2


@pytest.mark.parametrize("geographic", [False, True])
def test_nearest_of_skewed_cells(spark, skewed, geographic):
    at, cells = skewed
    rng = np.random.default_rng(5)
    asked = np.concatenate([rng.random((40, 2)) * 1e-3 + 0.5, rng.random((40, 2)) * 30 - 15, [[7.0, 7.0], [0.5, -60.0]]])
    points = spark.createDataFrame([*((i, float(x), float(y)) for i, (x, y) in enumerate(asked)), (99, None, 1.0)], "p int, x double, y double")
    got = {r.p: (r.flat_index, r.distance) for r in quadtree.nearest(points, cells, "p", geographic=geographic, leaf=8).collect()}
    assert len(got) == len(asked)
    for i, (x, y) in enumerate(asked):
        d = np.sqrt(((at[:, 0] - x) * (np.cos(np.radians(y)) if geographic else 1)) ** 2 + (at[:, 1] - y) ** 2) * (111.32 if geographic else 1)
        assert abs(got[i][1] - d.min()) <= 1e-9 * max(1, d.min()) and abs(d[got[i][0]] - d.min()) <= 1e-9 * max(1, d.min())
    assert got[80][0] == 1700  # of ten at one place the smallest
    assert quadtree.nearest(points, cells.limit(0), "p").count() == 0


def test_polygons_with_holes_and_parts(spark, skewed):
    _, _ = skewed
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    zones = spark.createDataFrame([("a", [square(0.0, 0.0, 4.0), square(1.0, 1.0, 2.0)]), ("b", [square(6.0, 0.0, 1.0), square(8.0, 0.0, 2.0)]), ("none", [])], "zone string, rings array<array<struct<x:double,y:double>>>")
    cells = spark.createDataFrame([(10 * i + j, i + 0.5, j + 0.5) for i in range(10) for j in range(10)], "flat_index int, x double, y double")
    got = {r.flat_index: r.zone for r in spatial.cells_in_polygons(cells, zones, "zone").collect()}
    want = {}
    for i in range(10):
        for j in range(10):
            if i < 4 and j < 4 and not (1 <= i < 3 and 1 <= j < 3):
                want[10 * i + j] = "a"
            elif i == 6 and j == 0 or i in (8, 9) and j < 2:
                want[10 * i + j] = "b"
    assert got == want
    shared = {(r.flat_index, r.zone): round(r.fraction, 9) for r in spatial.overlap(cells.withColumn("x", F.col("x") + 0.5), zones, "zone", 1.0, 1.0).collect()}
    assert shared[0, "a"] == 1.0 and shared[1, "a"] == 0.5 and shared[21, "a"] == 0.5 and (11, "a") not in shared and shared[30, "a"] == 0.5 and shared[50, "b"] == 0.5


def test_border_counts_only_if_nothing_lies_within(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    zones = spark.createDataFrame([("a", ring)], "zone string, ring array<struct<x:double,y:double>>")
    border = spark.createDataFrame([(0, 0.0, 0.5), (1, 1.0, 1.0), (2, 2.0, 2.0)], "flat_index int, x double, y double")
    assert {r.flat_index for r in spatial.cells_in_polygons(border, zones, "zone").collect()} == {0, 1}
    assert spatial.cells_in_polygons(border, zones, "zone", retry=False).count() == 0
    some = border.unionByName(spark.createDataFrame([(3, 0.5, 0.5)], border.schema))
    assert {r.flat_index for r in spatial.cells_in_polygons(some, zones, "zone").collect()} == {3}


def test_a_query_meets_leaves_not_cells(spark):
    """a row a leaf; deepest squares with many cells, and many cells at one place, count whole."""
    rng = np.random.default_rng(8)
    at = np.concatenate([rng.random((300, 2)), np.full((200, 2), 0.25), [[1e9, 0.0]]])  # all but one in one deepest square
    cells = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "flat_index int, x double, y double")
    asked = np.concatenate([rng.random((20, 2)), [[0.25, 0.25], [9e8, 1.0]]])
    near = quadtree.nearest(spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(asked)], "p int, x double, y double"), cells, "p", leaf=16)
    assert "_cells" in near._jdf.queryExecution().optimizedPlan().toString()
    got = {r.p: r.flat_index for r in near.collect()}
    assert got == {i: int(np.argmin(((at - q) ** 2).sum(1))) for i, q in enumerate(asked)}
