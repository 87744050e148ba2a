"""Geometries as bytes and projections, against published values."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from fluvial.functions import projections
from fluvial.sources import geometry


def test_published_projections(spark):
    """The worked examples of Snyder's manual (1987), on Clarke's ellipsoid."""
    d = spark.createDataFrame([(-75.0, 35.0, -73.5, 40.5)], "a double, b double, c double, d double")
    albers = projections.Albers(29.5, 45.5, -96.0, 23.0, ellipsoid="CLARKE1866")
    mercator = projections.TransverseMercator(-75.0, east=0.0, ellipsoid="CLARKE1866")
    r = d.select(*albers.forward(F.col("a"), F.col("b")), *mercator.forward(F.col("c"), F.col("d"))).first()
    assert all(abs(x - y) < 0.06 for x, y in zip(r, (1885472.7, 1535925.0, 127106.5, 4484124.4)))


@pytest.mark.parametrize("projection", [projections.Albers(), projections.Albers(-20.0, -40.0, 130.0, -30.0), projections.utm(33), projections.utm(56, south=True), projections.TransverseMercator(10.0, 49.0, 1.0)])
def test_there_and_back(spark, projection):
    lat = -1 if projection.lat0 < 0 or getattr(projection, "north", 0) > 1e6 else 1
    rows = [(projection.lon0 + dx, lat * la) for dx in (-20.0, -3.0, 0.0, 0.1, 25.0) for la in (0.5, 10.0, 33.3, 60.0)]
    d = spark.createDataFrame(rows, "lon double, lat double")
    d = d.select("*", F.struct(*[c.alias(n) for c, n in zip(projection.forward(F.col("lon"), F.col("lat")), "xy")]).alias("p"))
    for r in d.select("lon", "lat", *projection.inverse(F.col("p.x"), F.col("p.y"))).collect():
        assert abs(r[0] - r[2]) < 1e-6 and abs(r[1] - r[3]) < 1e-6


def test_geometry_bytes():
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)]
    xy = lambda rings: [[{"x": x, "y": y} for x, y in r] for r in rings]
    for kind, rings in (("point", [[(1.5, -2.0)]]), ("line", [ring]), ("lines", [ring, hole]), ("polygon", [ring, hole]), ("polygons", [ring, hole])):
        assert geometry.decode(geometry.encode(kind, rings)) == {"kind": kind, "srid": None, "rings": xy(rings)}
        assert geometry.decode(geometry.encode(kind, rings, 5070)) == {"kind": kind, "srid": 5070, "rings": xy(rings)}
    big = struct.pack(">BIIddd", 0, 1002, 1, 7.0, 8.0, 9.0)  # a line with Z, high byte first
    assert geometry.decode(big) == {"kind": "line", "srid": None, "rings": xy([[(7.0, 8.0)]])}
    ewkb = struct.pack("<BIidd", 1, 1 | 0x20000000, 4326, 1.0, 2.0)
    assert geometry.decode(ewkb)["srid"] == 4326
    envelope = b"GP\x00\x03" + struct.pack("<i4d", 4326, 0, 1, 0, 1) + geometry.encode("point", [[(1.0, 2.0)]])
    assert geometry.decode(envelope) == {"kind": "point", "srid": 4326, "rings": xy([[(1.0, 2.0)]])}
    assert geometry.decode(b"GP\x00\x11" + struct.pack("<i", 1))["rings"] == []
    assert geometry.decode(struct.pack("<BIdd", 1, 1, math.nan, math.nan))["rings"] == []
    for bad in (None, b"", b"\x01", b"\x01\x02\x00\x00\x00\xff\xff\xff\xff", b"GP\x00\xef" + bytes(8), b"\x01\x63\x00\x00\x00\x01\x00\x00\x00"):
        assert geometry.decode(bad) is None


def test_geometry_columns(spark):
    d = spark.createDataFrame([(1, "polygon", [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]], 4326), (2, "line", None, None)], "id int, kind string, rings array<array<struct<x:double,y:double>>>, srid int")
    got = {r.id: r.g for r in d.select("id", geometry.decoded(geometry.encoded("kind", "rings", "srid")).alias("g")).collect()}
    assert got[1].kind == "polygon" and got[1].srid == 4326 and [tuple(p) for p in got[1].rings[0]] == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]
    assert got[2] is None or got[2].rings is None
