"""Geometries as bytes: well-known binary (WKB, also with Z, M and SRID) and GeoPackage blobs, decoded in Arrow batches.

A geometry becomes struct(kind, srid, rings): rings are arrays of points (x, y): the lines of a line geometry, all rings of a polygon or of several
(a point is inside if it lies in an odd number of them), a ring of one point for each point. Closing points of rings are dropped. Null, empty and
unreadable bytes give NULL.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of geometries by number; bytes of a GeoPackage envelope by its code.
KINDS = {1: "point", 2: "line", 3: "polygon", 4: "points", 5: "lines", 6: "polygons", 7: "collection"}
ENVELOPES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
GEOMETRY = "struct<kind:string,srid:int,rings:array<array<struct<x:double,y:double>>>>"


def _read(data: bytes, at: int, rings: list) -> tuple[int, int, int | None]:
    """Append the rings of the geometry at a place: (where it ends, its kind, its SRID)."""
    order = "<" if data[at] else ">"
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    at += 5
    srid = None
    if code & 0x20000000:  # an SRID follows
        srid, at = struct.unpack_from(order + "i", data, at)[0], at + 4
    kind, more = (code & 0x0FFFFFFF) % 1000, (code & 0x0FFFFFFF) // 1000
    width = 2 + (bool(code & 0x80000000) or more in (1, 3)) + (bool(code & 0x40000000) or more in (2, 3))

    def points(n: int, at: int) -> list[dict]:
        v = struct.unpack_from(f"{order}{n * width}d", data, at)
        return [{"x": v[k], "y": v[k + 1]} for k in range(0, n * width, width)]

    if kind == 1:
        p = points(1, at)
        if p[0]["x"] == p[0]["x"]:  # an empty point has NaN
            rings.append(p)
        return at + 8 * width, kind, srid
    n = struct.unpack_from(order + "I", data, at)[0]
    at += 4
    if n > (len(data) - at):
        raise ValueError("more parts than bytes")
    if kind == 2:
        rings.append(points(n, at))
        return at + 8 * width * n, kind, srid
    if kind == 3:
        for _ in range(n):
            m = struct.unpack_from(order + "I", data, at)[0]
            ring = points(m, at + 4)
            rings.append(ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring)
            at += 4 + 8 * width * m
        return at, kind, srid
    if kind not in KINDS:
        raise ValueError(f"kind {kind} isn't known")
    for _ in range(n):
        at, _, _ = _read(data, at, rings)
    return at, kind, srid


def decode(data: bytes | None) -> dict | None:
    if not data:
        return None
    try:
        at, srid = 0, None
        if data[:2] == b"GP":
            flags = data[3]
            srid = struct.unpack_from(("<" if flags & 1 else ">") + "i", data, 4)[0]
            if flags & 0x10:
                return {"kind": "empty", "srid": srid, "rings": []}
            at = 8 + ENVELOPES[flags >> 1 & 7]
        rings: list = []
        _, kind, own = _read(data, at, rings)
        return {"kind": KINDS[kind], "srid": own if own is not None else srid, "rings": rings}
    except (struct.error, IndexError, KeyError, ValueError):
        return None


def encode(kind: str, rings: list[list[tuple[float, float]]], srid: int | None = None) -> bytes:
    """WKB of a point, line, lines or polygon; with an SRID, as a GeoPackage blob without an envelope."""
    number = {v: k for k, v in KINDS.items()}[kind]
    flat = lambda points: b"".join(struct.pack("<2d", *p) for p in points)
    closed = lambda r: [*r, r[0]] if r and r[0] != r[-1] else r
    body = struct.pack("<BI", 1, number)
    if kind == "point":
        body += flat(rings[0])
    elif kind == "line":
        body += struct.pack("<I", len(rings[0])) + flat(rings[0])
    elif kind == "lines":
        body += struct.pack("<I", len(rings)) + b"".join(encode("line", [r]) for r in rings)
    elif kind == "polygon":
        body += struct.pack("<I", len(rings)) + b"".join(struct.pack("<I", len(closed(r))) + flat(closed(r)) for r in rings)
    elif kind == "polygons":  # each ring a polygon
        body += struct.pack("<I", len(rings)) + b"".join(encode("polygon", [r]) for r in rings)
    else:
        raise ValueError(f"{kind} isn't written")
    return body if srid is None else b"GP\x00\x01" + struct.pack("<i", srid) + body


def decoded(c: Column | str) -> Column:
    """A column of bytes as geometries."""

    def run(data: pd.Series) -> pd.DataFrame:
        found = [decode(bytes(b) if b is not None else None) for b in data]
        return pd.DataFrame({k: [None if g is None else g[k] for g in found] for k in ("kind", "srid", "rings")})

    return F.pandas_udf(run, GEOMETRY)(c)


def encoded(kind: Column | str, rings: Column | str, srid: Column | str) -> Column:
    """Geometries as GeoPackage blobs (WKB where srid is null)."""

    def run(kind: pd.Series, rings: pd.Series, srid: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else encode(k, [[(p["x"], p["y"]) for p in ring] for ring in r], None if s is None or s != s else int(s)) for k, r, s in zip(kind, rings, srid)])

    return F.pandas_udf(run, "binary")(kind, rings, srid)
