"""Map projections as column expressions: degrees to metres and back, on an ellipsoid.

Transverse Mercator by the series in the third flattening (to the fourth order), Albers' equal-area conic by its closed form
and the series of the authalic latitude. Both come back within a millionth of a degree where they are used (Mercator within some 30 degrees
of its meridian)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Semi-major axis in metres and inverse flattening.
ELLIPSOIDS = {"WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101), "CLARKE1866": (6378206.4, 294.978698214)}


@dataclass(frozen=True)
class TransverseMercator:
    lon0: float
    lat0: float = 0.0
    scale: float = 0.9996
    east: float = 500_000.0
    north: float = 0.0
    ellipsoid: str = "WGS84"

    def _series(self) -> tuple[float, float, list[float], list[float], list[float]]:
        a, f = ELLIPSOIDS[self.ellipsoid]
        n = 1 / (2 * f - 1)
        radius = self.scale * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        ahead = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
        back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
        latitude = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
        return n, radius, ahead, back, latitude

    def _start(self) -> float:
        """The distance of lat0 from the equator."""
        n, radius, ahead, *_ = self._series()
        e, s = 2 * math.sqrt(n) / (1 + n), math.sin(math.radians(self.lat0))
        xi = math.atan(math.sinh(math.atanh(s) - e * math.atanh(e * s)))
        return radius * (xi + sum(c * math.sin(2 * (j + 1) * xi) for j, c in enumerate(ahead)))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        n, radius, ahead, *_ = self._series()
        e, s, d = 2 * math.sqrt(n) / (1 + n), F.sin(F.radians(lat)), F.radians(lon - self.lon0)
        t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
        xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
        x = eta + sum((c * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, c in enumerate(ahead)), F.lit(0.0))
        y = xi + sum((c * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, c in enumerate(ahead)), F.lit(0.0))
        return radius * x + self.east, radius * y - self._start() + self.north

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        _, radius, _, back, latitude = self._series()
        xi, eta = (y - self.north + self._start()) / radius, (x - self.east) / radius
        xi2 = xi - sum((c * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, c in enumerate(back)), F.lit(0.0))
        eta2 = eta - sum((c * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, c in enumerate(back)), F.lit(0.0))
        chi = F.asin(F.sin(xi2) / F.cosh(eta2))
        lat = chi + sum((c * F.sin(2 * (j + 1) * chi) for j, c in enumerate(latitude)), F.lit(0.0))
        return self.lon0 + F.degrees(F.atan2(F.sinh(eta2), F.cos(xi2))), F.degrees(lat)


@dataclass(frozen=True)
class Albers:
    """Standard parallels lat1 and lat2, origin lon0 and lat0; the defaults are those of the conterminous United States."""

    lat1: float = 29.5
    lat2: float = 45.5
    lon0: float = -96.0
    lat0: float = 23.0
    east: float = 0.0
    north: float = 0.0
    ellipsoid: str = "GRS80"

    def _constants(self) -> tuple[float, float, float, float, float, float]:
        a, f = ELLIPSOIDS[self.ellipsoid]
        e2 = (2 - 1 / f) / f
        e = math.sqrt(e2)

        def q(lat: float) -> float:
            s = math.sin(math.radians(lat))
            return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

        m2 = lambda lat: math.cos(math.radians(lat)) ** 2 / (1 - e2 * math.sin(math.radians(lat)) ** 2)
        n = (m2(self.lat1) - m2(self.lat2)) / (q(self.lat2) - q(self.lat1)) if self.lat1 != self.lat2 else math.sin(math.radians(self.lat1))
        c = m2(self.lat1) + n * q(self.lat1)
        return a, e, n, c, a * math.sqrt(c - n * q(self.lat0)) / n, q(90.0)

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        a, e, n, c, rho0, _ = self._constants()
        s = F.sin(F.radians(lat))
        q = (1 - e * e) * (s / (1 - e * e * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
        rho, theta = a * F.sqrt(c - n * q) / n, n * F.radians(lon - self.lon0)
        return rho * F.sin(theta) + self.east, rho0 - rho * F.cos(theta) + self.north

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        a, e, n, c, rho0, pole = self._constants()
        dx, dy, sign = x - self.east, rho0 - (y - self.north), math.copysign(1.0, n)
        beta = F.asin(F.greatest(F.least((c - (dx * dx + dy * dy) * n * n / (a * a)) / n / pole, F.lit(1.0)), F.lit(-1.0)))
        lat = beta + (e**2 / 3 + 31 * e**4 / 180 + 517 * e**6 / 5040) * F.sin(2 * beta) + (23 * e**4 / 360 + 251 * e**6 / 3780) * F.sin(4 * beta) + 761 * e**6 / 45360 * F.sin(6 * beta)
        return self.lon0 + F.degrees(F.atan2(sign * dx, sign * dy) / n), F.degrees(lat)


def utm(zone: int, south: bool = False) -> TransverseMercator:
    return TransverseMercator(6.0 * zone - 183.0, north=10_000_000.0 if south else 0.0)


def reproject(rings: Column | str, source=None, target=None) -> Column:
    """Arrays of arrays of points (structs x, y) from a source's metres, or degrees without one, to a target's, or degrees."""
    def move(p: Column) -> Column:
        x, y = p["x"], p["y"]
        if source is not None:
            x, y = source.inverse(x, y)
        if target is not None:
            x, y = target.forward(x, y)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(F.col(rings) if isinstance(rings, str) else rings, lambda ring: F.transform(ring, move))
