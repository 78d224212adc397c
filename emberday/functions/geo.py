"""Transverse Mercator projection as column arithmetic (Kruger series, 4th order).

Only one pair of systems is needed: geographic WGS84 degrees and the unified
Korean metric grid (GRS80 ellipsoid).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MercatorGrid:
    """Parameters of a transverse Mercator grid."""

    semi_major: float
    inverse_flattening: float
    lat0: float
    lon0: float
    scale: float
    false_easting: float
    false_northing: float

    @property
    def third_flattening(self) -> float:
        f = 1.0 / self.inverse_flattening
        return f / (2.0 - f)

    @property
    def rectifying_radius(self) -> float:
        n = self.third_flattening
        return self.semi_major / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    @property
    def conformal_factor(self) -> float:
        n = self.third_flattening
        return 2 * math.sqrt(n) / (1 + n)

    @property
    def alpha(self) -> tuple[float, ...]:
        n = self.third_flattening
        return (
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140,
            49561 * n**4 / 161280,
        )

    @property
    def beta(self) -> tuple[float, ...]:
        n = self.third_flattening
        return (
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840,
            4397 * n**4 / 161280,
        )

    @property
    def delta(self) -> tuple[float, ...]:
        n = self.third_flattening
        return (
            2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
            7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
            56 * n**3 / 15 - 136 * n**4 / 35,
            4279 * n**4 / 630,
        )

    @property
    def origin_arc(self) -> float:
        """Rectifying latitude of the grid origin, in units of the radius."""
        s = math.sin(math.radians(self.lat0))
        c = self.conformal_factor
        xi = math.atan(math.sinh(math.atanh(s) - c * math.atanh(c * s)))
        return xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(self.alpha, 1))


# GRS80 and the grid's published origin, scale and offsets.
METRIC_GRID = MercatorGrid(
    semi_major=6378137.0,
    inverse_flattening=298.257222101,
    lat0=38.0,
    lon0=127.5,
    scale=0.9996,
    false_easting=1_000_000.0,
    false_northing=2_000_000.0,
)


def project(lon: Column, lat: Column, grid: MercatorGrid = METRIC_GRID) -> Column:
    """Degrees to a struct of metres ``(x, y)``."""
    c = grid.conformal_factor
    sin_lat = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sin_lat) - F.lit(c) * F.atanh(F.lit(c) * sin_lat))
    d_lon = F.radians(lon - F.lit(grid.lon0))
    xi = F.atan2(t, F.cos(d_lon))
    eta = F.atanh(F.sin(d_lon) / F.sqrt(F.lit(1.0) + t * t))
    north, east = xi, eta
    for j, a in enumerate(grid.alpha, 1):
        k = F.lit(2.0 * j)
        north = north + F.lit(a) * F.sin(k * xi) * F.cosh(k * eta)
        east = east + F.lit(a) * F.cos(k * xi) * F.sinh(k * eta)
    radius = F.lit(grid.scale * grid.rectifying_radius)
    return F.struct(
        (F.lit(grid.false_easting) + radius * east).alias("x"),
        (F.lit(grid.false_northing) + radius * (north - F.lit(grid.origin_arc))).alias("y"),
    )


def unproject(x: Column, y: Column, grid: MercatorGrid = METRIC_GRID) -> Column:
    """Metres back to a struct of degrees ``(lon, lat)``."""
    radius = F.lit(grid.scale * grid.rectifying_radius)
    xi = (y - F.lit(grid.false_northing)) / radius + F.lit(grid.origin_arc)
    eta = (x - F.lit(grid.false_easting)) / radius
    xi1, eta1 = xi, eta
    for j, b in enumerate(grid.beta, 1):
        k = F.lit(2.0 * j)
        xi1 = xi1 - F.lit(b) * F.sin(k * xi) * F.cosh(k * eta)
        eta1 = eta1 - F.lit(b) * F.cos(k * xi) * F.sinh(k * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(grid.delta, 1):
        lat = lat + F.lit(d) * F.sin(F.lit(2.0 * j) * chi)
    lon = F.lit(grid.lon0) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))
    return F.struct(lon.alias("lon"), F.degrees(lat).alias("lat"))


def planar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)
