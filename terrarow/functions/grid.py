"""Tile grid, pixel and map coordinates, and projections, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the survey grid.
X0, Y0, TILE_M, TILE_PX, GSD = 628992.0, 5221222.4, 51.2, 2048, 0.025


def tile_row(name: Column) -> Column:
    """The number after the first r in r<digits>_c<digits>; null if the name has no tile part."""
    return F.nullif(F.regexp_extract(name, r"r(\d+)_c(\d+)", 1), F.lit("")).cast("int")


def tile_col(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"r(\d+)_c(\d+)", 2), F.lit("")).cast("int")


def strict_tile_name(name: Column, prefix: str) -> Column:
    """Whether the whole name is prefix_r<digits>_c<digits>.tif or .tiff, in any case."""
    return name.rlike(rf"(?i)^{prefix}_r\d+_c\d+\.tiff?$")


def image_keys(path: Column, prefix: str) -> Column:
    """Lower-case lookup keys of an image: its base name and its trailing tile name."""
    base = F.lower(F.regexp_extract(path, r"[^/\\]*$", 0))
    tile = F.nullif(F.regexp_extract(base, rf"{prefix}_r\d+_c\d+\.tiff?$", 0), F.lit(""))
    return F.array_compact(F.array_distinct(F.array(base, tile)))


def tile_x(c: Column) -> Column:
    return F.round(F.lit(X0) + c * TILE_M, 4)


def tile_y(r: Column) -> Column:
    return F.round(F.lit(Y0) - r * TILE_M, 4)


def map_x(c: Column, px: Column) -> Column:
    return F.round(F.lit(X0) + c * TILE_M + px * GSD, 4)


def map_y(r: Column, py: Column) -> Column:
    return F.round(F.lit(Y0) - r * TILE_M - py * GSD, 4)


def pixel_x(c: Column, x: Column) -> Column:
    return F.round((x - (F.lit(X0) + c * TILE_M)) / GSD, 2)


def pixel_y(r: Column, y: Column) -> Column:
    return F.round((F.lit(Y0) - r * TILE_M - y) / GSD, 2)


def tile_of_x(x: Column) -> Column:
    """Tile column by floor division."""
    return F.floor((x - X0) / TILE_M).cast("int")


def tile_of_y(y: Column) -> Column:
    return F.floor((F.lit(Y0) - y) / TILE_M).cast("int")


def clamp_pixel(v: Column) -> Column:
    """Within the tile, one decimal place."""
    return F.round(F.least(F.greatest(v, F.lit(0.0)), F.lit(float(TILE_PX))), 1)


def affine(px: Column, py: Column, t: tuple[Column, ...]) -> tuple[Column, Column]:
    """The six-number affine transform of a pixel."""
    a, b, c, d, e, f = t
    return a * px + b * py + c, d * px + e * py + f


def undirected_angle(dx: Column, dy: Column) -> Column:
    """Degrees in [0, 180)."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))


def angle_gap(a: Column, b: Column) -> Column:
    """Distance of undirected angles in degrees."""
    d = F.abs(a - b) % 180
    return F.least(d, F.lit(180) - d)


def mean_axis(angle_deg: Column, weight: Column) -> Column:
    """Aggregate: weighted mean of undirected angles by doubling them, in degrees [0, 180)."""
    double = F.radians(angle_deg * 2)
    return F.pmod(F.degrees(F.atan2(F.sum(weight * F.sin(double)), F.sum(weight * F.cos(double)))) / 2, F.lit(180.0))


_A, _F, _K0, _E0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def utm_from_lonlat(lon: Column, lat: Column, zone: int = 35) -> tuple[Column, Column]:
    """Easting and northing (north) by the third-order series of the transverse Mercator projection."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = 2 * math.sqrt(_N) / (1 + _N)
    sin = F.sin(phi)
    t = F.sinh(F.atanh(sin) - s * F.atanh(s * sin))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    e, n = eta, xi
    for j, a in enumerate(_FORWARD, 1):
        e = e + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        n = n + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _E0 + _K0 * _RADIUS * e, _K0 * _RADIUS * n


def lonlat_from_utm(e: Column, n: Column, zone: int = 35) -> tuple[Column, Column]:
    xi, eta = n / (_K0 * _RADIUS), (e - _E0) / (_K0 * _RADIUS)
    x, h = xi, eta
    for j, b in enumerate(_BACK, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        h = h - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(h))
    lat = chi
    for j, d in enumerate(_LATITUDE, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(h), F.cos(x))), F.degrees(lat)


_HALF_WORLD = math.pi * _A


def mercator_resolution(z: Column) -> Column:
    """Metres per pixel of a 256-pixel tile at zoom z."""
    return F.lit(2 * _HALF_WORLD / 256) / F.pow(F.lit(2.0), z)


def mercator_bounds(z: Column, x: Column, y: Column) -> tuple[Column, ...]:
    """xmin, ymin, xmax, ymax of a web tile."""
    size = F.lit(2 * _HALF_WORLD) / F.pow(F.lit(2.0), z)
    return x * size - _HALF_WORLD, _HALF_WORLD - (y + 1) * size, (x + 1) * size - _HALF_WORLD, _HALF_WORLD - y * size


def valid_tile(z: Column, x: Column, y: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    return z.between(0, 24) & (x >= 0) & (y >= 0) & (x < n) & (y < n)


def zoom_for(resolution: Column, margin: int = 0) -> Column:
    """The zoom whose resolution is nearest from above, plus margin, within 0..24."""
    return F.least(F.greatest(F.ceil(F.log2(F.lit(2 * _HALF_WORLD / 256) / resolution)).cast("int") + margin, F.lit(0)), F.lit(24))
