"""Geometry as column expressions: projection, pixels, polygons, distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.hydrology import Value, col

#: WGS84 semi-major axis and flattening; scale on the central meridian and false origins of UTM (fixed values).
A, FLATTENING, K0, EASTING, NORTHING_SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_N = FLATTENING / (2 - FLATTENING)
_RECTIFYING = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Krueger series to the fourth order: forward and inverse.
_ALPHA = (
    _N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3 + 41 / 180 * _N**4, 13 / 48 * _N**2 - 3 / 5 * _N**3 + 557 / 1440 * _N**4, 61 / 240 * _N**3 - 103 / 140 * _N**4, 49561 / 161280 * _N**4,
)
_BETA = (
    _N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3 - 1 / 360 * _N**4, 1 / 48 * _N**2 + 1 / 15 * _N**3 - 437 / 1440 * _N**4, 17 / 480 * _N**3 - 37 / 840 * _N**4, 4397 / 161280 * _N**4,
)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))


def utm_zone(epsg: int) -> tuple[int, bool]:
    """Zone number and whether it is south, of EPSG 326xx and 327xx."""
    if not (32601 <= epsg <= 32660 or 32701 <= epsg <= 32760):
        raise ValueError(f"EPSG:{epsg} is not a WGS84 UTM zone")
    return epsg % 100, epsg >= 32700


def _atanh(x: Column) -> Column:
    return 0.5 * F.ln((1 + x) / (1 - x))


def to_utm(lon: Value, lat: Value, epsg: int) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    zone, south = utm_zone(epsg)
    phi, lam = F.radians(col(lat)), F.radians(col(lon) - F.lit(float(zone * 6 - 183)))
    s = F.sin(phi)
    t = F.sinh(_atanh(s) - _E * _atanh(_E * s))
    xi, eta = F.atan2(t, F.cos(lam)), _atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EASTING + K0 * _RECTIFYING * x, (NORTHING_SOUTH if south else 0.0) + K0 * _RECTIFYING * y


def from_utm(x: Value, y: Value, epsg: int) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    zone, south = utm_zone(epsg)
    xi, eta = (col(y) - (NORTHING_SOUTH if south else 0.0)) / (K0 * _RECTIFYING), (col(x) - EASTING) / (K0 * _RECTIFYING)
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    # conformal to geodetic latitude, to the fourth order of n
    phi = chi
    for j, d in enumerate((2 * _N - 2 / 3 * _N**2 - 2 * _N**3 + 116 / 45 * _N**4, 7 / 3 * _N**2 - 8 / 5 * _N**3 - 227 / 45 * _N**4, 56 / 15 * _N**3 - 136 / 35 * _N**4, 4279 / 630 * _N**4), 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(v), F.cos(u))) + float(zone * 6 - 183), F.degrees(phi)


def pixel(x: Value, y: Value, a: Value, c: Value, e: Value, f: Value, rounding: str = "floor") -> tuple[Column, Column]:
    """(row, col) of a world point on a north-up grid of pixel sizes a, e and origin c, f; ``rounding`` floor or nearest."""
    across, down = (col(x) - col(c)) / col(a), (col(y) - col(f)) / col(e)
    whole = {"floor": F.floor, "nearest": F.bround}[rounding]
    return whole(down).cast("int"), whole(across).cast("int")


def centre(row: Column, column: Column, a: Value, c: Value, e: Value, f: Value) -> tuple[Column, Column]:
    """World point of a cell's centre."""
    return col(c) + (column + 0.5) * col(a), col(f) + (row + 0.5) * col(e)


def pixel_area(a: Value, e: Value, epsg: Column) -> Column:
    """Area of a cell in m2; raises on a geographic system."""
    return F.when(epsg == 4326, F.raise_error(F.lit("a geographic grid has no pixel area")).cast("double")).otherwise(F.abs(col(a) * col(e)))


def in_ring(x: Value, y: Value, ring: Column) -> Column:
    """Even-odd test of a point against a closed or open ring of structs (x, y)."""
    x, y = col(x), col(y)
    n = F.size(ring)
    ends = F.zip_with(ring, F.concat(F.slice(ring, 2, n), F.slice(ring, 1, 1)), lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))

    def crosses(s: Column) -> Column:
        spans = (s["y1"] > y) != (s["y2"] > y)
        at = (s["x2"] - s["x1"]) * (y - s["y1"]) / F.when(spans, s["y2"] - s["y1"]) + s["x1"]
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(ends, F.lit(0), lambda total, s: total + crosses(s)) % 2 == 1


def segment_distance(x: Value, y: Value, x1: Value, y1: Value, x2: Value, y2: Value) -> Column:
    """Distance of a point from a segment."""
    x, y, x1, y1, x2, y2 = map(col, (x, y, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.least(F.greatest(((x - x1) * dx + (y - y1) * dy) / F.when(length > 0, length), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    px, py = x - (x1 + t * dx), y - (y1 + t * dy)
    return F.sqrt(px * px + py * py)


def distance(x1: Value, y1: Value, x2: Value, y2: Value) -> Column:
    dx, dy = col(x1) - col(x2), col(y1) - col(y2)
    return F.sqrt(dx * dx + dy * dy)


def tile_name(lat: Value, lon: Value, degrees: int = 3) -> Column:
    """Name of the tile of that many degrees, after its south-west corner."""
    south, west = (F.floor(col(v) / degrees) * degrees for v in (lat, lon))
    return F.format_string("%s%02d%s%03d", F.when(south < 0, "S").otherwise("N"), F.abs(south), F.when(west < 0, "W").otherwise("E"), F.abs(west))
