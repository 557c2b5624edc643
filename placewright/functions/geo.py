"""Coordinates as Column expressions: frames, distances, tiles and polygons."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS 84 ellipsoid, UTM zone 51N, and the constants of the GCJ-02 and BD-09 frames.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
UTM_SCALE, UTM_EAST, UTM_MERIDIAN = 0.9996, 500000.0, 123.0
GCJ_A, GCJ_EE = 6378245.0, 0.006693421622965943
GCJ_BOX = (72.004, 137.8347, 0.8293, 55.8271)
# Earth radii of the distance methods, in metres.
MEAN_RADIUS, ROUND_RADIUS = 6371008.8, 6371000.0
PLANAR_METRES, PLANAR_LATITUDE = 111320.0, 31.23


def _krueger() -> tuple[float, list[float], list[float], list[float]]:
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    return radius, alpha, beta, delta


RADIUS, ALPHA, BETA, DELTA = _krueger()


def round6(c: Column) -> Column:
    return F.round(c, 6)


def utm_to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    """(longitude, latitude) to six places from metres of UTM zone 51N, by Krüger's series."""
    xi, eta = y / (UTM_SCALE * RADIUS), (x - UTM_EAST) / (UTM_SCALE * RADIUS)
    xi_, eta_ = xi, eta
    for j, b in enumerate(BETA, 1):
        xi_ = xi_ - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta_ = eta_ - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi_) / F.cosh(eta_))
    latitude = chi
    for j, d in enumerate(DELTA, 1):
        latitude = latitude + d * F.sin(2 * j * chi)
    return round6(UTM_MERIDIAN + F.degrees(F.atan2(F.sinh(eta_), F.cos(xi_)))), round6(F.degrees(latitude))


def wgs84_to_utm(longitude: Column, latitude: Column) -> tuple[Column, Column]:
    """Metres of UTM zone 51N; null where the position is none."""
    n = WGS84_F / (2 - WGS84_F)
    k = 2 * math.sqrt(n) / (1 + n)
    phi, east = F.radians(latitude), F.radians(longitude - UTM_MERIDIAN)
    t = F.sinh(F.atanh(F.sin(phi)) - k * F.atanh(k * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(east)), F.atanh(F.sin(east) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    valid = (F.abs(longitude) <= 180) & (F.abs(latitude) <= 90) & ~F.isnan(longitude) & ~F.isnan(latitude)
    return F.when(valid, UTM_EAST + UTM_SCALE * RADIUS * x), F.when(valid, UTM_SCALE * RADIUS * y)


def _waves(x: Column, periods: list[tuple[float, float]]) -> Column:
    total = F.lit(0.0)
    for height, wave in periods:
        total = total + height * F.sin(x * (math.pi / wave))
    return total * 2 / 3


def wgs84_to_gcj02(longitude: Column, latitude: Column) -> tuple[Column, Column]:
    """GCJ-02 to six places; positions outside China's box stay as they are."""
    x, y = longitude - 105, latitude - 35
    # The frame's polynomial and wave heights.
    d_lat = -100 + 2 * x + 3 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * F.sqrt(F.abs(x)) + _waves(x, [(20, 1 / 6), (20, 1 / 2)]) + _waves(y, [(20, 1), (40, 3)]) + _waves(y, [(160, 12), (320, 30)])
    d_lon = 300 + x + 2 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * F.sqrt(F.abs(x)) + _waves(x, [(20, 1 / 6), (20, 1 / 2)]) + _waves(x, [(20, 1), (40, 3)]) + _waves(x, [(150, 12), (300, 30)])
    radians = F.radians(latitude)
    flat = 1 - GCJ_EE * F.sin(radians) * F.sin(radians)
    lat = latitude + d_lat * 180 / (GCJ_A * (1 - GCJ_EE) / (flat * F.sqrt(flat)) * math.pi)
    lon = longitude + d_lon * 180 / (GCJ_A / F.sqrt(flat) * F.cos(radians) * math.pi)
    inside = longitude.between(*GCJ_BOX[:2]) & latitude.between(*GCJ_BOX[2:])
    return round6(F.when(inside, lon).otherwise(longitude)), round6(F.when(inside, lat).otherwise(latitude))


def bd09_to_gcj02(longitude: Column, latitude: Column) -> tuple[Column, Column]:
    x, y, wave = longitude - 0.0065, latitude - 0.006, math.pi * 3000 / 180
    radius = F.sqrt(x * x + y * y) - 0.00002 * F.sin(y * wave)
    angle = F.atan2(y, x) - 0.000003 * F.cos(x * wave)
    return round6(radius * F.cos(angle)), round6(radius * F.sin(angle))


def gcj02_to_wgs84(longitude: Column, latitude: Column, steps: int = 12) -> tuple[Column, Column]:
    """The inverse by fixed-point steps until both differences are within a millionth of a degree."""
    start = F.struct(longitude.cast("double").alias("lon"), latitude.cast("double").alias("lat"), F.lit(False).alias("done"))

    def step(at: Column, _: Column) -> Column:
        lon, lat = wgs84_to_gcj02(at["lon"], at["lat"])
        dx, dy = lon - longitude, lat - latitude
        moved = F.struct((at["lon"] - dx).alias("lon"), (at["lat"] - dy).alias("lat"), (F.greatest(F.abs(dx), F.abs(dy)) <= 1e-6).alias("done"))
        return F.when(at["done"], at).otherwise(moved)

    found = F.reduce(F.sequence(F.lit(1), F.lit(steps)), start, step)
    return round6(found["lon"]), round6(found["lat"])


def bd09_to_wgs84(longitude: Column, latitude: Column) -> tuple[Column, Column]:
    return gcj02_to_wgs84(*bd09_to_gcj02(longitude, latitude))


def is_geographic(x: Column, y: Column) -> Column:
    return (F.abs(x) <= 180) & (F.abs(y) <= 90)


def to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees from degrees or from metres of UTM zone 51N, told apart by their size."""
    lon, lat = utm_to_wgs84(x, y)
    return F.when(is_geographic(x, y), x).otherwise(lon), F.when(is_geographic(x, y), y).otherwise(lat)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = MEAN_RADIUS) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(a.isNotNull(), 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a))))  # least() passes over nulls


def equirectangular(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = ROUND_RADIUS) -> Column:
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return radius * F.sqrt(x * x + F.pow(F.radians(lat2 - lat1), 2))


def planar(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    x = (lon2 - lon1) * (PLANAR_METRES * math.cos(math.radians(PLANAR_LATITUDE)))
    return F.sqrt(x * x + F.pow((lat2 - lat1) * PLANAR_METRES, 2))


def distance(method: str, *at: Column) -> Column:
    """The four methods stay apart, as their results differ: ``haversine``, ``haversine_round``, ``equirectangular``, ``planar``."""
    return {"haversine": haversine, "haversine_round": lambda *a: haversine(*a, radius=ROUND_RADIUS), "equirectangular": equirectangular, "planar": planar}[method](*at)


def segment_distance2(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance from a point to a segment, which may be a single point."""
    dx, dy = x2 - x1, y2 - y1
    long2 = dx * dx + dy * dy
    t = F.when(long2 == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / F.nullif(long2, F.lit(0.0)))))
    return F.pow(px - (x1 + t * dx), 2) + F.pow(py - (y1 + t * dy), 2)


def crosses(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a ray to the right of the point crosses an edge."""
    return ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)


def in_rings(px: Column, py: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Even-odd rule over the edges of all rings of a literal polygon, so holes are outside."""
    inside = F.lit(False)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if y1 != y2:
                inside = inside != crosses(px, py, F.lit(float(x1)), F.lit(float(y1)), F.lit(float(x2)), F.lit(float(y2)))
    return inside


def tile(longitude: Column, latitude: Column, zoom: int) -> tuple[Column, Column]:
    n = 1 << zoom
    return F.floor((longitude + 180) / 360 * n).cast("int"), F.floor((1 - F.asinh(F.tan(F.radians(latitude))) / math.pi) / 2 * n).cast("int")


def ring_area_ha(ring: Column) -> Column:
    """Hectares of a ring of structs (x, y) in metres, by the shoelace formula."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(ring)), lambda i: F.get(ring, i - 1)["x"] * F.get(ring, F.pmod(i, F.size(ring)))["y"] - F.get(ring, F.pmod(i, F.size(ring)))["x"] * F.get(ring, i - 1)["y"])
    return F.abs(F.reduce(pairs, F.lit(0.0), lambda a, b: a + b)) / 20000
