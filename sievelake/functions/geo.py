"""Distances and grid cells of points in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.7714

#: Fixed alphabet of geohashes.
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def distance_m(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Great-circle distance to a point."""
    a, b = F.radians(lat), F.radians(F.lit(lat0))
    h = F.pow(F.sin((a - b) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon - F.lit(lon0)) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def geotile(lat: Column, lon: Column, zoom: int) -> Column:
    """``zoom/x/y`` of the web-mercator tile."""
    n = 1 << zoom
    x = F.floor((lon + 180) / 360 * n)
    s = F.sin(F.radians(F.greatest(F.least(lat, F.lit(85.05112878)), F.lit(-85.05112878))))
    y = F.floor((F.lit(0.5) - F.log((F.lit(1.0) + s) / (F.lit(1.0) - s)) / F.lit(12.566370614359172)) * n)
    bound = lambda v: F.greatest(F.least(v, F.lit(n - 1)), F.lit(0)).cast("string")
    return F.concat_ws("/", F.lit(str(zoom)), bound(x), bound(y))


def geohash(lat: Column, lon: Column, precision: int) -> Column:
    """Geohash of ``precision`` characters, 1 to 12."""
    bits = 5 * precision
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180) / 360 * (1 << lon_bits)), F.lit((1 << lon_bits) - 1)).cast("long")
    y = F.least(F.floor((lat + 90) / 180 * (1 << lat_bits)), F.lit((1 << lat_bits) - 1)).cast("long")

    def bit(i: int) -> Column:  # from the left; even ones are of the longitude
        of, width = (x, lon_bits) if i % 2 == 0 else (y, lat_bits)
        return F.shiftright(of, width - 1 - i // 2).bitwiseAND(F.lit(1))

    letters = []
    for c in range(precision):
        value = sum((bit(5 * c + i) * (16 >> i) for i in range(5)), F.lit(0).cast("long"))
        letters.append(F.substring(F.lit(GEOHASH_ALPHABET), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)
