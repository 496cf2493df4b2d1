"""Geodesy as Column functions: positions are (lon, lat) in degrees, bearings clockwise from north."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EARTH_RADIUS_M, METRES_PER_DEGREE, REFUGE_BEARINGS, REFUGE_DISTANCE_M, WEDGE_STEPS


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half = lambda d: F.sin(F.radians(d) / 2)
    a = half(lat2 - lat1) * half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon2 - lon1) * half(lon2 - lon1)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(a))


def folded(lon: Column, lat: Column) -> tuple[Column, Column]:
    """The same place with a longitude from 0 to 360, counted from 180 degrees west, and a latitude of 90 degrees at most:
    latitudes beyond that go on over the pole, down the other side."""
    turned = F.pmod(lat + 90.0, F.lit(360.0)) - 90.0
    over = turned > 90.0
    return F.pmod(lon + F.when(over, 360.0).otherwise(180.0), F.lit(360.0)), F.when(over, 180.0 - turned).otherwise(turned)


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d))) + 360.0, F.lit(360.0))


def destination(lon: Column, lat: Column, bearing: Column, distance_m: Column) -> tuple[Column, Column]:
    """Equirectangular offset; longitudes stay put at the poles."""
    b, shrink = F.radians(bearing), F.cos(F.radians(lat))
    east = F.when(F.abs(shrink) < 1e-9, F.lit(0.0)).otherwise(distance_m * F.sin(b) / (METRES_PER_DEGREE * shrink))
    return lon + east, lat + distance_m * F.cos(b) / METRES_PER_DEGREE


def downwind(direction: Column) -> Column:
    """Wind directions say where it comes from."""
    return F.pmod(direction + 180.0, F.lit(360.0))


def angular_difference(a: Column, b: Column) -> Column:
    d = F.abs(F.pmod(a, F.lit(360.0)) - F.pmod(b, F.lit(360.0)))
    return F.least(d, 360.0 - d)


def circular_mean(x: Column, y: Column, first: Column) -> Column:
    """Mean bearing from weighted sums of sines and cosines; cancelling vectors give the first bearing."""
    flat = (F.abs(x) < 1e-12) & (F.abs(y) < 1e-12)
    return F.when(flat, F.pmod(first, F.lit(360.0))).otherwise(F.pmod(F.degrees(F.atan2(x, y)) + 360.0, F.lit(360.0)))


def close_ring(ring: Column) -> Column:
    return F.when((F.size(ring) == 0) | (F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1)), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def wedge_ring(lon: Column, lat: Column, bearing: Column, length_km: Column, half_angle: Column, steps: int = WEDGE_STEPS) -> Column:
    """Closed ring from the apex along an arc of equal distance; null unless the length and the angle (below 180) are positive."""

    def rim(i: Column) -> Column:
        x, y = destination(lon, lat, bearing - half_angle + 2 * half_angle * i / steps, length_km * 1000.0)
        return F.struct(x.alias("lon"), y.alias("lat"))

    apex = F.array(F.struct(lon.alias("lon"), lat.alias("lat")))
    return F.when((length_km > 0) & (half_angle > 0) & (half_angle < 180), F.concat(apex, F.transform(F.sequence(F.lit(0), F.lit(steps)), rim), apex))


def refuges(lon: Column, lat: Column, ring: Column, distance_m: float = REFUGE_DISTANCE_M, bearings: int = REFUGE_BEARINGS) -> Column:
    """Points around a place, as struct(bearing, lon, lat), that a hazard's ring does not cover."""

    def at(i: Column) -> Column:
        b = i * (360.0 / bearings)
        x, y = destination(lon, lat, b, F.lit(distance_m))
        return F.struct(b.alias("bearing"), x.alias("lon"), y.alias("lat"))

    every = F.transform(F.sequence(F.lit(0), F.lit(bearings - 1)), at)
    return F.when(ring.isNull(), every).otherwise(F.filter(every, lambda p: ~point_in_ring(p["lon"], p["lat"], ring)))


def geojson(ring: Column) -> Column:
    """A ring as the text of a GeoJSON polygon; null for null."""
    pairs = F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))
    return F.when(ring.isNotNull(), F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(pairs).alias("coordinates"))))


def point_in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd ray casting over an array of struct(lon, lat)."""
    ahead = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    crosses = lambda p, q: ((p["lat"] > lat) != (q["lat"] > lat)) & (lon < (q["lon"] - p["lon"]) * (lat - p["lat"]) / F.nullif(q["lat"] - p["lat"], F.lit(0.0)) + p["lon"])
    hits = F.aggregate(F.zip_with(ring, ahead, lambda p, q: F.coalesce(crosses(p, q), F.lit(False)).cast("int")), F.lit(0), lambda a, x: a + x)
    return hits % 2 == 1


def ring_area_km2(ring: Column) -> Column:
    """Shoelace area scaled at the mean latitude of the ring's points."""
    ahead = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    cross = F.aggregate(F.zip_with(ring, ahead, lambda p, q: p["lon"] * q["lat"] - q["lon"] * p["lat"]), F.lit(0.0), lambda a, x: a + x)
    mean = F.aggregate(ring, F.lit(0.0), lambda a, p: a + p["lat"]) / F.size(ring)
    return F.abs(cross) / 2 * (METRES_PER_DEGREE / 1000) * (METRES_PER_DEGREE / 1000) * F.cos(F.radians(mean))


def rounded(value: Column, digits: int) -> Column:
    """Halves go away from zero after the shift, as SQL engines over doubles round: 64.000025 is 6400002.499... there."""
    return F.round(value * 10.0**digits) / 10.0**digits


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def solar_hour(moment: Column, lon: Column) -> Column:
    return F.pmod(F.hour(moment) + F.minute(moment) / 60.0 + F.second(moment) / 3600.0 + lon / 15.0, F.lit(24.0))


def halfwidth_m(extent_km: Column) -> Column:
    return F.greatest(F.lit(2000.0), F.least(F.lit(10000.0), F.coalesce(extent_km, F.lit(0.0)) * 500.0 * 1.5))


def buffer_m(extent_km: Column, default: float = 1000.0) -> Column:
    return F.when(F.coalesce(extent_km, F.lit(0.0)) <= 0, F.lit(default)).otherwise(F.greatest(F.lit(500.0), F.least(F.lit(20000.0), extent_km * 750.0)))


def tile_name(lon: Column, lat: Column, degrees: int = 3) -> Column:
    """Name of the land-cover tile by its south-west corner, like N27E075."""
    south, west = (F.floor(lat / degrees) * degrees).cast("int"), (F.floor(lon / degrees) * degrees).cast("int")
    padded = lambda x, n: F.lpad(F.abs(x).cast("string"), F.greatest(F.length(F.abs(x).cast("string")), F.lit(n)), F.lit("0"))  # noqa: E731  lpad alone cuts longer ones
    return F.concat(F.when(south >= 0, "N").otherwise("S"), padded(south, 2), F.when(west >= 0, "E").otherwise("W"), padded(west, 3))
