"""The nearest target of each point, exactly, by rings over a pyramid of grid cells.

Level 0 has cells of 360 / 2 ** BITS degrees (about 300 m), each level above cells twice as wide; a level's table holds
its occupied cells only.  One join looks at the 3 x 3 cells around a point on all levels at once: the nearest of the
farthest corners of occupied cells there is a distance that the nearest target can't exceed.  The search starts on the
lowest level whose ring is sure to cover that distance and goes down; on each level cells stay whose nearest edge is not
beyond the least farthest corner.  Targets are met in the few cells of level 0 that are left, so that neither a dense
town nor an empty country makes a point meet many of them.  Longitudes go round at 180 degrees.

Near the poles the cells' widths say little; points there meet all targets within the radius.  Latitudes beyond 90 degrees go
on over the pole, as they do in the distance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import geo
from .ingest import _staged, within_radius

#: Cells around the globe on level 0, as a power of 2.
BITS = 17
#: What is taken off a distance that must not be too long, as the earth's cells aren't flat.
SAFE = 0.99

_SIZE = 360.0 / 2**BITS
_METRES = math.radians(1.0) * C.EARTH_RADIUS_M


def _cell(lon: Column, lat: Column, level: int) -> tuple[Column, Column]:
    size = _SIZE * 2**level
    return F.pmod(F.floor((lon + 180.0) / size).cast("long"), F.lit(2 ** (BITS - level))), F.floor((lat + 90.0) / size).cast("long")


def _bounds(size: Column) -> tuple[Column, Column]:
    """Distances of a point (lon, lat) to the nearest edge (not too long) and the farthest corner (not too short) of a cell
    (cx, cy)."""
    west, south = F.col("cx") * size - 180.0, F.col("cy") * size - 90.0
    turn = lambda x: F.abs(F.pmod(x + 540.0, F.lit(360.0)) - 180.0)
    inside = F.pmod(F.col("lon") - west, F.lit(360.0)) <= size
    dx = F.when(inside, 0.0).otherwise(F.least(turn(F.col("lon") - west), turn(F.col("lon") - west - size)))
    dy = F.greatest(F.lit(0.0), south - F.col("lat"), F.col("lat") - south - size)
    highest = F.least(F.lit(90.0), F.greatest(F.abs(F.col("lat")), F.abs(south), F.abs(south + size)))
    shrink = F.cos(F.radians(highest))
    low = SAFE * _METRES * F.sqrt(dy * dy + dx * dx * shrink * shrink)
    widest = F.greatest(turn(F.col("lon") - west), turn(F.col("lon") - west - size))
    tallest = F.greatest(F.abs(F.col("lat") - south), F.abs(F.col("lat") - south - size))
    # a parallel is at most as long as at the cell's lowest latitude, and no arc is longer than its two legs
    lowest = F.when(south * (south + size) <= 0, 0.0).otherwise(F.least(F.abs(south), F.abs(south + size)))
    flat = F.sqrt(tallest * tallest + F.pow(widest * F.cos(F.radians(F.least(lowest, F.abs(F.col("lat"))))), 2))
    return low, flat * _METRES / SAFE


def _guaranteed(level: int) -> Column:
    """Metres around a point that its 3 x 3 cells of a level are sure to cover."""
    size = _SIZE * 2**level
    far = F.least(F.lit(90.0), F.abs(F.col("lat")) + size)
    return SAFE * _METRES * size * F.cos(F.radians(far))


def nearest(points: DataFrame, targets: DataFrame, radius_m: float, key: str = "key", target_id: str = "target_id", max_lat: float = 75.0) -> DataFrame:
    """Points (key, lon, lat) with their nearest target (target_id, t_lon, t_lat) within ``radius_m``, its distance_m and
    bearing; of equal distances the smallest id.  Points without one don't appear.  Beyond ``max_lat`` degrees there are no
    rings of cells."""
    levels = max(1, math.ceil(math.log2(radius_m / (SAFE * _METRES * _SIZE * math.cos(math.radians(max_lat + 1.0))))) + 1)
    if levels > BITS - 2:
        raise ValueError("the radius is too large for rings of cells")
    x, lat = geo.folded(F.col("lon"), F.col("lat"))
    every = points.where("lon is not null and lat is not null").select(F.struct(F.col(key).alias("key"), "lon", "lat").alias("key"), (x - 180.0).alias("lon"), lat.alias("lat"))
    # staged: every level reads them; cells and targets may be many more than Spark takes them for, so none are broadcast
    own = _staged(every.where(F.abs("lat") <= max_lat))
    tx, ty = geo.folded(F.col("t_lon"), F.col("t_lat"))
    cx, cy = _cell(tx - 180.0, ty, 0)
    placed = _staged(targets.where(F.col("t_lon").isNotNull() & F.col("t_lat").isNotNull()).select(F.col(target_id).alias("target_id"), "t_lon", "t_lat", cx.alias("cx"), cy.alias("cy")))
    up = F.array(*[F.struct(F.lit(q).alias("level"), F.shiftright("cx", q).alias("cx"), F.shiftright("cy", q).alias("cy")) for q in range(levels)])
    occupied = _staged(placed.select("cx", "cy").distinct().select(F.explode(up).alias("c")).select("c.*").distinct())

    def ring(q: int) -> Column:
        x, y = _cell(F.col("lon"), F.col("lat"), q)
        steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        return F.array(*[F.struct(F.lit(q).alias("level"), F.pmod(x + a, F.lit(2 ** (BITS - q))).alias("cx"), (y + b).alias("cy")) for a, b in steps])

    size = F.lit(_SIZE) * F.pow(F.lit(2.0), F.col("level"))
    around = own.select("key", "lon", "lat", F.explode(F.flatten(F.array(*map(ring, range(levels))))).alias("c")).select("key", "lon", "lat", "c.*")
    low, high = _bounds(size)
    met = around.join(occupied.hint("merge"), ["level", "cx", "cy"]).withColumn("high", high)
    reach = met.groupBy("key", "lon", "lat").agg(F.least(F.min("high"), F.lit(radius_m)).alias("reach"))
    start = F.lit(levels - 1)
    for q in reversed(range(levels - 1)):
        start = F.when(_guaranteed(q) >= F.col("reach"), q).otherwise(start)
    reach = _staged(reach.withColumn("start", start))

    left = None
    for q in reversed(range(levels)):
        begun = reach.where(F.col("start") == q).select("key", "lon", "lat", "reach", F.explode(ring(q)).alias("c")).select("key", "lon", "lat", "reach", "c.cx", "c.cy")
        if left is not None:
            children = F.array(*[F.struct((F.col("cx") * 2 + a).alias("cx"), (F.col("cy") * 2 + b).alias("cy")) for a in (0, 1) for b in (0, 1)])
            begun = begun.unionByName(left.select("key", "lon", "lat", "reach", F.explode(children).alias("c")).select("key", "lon", "lat", "reach", "c.cx", "c.cy"))
        low, high = _bounds(F.lit(_SIZE * 2**q))
        here = begun.join(occupied.where(F.col("level") == q).select("cx", "cy").hint("merge"), ["cx", "cy"]).withColumns({"low": low, "high": high})
        # a point has a few cells of a level
        least = F.least("reach", F.min("high").over(Window.partitionBy("key", "lon", "lat")))
        left = here.withColumn("reach", least).where(F.col("low") <= F.col("reach")).select("key", "lon", "lat", "reach", "cx", "cy")
    distance = geo.haversine_m(F.col("key.lon"), F.col("key.lat"), F.col("t_lon"), F.col("t_lat"))
    pairs = left.join(placed.hint("merge"), ["cx", "cy"]).withColumn("distance_m", distance).where(F.col("distance_m") <= radius_m).select("key", "distance_m", "target_id", "t_lon", "t_lat")
    beyond = every.where(F.abs("lat") > max_lat).select("key", "key.lon", "key.lat")
    _, south = geo.folded(F.col("t_lon"), F.col("t_lat"))
    high = placed.where(F.abs(south) > max_lat - math.degrees(radius_m / C.EARTH_RADIUS_M) - 1.0).select("target_id", F.col("t_lon").alias("f_lon"), F.col("t_lat").alias("f_lat"))
    pairs = pairs.unionByName(within_radius(beyond, high, radius_m).select("key", "distance_m", "target_id", F.col("f_lon").alias("t_lon"), F.col("f_lat").alias("t_lat")))
    best = pairs.groupBy("key").agg(F.min(F.struct("distance_m", "target_id", "t_lon", "t_lat")).alias("b"))
    named = best.select(F.col("key.key").alias(key), "key.lon", "key.lat", "b.*")
    return named.withColumn("bearing", geo.bearing_deg(F.col("lon"), F.col("lat"), F.col("t_lon"), F.col("t_lat"))).withColumnRenamed("target_id", target_id)
