"""Deduplication, spatial joins and clustering of detections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import geo
from ..session import shared_folder


def keep_first(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of every key in the given order (dropDuplicates would keep any)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def exact_key() -> list[Column]:
    return [F.col("source"), F.round("lon", 6), F.round("lat", 6), F.col("acq_datetime")]


def near_key() -> list[Column]:
    return [F.col("source"), F.round("lon", 4), F.round("lat", 4), F.date_trunc("minute", "acq_datetime")]


def dedup_exact(df: DataFrame, order: list[str]) -> DataFrame:
    return keep_first(df, exact_key(), order)


def dedup_near(df: DataFrame, order: list[str]) -> DataFrame:
    return keep_first(df, near_key(), order)


def dedup_existing(df: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose exact key isn't stored since the batch's earliest detection."""
    names = ["_source", "_lon", "_lat", "_t"]
    since = df.agg(F.min("acq_datetime").alias("_since"))
    known = stored.join(F.broadcast(since), stored["acq_datetime"] >= since["_since"]).select(*[c.alias(n) for c, n in zip(exact_key(), names, strict=True)]).distinct()
    keyed = df.select("*", *[c.alias(n) for c, n in zip(exact_key(), names, strict=True)])
    return keyed.join(known, names, "left_anti").drop(*names)


def grid_pairs(left: DataFrame, right: DataFrame, size_lon: float, size_lat: float, left_xy: tuple[str, str], right_xy: tuple[str, str]) -> DataFrame:
    """Candidate pairs within one cell of each other: an equi-join on grid cells, never a product.

    ``right`` is copied to the 3 x 3 cells around each of its points, so a pair within (size_lon, size_lat) meets
    exactly once.
    """
    at = left.withColumn("_cx", geo.cell(F.col(left_xy[0]), size_lon)).withColumn("_cy", geo.cell(F.col(left_xy[1]), size_lat))
    near = right.withColumn("_dx", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("_dy", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    near = near.withColumn("_cx", geo.cell(F.col(right_xy[0]), size_lon) + F.col("_dx")).withColumn("_cy", geo.cell(F.col(right_xy[1]), size_lat) + F.col("_dy")).drop("_dx", "_dy")
    return at.join(near, ["_cx", "_cy"]).drop("_cx", "_cy")


def _rows(radius_m: float) -> tuple[float, int]:
    """Height in degrees and number of the rows of cells for a radius."""
    height = radius_m / 111_000.0
    return height, max(1, math.ceil(180.0 / height))


def _columns(row: Column, height: float) -> Column:
    """Cells of a row, as wide as the radius on the row's shortest parallel: a row has the fewer the nearer it is to a pole."""
    shortest = F.least(F.lit(90.0), F.greatest(F.abs(row * height - 90.0), F.abs((row + 1) * height - 90.0)))
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(shortest)) / height)).cast("long")


def _row_of(lat: Column, height: float, rows: int) -> Column:
    return F.least(F.floor((lat + 90.0) / height), F.lit(rows - 1)).cast("long")


def _column_of(x: Column) -> Column:
    return F.floor(x * F.col("_n") / 360.0).cast("long")


def placed_at(points: DataFrame, radius_m: float) -> DataFrame:
    """Points (lon, lat) with their cell (_cx, _cy)."""
    height, rows = _rows(radius_m)
    x, y = geo.folded(F.col("lon"), F.col("lat"))
    at = points.withColumn("_x", x).withColumn("_cy", _row_of(y, height, rows)).withColumn("_n", _columns(F.col("_cy"), height))
    return at.withColumn("_cx", F.least(_column_of(F.col("_x")), F.col("_n") - 1)).drop("_x", "_n")


def placed_around(facilities: DataFrame, radius_m: float) -> DataFrame:
    """Facilities (f_lon, f_lat), copied to the cells (_cx, _cy) of their own and the next rows that their circle reaches."""
    height, rows = _rows(radius_m)
    r = radius_m / 6_371_000.0 * (1 + 1e-9)
    x, y = geo.folded(F.col("f_lon"), F.col("f_lat"))
    near = facilities.withColumns({"_x": x, "_y": y}).where("_x is not null and _y is not null")
    polar = F.radians(F.abs(F.col("_y"))) + r >= math.pi / 2
    reach = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(min(r, math.pi / 2)) / F.cos(F.radians("_y"))))) + 1e-9)
    row = _row_of(F.col("_y"), height, rows)
    around = F.sequence(F.greatest(row - 1, F.lit(0)), F.least(row + 1, F.lit(rows - 1)))
    near = near.withColumn("_reach", reach).withColumn("_cy", F.explode(around)).withColumn("_n", _columns(F.col("_cy"), height))
    first, last = _column_of(F.col("_x") - F.col("_reach")), _column_of(F.col("_x") + F.col("_reach"))
    cells = F.transform(F.sequence(first, F.least(last, first + F.col("_n") - 1)), lambda c: F.pmod(c, F.col("_n")))
    return near.withColumn("_cx", F.explode(cells)).drop("_x", "_y", "_n", "_reach")


def within_radius(points: DataFrame, facilities: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of points (lon, lat) and facilities (f_lon, f_lat) within ``radius_m``, with distance_m.

    Cells are as high and wide as the radius at any latitude, so a facility is copied to a few of them.  Latitudes beyond 90
    degrees go on over the pole, as they do in the distance.  Spark takes the copies for as many as the facilities, so they
    are kept from being broadcast.
    """
    distance = geo.haversine_m(F.col("lon"), F.col("lat"), F.col("f_lon"), F.col("f_lat"))
    met = placed_at(points, radius_m).join(placed_around(facilities, radius_m).hint("merge"), ["_cx", "_cy"]).drop("_cx", "_cy")
    return met.withColumn("distance_m", distance).where(F.col("distance_m") <= radius_m)


def within_wedge(wedges: DataFrame, facilities: DataFrame, side: int = 10) -> DataFrame:
    """Pairs of wedges (lon, lat, bearing, half_angle, length_km) and the facilities (f_lon, f_lat) of all cells of ``side``
    degrees that a wedge may reach, with distance_m; whether a facility lies inside is left to the caller.

    A facility has one cell; a wedge goes to the cells whose circumscribed circles come within its length and its angle,
    however long it is, so that cells behind it or beside it are not met.
    """
    across, down = 360 // side, 180 // side
    place = lambda x, start, n: F.least(F.greatest(F.floor((x - start) / side), F.lit(0)), F.lit(n - 1)).cast("int")
    turned = F.pmod(F.col("f_lon") + 180.0, F.lit(360.0))
    there = facilities.withColumn("_cell", place(F.col("f_lat"), -90.0, down) * across + place(turned, 0.0, across))

    def reached(c: Column) -> Column:
        x, south = F.pmod(c, F.lit(across)) * side - 180.0 + side / 2, F.floor(c / across) * side - 90.0
        y = south + side / 2
        # the corners nearer the equator are the farthest from the middle
        wide = F.when(y > 0, south).otherwise(south + side)
        radius = geo.haversine_m(x, y, x + side / 2, wide) * (1 + 1e-9) + 1.0
        away = geo.haversine_m(F.col("lon"), F.col("lat"), x, y)
        around = (away <= radius) | (away + radius >= math.pi * C.EARTH_RADIUS_M)
        # a circle is seen from the apex under twice this angle
        seen = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(radius / C.EARTH_RADIUS_M) / F.sin(away / C.EARTH_RADIUS_M)))) + 1e-6
        off = geo.angular_difference(geo.bearing_deg(F.col("lon"), F.col("lat"), x, y), F.col("bearing"))
        return (away - radius <= F.col("length_km") * 1000.0) & (around | (off <= F.col("half_angle") + seen))

    cells = F.filter(F.sequence(F.lit(0), F.lit(across * down - 1)), reached)
    distance = geo.haversine_m(F.col("lon"), F.col("lat"), F.col("f_lon"), F.col("f_lat"))
    return wedges.withColumn("_cell", F.explode(cells)).join(there, "_cell").drop("_cell").withColumn("distance_m", distance)


def contracted(points: DataFrame, eps: float) -> DataFrame:
    """Points (node, lon, lat) with ``rep``: the smallest node of their cell of side eps / sqrt(2), whose points are all
    within eps of each other."""
    side = eps * (0.5**0.5) * (1 - 1e-9)
    celled = points.withColumn("_cx", geo.cell(F.col("lon"), side)).withColumn("_cy", geo.cell(F.col("lat"), side))
    least = celled.groupBy("_cx", "_cy").agg(F.min("node").alias("rep"))
    return celled.join(least, ["_cx", "_cy"]).drop("_cx", "_cy")


def eps_edges(points: DataFrame, eps: float) -> DataFrame:
    """(a, b), a < b: representatives of contracted points (rep, lon, lat) of which some pair is within eps degrees."""
    other = points.select(F.col("rep").alias("b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    pairs = grid_pairs(points.select(F.col("rep").alias("a"), "lon", "lat"), other, eps, eps, ("lon", "lat"), ("lon2", "lat2"))
    dx, dy = F.col("lon") - F.col("lon2"), F.col("lat") - F.col("lat2")
    return pairs.where((F.col("a") < F.col("b")) & (dx * dx + dy * dy <= eps * eps)).select("a", "b").distinct()


def _staged(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the cluster's shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def connected(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): smallest node reachable, by large-star and small-star steps until nothing changes."""

    def least(df: DataFrame) -> DataFrame:
        return df.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = _staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = mark(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = least(large)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now, before = _staged(small), seen
        seen = mark(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def clustered(points: DataFrame, eps: float, key: str = "id") -> DataFrame:
    """The points with component: density-connected at eps with one point enough (noise is a cluster of its own).

    Points of one place are one node, so a site that is seen every day costs one point; links are closed over small cells
    that are whole components, not over places.
    """
    places = contracted(points.groupBy("lon", "lat").agg(F.min(key).alias("node")), eps)
    found = connected(eps_edges(places, eps)).withColumnRenamed("node", "rep")
    named = places.join(found, "rep", "left").select("lon", "lat", F.coalesce("component", "rep").alias("component"))
    return points.join(named, ["lon", "lat"])


def matched(new: DataFrame, stored: DataFrame, eps: float) -> DataFrame:
    """Each new cluster (new_id, lon, lat) with the nearest stored one (old_id) within eps degrees, or null."""
    old = stored.select("old_id", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    pairs = grid_pairs(new, old, eps, eps, ("lon", "lat"), ("lon2", "lat2"))
    dx, dy = F.col("lon") - F.col("lon2"), F.col("lat") - F.col("lat2")
    near = pairs.withColumn("d", dx * dx + dy * dy).where(F.col("d") <= eps * eps)
    best = near.groupBy("new_id").agg(F.min(F.struct("d", "old_id")).alias("best")).select("new_id", F.col("best.old_id").alias("old_id"))
    return new.join(best, "new_id", "left")


def merged(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored clusters with a batch's aggregates (cluster_id, lon, lat, first_seen, last_seen, n): weighted centroids."""
    b = batch.select("cluster_id", *[F.col(c).alias(f"b_{c}") for c in ("lon", "lat", "first_seen", "last_seen", "n")])
    both = stored.join(b, "cluster_id", "full_outer")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("b_n", F.lit(0))
    mean = lambda c: (F.coalesce(c, F.lit(0.0)) * n + F.coalesce(f"b_{c}", F.lit(0.0)) * m) / (n + m)
    return both.select("cluster_id", mean("lon").alias("lon"), mean("lat").alias("lat"), F.least("first_seen", "b_first_seen").alias("first_seen"), F.greatest("last_seen", "b_last_seen").alias("last_seen"), (n + m).alias("n"))
