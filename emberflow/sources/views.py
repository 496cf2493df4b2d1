"""Views over the driver's tables that have the shapes of the domain: detections, facilities, weather, grids.

The mapping is synthetic and deterministic.  A *site* (two users) stands for a cluster where a query needs cluster ids
without running the clustering itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import geo


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("long")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    user, event = F.col("user_id"), F.col("event_id")
    site = _div(user, 2)
    east = 700000 + site % 15 * 15000 + user % 2 * F.when(site % 3 == 0, 75).otherwise(500) + (event % 7 - 3) * 10
    north = 80000 + _div(site, 15) * 5000 + (_div(event, 7) % 5 - 2) * 10
    source = F.when(F.col("event_type") == "click", "VIIRS_SNPP_NRT").when(F.col("event_type") == "view", "VIIRS_NOAA20_NRT").when(F.col("event_type") == "purchase", "VIIRS_NOAA21_NRT").when(F.col("event_type") == "signup", "MODIS_NRT").otherwise("SENTINEL3_FRP")
    return e.select(
        event.alias("id"),
        site.alias("cluster_id"),
        source.alias("source"),
        (east.cast("double") / 1e4).alias("lon"),
        (north.cast("double") / 1e4).alias("lat"),
        F.col("ts").cast("timestamp").alias("acq_datetime"),
        F.col("value").alias("frp"),
        (F.lit(3e2) + F.col("value") * 2e-1).alias("brightness"),
        (F.lit(29e1) + (event % 200).cast("double") * 1e-1).alias("brightness_tir"),
        (F.get_json_object("props", "$.k").try_cast("double") / 1e2).alias("confidence"),
        F.when(F.hour("ts").between(6, 17), "D").otherwise("N").alias("daynight"),
        F.lit(375e-3).alias("scan"),
        F.lit(375e-3).alias("track"),
        user,
    )


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ("flare", "refinery", "oil_well", "steel", "power", "mine", "LNG", "industrial"))), (key % 8 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        key.alias("facility_id"),
        F.col("s_name").alias("name"),
        kind.alias("facility_type"),
        ((700000 + key % 15 * 15000 + key % 5 * 40).cast("double") / 1e4).alias("f_lon"),
        ((80000 + _div(key, 15) * 5000 + key % 3 * 30).cast("double") / 1e4).alias("f_lat"),
    )


def with_means(points: DataFrame, keys: list[str], columns: list[str], order: str = "id") -> DataFrame:
    """The points with the means of a group's ``columns`` in their place, summed in the order of ``order``.

    A sum's last bits depend on its order, and so does the side of a cell's edge on which a mean lies; in this order it
    doesn't matter how rows were dealt to tasks.  A group's rows are streamed, and spilled if need be.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return points.withColumns({c: F.avg(c).over(w) for c in columns})


def sites(points: DataFrame) -> DataFrame:
    """One row for each cluster: centroid, first and last detection, count."""
    known = with_means(points.select("cluster_id", "id", "lon", "lat", "acq_datetime", "frp", "brightness"), ["cluster_id"], ["lon", "lat"])
    return known.groupBy("cluster_id").agg(F.first("lon").alias("lon"), F.first("lat").alias("lat"), F.min("acq_datetime").alias("first_seen"), F.max("acq_datetime").alias("last_seen"), F.count("*").alias("n_detections"), F.max("frp").alias("frp_max"), F.max("brightness").alias("brightness_max"))


def weather(points: DataFrame) -> DataFrame:
    """Hourly weather of every cluster, over the hours that it was seen in: every third hour is missing."""
    hours = points.select("cluster_id", F.date_trunc("hour", "acq_datetime").alias("hour")).distinct()
    n = F.unix_timestamp("hour") / 3600
    wide = hours.select("cluster_id", F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("d"), "hour").select("cluster_id", F.timestamp_seconds(F.unix_timestamp("hour") + F.col("d") * 3600).alias("hour")).distinct()
    index = (n + F.col("cluster_id") * 7).cast("long")
    return wide.where((n.cast("long") + F.col("cluster_id")) % 3 != 0).select("cluster_id", "hour", ((index % 29).cast("double") / 2.9).alias("wind_speed"), (index * 37 % 360).cast("double").alias("wind_direction"), ((index * 13 % 101).cast("double") / 1e2).alias("cloud"), F.hour("hour").between(6, 17).alias("is_day"))


#: Spacing of the made-up road network in degrees, and how far it reaches around a place.
ROAD_STEP, ROAD_REACH = 0.02, 6
#: Cells of 0.01 degrees on a side of a raster block.
BLOCK = 8


def _around(places: DataFrame, step: float, reach: int) -> DataFrame:
    """Distinct grid cells (ix, iy) around places."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    at = places.select(F.floor(geo.rounded(F.col("lon"), 6) / step).cast("long").alias("x"), F.floor(geo.rounded(F.col("lat"), 6) / step).cast("long").alias("y")).distinct()
    wide = at.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    return wide.select((F.col("x") + F.col("dx")).alias("ix"), (F.col("y") + F.col("dy")).alias("iy")).distinct()


def road_nodes(places: DataFrame) -> DataFrame:
    """Crossings (target_id, t_lon, t_lat) of a made-up road network around places."""
    c = _around(places, ROAD_STEP, ROAD_REACH).where((F.col("ix") * 7 + F.col("iy") * 11) % 10 != 0)
    return c.select((F.col("ix") * 100_000 + F.col("iy")).alias("target_id"), "ix", "iy", ((F.col("ix").cast("double") + 5e-1) * ROAD_STEP).alias("t_lon"), ((F.col("iy").cast("double") + 5e-1) * ROAD_STEP).alias("t_lat"))


def roads(places: DataFrame) -> DataFrame:
    """Its edges (a, b, weight in metres), both ways."""
    n = road_nodes(places).select("target_id", "ix", "iy")
    to = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), (F.col("ix") + x).alias("jx"), (F.col("iy") + y).alias("jy")) for d, x, y in ((0, 1, 0), (1, 0, 1))]))
    one = n.select(F.col("target_id").alias("a"), "ix", "iy", to.alias("e")).where((F.col("ix") * 3 + F.col("iy") * 5 + F.col("e.d")) % 9 != 0)
    one = one.select("a", (F.col("e.jx") * 100_000 + F.col("e.jy")).alias("b"), (2000 + (F.col("ix") * 13 + F.col("iy") * 29 + F.col("e.d") * 7) % 700).alias("weight"))
    one = one.join(n.select(F.col("target_id").alias("b")).hint("merge"), "b", "left_semi").select("a", "b", "weight")
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def ways(f: DataFrame) -> DataFrame:
    """Two made-up ways (way_id, rings) near each facility: squares, some with a hole, some that don't close."""
    key = F.col("facility_id")
    w = f.select(key, "f_lon", "f_lat", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    half = 4e-4 + (key % 4).cast("double") * 3e-4
    x = F.col("f_lon") + ((key * 7 + F.col("k") * 5) % 9 - 4).cast("double") * 5e-4
    y = F.col("f_lat") + ((key * 11 + F.col("k") * 3) % 9 - 4).cast("double") * 5e-4
    corner = lambda a, b, h: F.struct((x + a * h).alias("lon"), (y + b * h).alias("lat"))
    square = lambda h: F.array(*[corner(a, b, h) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
    outer = F.when((key + F.col("k")) % 4 == 3, F.slice(square(half), 1, 4)).otherwise(square(half))
    return w.select((key * 2 + F.col("k")).alias("way_id"), F.when((key + F.col("k")) % 5 == 0, F.array(outer, square(half / 2))).otherwise(F.array(outer)).alias("rings"))


def cover_code(gx: Column, gy: Column) -> Column:
    """The made-up land cover of a cell of 0.01 degrees; 0 is no data."""
    codes = F.array(*map(F.lit, (10, 20, 40, 50, 60, 80, 90, 95)))
    rest = (gx * 7 + gy * 13) % 8
    # west of Greenwich or south of the equator a remainder may be negative
    return F.when((gx * 3 + gy * 5) % 11 == 0, 0).otherwise(F.element_at(codes, F.when(rest < 0, 8).otherwise(rest + 1).cast("int")))


def windows(places: DataFrame, radius_m: float, size: float = 0.01) -> DataFrame:
    """(cluster_id, x0, x1, y0, y1): the cells whose centres lie within ``radius_m`` north, south, east and west of places."""
    dy = F.lit(radius_m / C.METRES_PER_DEGREE)
    dx = dy / F.cos(F.radians("lat"))
    first, last = lambda x: F.ceil(x / size - 0.5).cast("long"), lambda x: F.floor(x / size - 0.5).cast("long")
    return places.select("cluster_id", first(F.col("lon") - dx).alias("x0"), last(F.col("lon") + dx).alias("x1"), first(F.col("lat") - dy).alias("y0"), last(F.col("lat") + dy).alias("y1")).where("x0 <= x1 and y0 <= y1")


#: Columns of blocks that one row of a window's touched blocks stands for, before they are listed one by one.
_STRIPE = 4096


def touched(w: DataFrame, block: int = BLOCK) -> DataFrame:
    """Windows for each block (bx, by) that they touch: stripes of columns first, as windows near a pole are long."""
    at = lambda c, n: F.floor(c / n).cast("long")
    wide = w.withColumn("by", F.explode(F.sequence(at(F.col("y0"), block), at(F.col("y1"), block))))
    wide = wide.withColumn("_s", F.explode(F.sequence(at(F.col("x0"), block * _STRIPE), at(F.col("x1"), block * _STRIPE))))
    from_, to = F.greatest(at(F.col("x0"), block), F.col("_s") * _STRIPE), F.least(at(F.col("x1"), block), F.col("_s") * _STRIPE + _STRIPE - 1)
    # dealt anew, or one task would list all blocks of the places at a pole
    return wide.repartition("cluster_id", "by", "_s").withColumn("bx", F.explode(F.sequence(from_, to))).drop("_s")


def cover_blocks(places: DataFrame, radius_m: float | None = None) -> DataFrame:
    """The raster around places as blocks (bx, by, codes: row by row), as a tiled file has them; with a radius also all
    blocks of the windows that it asks for, which are wide at high latitudes."""
    b = _around(places, 0.01 * BLOCK, 2).withColumnsRenamed({"ix": "bx", "iy": "by"})
    if radius_m is not None:
        b = b.unionByName(touched(windows(places, radius_m)).select("bx", "by")).distinct()
    cell = lambda i: cover_code(F.col("bx") * BLOCK + i % BLOCK, F.col("by") * BLOCK + F.floor(i / BLOCK).cast("long"))
    return b.select("bx", "by", F.transform(F.sequence(F.lit(0), F.lit(BLOCK * BLOCK - 1)), cell).alias("codes"))


#: The same views for DuckDB.
ORACLE = """
b AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props,'$.k') AS INTEGER) AS k, user_id // 2 AS site FROM events),
detections AS (
  SELECT event_id AS id, site AS cluster_id,
    CASE event_type WHEN 'click' THEN 'VIIRS_SNPP_NRT' WHEN 'view' THEN 'VIIRS_NOAA20_NRT' WHEN 'purchase' THEN 'VIIRS_NOAA21_NRT' WHEN 'signup' THEN 'MODIS_NRT' ELSE 'SENTINEL3_FRP' END AS source,
    CAST(700000 + (site % 15)*15000 + (user_id % 2)*(CASE WHEN site % 3 = 0 THEN 75 ELSE 500 END) + ((event_id % 7)-3)*10 AS DOUBLE)/1e4 AS lon,
    CAST(80000 + (site // 15)*5000 + ((event_id // 7) % 5 - 2)*10 AS DOUBLE)/1e4 AS lat,
    ts AS acq_datetime, value AS frp, 3e2 + value*2e-1 AS brightness, 29e1 + CAST(event_id % 200 AS DOUBLE)*1e-1 AS brightness_tir,
    CAST(k AS DOUBLE)/1e2 AS confidence, CASE WHEN hour(ts) BETWEEN 6 AND 17 THEN 'D' ELSE 'N' END AS daynight, user_id
  FROM b),
facilities AS (
  SELECT s_suppkey AS facility_id, s_name AS name,
    CASE s_suppkey % 8 WHEN 0 THEN 'flare' WHEN 1 THEN 'refinery' WHEN 2 THEN 'oil_well' WHEN 3 THEN 'steel' WHEN 4 THEN 'power' WHEN 5 THEN 'mine' WHEN 6 THEN 'LNG' ELSE 'industrial' END AS facility_type,
    CAST(700000 + (s_suppkey % 15)*15000 + (s_suppkey % 5)*40 AS DOUBLE)/1e4 AS f_lon,
    CAST(80000 + (s_suppkey // 15)*5000 + (s_suppkey % 3)*30 AS DOUBLE)/1e4 AS f_lat
  FROM supplier),
sites AS (SELECT cluster_id, avg(lon) AS lon, avg(lat) AS lat, min(acq_datetime) AS first_seen, max(acq_datetime) AS last_seen, count(*) AS n_detections, max(frp) AS frp_max, max(brightness) AS brightness_max FROM detections GROUP BY 1),
wide AS (SELECT DISTINCT cluster_id, date_trunc('hour', acq_datetime) + to_hours(d) AS hour FROM detections, (SELECT unnest([-2,-1,0,1,2]) AS d)),
weather AS (SELECT cluster_id, hour, CAST(i % 29 AS DOUBLE)/2.9 AS wind_speed, CAST(i*37 % 360 AS DOUBLE) AS wind_direction, CAST(i*13 % 101 AS DOUBLE)/1e2 AS cloud, hour(hour) BETWEEN 6 AND 17 AS is_day
  FROM (SELECT cluster_id, hour, CAST(epoch(hour)/3600 AS BIGINT) AS n, CAST(epoch(hour)/3600 AS BIGINT) + cluster_id*7 AS i FROM wide) WHERE (n + cluster_id) % 3 <> 0)
"""

ORACLE_ROADS = f"""
, road_at AS (SELECT DISTINCT CAST(floor(round(lon,6)/{ROAD_STEP}) AS BIGINT) AS x, CAST(floor(round(lat,6)/{ROAD_STEP}) AS BIGINT) AS y FROM sites),
crossings AS (SELECT DISTINCT x + dx AS ix, y + dy AS iy, (x + dx)*100000 + y + dy AS node, (CAST(x + dx AS DOUBLE) + 5e-1)*{ROAD_STEP} AS t_lon, (CAST(y + dy AS DOUBLE) + 5e-1)*{ROAD_STEP} AS t_lat
  FROM road_at, (SELECT unnest(range(-{ROAD_REACH}, {ROAD_REACH + 1})) AS dx), (SELECT unnest(range(-{ROAD_REACH}, {ROAD_REACH + 1})) AS dy) WHERE ((x + dx)*7 + (y + dy)*11) % 10 <> 0),
road1 AS (SELECT c.node AS a, (ix + 1 - d)*100000 + iy + d AS b, 2000 + (ix*13 + iy*29 + d*7) % 700 AS weight FROM crossings c, (SELECT unnest([0, 1]) AS d) WHERE (ix*3 + iy*5 + d) % 9 <> 0),
road2 AS (SELECT a, b, weight FROM road1 WHERE b IN (SELECT node FROM crossings)),
roads AS (SELECT a, b, weight FROM road2 UNION ALL SELECT b, a, weight FROM road2)"""
