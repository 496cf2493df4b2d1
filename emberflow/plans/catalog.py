"""Queries over the driver's tables, one for each family of operators, with their DuckDB equivalents.

Floating results are rounded in both engines, as their trigonometric functions differ in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import detection, geo, physics, scoring, text
from ..operators import features, ingest, temporal
from ..sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None, ctes: bool = True):
    """Registers a query under its function's name; ``oracle`` continues the WITH list of the views."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = (f"WITH {views.ORACLE}{oracle}" if ctes else oracle).strip()
        return f

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    return geo.rounded(F.col(c) if isinstance(c, str) else c, digits)


_HAV = "2*6371000.0*asin(sqrt(pow(sin(radians({b1}-{a1})/2),2)+cos(radians({a1}))*cos(radians({b1}))*pow(sin(radians({b0}-{a0})/2),2)))"


def hav(a0: str, a1: str, b0: str, b1: str) -> str:
    return _HAV.format(a0=a0, a1=a1, b0=b0, b1=b1)


# --- normalising, deduplication, filters -----------------------------------------------------------


@query("""
SELECT id, CASE WHEN contains(source,'VIIRS') THEN 'VIIRS' WHEN contains(source,'MODIS') THEN 'MODIS' ELSE 'SENTINEL' END AS sensor,
  replace(replace(source,'_NRT',''),'_RT','') AS platform,
  CASE WHEN contains(source,'VIIRS') THEN CASE id % 4 WHEN 0 THEN 0.3 WHEN 1 THEN 0.7 WHEN 2 THEN 0.95 END ELSE round(greatest(0, least(1, confidence)),6) END AS norm_confidence,
  CASE WHEN confidence >= 0.8 THEN 'HIGH' WHEN confidence >= 0.5 THEN 'NOMINAL' WHEN confidence IS NOT NULL THEN 'LOW' END AS band,
  round(CASE WHEN id % 5 = 0 THEN coalesce(confidence,0.5)*0.85 ELSE greatest(0, coalesce(confidence,0.5)*(1-0.5*((id%5)/5.0))) END,6) AS decayed,
  CASE WHEN id % 5 = 0 THEN false ELSE (id%5)/5.0 <= 0.3 END AS optical_available,
  format('cloud|{:.2f}|{:.2f}', lon, lat) AS cache_key
FROM detections""")
def normalise_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.detections(spark, sf_dir)
    raw = F.when(F.col("source").contains("VIIRS"), F.element_at(F.array(F.lit("l"), F.lit(" Nominal "), F.lit("H"), F.lit("?")), (F.col("id") % 4 + 1).cast("int"))).otherwise((F.col("confidence") * 100).cast("string"))
    cloud = F.when(F.col("id") % 5 != 0, F.col("id") % 5 / 5.0)
    return d.select(
        "id", detection.sensor_family(F.col("source")).alias("sensor"), detection.platform(F.col("source")).alias("platform"), r(detection.confidence(F.col("source"), raw)).alias("norm_confidence"),
        detection.confidence_band(F.col("confidence")).alias("band"), r(detection.decayed_confidence(F.col("confidence"), cloud)).alias("decayed"), detection.optically_available(cloud).alias("optical_available"),
        detection.cache_key("cloud", F.col("lon"), F.col("lat")).alias("cache_key"),
    )


def _fed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as two feeds give them: every tenth comes again."""
    d = views.detections(spark, sf_dir).withColumn("feed_seq", F.lit(0))
    return d.unionByName(d.where("id % 10 = 0").withColumn("feed_seq", F.lit(1)))


_FED = ", fed AS (SELECT *, 0 AS feed_seq FROM detections UNION ALL SELECT *, 1 FROM detections WHERE id % 10 = 0)"


@query(_FED + " SELECT id, feed_seq, source FROM fed QUALIFY row_number() OVER (PARTITION BY source, round(lon,6), round(lat,6), acq_datetime ORDER BY feed_seq, id) = 1")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.dedup_exact(_fed(spark, sf_dir), ["feed_seq", "id"]).select("id", "feed_seq", "source")


@query(_FED + " SELECT id, feed_seq, source FROM fed QUALIFY row_number() OVER (PARTITION BY source, round(lon,4), round(lat,4), date_trunc('minute', acq_datetime) ORDER BY feed_seq, id) = 1")
def dedup_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.dedup_near(_fed(spark, sf_dir), ["feed_seq", "id"]).select("id", "feed_seq", "source")


@query(_FED + " SELECT id, feed_seq, source FROM fed d WHERE NOT EXISTS (SELECT 1 FROM detections s WHERE s.acq_datetime < TIMESTAMP '2024-01-16' AND s.source = d.source AND round(s.lon,6) = round(d.lon,6) AND round(s.lat,6) = round(d.lat,6) AND s.acq_datetime = d.acq_datetime)")
def dedup_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both feeds against what was stored by the middle of the month."""
    return ingest.dedup_existing(_fed(spark, sf_dir), views.detections(spark, sf_dir).where("acq_datetime < timestamp '2024-01-16'")).select("id", "feed_seq", "source")


@query("SELECT id, source, lon, lat, acq_datetime FROM detections WHERE lon > 72 AND lon < 80 AND lat > 8 AND lat < 10 AND acq_datetime >= TIMESTAMP '2024-01-10' AND source = 'MODIS_NRT' ORDER BY acq_datetime DESC, id LIMIT 500")
def filter_bbox_since_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing: strict bounds, newest first, a page of 500."""
    d = views.detections(spark, sf_dir).where("lon > 72 and lon < 80 and lat > 8 and lat < 10 and acq_datetime >= timestamp '2024-01-10' and source = 'MODIS_NRT'")
    return d.orderBy(F.desc("acq_datetime"), "id").limit(500).select("id", "source", "lon", "lat", "acq_datetime")


# --- clustering ------------------------------------------------------------------------------------


_REACH = """
, places AS (SELECT lon, lat, min(id) AS node FROM detections GROUP BY 1, 2),
grid AS (SELECT *, floor(lon/0.005) AS cx, floor(lat/0.005) AS cy FROM places),
edges AS (SELECT a.node AS a, b.node AS b FROM grid a, (SELECT g.*, cx + dx AS kx, cy + dy AS ky FROM grid g, (SELECT unnest([-1,0,1]) AS dx), (SELECT unnest([-1,0,1]) AS dy)) b
  WHERE a.cx = b.kx AND a.cy = b.ky AND pow(a.lon-b.lon,2)+pow(a.lat-b.lat,2) <= 0.005*0.005),
reach AS (WITH RECURSIVE walk(node, seen) AS (SELECT node, node FROM places UNION SELECT w.node, e.b FROM walk w JOIN edges e ON e.a = w.seen) SELECT node, min(seen) AS component FROM walk GROUP BY 1)"""


@query(_REACH + "\nSELECT component, count(*) AS n, count(DISTINCT (d.lon, d.lat)) AS n_places FROM detections d JOIN places p USING (lon, lat) JOIN reach USING (node) GROUP BY 1")
def cluster_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clustering of all detections (eps 0.005 degrees, one point is enough)."""
    found = ingest.clustered(views.detections(spark, sf_dir), C.CLUSTER_EPS_DEGREES)
    return found.groupBy("component").agg(F.count("*").alias("n"), F.count_distinct("lon", "lat").alias("n_places"))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = views.detections(spark, sf_dir)
    mean = lambda part, key: part.groupBy(F.col("user_id").alias(key)).agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    return mean(d.where("acq_datetime >= timestamp '2024-01-16'"), "new_id"), mean(d.where("acq_datetime < timestamp '2024-01-16'"), "old_id")


@query("""
, new AS (SELECT user_id AS new_id, avg(lon) AS lon, avg(lat) AS lat FROM detections WHERE acq_datetime >= TIMESTAMP '2024-01-16' GROUP BY 1),
old AS (SELECT user_id AS old_id, avg(lon) AS lon, avg(lat) AS lat FROM detections WHERE acq_datetime < TIMESTAMP '2024-01-16' GROUP BY 1),
pairs AS (SELECT n.new_id, o.old_id, pow(n.lon-o.lon,2)+pow(n.lat-o.lat,2) AS d FROM new n JOIN old o ON abs(n.lon-o.lon) <= 0.005 AND abs(n.lat-o.lat) <= 0.005)
SELECT new_id, (SELECT arg_min(old_id, (d, old_id)) FROM pairs p WHERE p.new_id = n.new_id AND d <= 0.005*0.005) AS old_id FROM new n""")
def match_existing_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = _halves(spark, sf_dir)
    return ingest.matched(new, old, C.CLUSTER_EPS_DEGREES).select("new_id", "old_id")


def _aggregates(d: DataFrame) -> DataFrame:
    return d.groupBy("cluster_id").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.min("acq_datetime").alias("first_seen"), F.max("acq_datetime").alias("last_seen"), F.count("*").alias("n"))


@query("SELECT cluster_id, round(avg(lon),6) AS lon, round(avg(lat),6) AS lat, min(acq_datetime) AS first_seen, max(acq_datetime) AS last_seen, count(*) AS n FROM detections GROUP BY 1")
def merge_running_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches merged one after the other give the clusters of all."""
    d = views.detections(spark, sf_dir)
    both = ingest.merged(_aggregates(d.where("id % 2 = 0")), _aggregates(d.where("id % 2 = 1")))
    return both.select("cluster_id", r("lon").alias("lon"), r("lat").alias("lat"), "first_seen", "last_seen", "n")


# --- features --------------------------------------------------------------------------------------

_SPAN = "(epoch_us(max(acq_datetime))-epoch_us(min(acq_datetime)))/8.64e10"


@query(f"""
SELECT cluster_id, round(avg(frp),6) AS frp_mean, max(frp) AS frp_max, round(stddev_pop(frp),6) AS frp_std, round(avg(brightness),6) AS brightness_mean, round(max(brightness),6) AS brightness_max,
  round(avg(confidence),5) AS confidence_mean, round({_SPAN},6) AS persistence_days, CAST(count(*) AS DOUBLE) AS n_detections, round(count(*)/greatest({_SPAN},1),6) AS detections_per_day,
  round(avg(CASE daynight WHEN 'N' THEN 1.0 ELSE 0.0 END),6) AS night_fraction, CAST(count(DISTINCT replace(source,'_NRT','')) AS DOUBLE) AS source_diversity FROM detections GROUP BY 1""")
def thermal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = features.thermal(views.detections(spark, sf_dir))
    return t.select("cluster_id", *[c if c in ("frp_max", "n_detections", "source_diversity") else r(c, 5 if c == "confidence_mean" else 6).alias(c) for c in t.columns[1:]])


_EXTENT = f"""
, ord AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY acq_datetime, id) AS rn, count(*) OVER (PARTITION BY cluster_id) AS n FROM detections),
places AS (SELECT cluster_id, lon, lat, min(rn) <= any_value(n) // 2 AS early FROM ord GROUP BY 1, 2, 3),
pair AS (SELECT a.cluster_id, {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')}/1000 AS km, a.early AND b.early AS early FROM places a JOIN places b ON a.cluster_id = b.cluster_id AND (a.lon < b.lon OR (a.lon = b.lon AND a.lat < b.lat))),
extent_of AS (SELECT cluster_id, max(km) AS extent, max(CASE WHEN early THEN km END) AS first_extent FROM pair GROUP BY 1),
spans AS (SELECT cluster_id, {_SPAN} AS span, count(*) AS n FROM detections GROUP BY 1),
extents AS (SELECT cluster_id, coalesce(extent,0) AS spatial_extent_km, CASE WHEN n < 4 OR span <= 0 THEN 0 ELSE (coalesce(extent,0)-coalesce(first_extent,0))/span END AS spatial_growth_rate FROM spans LEFT JOIN extent_of USING (cluster_id))"""


@query(_EXTENT + " SELECT cluster_id, round(spatial_extent_km,6) AS spatial_extent_km, round(spatial_growth_rate,6) AS spatial_growth_rate FROM extents")
def spatial_extent_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.extent_and_growth(views.detections(spark, sf_dir)).select("cluster_id", r("spatial_extent_km").alias("spatial_extent_km"), r("spatial_growth_rate").alias("spatial_growth_rate"))


_BASE = """
, lasts AS (SELECT cluster_id, max(acq_datetime) AS last FROM detections GROUP BY 1),
base AS (SELECT d.cluster_id, count(*) AS n_base, avg(frp) AS base_mean, stddev_pop(frp) AS base_std, quantile_cont(frp, 0.5) AS base_p50, quantile_cont(frp, 0.95) AS base_p95, max(frp) AS base_max
  FROM detections d JOIN lasts USING (cluster_id) WHERE acq_datetime < last AND acq_datetime >= last - INTERVAL 90 DAY GROUP BY 1)"""


@query(_BASE + """
SELECT cluster_id, n_base, round(CASE WHEN n_base >= 2 THEN base_mean END,6) AS base_mean, round(CASE WHEN n_base >= 2 THEN base_std END,6) AS base_std, round(base_p50,6) AS base_p50, round(base_p95,6) AS base_p95,
  round(CASE WHEN n_base >= 2 THEN CASE WHEN base_std = 0 THEN CASE WHEN abs(frp_max-base_mean) <= 1e-9*greatest(abs(frp_max),abs(base_mean)) THEN 0 WHEN frp_max > base_mean THEN 3 ELSE -3 END ELSE (frp_max-base_mean)/base_std END END,6) AS frp_zscore
FROM sites LEFT JOIN base USING (cluster_id)""")
def frp_baseline_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.detections(spark, sf_dir)
    both = views.sites(d).select("cluster_id", "frp_max").join(features.baseline(d), "cluster_id", "left")
    known = lambda c: F.when(F.col("n_base") >= 2, F.col(c))
    return both.select("cluster_id", "n_base", r(known("base_mean")).alias("base_mean"), r(known("base_std")).alias("base_std"), r("base_p50").alias("base_p50"), r("base_p95").alias("base_p95"), r(features.zscore(F.col("frp_max"), known("base_mean"), known("base_std"))).alias("frp_zscore"))


@query("""
, steps AS (SELECT cluster_id, frp, CASE WHEN epoch_us(acq_datetime) > lag(epoch_us(acq_datetime)) OVER w THEN (frp - lag(frp) OVER w)/((epoch_us(acq_datetime)-lag(epoch_us(acq_datetime)) OVER w)/3.6e9) END AS rate FROM detections WINDOW w AS (PARTITION BY cluster_id ORDER BY acq_datetime, id)),
g AS (SELECT cluster_id, max(frp) AS frp_max, max(CASE WHEN rate > 0 THEN rate END) AS rate FROM steps GROUP BY 1)
SELECT cluster_id, frp_max, round(rate,2) AS rate, frp_max >= 100 OR coalesce(rate >= 40, false) AS is_crown_fire FROM g""")
def crown_fire_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = features.frp_rates(views.detections(spark, sf_dir))
    crown = F.coalesce(F.col("frp_max") >= C.CROWN_FRP_MW, F.lit(False)) | F.coalesce(F.col("rate") >= C.CROWN_RATE_MW_H, F.lit(False))
    return g.select("cluster_id", "frp_max", r("rate", 2).alias("rate"), crown.alias("is_crown_fire"))


@query("""
SELECT cluster_id, max(frp) AS max_frp, round(max(brightness),6) AS max_brightness, max(acq_datetime) AS last_seen, count(*) AS n, round(avg(confidence),5) AS mean_confidence, arg_max(source, (acq_datetime, id)) AS sensor FROM detections GROUP BY 1""")
def hotspot_summary_latest_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.detections(spark, sf_dir).groupBy("cluster_id").agg(F.max("frp").alias("max_frp"), r(F.max("brightness")).alias("max_brightness"), F.max("acq_datetime").alias("last_seen"), F.count("*").alias("n"), r(F.avg("confidence"), 5).alias("mean_confidence"), F.max_by("source", F.struct("acq_datetime", "id")).alias("sensor"))


@query("""
, recent AS (SELECT * FROM detections QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY acq_datetime DESC, id DESC) <= 200)
SELECT cluster_id, max(frp) AS max_frp, count(*) AS n, round(avg(confidence),5) AS mean_confidence FROM recent GROUP BY 1""")
def hotspot_summary_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over each cluster's latest 200 detections."""
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("acq_datetime"), F.desc("id")))
    return views.detections(spark, sf_dir).withColumn("rank", rank).where("rank <= 200").groupBy("cluster_id").agg(F.max("frp").alias("max_frp"), F.count("*").alias("n"), r(F.avg("confidence"), 5).alias("mean_confidence"))


# --- joins -----------------------------------------------------------------------------------------

_NEAR = f"""
, cand AS (SELECT s.cluster_id, facility_id, name, facility_type, {hav('s.lon', 's.lat', 'f_lon', 'f_lat')} AS distance_m FROM sites s, facilities),
near AS (SELECT * FROM cand WHERE distance_m <= 5000)"""


def _near(spark: SparkSession, sf_dir: str, sites: DataFrame | None = None) -> DataFrame:
    points = sites or views.sites(views.detections(spark, sf_dir))
    return ingest.within_radius(points.select("cluster_id", "lon", "lat"), views.facilities(spark, sf_dir), C.SEARCH_RADIUS_M)


def _nearest(near: DataFrame) -> DataFrame:
    best = near.groupBy("cluster_id").agg(F.min(F.struct("distance_m", "facility_id", "facility_type")).alias("b"))
    return best.select("cluster_id", F.col("b.facility_id").alias("facility_id"), F.col("b.facility_type").alias("facility_type"), F.col("b.distance_m").alias("distance_m"))


_BEST = _NEAR + ", best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY distance_m, facility_id) = 1)"


@query(_BEST + " SELECT s.cluster_id, facility_id, facility_type, round(distance_m,3) AS distance_m, round(exp(-distance_m/500),6) AS weight FROM sites s LEFT JOIN best USING (cluster_id)")
def nearest_facility(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _nearest(_near(spark, sf_dir))
    return views.sites(views.detections(spark, sf_dir)).select("cluster_id").join(best, "cluster_id", "left").select("cluster_id", "facility_id", "facility_type", r("distance_m", 3).alias("distance_m"), r(scoring.proximity_weight(F.col("distance_m"))).alias("weight"))


_PRIOR = "CASE facility_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.TYPE_PRIORS.items()) + " ELSE 0.4 END"
_ATTR = _NEAR + f"""
, top25 AS (SELECT *, {_PRIOR}*exp(-distance_m/500) AS score FROM near QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY distance_m, facility_id) <= 25),
ranked AS (SELECT cluster_id, facility_id, facility_type, distance_m, score/sum(score) OVER (PARTITION BY cluster_id) AS probability, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, distance_m, facility_id) AS rank FROM top25)"""


def _attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("cluster_id")
    near = _near(spark, sf_dir).withColumn("seq", F.row_number().over(w.orderBy("distance_m", "facility_id"))).where(F.col("seq") <= C.MAX_CANDIDATES)
    scored = near.withColumn("score", scoring.candidate_score(F.col("distance_m"), F.col("facility_type"), F.lit(False)))
    return scored.withColumn("probability", F.when(F.sum("score").over(w) > 0, F.col("score") / F.sum("score").over(w)).otherwise(0.0)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "distance_m", "facility_id")))


@query(_ATTR + " SELECT cluster_id, facility_id, facility_type, round(distance_m,3) AS distance_m, round(probability,6) AS probability, CAST(rank AS INTEGER) AS rank FROM ranked")
def facility_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributed(spark, sf_dir).select("cluster_id", "facility_id", "facility_type", r("distance_m", 3).alias("distance_m"), r("probability").alias("probability"), "rank")


@query(_ATTR + " SELECT cluster_id, count(*) AS n, coalesce(max(CASE WHEN rank=1 THEN probability END) - max(CASE WHEN rank=2 THEN probability END) >= 0.25, true) AS confident FROM ranked GROUP BY 1")
def attribution_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda k: F.max(F.when(F.col("rank") == k, F.col("probability")))
    return _attributed(spark, sf_dir).groupBy("cluster_id").agg(F.count("*").alias("n"), F.coalesce(p(1) - p(2) >= C.CONFIDENT_MARGIN, F.lit(True)).alias("confident"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States as rings: a box for each nation with a bite out of its north-east corner."""
    n = F.col("n_nationkey").cast("double")
    x, y = F.lit(70.0) + F.pmod(n, F.lit(5.0)) * 5.0, F.lit(7.0) + F.floor(n / 5) * 5.0
    corner = lambda dx, dy: F.struct((x + dx).alias("lon"), (y + dy).alias("lat"))
    ring = F.array(corner(0.0, 0.0), corner(5.0, 0.0), corner(5.0, 2.5), corner(2.5, 5.0), corner(0.0, 5.0), corner(0.0, 0.0))
    return views.table(spark, sf_dir, "nation").select(F.col("n_name").alias("state"), ring.alias("ring"), x.alias("west"), y.alias("south"))


_RING = """
, boxes AS (SELECT n_name AS state, 70.0 + (n_nationkey % 5)*5.0 AS x, 7.0 + (n_nationkey // 5)*5.0 AS y FROM nation),
inside AS (SELECT cluster_id, state FROM sites s JOIN boxes b ON lon >= x AND lon < x+5 AND lat >= y AND lat < y+5 WHERE lat <= y+2.5 OR (lon - x) < 2.5 + (5-(lat-y)))"""


@query(_RING + " SELECT s.cluster_id, state FROM sites s LEFT JOIN inside USING (cluster_id)")
def point_in_polygon_admin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which state a cluster lies in: cells of the rings' boxes join the points, ray casting decides."""
    return _admin(spark, sf_dir, views.sites(views.detections(spark, sf_dir)))


def _admin(spark: SparkSession, sf_dir: str, sites: DataFrame) -> DataFrame:
    points = sites.select("cluster_id", "lon", "lat")
    size = 5.0
    rings = _boxes(spark, sf_dir).select("state", "ring", geo.cell(F.col("west") - 70.0, size).alias("cx"), geo.cell(F.col("south") - 7.0, size).alias("cy"))
    keyed = points.withColumn("cx", geo.cell(F.col("lon") - 70.0, size)).withColumn("cy", geo.cell(F.col("lat") - 7.0, size))
    hit = keyed.join(rings, ["cx", "cy"]).where(geo.point_in_ring(F.col("lon"), F.col("lat"), F.col("ring"))).groupBy("cluster_id").agg(F.min("state").alias("state"))
    return points.select("cluster_id").join(hit, "cluster_id", "left")


_ASOF = """
, hours_of AS (SELECT d.id, d.cluster_id, w.hour, w.wind_speed, w.wind_direction, w.cloud, w.is_day FROM detections d JOIN weather w ON w.cluster_id = d.cluster_id AND abs(epoch_us(d.acq_datetime)-epoch_us(w.hour)) <= 3600000000
  QUALIFY row_number() OVER (PARTITION BY d.id ORDER BY abs(epoch_us(d.acq_datetime)-epoch_us(w.hour)), w.hour) = 1),
winds AS (SELECT d.id, d.cluster_id, d.lon, d.lat, d.frp, d.acq_datetime, coalesce(wind_speed, 3.0) AS speed, coalesce(wind_direction, 0.0) AS direction, cloud, coalesce(is_day, hour(acq_datetime) BETWEEN 6 AND 18) AS day, hour IS NOT NULL AS measured FROM detections d LEFT JOIN hours_of USING (id))"""


def _winds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detection with the nearest hour of weather within an hour, or what is assumed without one.

    The hours around a detection are few and known, so the as-of join is an equi-join on the hour.
    """
    d = views.detections(spark, sf_dir)
    w = views.weather(d)
    hour = F.unix_timestamp(F.date_trunc("hour", "acq_datetime"))
    asked = d.select("id", "cluster_id", "acq_datetime", F.explode(F.array(hour, hour + 3600, hour - 3600)).alias("h")).withColumn("hour", F.timestamp_seconds("h"))
    gap = F.abs(F.unix_micros("acq_datetime") - F.unix_micros("hour"))
    best = asked.join(w, ["cluster_id", "hour"]).where(gap <= 3_600_000_000).groupBy("id").agg(F.min_by(F.struct("wind_speed", "wind_direction", "cloud", "is_day"), F.struct(gap, "hour")).alias("w"))
    x = d.join(best, "id", "left")
    return x.select("id", "cluster_id", "lon", "lat", "frp", "acq_datetime", F.coalesce("w.wind_speed", F.lit(3.0)).alias("speed"), F.coalesce("w.wind_direction", F.lit(0.0)).alias("direction"), F.col("w.cloud").alias("cloud"), F.coalesce("w.is_day", F.hour("acq_datetime").between(6, 18)).alias("day"), F.col("w").isNotNull().alias("measured"))


@query(_ASOF + " SELECT id, round(speed,6) AS speed, direction, cloud, day, measured FROM winds")
def asof_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _winds(spark, sf_dir).select("id", r("speed").alias("speed"), "direction", "cloud", "day", "measured")


_ALERTS = f"""
, alerts AS (SELECT lon + 0.0027 AS a_lon, lat AS a_lat, CASE WHEN id % 250 <> 0 THEN acq_datetime + INTERVAL 12 HOUR END AS a_time FROM detections WHERE id % 50 = 0),
alerted AS (SELECT DISTINCT s.cluster_id FROM sites s JOIN alerts ON {hav('s.lon', 's.lat', 'a_lon', 'a_lat')} <= 1000 AND (a_time IS NULL OR abs(epoch_us(a_time) - epoch_us(last_seen)) <= 86400000000))"""


def _alerted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.detections(spark, sf_dir)
    alerts = d.where("id % 50 = 0").select((F.col("lon") + 0.0027).alias("f_lon"), F.col("lat").alias("f_lat"), F.when(F.col("id") % 250 != 0, F.col("acq_datetime") + F.expr("interval 12 hours")).alias("a_time"))
    near = ingest.within_radius(views.sites(d).select("cluster_id", "lon", "lat", "last_seen"), alerts, 1000.0)
    return near.where(F.col("a_time").isNull() | (F.abs(F.unix_micros("a_time") - F.unix_micros("last_seen")) <= 86_400_000_000)).select("cluster_id").distinct()


@query(_ALERTS + " SELECT cluster_id FROM alerted")
def alert_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with a forest-fire alert within 1 km and a day (an undated alert needs the place only)."""
    return _alerted(spark, sf_dir)


# --- movement, corridors, plumes -------------------------------------------------------------------

_TRAJ = f"""
, bk AS (SELECT *, (epoch_us(acq_datetime) - min(epoch_us(acq_datetime)) OVER (PARTITION BY cluster_id)) // 43200000000 AS bucket FROM detections),
cen AS (SELECT cluster_id, bucket, min(epoch_us(acq_datetime)) AS t, avg(lon) AS lon, avg(lat) AS lat FROM bk GROUP BY 1, 2),
rec AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM (SELECT * FROM cen QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY bucket DESC) <= 6) WINDOW w AS (PARTITION BY cluster_id ORDER BY bucket)),
legs AS (SELECT *, {hav('plon', 'plat', 'lon', 'lat')} AS leg, degrees(atan2(sin(radians(lon-plon))*cos(radians(lat)), cos(radians(plat))*sin(radians(lat))-sin(radians(plat))*cos(radians(lat))*cos(radians(lon-plon)))) AS brg FROM rec),
agg AS (SELECT cluster_id, count(*) AS n_observations, arg_min(lon, bucket) AS lon0, arg_min(lat, bucket) AS lat0, arg_max(lon, bucket) AS lon1, arg_max(lat, bucket) AS lat1, (max(t)-min(t))/8.64e10 AS days, sum(leg)/1000 AS path,
  sum(CASE WHEN leg >= 1 THEN leg*sin(radians(brg)) END) AS x, sum(CASE WHEN leg >= 1 THEN leg*cos(radians(brg)) END) AS y, count(CASE WHEN leg >= 1 THEN 1 END) AS moves FROM legs GROUP BY 1),
net AS (SELECT *, {hav('lon0', 'lat0', 'lon1', 'lat1')}/1000 AS net, moves > 0 AND days > 0 AND n_observations >= 2 AS directed FROM agg),
traj AS (SELECT cluster_id, n_observations, CASE WHEN directed THEN (degrees(atan2(x, y)) + 360) % 360 END AS bearing, CASE WHEN directed THEN net/days ELSE 0 END AS rate_km_day, CASE WHEN n_observations >= 2 THEN net ELSE 0 END AS net_km, CASE WHEN directed AND path > 0 THEN greatest(0, least(1, net/path)) ELSE 0 END AS confidence FROM net)"""


@query(_TRAJ + " SELECT cluster_id, n_observations, round(bearing,4) AS bearing, round(rate_km_day,6) AS rate_km_day, round(net_km,6) AS net_km, round(confidence,6) AS confidence FROM traj")
def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = features.trajectory(views.detections(spark, sf_dir))
    return t.select("cluster_id", "n_observations", r("bearing", 4).alias("bearing"), r("rate_km_day").alias("rate_km_day"), r("net_km").alias("net_km"), r("confidence").alias("confidence"))


_CORR = _TRAJ + """
, corr AS (SELECT t.cluster_id, s.lon, s.lat, bearing, rate_km_day, 60 - 45*confidence AS half_angle, greatest(1.0, rate_km_day*72/24) AS length_km FROM traj t JOIN sites s USING (cluster_id) WHERE bearing IS NOT NULL AND rate_km_day > 0),
hits AS (SELECT c.*, f.facility_id, """ + hav("c.lon", "c.lat", "f_lon", "f_lat") + """/1000 AS distance_km, (degrees(atan2(sin(radians(f_lon-c.lon))*cos(radians(f_lat)), cos(radians(c.lat))*sin(radians(f_lat))-sin(radians(c.lat))*cos(radians(f_lat))*cos(radians(f_lon-c.lon)))) + 360) % 360 AS to_f FROM corr c, facilities f),
threatened AS (SELECT cluster_id, facility_id, distance_km, distance_km/rate_km_day*24 AS eta FROM hits WHERE distance_km <= length_km AND least(abs(to_f-bearing), 360-abs(to_f-bearing)) <= half_angle)"""


def _corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.detections(spark, sf_dir)
    t = features.trajectory(d).where("bearing is not null and rate_km_day > 0")
    sites = views.sites(d).select("cluster_id", "lon", "lat")
    return t.join(sites, "cluster_id").select("cluster_id", "lon", "lat", "bearing", "rate_km_day", scoring.corridor_half_angle(F.col("confidence")).alias("half_angle"), F.greatest(F.lit(1.0), F.col("rate_km_day") * 72 / 24).alias("length_km"))


@query(_CORR + " SELECT cluster_id, facility_id, round(distance_km,4) AS distance_km, round(eta,3) AS eta_hours FROM threatened")
def corridor_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _threatened(_corridors(spark, sf_dir), views.facilities(spark, sf_dir))


#: Upper lengths of corridors (km) that are joined together, with cells of that size.
_LENGTH_CLASSES = (50, 100, 200, 400, 800, 1600, 3200)


def _threatened(corridors: DataFrame, facilities: DataFrame) -> DataFrame:
    """Facilities inside each wedge: one grid join for each class of lengths, and one for all wedges beyond the last."""
    classes = []
    for above, to in zip((0, *_LENGTH_CLASSES), _LENGTH_CLASSES, strict=False):
        some = corridors.where((F.col("length_km") > above) & (F.col("length_km") <= to))
        classes.append(ingest.within_radius(some, facilities, to * 1000.0))
    classes.append(ingest.within_wedge(corridors.where(F.col("length_km") > _LENGTH_CLASSES[-1]), facilities))
    near = reduce(DataFrame.unionByName, classes)
    km = F.col("distance_m") / 1000.0
    off = geo.angular_difference(geo.bearing_deg(F.col("lon"), F.col("lat"), F.col("f_lon"), F.col("f_lat")), F.col("bearing"))
    hit = near.where((km <= F.col("length_km")) & (off <= F.col("half_angle")))
    return hit.select("cluster_id", "facility_id", r(km, 4).alias("distance_km"), r(scoring.hours_to_impact(km, F.col("rate_km_day")), 3).alias("eta_hours"))


@query(_TRAJ + """
, bent AS (SELECT t.cluster_id, bearing, confidence, (s.cluster_id*37 % 360 + 180.0) % 360 AS wind, 0.4*(1-confidence)+0.2*confidence AS w FROM traj t JOIN sites s USING (cluster_id))
SELECT cluster_id, round(CASE WHEN bearing IS NULL THEN wind ELSE (degrees(atan2((1-w)*sin(radians(bearing))+w*sin(radians(wind)), (1-w)*cos(radians(bearing))+w*cos(radians(wind)))) + 360) % 360 END,4) AS spread_bearing FROM bent""")
def spread_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed movement blended with the downwind direction, by how straight the movement was."""
    t = features.trajectory(views.detections(spark, sf_dir))
    wind = geo.downwind((F.col("cluster_id") * 37 % 360).cast("double"))
    w = 0.4 * (1 - F.col("confidence")) + 0.2 * F.col("confidence")
    x = (1 - w) * F.sin(F.radians("bearing")) + w * F.sin(F.radians(wind))
    y = (1 - w) * F.cos(F.radians("bearing")) + w * F.cos(F.radians(wind))
    return t.select("cluster_id", r(F.when(F.col("bearing").isNull(), wind).otherwise(geo.circular_mean(x, y, F.col("bearing"))), 4).alias("spread_bearing"))


_CLS = """CASE WHEN day THEN CASE WHEN speed < 2 THEN CASE WHEN c < 0.75 THEN 'A' ELSE 'B' END WHEN speed < 3 THEN CASE WHEN c < 0.35 THEN 'A' WHEN c < 0.75 THEN 'B' ELSE 'C' END
  WHEN speed < 5 THEN CASE WHEN c < 0.75 THEN 'B' ELSE 'C' END WHEN speed < 6 THEN CASE WHEN c < 0.75 THEN 'C' ELSE 'D' END ELSE CASE WHEN c < 0.35 THEN 'C' ELSE 'D' END END
  ELSE CASE WHEN speed < 2 THEN 'F' WHEN speed < 3 THEN CASE WHEN c < 0.5 THEN 'F' ELSE 'E' END WHEN speed < 5 THEN CASE WHEN c < 0.5 THEN 'E' ELSE 'D' END ELSE 'D' END END"""
_SY = "CASE cls " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.SIGMA_Y.items()) + " END"
_PLUME = _ASOF + f"""
, pl0 AS (SELECT *, coalesce(greatest(0, least(1, cloud)), 0.5) AS c FROM winds), pl1 AS (SELECT *, {_CLS} AS cls FROM pl0),
pl2 AS (SELECT *, 9.81*frp*1e6/0.17/(pi()*1.2*1004.0*293.0) AS flux, greatest(speed, 0.5) AS u,
  greatest(2000.0, least((5000.0+2000.0*speed)*CASE WHEN cls IN ('E','F') THEN 1.5 WHEN cls IN ('A','B') THEN 0.7 ELSE 1 END*(1+least(frp/500, 1)), 50000.0)) AS length_m, (direction + 180) % 360 AS travel FROM pl1),
pl3 AS (SELECT *, CASE WHEN frp <= 0 THEN 0 WHEN flux < 55 THEN 21.4*pow(flux,0.75)/u ELSE 38.7*pow(flux,0.6)/u END AS rise, {_SY}*length_m/sqrt(1+1e-4*length_m) AS sy,
  CASE cls WHEN 'A' THEN 0.2*length_m WHEN 'B' THEN 0.12*length_m WHEN 'C' THEN 0.08*length_m/sqrt(1+2e-4*length_m) WHEN 'D' THEN 0.06*length_m/sqrt(1+1.5e-3*length_m) WHEN 'E' THEN 0.03*length_m/(1+3e-4*length_m) ELSE 0.016*length_m/(1+3e-4*length_m) END AS sz FROM pl2)"""


def _plumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _winds(spark, sf_dir).withColumn("cls", physics.stability(F.col("speed"), F.col("day"), F.col("cloud")))
    return w.withColumn("length_m", physics.plume_length_m(F.col("speed"), F.col("cls"), F.col("frp"))).withColumn("rise", physics.plume_rise(F.col("frp"), F.col("speed")))


_HALF_WIDTH = _PLUME + f"""
, pl4 AS (SELECT *, sin(radians(travel)) AS sn, cos(radians(travel)) AS cs FROM pl3),
along AS (SELECT *, length_m*i/24 AS d FROM pl4, (SELECT unnest(range(25)) AS i)),
flanks AS (SELECT *, 2.146*{_SY}*d/sqrt(1+1e-4*d) AS w, lat + d*cs/111320.0 AS cy, lon + d*sn/(111320.0*cos(radians(lat))) AS cx FROM along)"""


def _flank(side: str) -> str:
    d = "length_m*i/24"
    w, y = f"{side}2.146*{_SY}*{d}/sqrt(1+1e-4*{d})", f"(lat + {d}*cs/111320.0)"
    return f"list_transform(range(25), lambda i: struct_pack(lon := lon + {d}*sn/(111320.0*cos(radians(lat))) + {w}*cs/(111320.0*cos(radians({y}))), lat := {y} - {w}*sn/111320.0))"


@query(_PLUME + f"""
, pl4 AS (SELECT *, sin(radians(travel)) AS sn, cos(radians(travel)) AS cs FROM pl3),
ringed AS (SELECT *, list_concat({_flank("")}, list_reverse({_flank("-")})) AS ring FROM pl4),
axes AS (SELECT *, list_transform(ring, lambda v: v.lon) AS lons, list_transform(ring, lambda v: v.lat) AS lats FROM ringed)
SELECT id, cls AS stability, round(length_m,3) AS length_m, round(rise,4) AS plume_rise_m, round(2.146*sy,3) AS half_width_m, len(ring) AS n_points,
  round((lats[25]+lats[26])/2,5) AS tip_lat, round(lats[13],5) AS middle_lat, round(lons[13],5) AS middle_lon,
  round(list_min(lons),5) AS west, round(list_min(lats),5) AS south, round(list_max(lons),5) AS east, round(list_max(lats),5) AS north FROM axes""")
def stability_plume_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stability, rise and footprint ring of every detection's plume: its vertices, its tip, the right flank halfway and its extent."""
    p, args = _footprints(spark, sf_dir)
    q = p.withColumn("ring", physics.plume_ring(*args))
    lons, lats = F.col("ring.lon"), F.col("ring.lat")
    # the flanks' last points lie opposite each other across the tip
    tip, middle = (F.get(lats, F.lit(24)) + F.get(lats, F.lit(25))) / 2, F.get("ring", F.lit(12))
    return q.select(
        "id", F.col("cls").alias("stability"), r("length_m", 3).alias("length_m"), r("rise", 4).alias("plume_rise_m"), r("spread", 3).alias("half_width_m"), F.size("ring").cast("long").alias("n_points"),
        r(tip, 5).alias("tip_lat"), r(middle["lat"], 5).alias("middle_lat"), r(middle["lon"], 5).alias("middle_lon"),
        r(F.array_min(lons), 5).alias("west"), r(F.array_min(lats), 5).alias("south"), r(F.array_max(lons), 5).alias("east"), r(F.array_max(lats), 5).alias("north"),
    )


def _footprints(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Column]]:
    """The plumes, and the columns that their contours are drawn from."""
    travel = F.radians(geo.downwind(F.col("direction")))
    p = _plumes(spark, sf_dir).withColumn("spread", C.LATERAL_MULTIPLE * physics.sigma_y(F.col("length_m"), F.col("cls"))).withColumn("east", F.sin(travel)).withColumn("north", F.cos(travel))
    return p, [F.col(c) for c in ("lon", "lat", "east", "north", "length_m", "spread")]


@query(_HALF_WIDTH + """
SELECT id, i AS seq, round(cx + w*cs/(111320.0*cos(radians(cy))),5) AS lon, round(cy - w*sn/111320.0,5) AS lat FROM flanks
UNION ALL SELECT id, 49 - i, round(cx - w*cs/(111320.0*cos(radians(cy))),5), round(cy + w*sn/111320.0,5) FROM flanks""")
def plume_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vertices of every detection's plume, in the order of its ring."""
    p, args = _footprints(spark, sf_dir)
    v = p.select("id", F.posexplode(physics.plume_ring(*args)).alias("seq", "v"))
    return v.select("id", F.col("seq").cast("long").alias("seq"), r("v.lon", 5).alias("lon"), r("v.lat", 5).alias("lat"))


@query(_PLUME + " SELECT id, round(1e6*(1000.0/(2*pi()*u*sy*sz))*exp(-(50.0*50.0)/(2*sy*sy))*(exp(-pow(2-rise,2)/(2*sz*sz))+exp(-pow(2+rise,2)/(2*sz*sz))),4) AS micrograms FROM pl3")
def plume_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the end of the plume, 50 m off its axis and 2 m up, for a kilogram a second."""
    p = _plumes(spark, sf_dir)
    return p.select("id", r(1e6 * physics.concentration(F.col("length_m"), F.lit(50.0), F.lit(2.0), F.lit(1000.0), F.col("speed"), F.col("rise"), F.col("cls")), 4).alias("micrograms"))


_RAD = "(2*6.62607015e-34*2.99792458e8*2.99792458e8/(pow({w},5)*(exp(6.62607015e-34*2.99792458e8/1.380649e-23/({w}*{t}))-1)))"


@query("SELECT id, round(" + _RAD.format(w="3.74e-6", t="brightness") + "/1e6,6) AS radiance_mir, round(" + _RAD.format(w="11.45e-6", t="brightness_tir") + "/1e6,6) AS radiance_tir, round(brightness,4) AS back_k FROM detections")
def planck_brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.detections(spark, sf_dir)
    mir, tir = physics.radiance(C.VIIRS_BANDS[0], F.col("brightness")), physics.radiance(C.VIIRS_BANDS[1], F.col("brightness_tir"))
    return d.select("id", r(mir / 1e6).alias("radiance_mir"), r(tir / 1e6).alias("radiance_tir"), r(physics.brightness_temperature(C.VIIRS_BANDS[0], mir), 4).alias("back_k"))


@query("""
SELECT id, CAST(500 + id % 13 * 50 AS DOUBLE) AS fire_k, round(pow(10.0, -(2.0 + id % 3)),6) AS fraction, CAST(295 + id % 11 AS DOUBLE) AS background_k FROM detections""")
def dozier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fires of known temperature and size, mixed into pixels by the forward model and retrieved again."""
    d = views.detections(spark, sf_dir).select("id", (500 + F.col("id") % 13 * 50).cast("double").alias("t"), F.pow(F.lit(10.0), -(2.0 + F.col("id") % 3)).alias("p"), (295 + F.col("id") % 11).cast("double").alias("b"))
    seen = lambda w: physics.brightness_temperature(w, physics.mixed_radiance(w, F.col("p"), F.col("t"), F.col("b")))
    pixels = d.withColumn("mir", seen(C.MODIS_BANDS[0])).withColumn("tir", seen(C.MODIS_BANDS[1]))
    found = physics.dozier(F.col("mir"), F.col("tir"), F.col("b"), F.lit("MODIS"))
    return pixels.withColumn("s", found).select("id", r("s.temperature_k", 2).alias("fire_k"), r("s.fraction").alias("fraction"), F.col("b").alias("background_k"))


# --- rhythm, persistence, forecasts ----------------------------------------------------------------

_SLOTS = f"""
, spn AS (SELECT cluster_id, {_SPAN} AS span_days FROM detections GROUP BY 1),
sl0 AS (SELECT cluster_id, replace(source,'_NRT','') AS platform, daynight, count(*) AS n, avg(cos(h/24*2*pi())) AS x, avg(sin(h/24*2*pi())) AS y FROM (SELECT *, (hour(acq_datetime)+minute(acq_datetime)/60.0+floor(second(acq_datetime))/3600.0+lon/15) % 24 AS h FROM detections) GROUP BY 1, 2, 3),
slots AS (SELECT s.*, span_days, greatest(span_days,1) AS expected, least(n/greatest(span_days,1),1) AS rate, ((atan2(y,x)/(2*pi())*24) % 24 + 24) % 24 AS mean_hour,
  CASE WHEN sqrt(x*x+y*y) >= 1 THEN 0 ELSE sqrt(-2*ln(greatest(sqrt(x*x+y*y),1e-12)))/(2*pi())*24 END AS spread_hours FROM sl0 s JOIN spn USING (cluster_id))"""


@query(_SLOTS + " SELECT cluster_id, platform, daynight, n, round(expected,6) AS expected, round(rate,6) AS rate, round(mean_hour,5) AS mean_hour, round(spread_hours,5) AS spread_hours FROM slots")
def overpass_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = temporal.slots(views.detections(spark, sf_dir))
    return s.select("cluster_id", "platform", "daynight", "n", r("expected").alias("expected"), r("rate").alias("rate"), r("mean_hour", 5).alias("mean_hour"), r("spread_hours", 5).alias("spread_hours"))


_RHYTHM = _SLOTS + """
, en AS (SELECT cluster_id, any_value(span_days) AS span_days, sum(n) AS n, count(*) AS k, sum(-p*ln(p)) AS h, avg(CASE WHEN daynight='D' THEN rate END) AS day, avg(CASE WHEN daynight='N' THEN rate END) AS night, min(CASE WHEN n >= 3 AND spread_hours > 2 THEN 0 ELSE 1 END) AS ok FROM (SELECT *, rate/sum(rate) OVER (PARTITION BY cluster_id) AS p FROM slots) GROUP BY 1),
wk AS (SELECT cluster_id, sum(CASE WHEN isodow(acq_datetime)=7 THEN 1 ELSE 0 END) AS su, sum(CASE WHEN isodow(acq_datetime)=7 THEN 0 ELSE 1 END) AS ot FROM detections GROUP BY 1),
lst AS (SELECT cluster_id, replace(arg_max(source,(acq_datetime,id)),'_NRT','') AS platform, arg_max(daynight,(acq_datetime,id)) AS daynight FROM detections GROUP BY 1),
an AS (SELECT cluster_id, least((n-1)/expected,1) < 0.15 AS anomaly FROM lst JOIN slots USING (cluster_id, platform, daynight)),
ry AS (SELECT *, ot/greatest(span_days/7,1/7.0)/6 AS wd, su/greatest(span_days/7,1/7.0) AS we FROM en JOIN wk USING (cluster_id) JOIN an USING (cluster_id))"""


@query(_RHYTHM + """
SELECT cluster_id, CAST(n AS BIGINT) AS n_observations, round(CASE WHEN n >= 8 AND k >= 2 THEN greatest(0,least(1,1-h/ln(k))) END,6) AS shift_sharpness, round(CASE WHEN n >= 8 AND day+night > 0 THEN (day-night)/(day+night) END,6) AS day_night_contrast,
  round(CASE WHEN n >= 8 AND span_days >= 14 THEN CASE WHEN wd <= 0 THEN CASE WHEN we > 0 THEN -1 END ELSE greatest(-1,least(1,(wd-we)/wd)) END END,6) AS weekend_suppression, n >= 8 AND anomaly AS schedule_anomaly, ok = 1 AS slots_consistent FROM ry""")
def rhythm_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = temporal.rhythm(views.detections(spark, sf_dir))
    return f.select("cluster_id", "n_observations", *[r(c).alias(c) for c in ("shift_sharpness", "day_night_contrast", "weekend_suppression")], "schedule_anomaly", "slots_consistent")


_DAILY = """
, dy AS (SELECT cluster_id, CAST(acq_datetime AS DATE) AS day, count(*) AS n FROM detections GROUP BY 1, 2),
gd AS (SELECT cluster_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM dy GROUP BY 1),
daily AS (SELECT g.cluster_id, g.day, coalesce(n,0) AS n FROM gd g LEFT JOIN dy USING (cluster_id, day))"""


@query(_DAILY + " SELECT * FROM daily")
def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.daily_series(views.detections(spark, sf_dir))


_POWER = _DAILY + """
, sx AS (SELECT cluster_id, row_number() OVER w - 1 AS i, count(*) OVER p AS size, n - avg(n) OVER p AS v FROM daily WINDOW w AS (PARTITION BY cluster_id ORDER BY day), p AS (PARTITION BY cluster_id)),
wv AS (SELECT cluster_id, k, size, sum(v*cos(2*pi()*k*i/size)) AS re, sum(v*sin(2*pi()*k*i/size)) AS im FROM sx, (SELECT unnest(range(1, 400)) AS k) WHERE size >= 14 AND k <= size // 2 GROUP BY 1, 2, 3),
power AS (SELECT cluster_id, k, size/k AS period_days, re*re+im*im AS power FROM wv WHERE size/k BETWEEN 2 AND 30)"""


@query(_POWER + " SELECT cluster_id, k, round(period_days,6) AS period_days, round(power,4) AS power FROM power")
def periodogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = temporal.periodogram(temporal.daily_series(views.detections(spark, sf_dir)))
    return p.select("cluster_id", "k", r("period_days").alias("period_days"), r("power", 4).alias("power"))


@query(_POWER + """
, mx AS (SELECT cluster_id, arg_max(period_days, (power, -k)) AS p, max(power)/sum(power) AS share, sum(power) AS total FROM power GROUP BY 1)
SELECT cluster_id, round(p,6) AS period_days, round(share,5) AS confidence, abs(p-7) <= 0.75 AS weekly FROM mx WHERE total > 1e-9""")
def dominant_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = temporal.dominant_period(temporal.periodogram(temporal.daily_series(views.detections(spark, sf_dir))))
    return p.select("cluster_id", r("period_days").alias("period_days"), r("confidence", 5).alias("confidence"), "weekly")


_PTSI = _RHYTHM + _BASE + """
, cur AS (SELECT cluster_id, arg_max(frp,(acq_datetime,id)) AS current FROM detections GROUP BY 1), mr AS (SELECT cluster_id, max(rate) AS rate, any_value(span_days) AS span_days FROM slots GROUP BY 1),
pt0 AS (SELECT m.cluster_id, rate, span_days, current, CASE WHEN n_base >= 5 THEN base_mean END AS mean, CASE WHEN n_base >= 5 THEN greatest(base_std,0.5) END AS std FROM mr m LEFT JOIN base USING (cluster_id) JOIN cur USING (cluster_id)),
pt1 AS (SELECT *, 0.40*CASE WHEN span_days > 0 THEN least(span_days/30,1) ELSE 0 END + 0.35*greatest(0,least(coalesce(rate,0),1)) + 0.25*CASE WHEN mean > 0 THEN greatest(0,1-least(std/mean,1)) ELSE 0 END AS score FROM pt0),
ptsi AS (SELECT cluster_id, score, CASE WHEN score >= 0.6 THEN 'persistent' WHEN score >= 0.3 THEN 'intermittent' ELSE 'transient' END AS source_class, (current-mean)/std AS sigma, CASE WHEN mean > 0 THEN current/mean END AS multiple, abs((current-mean)/std) < 3 AS normal, mean, std, current FROM pt1)"""


def _ptsi(spark: SparkSession, sf_dir: str, points: DataFrame | None = None) -> DataFrame:
    d = points or views.detections(spark, sf_dir)
    best = temporal.slots(d).groupBy("cluster_id").agg(F.max("rate").alias("rate"), F.first("span_days").alias("span_days"))
    current = d.groupBy("cluster_id").agg(F.max_by("frp", F.struct("acq_datetime", "id")).alias("current"))
    base = features.baseline(d).select("cluster_id", F.when(F.col("n_base") >= C.MIN_BASELINE, F.col("base_mean")).alias("mean"), F.when(F.col("n_base") >= C.MIN_BASELINE, F.greatest("base_std", F.lit(C.MIN_BASELINE_STD))).alias("std"))
    x = best.join(base, "cluster_id", "left").join(current, "cluster_id")
    score = scoring.ptsi(scoring.longevity(F.col("span_days")), scoring.reliability(F.col("rate")), scoring.steadiness(F.col("mean"), F.col("std")))
    sigma = (F.col("current") - F.col("mean")) / F.col("std")
    return x.withColumn("score", score).select("cluster_id", "score", scoring.source_class(F.col("score")).alias("source_class"), sigma.alias("sigma"), F.when(F.col("mean") > 0, F.col("current") / F.col("mean")).alias("multiple"), (F.abs(sigma) < C.NORMAL_SIGMA).alias("normal"), "mean", "std", "current")


@query(_PTSI + " SELECT cluster_id, round(score,6) AS score, source_class, round(sigma,6) AS sigma, round(multiple,6) AS multiple, normal FROM ptsi")
def ptsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ptsi(spark, sf_dir).select("cluster_id", r("score").alias("score"), "source_class", r("sigma").alias("sigma"), r("multiple").alias("multiple"), "normal")


_FRESH = """
, gp AS (SELECT cluster_id, acq_datetime, (epoch_us(acq_datetime)-lag(epoch_us(acq_datetime)) OVER (PARTITION BY cluster_id ORDER BY acq_datetime, id))/3.6e9 AS gap FROM detections),
cd AS (SELECT cluster_id, max(acq_datetime) AS last_seen, CASE WHEN count(*) >= 3 THEN quantile_cont(CASE WHEN gap > 0 THEN gap END, 0.5) END AS cadence FROM gp GROUP BY 1),
ag AS (SELECT *, (epoch_us((SELECT max(acq_datetime) FROM detections))-epoch_us(last_seen))/3.6e9*20 AS age FROM cd),
fresh AS (SELECT *, CASE WHEN age >= 72 THEN 'STALE' WHEN age <= CASE WHEN cadence > 0 THEN cadence*1.5 ELSE 12 END THEN 'FRESH' WHEN age <= CASE WHEN cadence > 0 THEN cadence*3 ELSE 36 END THEN 'MODERATE' ELSE 'STALE' END AS label FROM ag)"""


def _freshness(d: DataFrame) -> DataFrame:
    """Ages against the newest detection of all, stretched by 20 as the fixture's sites are all seen to the end."""
    now = d.agg(F.max(F.unix_micros("acq_datetime")).alias("now"))
    c = temporal.cadence(d).crossJoin(F.broadcast(now))  # one row
    age = (F.col("now") - F.unix_micros("last_seen")) / 3.6e9 * 20
    return c.select("cluster_id", "last_seen", "cadence_hours", age.alias("age_hours"), scoring.freshness(age, F.col("cadence_hours")).alias("label"))


@query(_FRESH + " SELECT cluster_id, round(cadence,6) AS cadence_hours, round(age,6) AS age_hours, label FROM fresh")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _freshness(views.detections(spark, sf_dir)).select("cluster_id", r("cadence_hours").alias("cadence_hours"), r("age_hours").alias("age_hours"), "label")


_NOISE = "pow(greatest(0.30*abs({f}), 1.0), 2)"
_KALMAN = f"""
, sr AS (SELECT cluster_id, (epoch_us(acq_datetime)-min(epoch_us(acq_datetime)) OVER (PARTITION BY cluster_id))/3.6e9 AS t, frp AS f, row_number() OVER (PARTITION BY cluster_id ORDER BY acq_datetime, id) AS rn FROM detections WHERE frp >= 0),
kal AS (WITH RECURSIVE k(cluster_id, rn, t, f, r, a, b, d, nis) AS (
  SELECT cluster_id, rn, t, f, CAST(0 AS DOUBLE), {_NOISE.format(f='f')}, CAST(0 AS DOUBLE), pow(greatest(abs(f),5.0)/24.0, 2), CAST(0 AS DOUBLE) FROM sr WHERE rn = 1
  UNION ALL
  SELECT cluster_id, rn, t, pf + g*e, r + h*e, pa - g*pa, 0.5*((pb - g*pb) + (pb - h*pa)), pd - h*pb, nis + e*e/s FROM (
    SELECT *, pa/s AS g, pb/s AS h, z - pf AS e FROM (
      SELECT *, pa + {_NOISE.format(f='z')} AS s FROM (
        SELECT *, a + 2*dt*b + dt*dt*d + q*dt*dt*dt/3.0 AS pa, b + dt*d + q*dt*dt/2.0 AS pb, d + q*dt AS pd FROM (
          SELECT *, 1e-7*pow(greatest(abs(greatest(pf, f)),5.0),2) AS q FROM (
            SELECT k.cluster_id, n.rn, n.t, n.f AS z, k.f, k.r, k.a, k.b, k.d, k.nis, n.t - k.t AS dt, k.f + k.r*(n.t-k.t) AS pf FROM k JOIN sr n ON n.cluster_id = k.cluster_id AND n.rn = k.rn + 1)))))
) SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY rn DESC) = 1)"""


@query(_KALMAN + " SELECT cluster_id, round(f,5) AS frp, round(r,6) AS rate, round(a,4) AS var_frp, round(b,5) AS cov, round(d,6) AS var_rate, rn AS n_updates, round(nis/(rn-1),5) AS mean_nis FROM kal")
def kalman_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = temporal.kalman(views.detections(spark, sf_dir))
    return k.select("cluster_id", r("frp", 5).alias("frp"), r("rate").alias("rate"), r("var_frp", 4).alias("var_frp"), r("cov", 5).alias("cov"), r("var_rate").alias("var_rate"), "n_updates", r("mean_nis", 5).alias("mean_nis"))


_WALK = f"""
, fs AS (SELECT cluster_id, t, f, row_number() OVER (PARTITION BY cluster_id ORDER BY t, f) AS rn FROM sr),
walk AS (WITH RECURSIVE k(cluster_id, rn, t, f, r, a, b, d, recent, actual, predicted, std) AS (
  SELECT cluster_id, rn, t, f, CAST(0 AS DOUBLE), {_NOISE.format(f='f')}, CAST(0 AS DOUBLE), pow(greatest(abs(f),5.0)/24.0, 2), CAST([] AS DOUBLE[]), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM fs WHERE rn = 1
  UNION ALL
  SELECT cluster_id, rn, t, pf + g*e, r + h*e, pa - g*pa, 0.5*((pb - g*pb) + (pb - h*pa)), pd - h*pb, list_append(CASE WHEN len(recent) >= 5 THEN recent[2:5] ELSE recent END, e*e/s), z, pf, 2.5*sqrt(greatest(va, 0)) FROM (
    SELECT *, pa/s AS g, pb/s AS h, z - pf AS e FROM (
      SELECT *, pa + {_NOISE.format(f='z')} AS s FROM (
        SELECT *, a + 2*dt*b + dt*dt*d + q*u*dt*dt*dt/3.0 AS pa, b + dt*d + q*u*dt*dt/2.0 AS pb, d + q*u*dt AS pd, a + 2*dt*b + dt*dt*d + q*dt*dt*dt/3.0 + {_NOISE.format(f='greatest(pf,0)')} AS va FROM (
          SELECT *, 1e-7*pow(greatest(abs(greatest(pf, f)),5.0),2) AS q, CASE WHEN len(recent) < 2 THEN 1.0 ELSE greatest(1.0, least(list_sum(recent)/len(recent), 25.0)) END AS u FROM (
            SELECT k.cluster_id, n.rn, n.t, n.f AS z, k.f, k.r, k.a, k.b, k.d, k.recent, n.t - k.t AS dt, k.f + k.r*(n.t-k.t) AS pf FROM k JOIN fs n ON n.cluster_id = k.cluster_id AND n.rn = k.rn + 1)))))
) SELECT *, abs(actual - predicted) AS error FROM k WHERE rn > 4)"""


@query(_KALMAN[: _KALMAN.index(",\nkal AS")] + _WALK + " SELECT cluster_id, rn - 1 AS i, round(actual,6) AS actual, round(predicted,5) AS predicted, round(std,5) AS std FROM walk")
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was predicted for every observation after a cluster's fourth, from those before it."""
    w = temporal.walk_forward(views.detections(spark, sf_dir))
    return w.select("cluster_id", "i", r("actual").alias("actual"), r("predicted", 5).alias("predicted"), r("std", 5).alias("std"))


@query(_KALMAN[: _KALMAN.index(",\nkal AS")] + _WALK + f"""
, cal AS (SELECT cluster_id, count(*) AS n, avg(CASE WHEN error <= {C.Z50}*std THEN 1.0 ELSE 0.0 END) AS c50, avg(CASE WHEN error <= {C.Z90}*std THEN 1.0 ELSE 0.0 END) AS c90, avg(error) AS mae, quantile_cont(error, 0.5) AS median, avg((actual - predicted)/std) AS off FROM walk GROUP BY 1)
SELECT cluster_id, n, round(c50,5) AS coverage_50, round(c90,5) AS coverage_90, round(mae,5) AS mae, round(median,5) AS median_error, round(off,5) AS mean_normalised, CASE WHEN c90 < 0.75 THEN 'OVERCONFIDENT' WHEN c90 > 0.98 THEN 'OVER-CONSERVATIVE' ELSE 'CALIBRATED' END AS verdict FROM cal""")
def walk_forward_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = temporal.calibration(temporal.walk_forward(views.detections(spark, sf_dir)))
    return c.select("cluster_id", "n", *[r(x, 5).alias(x) for x in ("coverage_50", "coverage_90", "mae", "median_error", "mean_normalised")], "verdict")


def _escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.detections(spark, sf_dir)
    p = _ptsi(spark, sf_dir).select("cluster_id", scoring.critical_threshold(F.col("mean"), F.col("std")).alias("threshold"))
    return temporal.escalation(temporal.kalman(d).join(p, "cluster_id"))


@query()
def escalation_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _escalation(spark, sf_dir)
    return e.select("cluster_id", r("threshold").alias("threshold"), "escalating", "already_critical", *[r(c, 4).alias(c) for c in ("hours_to_critical", "p05", "p25", "p75", "p95")], r("probability").alias("probability"))


# --- hazard scores ---------------------------------------------------------------------------------

_CLASS_ARRAY = "[" + ",".join(f"'{c}'" for c in C.CLASSES) + "]"
_FACTS = _EXTENT + _BEST[_BEST.index(", cand"):] + _TRAJ + f"""
, facts AS (SELECT s.*, CASE WHEN s.cluster_id % 7 <> 0 THEN {_CLASS_ARRAY}[s.cluster_id % 5 + 1] END AS predicted, spatial_extent_km, spatial_growth_rate, distance_m, facility_type, facility_id, rate_km_day, bearing,
  CASE WHEN s.cluster_id % 4 <> 0 THEN CAST(s.cluster_id * 731 % 9000 AS DOUBLE) END AS built_m, CAST(s.cluster_id % 20 AS DOUBLE) AS people FROM sites s JOIN extents USING (cluster_id) LEFT JOIN best USING (cluster_id) JOIN traj USING (cluster_id))"""


def _predicted() -> Column:
    key = F.col("cluster_id")
    return F.when(key % 7 != 0, F.element_at(F.array(*map(F.lit, C.CLASSES)), (key % 5 + 1).cast("int")))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each cluster with what the hazard scores need; class, built-up distance and people are made up."""
    d = views.detections(spark, sf_dir)
    key = F.col("cluster_id")
    parts = (features.extent_and_growth(d), _nearest(_near(spark, sf_dir)), features.trajectory(d).select("cluster_id", "rate_km_day", "bearing"))
    out = views.sites(d)
    for part, how in zip(parts, ("inner", "left", "inner"), strict=True):
        out = out.join(part, "cluster_id", how)
    return out.withColumn("predicted", _predicted()).withColumn("built_m", F.when(key % 4 != 0, (key * 731 % 9000).cast("double"))).withColumn("people", (key % 20).cast("double"))


_WUI = """
, w0 AS (SELECT *, CASE WHEN greatest(rate_km_day, CASE WHEN spatial_growth_rate > 0 THEN spatial_growth_rate ELSE 0 END) <= 0 THEN NULL WHEN built_m <= 0 THEN 0 ELSE built_m/1000/greatest(rate_km_day, CASE WHEN spatial_growth_rate > 0 THEN spatial_growth_rate ELSE 0 END)*24 END AS eta FROM facts),
w1 AS (SELECT *, CASE WHEN built_m IS NULL THEN 'MONITOR' WHEN built_m <= 2400 OR coalesce(eta BETWEEN 0 AND 12, false) THEN 'CRITICAL_AIR_TANKER_DISPATCH' WHEN built_m <= 7200 THEN 'WATCH' ELSE 'MONITOR' END AS raw FROM w0),
wui AS (SELECT *, CASE WHEN raw = 'CRITICAL_AIR_TANKER_DISPATCH' AND NOT ((cluster_id % 3 = 0 OR people >= 8) AND cluster_id % 2 = 0) THEN 'WATCH' ELSE raw END AS priority FROM w1)"""


def _wui(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir)
    rate = F.greatest("rate_km_day", F.when(F.col("spatial_growth_rate") > 0, F.col("spatial_growth_rate")).otherwise(0.0))
    f = f.withColumn("eta", scoring.hours_to_impact(F.col("built_m") / 1000, rate))
    f = f.withColumn("raw", scoring.wui_priority(F.col("built_m"), F.col("eta")))
    return f.withColumn("priority", scoring.gated_priority(F.col("raw"), F.col("cluster_id") % 3 == 0, scoring.populated(F.col("people")), F.col("cluster_id") % 2 == 0))


@query(_FACTS + _WUI + " SELECT cluster_id, round(eta,4) AS eta_hours, raw AS raw_priority, priority FROM wui")
def wui_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wui(spark, sf_dir).select("cluster_id", r("eta", 4).alias("eta_hours"), F.col("raw").alias("raw_priority"), "priority")


_RDI = """
, r0 AS (SELECT *, CASE WHEN spatial_extent_km > 0 THEN pi()*pow(spatial_extent_km/2,2)*100 ELSE 0 END AS ha FROM facts),
r1 AS (SELECT *, round(least(CASE WHEN frp_max > 0 THEN least(frp_max/150*35,35) ELSE 0 END + CASE WHEN built_m/1000 <= 2.4 THEN 40 WHEN built_m/1000 <= 10 THEN 40-35*((built_m/1000-2.4)/7.6) ELSE 5 END + CASE WHEN ha > 0 THEN least(ha/500*25,25) ELSE 0 END,100),1) AS rdi FROM r0),
rd AS (SELECT *, CASE WHEN rdi >= 80 THEN 'FULL_SUPPRESSION_AIR_TANKERS' WHEN rdi >= 50 THEN 'POINT_ZONE_PROTECTION' ELSE 'MONITOR_ECOLOGICAL_BENEFIT' END AS coa FROM r1)"""


def _rdi(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir).withColumn("ha", scoring.footprint_ha(F.col("spatial_extent_km")))
    f = f.withColumn("rdi", scoring.rdi(F.col("frp_max"), F.col("built_m"), F.col("ha")))
    return f.withColumn("coa", scoring.course_of_action(F.col("rdi")))


@query(_FACTS + _RDI + " SELECT cluster_id, round(ha,4) AS area_ha, rdi AS rdi_score, coa AS coa_type FROM rd")
def rdi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rdi(spark, sf_dir).select("cluster_id", r("ha", 4).alias("area_ha"), F.col("rdi").alias("rdi_score"), F.col("coa").alias("coa_type"))


_TRIP = "CASE WHEN {v} > 0 THEN greatest(1, ceil({v}/{d})) ELSE 0 END"
_SUPP = _RDI + """
, s0 AS (SELECT *, coalesce(predicted,'') AS kind, greatest(ha, 14.0625) AS eha, CASE WHEN frp_max > 0 THEN least(1+frp_max/50,3) ELSE 1 END AS m FROM rd),
s1 AS (SELECT *, coa = 'FULL_SUPPRESSION_AIR_TANKERS' OR frp_max >= 100 OR eha >= 50 AS air, eha*m*CASE kind WHEN 'industrial_fire' THEN 975000 WHEN 'gas_flare' THEN 500 WHEN 'wildfire' THEN 10000 ELSE 3000 END AS l, eha*m*5000 AS m3 FROM s0)"""


@query(_FACTS + _SUPP + f"""
SELECT cluster_id, CASE kind WHEN 'industrial_fire' THEN 'foam' WHEN 'gas_flare' THEN 'fuel_isolation' WHEN 'mining' THEN 'excavation_and_smothering' ELSE 'water' END AS resource_kind, round(eha,2) AS effective_ha, round(m,2) AS multiplier, air AS air_support,
  CASE WHEN kind <> 'mining' THEN round(l,0) END AS volume_l, CASE WHEN kind = 'mining' THEN round(m3,0) END AS volume_m3, CAST(CASE WHEN kind = 'mining' THEN 0 ELSE {_TRIP.format(v='l', d=5000)} END AS BIGINT) AS tanker_trips,
  CAST(CASE WHEN kind NOT IN ('industrial_fire','gas_flare','mining') AND air THEN {_TRIP.format(v='l', d=3000)} ELSE 0 END AS BIGINT) AS air_drops, CAST(CASE WHEN kind = 'mining' THEN {_TRIP.format(v='m3', d=10)} ELSE 0 END AS BIGINT) AS truck_loads,
  CAST(CASE WHEN kind = 'gas_flare' THEN 1 ELSE 0 END AS INTEGER) AS well_control_units FROM s1""")
def suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _rdi(spark, sf_dir)
    parts = scoring.suppression(F.col("predicted"), F.col("frp_max"), F.col("ha"), F.col("coa"), F.lit("VIIRS"))
    return f.select("cluster_id", *[c.alias(n) for n, c in parts.items()])


# --- labels, evidence, models ----------------------------------------------------------------------

_CROP, _FOREST = "CAST(cluster_id * 17 % 101 AS DOUBLE)/100", "CAST(cluster_id * 29 % 101 AS DOUBLE)/100"
_VOTES = _ALERTS + f"""
, lf AS (SELECT f.*, {_CROP} AS crop, {_FOREST} AS forest, {_SPAN.replace('max(acq_datetime)', 'last_seen').replace('min(acq_datetime)', 'first_seen')} AS persist, a.cluster_id IS NOT NULL AS alerted, 73.8 + (f.cluster_id % 5) AS vlon, 29.5 + (f.cluster_id % 4) AS vlat FROM facts f LEFT JOIN alerted a USING (cluster_id)),
vt AS (SELECT cluster_id, [
  {{'c': CASE WHEN facility_type = 'flare' AND distance_m <= 500 THEN CASE WHEN persist >= 3 THEN 0.90 ELSE 0.60 END END, 'o': 0, 'l': 'gas_flare'}},
  {{'c': CASE WHEN facility_type = 'mine' AND distance_m <= 500 AND persist >= 3 THEN 0.85 END, 'o': -1, 'l': 'mining'}},
  {{'c': CASE WHEN vlon BETWEEN 73.8 AND 77.6 AND vlat BETWEEN 29.5 AND 32.6 AND month(last_seen + INTERVAL 90 DAY) IN (4,5,10,11) AND crop >= 0.6 AND NOT coalesce(persist > 50, false) AND NOT coalesce(distance_m <= 500, false) THEN 0.80 END, 'o': -2, 'l': 'agricultural_burning'}},
  {{'c': CASE WHEN alerted THEN 0.92 WHEN forest >= 0.5 AND NOT coalesce(distance_m < 1000, false) THEN CASE WHEN spatial_growth_rate > 0.05 THEN 0.75 ELSE 0.60 END END, 'o': -3, 'l': 'wildfire'}},
  {{'c': CASE WHEN facility_type IN ('refinery','industrial','power','oil_well','steel','LNG') AND distance_m <= 500 AND persist >= 14 THEN 0.85 END, 'o': -4, 'l': 'industrial_fire'}}] AS v FROM lf),
vs AS (SELECT cluster_id, list_filter(v, lambda x: x.c IS NOT NULL) AS v FROM vt),
vb AS (SELECT cluster_id, len(v) AS n_votes, list_sort(v, 'DESC')[1] AS best, v FROM vs),
vr AS (SELECT *, list_max([x.c FOR x IN v IF x.l <> best.l]) AS rival FROM vb)"""


def _voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir).join(_alerted(spark, sf_dir).withColumn("alerted", F.lit(True)), "cluster_id", "left")
    key = F.col("cluster_id")
    persist = (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 8.64e10
    # the fixture's month and place are moved into the rule's season and belt, and its span is shortened for that rule
    short = F.when(persist > 50, persist).otherwise(F.least(persist, F.lit(5.0)))
    args = (key % 5 + 73.8, key % 4 + 29.5, F.col("last_seen") + F.expr("interval 90 days"), F.col("facility_type"), F.col("distance_m"))
    rest = ((key * 17 % 101).cast("double") / 100, (key * 29 % 101).cast("double") / 100, F.col("spatial_growth_rate"), F.col("alerted"))
    long_votes = scoring.votes(*args, persist, F.lit(None).cast("double"), *rest)
    agri = F.filter(scoring.votes(*args, short, F.lit(None).cast("double"), *rest), lambda v: v["label"] == "agricultural_burning")
    return f.withColumn("votes", F.concat(F.filter(long_votes, lambda v: v["label"] != "agricultural_burning"), agri))


@query(_FACTS + _VOTES + " SELECT cluster_id, CAST(n_votes AS INTEGER) AS n_votes, best.l AS top_label, round(CAST(best.c AS DOUBLE),2) AS top_confidence FROM vr")
def label_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _voted(spark, sf_dir).withColumn("best", F.array_max("votes"))
    return v.select("cluster_id", F.size("votes").alias("n_votes"), F.col("best.label").alias("top_label"), r("best.confidence", 2).alias("top_confidence"))


@query(_FACTS + _VOTES + " SELECT cluster_id, CASE WHEN n_votes > 0 AND NOT coalesce(CAST(best.c AS DOUBLE) - CAST(rival AS DOUBLE) < 0.1, false) THEN best.l END AS label, n_votes > 0 AND coalesce(CAST(best.c AS DOUBLE) - CAST(rival AS DOUBLE) < 0.1, false) AS ambiguous FROM vr")
def resolve_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _voted(spark, sf_dir).withColumn("won", scoring.resolved(F.col("votes")))
    return v.select("cluster_id", F.col("won.label").alias("label"), ((F.size("votes") > 0) & F.col("won").isNull()).alias("ambiguous"))


@query("""
, tl AS (SELECT floor(lon/0.5) AS tx, floor(lat/0.5) AS ty, count(*) AS n, min(md5(concat(CAST(floor(lon/0.5) AS BIGINT), ':', CAST(floor(lat/0.5) AS BIGINT), ':42'))) AS h FROM sites GROUP BY 1, 2),
cu AS (SELECT *, coalesce(sum(n) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY h) AS pos, count(*) OVER () AS tiles, sum(n) OVER () AS total FROM tl)
SELECT CAST(tx AS BIGINT) AS tile_x, CAST(ty AS BIGINT) AS tile_y, n, before < greatest(1, round(total*0.2)) AND pos < tiles AS is_test FROM cu""")
def spatial_tile_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tiles of half a degree held out, in the order of a seeded hash, until a fifth of the rows is reached.

    The running total is over one row for each tile, of which there are at most as many as tiles on earth.
    """
    s = views.sites(views.detections(spark, sf_dir))
    tiles = s.groupBy(geo.cell(F.col("lon"), 0.5).alias("tile_x"), geo.cell(F.col("lat"), 0.5).alias("tile_y")).agg(F.count("*").alias("n"))
    tiles = tiles.withColumn("h", F.md5(F.concat_ws(":", "tile_x", "tile_y", F.lit("42")).cast("binary")))
    w = Window.orderBy("h")
    every = Window.partitionBy()
    t = tiles.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("pos", F.row_number().over(w)).withColumn("tiles", F.count("*").over(every)).withColumn("total", F.sum("n").over(every))
    return t.select("tile_x", "tile_y", "n", ((F.col("before") < F.greatest(F.lit(1.0), F.round(F.col("total") * 0.2))) & (F.col("pos") < F.col("tiles"))).alias("is_test"))


@query("""
, cw AS (SELECT source AS label, count(*) AS n FROM detections GROUP BY 1), rw AS (SELECT *, sum(n) OVER ()/(count(*) OVER ()*n) AS raw FROM cw)
SELECT label, n, round(raw/avg(raw) OVER (),6) AS weight FROM rw""")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse frequencies, scaled to a mean of 1: one row for each class."""
    c = views.detections(spark, sf_dir).groupBy(F.col("source").alias("label")).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    raw = c.withColumn("raw", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))
    return raw.select("label", "n", r(F.col("raw") / F.avg("raw").over(every)).alias("weight"))


@query("""
, ev AS (SELECT cluster_id, cluster_id % 2 = 0 AS context, true AS thermal, cluster_id % 3 <> 0 AS temporal, true AS spatial, cluster_id % 5 = 0 AS imagery, cluster_id % 4 <> 1 AS rhythm FROM sites),
wt AS (SELECT *, 0.25 + 0.10 + CASE WHEN context THEN 0.30 ELSE 0 END + CASE WHEN temporal THEN 0.20 ELSE 0 END + CASE WHEN imagery THEN 0.10 ELSE 0 END + CASE WHEN rhythm THEN 0.05 ELSE 0 END AS w FROM ev)
SELECT cluster_id, context, imagery, rhythm, round(CAST(w AS DOUBLE),4) AS available_weight, round(0.5+0.5*CAST(w AS DOUBLE),4) AS multiplier FROM wt""")
def evidence_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("cluster_id")
    present = {"context": key % 2 == 0, "thermal": F.lit(True), "temporal": key % 3 != 0, "spatial": F.lit(True), "imagery": key % 5 == 0, "rhythm": key % 4 != 1}
    # one real value in a group is enough; NaN is none
    s = views.sites(views.detections(spark, sf_dir)).select("cluster_id", *[F.when(present[g], 1.5).otherwise(F.lit(float("nan"))).alias(c) for c, g in C.FEATURES.items()])
    found = {g: scoring.group_present([F.col(c) for c, own in C.FEATURES.items() if own == g]) for g in C.GROUP_WEIGHTS}
    weight, multiplier = scoring.evidence_multiplier(found)
    return s.select("cluster_id", *[found[g].alias(g) for g in ("context", "imagery", "rhythm")], r(weight, 4).alias("available_weight"), r(multiplier, 4).alias("multiplier"))


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding[1:5], lambda x: exp(CAST(x AS DOUBLE))) AS a, list_transform(embedding[6:10], lambda x: exp(CAST(x AS DOUBLE))) AS i FROM embeddings),
n AS (SELECT vec_id, list_transform(a, lambda x: x/list_sum(a)) AS p, CASE WHEN vec_id % 3 <> 0 THEN list_transform(i, lambda x: x/list_sum(i)) END AS q FROM e),
f AS (SELECT vec_id, q IS NOT NULL AS has_image, CASE WHEN q IS NULL THEN p ELSE [0.7*p[1]+0.3*q[1], 0.7*p[2]+0.3*q[2], 0.7*p[3]+0.3*q[3], 0.7*p[4]+0.3*q[4], 0.7*p[5]+0.3*q[5]] END AS z FROM n)
SELECT vec_id, has_image, """ + _CLASS_ARRAY + """[list_position(z, list_max(z))] AS top_class, round(list_max(z)*0.9*100,2) AS confidence FROM f""", ctes=False)
def late_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tabular and image probabilities (from slices of the embeddings) fused 0.7 to 0.3, where there is an image."""
    e = views.table(spark, sf_dir, "embeddings")
    dist = lambda at: F.map_from_arrays(F.array(*map(F.lit, C.CLASSES)), F.transform(F.slice("embedding", at, 5), lambda x: F.exp(x.cast("double"))))
    p = e.select("vec_id", scoring.aligned(dist(1)).alias("p"), F.when(F.col("vec_id") % 3 != 0, scoring.aligned(dist(6))).alias("q"))
    z = p.select("vec_id", F.col("q").isNotNull().alias("has_image"), scoring.fused(F.col("p"), F.col("q")).alias("z"))
    return z.select("vec_id", "has_image", scoring.top_class(F.col("z")).alias("top_class"), scoring.confidence_score(F.col("z"), F.lit(0.9)).alias("confidence"))


# --- grids and images ------------------------------------------------------------------------------

_GRID_CODE = "CASE (gx*7 + gy*13) % 8 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 40 WHEN 3 THEN 50 WHEN 4 THEN 60 WHEN 5 THEN 80 WHEN 6 THEN 90 ELSE 95 END"
_GRID = f"""
, ctr AS (SELECT cluster_id, CAST(floor(round(lon,6)/0.01) AS BIGINT) AS cx, CAST(floor(round(lat,6)/0.01) AS BIGINT) AS cy FROM sites),
cells AS (SELECT cluster_id, gx, gy, {_GRID_CODE} AS code, CASE WHEN (gx*31+gy*17) % 5 = 0 THEN -1.0 ELSE CAST((gx*31+gy*17) % 40 AS DOUBLE) END AS people FROM (SELECT cluster_id, cx + dx AS gx, cy + dy AS gy FROM ctr, (SELECT unnest(range(-2,3)) AS dx), (SELECT unnest(range(-2,3)) AS dy)))"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 x 5 grid cells around each cluster, joined with a raster kept as a table of cells."""
    s = views.sites(views.detections(spark, sf_dir)).select("cluster_id", geo.cell(r("lon"), 0.01).alias("cx"), geo.cell(r("lat"), 0.01).alias("cy"))  # sums of any order, one cell
    step = F.sequence(F.lit(-2), F.lit(2))
    wanted = s.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).select("cluster_id", (F.col("cx") + F.col("dx")).alias("gx"), (F.col("cy") + F.col("dy")).alias("gy"))
    codes = F.array(*map(F.lit, (10, 20, 40, 50, 60, 80, 90, 95)))
    h = F.col("gx") * 31 + F.col("gy") * 17
    raster = wanted.select("gx", "gy").distinct().select("gx", "gy", F.element_at(codes, ((F.col("gx") * 7 + F.col("gy") * 13) % 8 + 1).cast("int")).alias("code"), F.when(h % 5 == 0, -1.0).otherwise((h % 40).cast("double")).alias("people"))
    return wanted.join(raster, ["gx", "gy"])


_SHARES = {"pct_cropland": (40,), "pct_forest": (10, 95), "pct_urban": (50,), "pct_water": (80, 90), "pct_barren": (60, 20, 30)}


@query(_GRID + " SELECT cluster_id, " + ", ".join(f"round(avg(CASE WHEN code IN {(*v, -1)} THEN 1.0 ELSE 0.0 END),6) AS {k}" for k, v in _SHARES.items()) + " FROM cells GROUP BY 1")
def landcover_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).groupBy("cluster_id").agg(*[r(F.avg(F.when(F.col("code").isin(*v), 1.0).otherwise(0.0))).alias(k) for k, v in _SHARES.items()])


@query(_GRID + " SELECT cluster_id, CAST(round(sum(CASE WHEN people > 0 THEN people ELSE 0 END)) AS BIGINT) AS population FROM cells GROUP BY 1")
def zonal_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive cells summed; negative ones are the raster's sentinel."""
    return _cells(spark, sf_dir).groupBy("cluster_id").agg(F.round(F.sum(F.when(F.col("people") > 0, F.col("people")).otherwise(0.0))).cast("long").alias("population"))


_PIX = """
WITH px AS (SELECT vec_id, i, abs(CAST(embedding[i] AS DOUBLE)) AS blue, abs(CAST(embedding[i+12] AS DOUBLE)) AS green, abs(CAST(embedding[i+24] AS DOUBLE)) AS red, abs(CAST(embedding[i+36] AS DOUBLE)) AS nir, abs(CAST(embedding[i+48] AS DOUBLE)) AS swir FROM embeddings, (SELECT unnest(range(1,13)) AS i)),
ix AS (SELECT vec_id, i, CASE WHEN abs(nir+red) > 1e-4 THEN (nir-red)/(nir+red) ELSE 0 END AS ndvi, CASE WHEN abs(swir+nir) > 1e-4 THEN (swir-nir)/(swir+nir) ELSE 0 END AS ndbi, CASE WHEN blue > 1e-4 THEN red/blue ELSE 0 END AS rb, (blue+green+red)/3 AS bright, swir FROM px)"""


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of five bands, cut from the embeddings and made positive, with their indices - all array functions."""
    e = views.table(spark, sf_dir, "embeddings")
    band = lambda k: F.transform(F.slice("embedding", 1 + 12 * k, 12), lambda x: F.abs(x.cast("double")))
    p = e.select("vec_id", F.arrays_zip(*[band(k).alias(n) for k, n in enumerate(("blue", "green", "red", "nir", "swir"))]).alias("px"))
    diff = lambda a, b: F.when(F.abs(a + b) > 1e-4, (a - b) / (a + b)).otherwise(0.0)
    pixel = lambda x: F.struct(diff(x["nir"], x["red"]).alias("ndvi"), diff(x["swir"], x["nir"]).alias("ndbi"), F.when(x["blue"] > 1e-4, x["red"] / x["blue"]).otherwise(0.0).alias("rb"), ((x["blue"] + x["green"] + x["red"]) / 3).alias("bright"), x["swir"].alias("swir"))
    return p.select("vec_id", F.transform("px", pixel).alias("px"))


@query(_PIX + " SELECT vec_id, round(avg(ndvi),5) AS ndvi, round(avg(ndbi),5) AS ndbi, round(avg(rb),4) AS red_blue FROM ix GROUP BY 1", ctes=False)
def spectral_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda f: F.aggregate("px", F.lit(0.0), lambda a, x: a + x[f]) / F.size("px")
    return _bands(spark, sf_dir).select("vec_id", r(mean("ndvi"), 5).alias("ndvi"), r(mean("ndbi"), 5).alias("ndbi"), r(mean("rb"), 4).alias("red_blue"))


@query(_PIX + """, m AS (SELECT vec_id, (i-1) % 4 AS c, (i-1) // 4 AS w, bright > 0.12 AND rb < 1.0 AND swir < 0.25 AND ndvi < 0.35 AS s FROM ix),
g AS (SELECT vec_id, avg(CASE WHEN s THEN 1.0 ELSE 0.0 END) AS coverage, count(CASE WHEN s THEN 1 END) AS n, avg(CASE WHEN s THEN c END) AS x, avg(CASE WHEN s THEN w END) AS y FROM m GROUP BY 1)
SELECT vec_id, round(coverage,6) AS coverage, round(CASE WHEN n >= 2 AND pow(x-1.5,2)+pow(y-1.0,2) >= 0.25 THEN ((degrees(atan2(x-1.5, -(y-1.0))) % 360) + 360) % 360 END,4) AS bearing FROM g""", ctes=False)
def smoke_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoke pixels of the (4 x 3) patches and the bearing from the centre to their middle; rows run south."""
    smoky = lambda x: (x["bright"] > 0.12) & (x["rb"] < 1.0) & (x["swir"] < 0.25) & (x["ndvi"] < 0.35)
    at = F.filter(F.transform("px", lambda x, i: F.when(smoky(x), i)), lambda i: i.isNotNull())
    b = _bands(spark, sf_dir).select("vec_id", F.size("px").alias("size"), at.alias("at"))
    mean = lambda f: F.aggregate("at", F.lit(0.0), lambda a, i: a + f(i)) / F.size("at")
    x, y = mean(lambda i: i % 4) - 1.5, mean(lambda i: F.floor(i / 4)) - 1.0
    found = F.when((F.size("at") >= 2), F.when(x * x + y * y >= 0.25, F.pmod(F.degrees(F.atan2(x, -y)), F.lit(360.0))))
    return b.select("vec_id", r(F.size("at") / F.col("size")).alias("coverage"), r(found, 4).alias("bearing"))


# --- read queries ----------------------------------------------------------------------------------

_DASH = _FACTS + _RHYTHM[_RHYTHM.index(", spn"):] + _PTSI[_PTSI.index(", lasts"):] + _RING + """
, sens AS (SELECT cluster_id, arg_max(source,(acq_datetime,id)) AS source, avg(confidence) AS confidence FROM detections GROUP BY 1),
dash AS (SELECT f.cluster_id, f.last_seen, state, predicted, f.facility_type, f.frp_max, f.brightness_max, f.n_detections, source, confidence, p.source_class, coalesce(NOT p.normal, false) AS active,
  f.cluster_id % 6 = 0 AS escalating FROM facts f JOIN inside USING (cluster_id) JOIN ptsi p USING (cluster_id) JOIN sens USING (cluster_id) WHERE f.last_seen >= (SELECT max(last_seen) FROM facts) - INTERVAL 3 DAY)"""
_RISK = "round_even(least(least(frp_max/100,1)*55 + greatest(0,least((brightness_max-295)/65,1))*30 + CASE WHEN predicted='industrial_fire' THEN 10 ELSE 0 END + CASE WHEN escalating THEN 5 ELSE 0 END,100),0)"


@query(_DASH + f"""
SELECT cluster_id, last_seen, state, predicted, CASE WHEN predicted='agricultural_burning' THEN 'agri' WHEN predicted='mining' THEN 'coal' WHEN predicted='gas_flare' THEN 'petroleum' WHEN facility_type IN ('refinery','oil_well','flare','LNG') THEN 'petroleum' WHEN facility_type='mine' THEN 'coal' ELSE 'industrial' END AS type,
  CASE WHEN contains(source,'VIIRS') THEN 'VIIRS' WHEN contains(source,'MODIS') THEN 'MODIS' ELSE 'SENTINEL' END AS sensor, CASE WHEN confidence >= 0.8 THEN 'HIGH' WHEN confidence >= 0.5 THEN 'NOMINAL' ELSE 'LOW' END AS band,
  CASE WHEN escalating OR active THEN 'Active' WHEN source_class='persistent' THEN 'Verified' ELSE 'Under Control' END AS status, CAST({_RISK} AS INTEGER) AS risk, n_detections FROM dash ORDER BY last_seen DESC, cluster_id LIMIT 500""")
def dashboard_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship read: recent clusters inside the country, newest first, with everything the page shows."""
    d = views.detections(spark, sf_dir)
    newest = d.agg(F.max("acq_datetime").alias("newest"))
    # the recent clusters come first: what the page shows is built for them only
    recent = views.sites(d).crossJoin(F.broadcast(newest)).where(F.col("last_seen") >= F.col("newest") - F.expr("interval 3 days"))  # one row
    inside = _admin(spark, sf_dir, recent).where("state is not null")
    theirs = d.join(recent.select("cluster_id"), "cluster_id", "left_semi")
    latest = theirs.groupBy("cluster_id").agg(F.max_by("source", F.struct("acq_datetime", "id")).alias("source"), F.avg("confidence").alias("confidence"))
    known = recent.join(_nearest(_near(spark, sf_dir, recent)), "cluster_id", "left").withColumn("predicted", _predicted())
    page = known.join(inside, "cluster_id").join(_ptsi(spark, sf_dir, theirs).select("cluster_id", "source_class", "normal"), "cluster_id").join(latest, "cluster_id")
    rising = F.col("cluster_id") % 6 == 0
    return page.select(
        "cluster_id", "last_seen", "state", "predicted", detection.display_type(F.col("predicted"), F.col("facility_type")).alias("type"), detection.sensor_family(F.col("source")).alias("sensor"), detection.confidence_band(F.col("confidence")).alias("band"),
        detection.status(detection.is_active(rising, F.col("normal")), F.lit("active"), F.col("source_class")).alias("status"), detection.risk_score(F.col("frp_max"), F.col("brightness_max"), F.col("predicted"), rising).alias("risk"), "n_detections",
    ).orderBy(F.desc("last_seen"), "cluster_id").limit(500)


@query(_FACTS + _WUI + """
, feed AS (SELECT cluster_id, 'wui' AS kind, 0 AS priority, eta AS key FROM wui WHERE priority <> 'MONITOR' UNION ALL SELECT cluster_id, 'escalation', 1, CAST(cluster_id % 50 AS DOUBLE) FROM facts WHERE cluster_id % 6 = 0)
SELECT cluster_id, kind, priority, round(key,4) AS hours FROM feed ORDER BY priority, key NULLS LAST, cluster_id LIMIT 40""")
def alerts_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlements under threat first, then escalating sources; soonest first within each."""
    w = _wui(spark, sf_dir)
    near = w.where(F.col("priority") != C.MONITOR).select("cluster_id", F.lit("wui").alias("kind"), F.lit(0).alias("priority"), F.col("eta").alias("key"))
    rising = w.where("cluster_id % 6 = 0").select("cluster_id", F.lit("escalation").alias("kind"), F.lit(1).alias("priority"), (F.col("cluster_id") % 50).cast("double").alias("key"))
    return near.unionByName(rising).orderBy("priority", F.asc_nulls_last("key"), "cluster_id").limit(40).select("cluster_id", "kind", "priority", r("key", 4).alias("hours"))


@query(_FRESH + " SELECT cluster_id, label, CAST(cluster_id % 50 AS DOUBLE) AS hours FROM fresh WHERE cluster_id % 2 = 0 AND label IN ('FRESH','MODERATE') ORDER BY hours NULLS LAST, cluster_id LIMIT 50")
def escalating_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _freshness(views.detections(spark, sf_dir)).where("cluster_id % 2 = 0").where(F.col("label").isin("FRESH", "MODERATE"))
    return f.select("cluster_id", "label", (F.col("cluster_id") % 50).cast("double").alias("hours")).orderBy(F.asc_nulls_last("hours"), "cluster_id").limit(50)


@query("SELECT count(DISTINCT cluster_id) AS clusters, count(*) AS hotspots, (SELECT count(*) FROM facilities) AS facilities, count(DISTINCT CASE WHEN cluster_id % 7 <> 0 THEN cluster_id END) AS classified, count(DISTINCT CASE WHEN cluster_id % 6 = 0 THEN cluster_id END) AS escalating FROM detections")
def dashboard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.detections(spark, sf_dir)
    one = lambda c: F.count_distinct(F.when(c, F.col("cluster_id")))
    left = d.agg(F.count_distinct("cluster_id").alias("clusters"), F.count("*").alias("hotspots"), one(F.col("cluster_id") % 7 != 0).alias("classified"), one(F.col("cluster_id") % 6 == 0).alias("escalating"))
    return left.crossJoin(views.facilities(spark, sf_dir).agg(F.count("*").alias("facilities"))).select("clusters", "hotspots", "facilities", "classified", "escalating")  # one row each


@query("SELECT cluster_id, last_seen FROM sites WHERE cluster_id % 7 = 0")
def unprocessed_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters without a classification: an anti-join, newest first."""
    s = views.sites(views.detections(spark, sf_dir)).select("cluster_id", "last_seen")
    return s.join(s.where("cluster_id % 7 <> 0").select("cluster_id"), "cluster_id", "left_anti").orderBy(F.desc_nulls_last("last_seen"), "cluster_id")


# --- further reads and decisions -------------------------------------------------------------------



def _emission_sql(i: int) -> str:
    of = lambda v: ",".join(v[1]) if i else v[0]
    by_type = " ".join(f"WHEN '{k}' THEN '{of(v)}'" for k, v in C.EMISSIONS.items() if k == k.lower())
    by_class = " ".join(f"WHEN '{k}' THEN '{of(v)}'" for k, v in C.CLASS_EMISSIONS.items())
    industrial = of(C.EMISSIONS["industrial"])
    return f"coalesce(CASE lower(facility_type) {by_type} END, CASE predicted {by_class} WHEN 'industrial_fire' THEN '{industrial}' WHEN 'gas_flare' THEN '{industrial}' WHEN 'mining' THEN '{industrial}' END, '{of(C.UNKNOWN_EMISSIONS)}')"


@query(_FACTS + f" SELECT cluster_id, {_emission_sql(0)} AS hazard, {_emission_sql(1)} AS substances FROM facts")
def chemical_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir)
    hazard, substances = scoring.emissions(F.col("facility_type"), F.col("predicted"))
    return f.select("cluster_id", hazard.alias("hazard"), substances.alias("substances"))


@query("""
, ts AS (SELECT cluster_id, last_seen, row_number() OVER (ORDER BY last_seen DESC, cluster_id DESC) AS back, count(*) OVER () AS n FROM sites)
SELECT cluster_id, back <= greatest(1, CAST(round_even(n*0.2, 0) AS BIGINT)) AS is_test FROM ts""")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most recent fifth of the clusters is held out: a threshold found by a top-k, not one sorted partition."""
    s = views.sites(views.detections(spark, sf_dir)).select("cluster_id", "last_seen")
    key = F.struct("last_seen", "cluster_id")
    share = F.percentile_approx(F.unix_micros("last_seen"), F.lit(0.7), F.lit(100)).alias("near")
    size = s.agg(F.count("*").alias("n"), share)  # one row
    both = s.crossJoin(F.broadcast(size)).withColumn("key", key)
    # only rows near the cut are ranked; those above it are counted
    top = both.where(F.unix_micros("last_seen") >= F.col("near")).withColumn("back", F.row_number().over(Window.partitionBy("near").orderBy(F.desc("key"))))
    held = top.where(F.col("back") <= F.greatest(F.lit(1), F.bround(F.col("n") * 0.2, 0).cast("long"))).select("cluster_id", F.lit(True).alias("is_test"))
    return s.select("cluster_id").join(held, "cluster_id", "left").select("cluster_id", F.coalesce("is_test", F.lit(False)).alias("is_test"))


@query("SELECT cluster_id, last_seen, n_detections FROM sites WHERE n_detections > 100 ORDER BY last_seen DESC, cluster_id LIMIT 500")
def list_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.sites(views.detections(spark, sf_dir)).where("n_detections > 100")
    return s.orderBy(F.desc_nulls_first("last_seen"), "cluster_id").limit(500).select("cluster_id", "last_seen", "n_detections")


@query("SELECT facility_id, name, facility_type FROM facilities WHERE facility_type = 'steel' ORDER BY facility_id LIMIT 1000")
def list_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.facilities(spark, sf_dir).where("facility_type = 'steel'").orderBy("facility_id").limit(1000).select("facility_id", "name", "facility_type")


@query("""
, vd AS (SELECT cluster_id, CASE WHEN cluster_id % 7 <> 0 THEN last_seen - to_hours(CAST(cluster_id * 13 % 97 AS INTEGER)) END AS judged FROM sites)
SELECT cluster_id, judged FROM vd ORDER BY judged NULLS FIRST, cluster_id LIMIT 40""")
def reclassify_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to judge next: never judged first, then the oldest verdict."""
    s = views.sites(views.detections(spark, sf_dir))
    verdicts = s.where("cluster_id % 7 <> 0").select("cluster_id", F.timestamp_micros(F.unix_micros("last_seen") - F.col("cluster_id") * 13 % 97 * 3_600_000_000).alias("judged"))
    return s.select("cluster_id").join(verdicts, "cluster_id", "left").orderBy(F.asc_nulls_first("judged"), "cluster_id").limit(40)


@query("""
, ck AS (SELECT CASE id % 3 WHEN 0 THEN 'cloud' WHEN 1 THEN 'wind' ELSE 'landcover' END || format('|{:.2f}|{:.2f}', lon, lat) AS key FROM detections)
SELECT split_part(key,'|',1) AS namespace, count(DISTINCT key) AS n FROM ck GROUP BY 1""")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.detections(spark, sf_dir)
    key = F.coalesce(*[F.when(F.col("id") % 3 == i, detection.cache_key(n, F.col("lon"), F.col("lat"))) for i, n in enumerate(("cloud", "wind", "landcover"))])
    return d.select(key.alias("key")).groupBy(F.substring_index("key", "|", 1).alias("namespace")).agg(F.count_distinct("key").alias("n"))


@query("""
SELECT CAST(floor(lon/2) AS BIGINT) AS tile_x, CAST(floor(lat/2) AS BIGINT) AS tile_y, count(*) AS n FROM sites GROUP BY 1, 2 ORDER BY n DESC, tile_x, tile_y""")
def tiles_by_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of two degrees in the order in which to load map data: most clusters first."""
    s = views.sites(views.detections(spark, sf_dir))
    return s.groupBy(geo.cell(F.col("lon"), 2.0).alias("tile_x"), geo.cell(F.col("lat"), 2.0).alias("tile_y")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tile_x", "tile_y")


@query(_FACTS + """
SELECT cluster_id, coalesce(built_m + 700 <= built_m + 1500, false) AS settlement_matches, coalesce(distance_m + 500 <= distance_m + 400, false) AS same_site,
  CASE WHEN regexp_matches('Cluster ' || cluster_id, '^cluster \\d+', 'i') AND cluster_id % 2 = 0 THEN NULL ELSE coalesce(facility_type, 'none') END AS display_name FROM facts""")
def name_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether names found nearby may stand for what was measured, and names that aren't shown."""
    f = _facts(spark, sf_dir)
    name = F.when(F.col("cluster_id") % 2 == 0, F.concat(F.lit("Cluster "), F.col("cluster_id"))).otherwise(F.coalesce("facility_type", F.lit("none")))
    return f.select(
        "cluster_id", scoring.same_site(F.col("built_m") + 700, F.col("built_m"), C.SETTLEMENT_EXCESS_M).alias("settlement_matches"), scoring.same_site(F.col("distance_m") + 500, F.col("distance_m"), C.SAME_SITE_EXCESS_M).alias("same_site"),
        F.when(~name.rlike(r"(?i)^cluster \d+"), name).alias("display_name"),
    )


@query(_FACTS + """
SELECT cluster_id, round(CASE WHEN spatial_extent_km <= 0 THEN 1000 ELSE greatest(500, least(20000, spatial_extent_km*750)) END,3) AS buffer_m, round(greatest(2000, least(10000, spatial_extent_km*750)),3) AS patch_halfwidth_m,
  format('{}{:02d}{}{:03d}', CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END, CAST(floor(lat/3)*3 AS INTEGER), CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END, CAST(floor(lon/3)*3 AS INTEGER)) AS tile FROM facts""")
def sampling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far around a cluster land cover and images are sampled, and from which tile."""
    f = _facts(spark, sf_dir)
    return f.select("cluster_id", r(geo.buffer_m(F.col("spatial_extent_km")), 3).alias("buffer_m"), r(geo.halfwidth_m(F.col("spatial_extent_km")), 3).alias("patch_halfwidth_m"), geo.tile_name(F.col("lon"), F.col("lat")).alias("tile"))


@query(_FACTS + """
, feats AS (SELECT f.cluster_id, frp_max, spatial_extent_km, CASE WHEN f.cluster_id % 2 = 0 THEN distance_m END AS new_d, CASE WHEN f.cluster_id % 3 = 0 THEN 1.0 ELSE 99.0 END AS old_d FROM facts f)
SELECT cluster_id, frp_max, round(coalesce(new_d, CAST(old_d AS DOUBLE)),4) AS facility_distance_m FROM feats""")
def upsert_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage writes only its own columns, and only what it knows."""
    from ..operators import state

    f = _facts(spark, sf_dir)
    stored = f.select("cluster_id", "frp_max", F.when(F.col("cluster_id") % 3 == 0, 1.0).otherwise(99.0).alias("facility_distance_m"))
    batch = f.select("cluster_id", F.when(F.col("cluster_id") % 2 == 0, F.col("distance_m")).alias("facility_distance_m"))
    return state.upsert(stored, batch, "cluster_id", ["facility_distance_m"]).select("cluster_id", "frp_max", r("facility_distance_m", 4).alias("facility_distance_m"))


@query(_PTSI + """
SELECT p.cluster_id, concat_ws('; ', source_class || ' heat source', format('{:.1f} days between first and last detection', span_days), CASE WHEN multiple > 0 THEN format('{:.1f} times the mean output', multiple) END,
  CASE WHEN sigma IS NOT NULL THEN format('{:+.1f} standard deviations', sigma) END, CASE WHEN normal THEN 'usual' WHEN NOT normal THEN 'unusual' ELSE 'nothing to compare with' END) AS summary
FROM ptsi p JOIN mr USING (cluster_id)""")
def ptsi_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = temporal.slots(views.detections(spark, sf_dir)).groupBy("cluster_id").agg(F.first("span_days").alias("days"))
    p = _ptsi(spark, sf_dir).join(days, "cluster_id")
    return p.select("cluster_id", text.ptsi_summary(F.col("source_class"), F.col("days"), F.col("multiple"), F.col("sigma"), F.col("normal")).alias("summary"))


@query(_FACTS + _SUPP + f"""
, sm AS (SELECT *, CAST(CASE WHEN kind = 'mining' THEN 0 ELSE {_TRIP.format(v='l', d=5000)} END AS BIGINT) AS tt, CAST(CASE WHEN kind = 'mining' THEN {_TRIP.format(v='m3', d=10)} ELSE 0 END AS BIGINT) AS tl, CAST(CASE WHEN kind NOT IN ('industrial_fire','gas_flare','mining') AND air THEN {_TRIP.format(v='l', d=3000)} ELSE 0 END AS BIGINT) AS dr FROM s1)
SELECT cluster_id, concat_ws(chr(10), 'Fire report ' || cluster_id, 'site: ' || CASE WHEN cluster_id % 2 = 0 THEN facility_type END, format('north, east: {{:.4f}}, {{:.4f}}', round(lat,4), round(lon,4)),
  'water: ' || CASE WHEN kind <> 'mining' THEN format('{{:,}} litres', CAST(round(l,0) AS BIGINT)) ELSE format('{{:,}} m3 to cover', CAST(round(m3,0) AS BIGINT)) END, 'vehicles: ' || coalesce(nullif(tt,0), nullif(tl,0)),
  'aircraft: ' || CASE WHEN air THEN dr || ' drops' END, 'details: https://example.org/' || cluster_id) AS body FROM sm""")
def sms_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _rdi(spark, sf_dir)
    s = scoring.suppression(F.col("predicted"), F.col("frp_max"), F.col("ha"), F.col("coa"), F.lit("VIIRS"))
    place = F.when(F.col("cluster_id") % 2 == 0, F.col("facility_type"))
    fields = {
        "site": place, "north, east": F.format_string("%.4f, %.4f", r("lat", 4), r("lon", 4)), "water": text.water_needed(s["volume_l"], s["volume_m3"]),
        "vehicles": F.coalesce(F.nullif(s["tanker_trips"], F.lit(0)), F.nullif(s["truck_loads"], F.lit(0))), "aircraft": F.when(s["air_support"], F.concat(s["air_drops"].cast("string"), F.lit(" drops"))),
        "details": F.concat(F.lit("https://example.org/"), F.col("cluster_id")),
    }
    body = text.dispatch_message(F.concat(F.lit("Fire report "), F.col("cluster_id")), fields)
    return f.select("cluster_id", body.alias("body"))
