"""The event path: the assembled feature vector, fire temperatures, corridors as geometry, stored state and reads by cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import geo, scoring
from ..operators import explain, features, ingest, models, state, temporal
from ..sources import views
from . import catalog as k
from .catalog import query, r

# --- fire temperature ------------------------------------------------------------------------------


def _glow(w: str, t: str) -> str:
    return k._RAD.format(w=w, t=t)


_AT = f"(e4/({_glow('w4', '{t}')} - g4)*({_glow('w5', '{t}')} - g5) - e5)"
_MIDDLE = "((lo+hi)/2)"
_FIRE = f"""
, usable AS (SELECT *, brightness_tir BETWEEN 260 AND 330 AS plausible FROM detections WHERE contains(source,'VIIRS') OR contains(source,'MODIS')),
bg0 AS (SELECT cluster_id, count(CASE WHEN plausible THEN 1 END) AS n, quantile_cont(CASE WHEN plausible THEN brightness_tir END, 0.1) AS low, count(CASE WHEN daynight = 'D' THEN 1 END) >= count(CASE WHEN daynight = 'N' THEN 1 END) AS day FROM usable GROUP BY 1),
bg AS (SELECT cluster_id, CASE WHEN n >= 4 THEN low WHEN day THEN 305.0 ELSE 290.0 END AS background_k, CASE WHEN n >= 4 THEN 'percentile' ELSE 'climatology' END AS background_source, CASE WHEN n >= 4 THEN n ELSE 0 END AS n_samples FROM bg0),
hot AS (SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY brightness DESC, id) = 1),
tr0 AS (SELECT cluster_id, o, brightness AS mir, brightness_tir AS tir, CAST(background_k + o AS DOUBLE) AS b, contains(source,'MODIS') AS modis FROM hot JOIN bg USING (cluster_id), (SELECT unnest([-1, 0, 1]) AS o)),
tr1 AS (SELECT *, CASE WHEN modis THEN 3.959e-6 ELSE 3.74e-6 END AS w4, CASE WHEN modis THEN 11.03e-6 ELSE 11.45e-6 END AS w5, CASE WHEN modis THEN 500e0 ELSE 367e0 END AS full_k FROM tr0),
tr2 AS (SELECT *, {_glow('w4', 'b')} AS g4, {_glow('w5', 'b')} AS g5, {_glow('w4', 'mir')} - {_glow('w4', 'b')} AS e4, {_glow('w5', 'tir')} - {_glow('w5', 'b')} AS e5 FROM tr1),
tr3 AS (SELECT * FROM tr2 WHERE mir < full_k AND e4 > 0 AND e5 > 0 AND {_AT.format(t='400e0')} > 0 AND {_AT.format(t='1800e0')} < 0),
bis AS (WITH RECURSIVE z(cluster_id, o, step, lo, hi, w4, w5, g4, g5, e4, e5) AS (
  SELECT cluster_id, o, 0, 400e0, 1800e0, w4, w5, g4, g5, e4, e5 FROM tr3
  UNION ALL SELECT cluster_id, o, step + 1, CASE WHEN {_AT.format(t=_MIDDLE)} > 0 THEN {_MIDDLE} ELSE lo END, CASE WHEN {_AT.format(t=_MIDDLE)} > 0 THEN hi ELSE {_MIDDLE} END, w4, w5, g4, g5, e4, e5 FROM z WHERE step < 60
) SELECT cluster_id, o, {_MIDDLE} AS t, e4/({_glow('w4', _MIDDLE)} - g4) AS p FROM z WHERE step = 60),
ok AS (SELECT * FROM bis WHERE p BETWEEN 1e-7 AND 1),
fire AS (SELECT hot.cluster_id, background_k, background_source, n_samples, m.t AS fire_k, m.p AS fraction, m.p*nullif(scan,0)*nullif(track,0)*1e6 AS area_m2,
  CASE WHEN coalesce(c.t, w.t) IS NOT NULL AND m.t IS NOT NULL THEN least(m.t, c.t, w.t) END AS low_k, CASE WHEN coalesce(c.t, w.t) IS NOT NULL AND m.t IS NOT NULL THEN greatest(m.t, c.t, w.t) END AS high_k
  FROM (SELECT *, 375e-3 AS scan, 375e-3 AS track FROM hot) hot JOIN bg USING (cluster_id) LEFT JOIN ok m ON m.cluster_id = hot.cluster_id AND m.o = 0 LEFT JOIN ok c ON c.cluster_id = hot.cluster_id AND c.o = -1 LEFT JOIN ok w ON w.cluster_id = hot.cluster_id AND w.o = 1)"""


@query(_FIRE + """
SELECT cluster_id, round(background_k,4) AS background_k, background_source, n_samples, round(fire_k,3) AS fire_k, round(fraction*1e4,5) AS fraction_e4, round(area_m2,2) AS area_m2, round(low_k,3) AS low_k, round(high_k,3) AS high_k,
  CASE WHEN fire_k IS NOT NULL THEN coalesce((high_k - low_k)/fire_k <= 0.3, false) END AS well_constrained FROM fire""")
def fire_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-pixel temperature of each cluster's hottest detection, bracketed by 1 K of background."""
    t = features.fire_temperature(views.detections(spark, sf_dir))
    return t.select("cluster_id", r("background_k", 4).alias("background_k"), "background_source", "n_samples", r("fire_k", 3).alias("fire_k"), r(F.col("fraction") * 1e4, 5).alias("fraction_e4"), r("area_m2", 2).alias("area_m2"), r("low_k", 3).alias("low_k"), r("high_k", 3).alias("high_k"), "well_constrained")


# --- escalation and the feature vector -------------------------------------------------------------


def _escalation_sql(samples: int = C.SAMPLES, seed: int = 42) -> str:
    """Continues the lists of the persistence index and the filter; the draws are spelt out."""
    import random

    rng = random.Random(seed)
    pairs = ",".join(f"({rng.gauss(0.0, 1.0)!r}::DOUBLE,{rng.gauss(0.0, 1.0)!r}::DOUBLE)" for _ in range(samples))
    return f"""
, draws(z1, z2) AS (VALUES {pairs}),
es0 AS (SELECT p.cluster_id, f, r, greatest(mean + 3*CASE WHEN std > 0 THEN std ELSE greatest(mean*0.5, 1) END, 10) AS threshold, greatest(a,0)*6.25 AS va, b*6.25 AS vb, greatest(d,0)*6.25 AS vd FROM kal JOIN (SELECT cluster_id, CASE WHEN mean IS NOT NULL THEN mean END AS mean, std FROM ptsi) p USING (cluster_id)),
es1 AS (SELECT *, sqrt(va) AS l11, CASE WHEN va > 0 THEN vb/sqrt(va) ELSE 0 END AS l21 FROM (SELECT cluster_id, f, r, CASE WHEN isfinite(threshold) AND EXISTS (SELECT 1 FROM ptsi q WHERE q.cluster_id = es0.cluster_id AND q.mean IS NOT NULL) THEN threshold END AS threshold, va, vb, vd FROM es0)),
es2 AS (SELECT cluster_id, threshold, f + l11*z1 AS level, r + l21*z1 + sqrt(greatest(vd - l21*l21, 0))*z2 AS rate FROM es1, draws WHERE f < threshold),
es3 AS (SELECT cluster_id, CASE WHEN rate > 1e-3 THEN CASE WHEN level >= threshold THEN 0 ELSE (threshold-level)/rate END END AS t FROM es2),
es4 AS (SELECT cluster_id, count(CASE WHEN t <= 240 THEN 1 END)/{samples}.0 AS prob, quantile_cont(CASE WHEN t <= 240 THEN t END, [0.05,0.25,0.5,0.75,0.95]) AS q FROM es3 GROUP BY 1),
esc AS (SELECT es1.cluster_id, threshold, coalesce(f >= threshold, false) AS critical, NOT coalesce(f >= threshold, false) AND coalesce(prob >= 0.1, false) AS rising, prob, q FROM es1 LEFT JOIN es4 USING (cluster_id))"""


_ESCALATION = k._PTSI + k._KALMAN + _escalation_sql()

k.ORACLE_SQL["escalation_forecast"] = f"WITH {views.ORACLE}{_ESCALATION}" + """
SELECT cluster_id, round(threshold,6) AS threshold, critical OR rising AS escalating, critical AS already_critical, round(CASE WHEN critical THEN 0 WHEN rising THEN q[3] END,4) AS hours_to_critical,
  round(CASE WHEN rising THEN q[1] END,4) AS p05, round(CASE WHEN rising THEN q[2] END,4) AS p25, round(CASE WHEN rising THEN q[4] END,4) AS p75, round(CASE WHEN rising THEN q[5] END,4) AS p95, round(CAST(CASE WHEN critical THEN 1 ELSE coalesce(prob,0) END AS DOUBLE),6) AS probability FROM esc"""


def vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed columns of every cluster, in order; what a stage can't tell is null.

    All parts have one row for a cluster and are joined on its id, so the joins share one partitioning.
    """
    d = views.detections(spark, sf_dir)
    near = k._nearest(k._near(spark, sf_dir)).select("cluster_id", F.col("distance_m").alias("facility_distance_m"))
    share = lambda codes: F.avg(F.when(F.col("code").isin(*codes), 1.0).otherwise(0.0))
    cover = k._cells(spark, sf_dir).groupBy("cluster_id").agg(*[share(k._SHARES[c]).alias(c) for c in ("pct_cropland", "pct_forest", "pct_urban")], F.sum(F.when(F.col("people") > 0, F.col("people")).otherwise(0.0)).alias("population_density"))
    base = features.baseline(d).where("n_base >= 2").select("cluster_id", "base_mean", "base_std")
    mean = lambda f: F.aggregate("px", F.lit(0.0), lambda a, x: a + x[f]) / F.size("px")
    patches = k._bands(spark, sf_dir).select(F.col("vec_id").alias("cluster_id"), mean("ndvi").alias("ndvi"), mean("ndbi").alias("ndbi"), mean("rb").alias("smoke_red_blue_ratio"))
    fire = features.fire_temperature(d).select("cluster_id", F.col("fire_k").alias("dozier_temp"))
    rhythm = temporal.rhythm(d).select("cluster_id", "shift_sharpness", "weekend_suppression")
    ahead = k._escalation(spark, sf_dir).select("cluster_id", F.col("hours_to_critical").alias("kalman_time_to_critical"))
    out = features.thermal(d)
    for part in (features.extent_and_growth(d), near, cover, base, patches, fire, rhythm, ahead):
        out = out.join(part, "cluster_id", "left")
    metres = F.col("facility_distance_m")
    out = out.withColumn("facility_prior_weight", scoring.proximity_weight(metres)).withColumn("near_facility", (metres < 1000.0).cast("double")).withColumn("frp_zscore", features.zscore(F.col("frp_max"), F.col("base_mean"), F.col("base_std")))
    return out.select("cluster_id", *C.FEATURES)


_VECTOR = _ESCALATION + k._EXTENT + k._BEST[k._BEST.index(", cand") :] + _FIRE + k._GRID + ", " + k._PIX.strip().removeprefix("WITH ") + f"""
, th AS (SELECT cluster_id, avg(frp) AS frp_mean, max(frp) AS frp_max, stddev_pop(frp) AS frp_std, avg(brightness) AS brightness_mean, max(brightness) AS brightness_max, avg(confidence) AS confidence_mean, {k._SPAN} AS persistence_days, CAST(count(*) AS DOUBLE) AS n_detections,
  count(*)/greatest({k._SPAN},1) AS detections_per_day, avg(CASE daynight WHEN 'N' THEN 1.0 ELSE 0.0 END) AS night_fraction, CAST(count(DISTINCT replace(source,'_NRT','')) AS DOUBLE) AS source_diversity FROM detections GROUP BY 1),
cv AS (SELECT cluster_id, avg(CASE WHEN code = 40 THEN 1.0 ELSE 0.0 END) AS pct_cropland, avg(CASE WHEN code IN (10,95) THEN 1.0 ELSE 0.0 END) AS pct_forest, avg(CASE WHEN code = 50 THEN 1.0 ELSE 0.0 END) AS pct_urban, sum(CASE WHEN people > 0 THEN people ELSE 0 END) AS population_density FROM cells GROUP BY 1),
im AS (SELECT vec_id AS cluster_id, avg(ndvi) AS ndvi, avg(ndbi) AS ndbi, avg(rb) AS rb FROM ix GROUP BY 1)"""
_ROUNDED = {c: 3 if c in ("facility_distance_m", "dozier_temp", "smoke_red_blue_ratio") else 4 for c in C.FEATURES}


_VECTOR_ROWS = """
SELECT th.*, pct_cropland, pct_forest, pct_urban, distance_m AS facility_distance_m, exp(-distance_m/500) AS facility_prior_weight, population_density, CASE WHEN distance_m < 1000 THEN 1 WHEN distance_m >= 1000 THEN 0 END AS near_facility, spatial_extent_km, spatial_growth_rate, fire_k AS dozier_temp, ndvi, ndbi, rb AS smoke_red_blue_ratio,
  CASE WHEN n_base >= 2 THEN CASE WHEN base_std = 0 THEN CASE WHEN abs(frp_max-base_mean) <= 1e-9*greatest(abs(frp_max),abs(base_mean)) THEN 0 WHEN frp_max > base_mean THEN 3 ELSE -3 END ELSE (frp_max-base_mean)/base_std END END AS frp_zscore,
  CASE WHEN ry.n >= 8 AND k >= 2 THEN greatest(0,least(1,1-h/ln(k))) END AS shift_sharpness, CASE WHEN ry.n >= 8 AND ry.span_days >= 14 THEN CASE WHEN wd <= 0 THEN CASE WHEN we > 0 THEN -1 END ELSE greatest(-1,least(1,(wd-we)/wd)) END END AS weekend_suppression,
  CASE WHEN critical THEN 0 WHEN rising THEN q[3] END AS kalman_time_to_critical
FROM th JOIN extents USING (cluster_id) LEFT JOIN best USING (cluster_id) LEFT JOIN cv USING (cluster_id) LEFT JOIN base USING (cluster_id) LEFT JOIN im USING (cluster_id) LEFT JOIN fire USING (cluster_id) LEFT JOIN ry USING (cluster_id) LEFT JOIN esc USING (cluster_id)"""


@query(_VECTOR + " SELECT cluster_id, " + ", ".join(f"round(CAST({c} AS DOUBLE),{n}) AS {c}" for c, n in _ROUNDED.items()) + f" FROM ({_VECTOR_ROWS})")
def event_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 28 features of every cluster."""
    return vector(spark, sf_dir).select("cluster_id", *[r(F.col(c).cast("double"), n).alias(c) for c, n in _ROUNDED.items()])


@query(k._FACTS + k._VOTES + """
SELECT f.cluster_id, vr.best.l AS label, round(CAST(best.c AS DOUBLE),2) AS confidence, round(s.lon,5) AS lon, round(s.lat,5) AS lat, floor(round(s.lon,6)/0.5) AS tile_x, floor(round(s.lat,6)/0.5) AS tile_y
FROM facts f JOIN vr USING (cluster_id) JOIN sites s ON s.cluster_id = f.cluster_id WHERE n_votes > 0 AND NOT coalesce(CAST(best.c AS DOUBLE) - CAST(rival AS DOUBLE) < 0.1, false)""")
def training_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with a label that is settled, with their place and tile: what training may use."""
    v = k._voted(spark, sf_dir).withColumn("won", scoring.resolved(F.col("votes"))).where("won is not null")
    tile = lambda c: geo.cell(r(c), 0.5).cast("double")
    return v.select("cluster_id", F.col("won.label").alias("label"), r("won.confidence", 2).alias("confidence"), r("lon", 5).alias("lon"), r("lat", 5).alias("lat"), tile("lon").alias("tile_x"), tile("lat").alias("tile_y"))


# --- reasons ---------------------------------------------------------------------------------------

#: A forest of given trees, for verdicts that SQL can follow; fitted ones have the same form.  A split has the feature, the
#: threshold and the class shares before it; a leaf only has shares.
GIVEN_FOREST = explain.given(
    list(C.FEATURES),
    ("frp_mean", 48.0, [0.30, 0.31, 0.19, 0.10, 0.10], [0.10, 0.52, 0.18, 0.10, 0.10], ("facility_distance_m", 900.0, [0.50, 0.10, 0.20, 0.11, 0.09], [0.81, 0.06, 0.04, 0.05, 0.04], [0.10, 0.11, 0.59, 0.12, 0.08])),
    ("n_detections", 130.0, [0.20, 0.21, 0.29, 0.20, 0.10], ("frp_max", 150.0, [0.10, 0.12, 0.48, 0.21, 0.09], [0.05, 0.06, 0.68, 0.12, 0.09], [0.11, 0.10, 0.28, 0.41, 0.10]), ("persistence_days", 29.5, [0.40, 0.39, 0.06, 0.10, 0.05], [0.21, 0.58, 0.11, 0.06, 0.04], [0.61, 0.19, 0.01, 0.14, 0.05])),
    ("night_fraction", 0.5, [0.25, 0.26, 0.19, 0.20, 0.10], [0.36, 0.34, 0.09, 0.11, 0.10], ("pct_forest", 0.3, [0.10, 0.12, 0.38, 0.30, 0.10], [0.11, 0.09, 0.49, 0.22, 0.09], ("frp_mean", 50.0, [0.09, 0.12, 0.21, 0.48, 0.10], [0.08, 0.11, 0.22, 0.50, 0.09], [0.12, 0.13, 0.19, 0.44, 0.12]))),
)


def _explain_sql() -> str:
    """Walks a table of the nodes, a split a step."""
    names = list(C.FEATURES)
    nodes = ", ".join(f"({t}, {i}, {n['f']}, {n['t']!r}::DOUBLE, {n['l']}, {n['r']}, {n['p']!r}::DOUBLE[])" for t, tree in enumerate(GIVEN_FOREST) for i, n in enumerate(tree))
    used = sorted({n["f"] for tree in GIVEN_FOREST for n in tree if n["f"] >= 0})
    values = " UNION ALL ".join(f"SELECT cluster_id, {i} AS f, CAST({names[i]} AS DOUBLE) AS v FROM vec" for i in used)
    means = ", ".join(f"avg(p[{i}])" for i in range(1, len(C.CLASSES) + 1))
    return f"""
, nodes(tree, node, f, t, l, r, p) AS (VALUES {nodes}),
vec AS ({_VECTOR_ROWS}),
x AS (SELECT cluster_id, f, coalesce(v, -9999) AS v FROM ({values})),
walk AS (WITH RECURSIVE w(cluster_id, tree, f, node, before, p) AS (
  SELECT cluster_id, tree, CAST(NULL AS INTEGER), node, CAST(NULL AS DOUBLE[]), p FROM vec, nodes WHERE node = 0
  UNION ALL SELECT w.cluster_id, w.tree, n.f, c.node, w.p, c.p FROM w JOIN nodes n ON n.tree = w.tree AND n.node = w.node JOIN x ON x.cluster_id = w.cluster_id AND x.f = n.f JOIN nodes c ON c.tree = n.tree AND c.node = CASE WHEN x.v <= n.t THEN n.l ELSE n.r END WHERE n.f >= 0
) SELECT * FROM w),
told AS (SELECT cluster_id, q, list_position(q, list_max(q)) AS c FROM (SELECT cluster_id, [{means}] AS q FROM (SELECT w.cluster_id, w.p FROM walk w JOIN nodes n USING (tree, node) WHERE n.f < 0) GROUP BY 1))
SELECT cluster_id, {list(C.CLASSES)!r}[c] AS predicted_class, round(q[c], 9) AS probability, round((SELECT avg(p[c]) FROM nodes WHERE node = 0), 9) AS base, {names!r}[f + 1] AS feature, round(sum(p[c] - before[c]) / {len(GIVEN_FOREST)}, 9) AS contribution
FROM told JOIN walk USING (cluster_id) WHERE f IS NOT NULL GROUP BY cluster_id, q, c, f HAVING abs(sum(p[c] - before[c])) > 1e-9"""


@query(_VECTOR + _explain_sql())
def explain_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each feature adds to the probability of a cluster's class, by the given forest."""
    told = models.explained(GIVEN_FOREST, vector(spark, sf_dir), list(C.FEATURES))
    parts = told.select("cluster_id", "predicted_class", r(F.array_max("probabilities"), 9).alias("probability"), r("base", 9).alias("base"), F.posexplode("contributions").alias("f", "by"))
    return parts.where(F.abs("by") * len(GIVEN_FOREST) > 1e-9).select("cluster_id", "predicted_class", "probability", "base", F.element_at(F.array(*map(F.lit, C.FEATURES)), F.col("f") + 1).alias("feature"), r("by", 9).alias("contribution"))


# --- corridors -------------------------------------------------------------------------------------

_GATED = k._FACTS + k._CORR[len(k._TRAJ) :] + """
, gated AS (SELECT c.*, predicted FROM corr c JOIN facts f USING (cluster_id) WHERE predicted IN ('wildfire','agricultural_burning')),
rim AS (SELECT cluster_id, i, CASE WHEN i IN (0, 14) THEN lon ELSE lon + length_km*1000*sin(radians(bearing - half_angle + 2*half_angle*(i-1)/12))/(111320.0*cos(radians(lat))) END AS x, CASE WHEN i IN (0, 14) THEN lat ELSE lat + length_km*1000*cos(radians(bearing - half_angle + 2*half_angle*(i-1)/12))/111320.0 END AS y
  FROM gated, (SELECT unnest(range(0, 15)) AS i))"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corridors of the classes that advance, with the wedge's ring."""
    classes = k._facts(spark, sf_dir).where(F.col("predicted").isin("wildfire", "agricultural_burning")).select("cluster_id", "predicted")
    c = k._corridors(spark, sf_dir).join(classes, "cluster_id")
    return c.withColumn("ring", geo.wedge_ring(F.col("lon"), F.col("lat"), F.col("bearing"), F.col("length_km"), F.col("half_angle")))


@query(_GATED + " SELECT cluster_id, CAST(i AS INTEGER) AS vertex, round(x,5) AS lon, round(y,5) AS lat FROM rim")
def corridor_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vertex of the corridors."""
    return _gated(spark, sf_dir).select("cluster_id", F.posexplode("ring").alias("vertex", "p")).select("cluster_id", "vertex", r("p.lon", 5).alias("lon"), r("p.lat", 5).alias("lat"))


@query(_GATED + """
, edge AS (SELECT cluster_id, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM rim WINDOW w AS (PARTITION BY cluster_id ORDER BY i)),
around AS (SELECT cluster_id, j*30.0 AS bearing, lon + 8000*sin(radians(j*30.0))/(111320.0*cos(radians(lat))) AS px, lat + 8000*cos(radians(j*30.0))/111320.0 AS py FROM gated, (SELECT unnest(range(0, 12)) AS j)),
covered AS (SELECT a.cluster_id, a.bearing, any_value(px) AS px, any_value(py) AS py, count(CASE WHEN (y1 > py) <> (y2 > py) AND px < (x2-x1)*(py-y1)/(y2-y1)+x1 THEN 1 END) AS crossings FROM around a JOIN edge e USING (cluster_id) WHERE x2 IS NOT NULL GROUP BY 1, 2)
SELECT cluster_id, CAST(bearing AS DOUBLE) AS bearing, round(px,5) AS lon, round(py,5) AS lat FROM covered WHERE crossings % 2 = 0""")
def safe_refuges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where to go: points 8 km around a fire that its corridor does not cover."""
    g = _gated(spark, sf_dir)
    p = g.select("cluster_id", F.explode(geo.refuges(F.col("lon"), F.col("lat"), F.col("ring"))).alias("p"))
    return p.select("cluster_id", F.col("p.bearing").alias("bearing"), r("p.lon", 5).alias("lon"), r("p.lat", 5).alias("lat"))


@query(_GATED + """
, reach AS (SELECT cluster_id, count(*) AS n, min(eta) AS eta FROM threatened GROUP BY 1)
SELECT f.cluster_id, g.cluster_id IS NOT NULL AS threat_corridor_present, round(g.length_km,6) AS length_km, CASE WHEN g.cluster_id IS NOT NULL THEN coalesce(n, 0) END AS n_threatened, CASE WHEN g.cluster_id IS NOT NULL THEN round(eta,3) END AS first_eta_hours
FROM facts f LEFT JOIN gated g USING (cluster_id) LEFT JOIN reach USING (cluster_id)""")
def corridor_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored of corridors: built where the class and the movement call for one, cleared everywhere else."""
    g = _gated(spark, sf_dir)
    reach = k._threatened(g, views.facilities(spark, sf_dir)).groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("eta_hours").alias("first_eta_hours"))
    built = g.select("cluster_id", F.lit(True).alias("present"), r("length_km").alias("length_km")).join(reach, "cluster_id", "left").withColumn("n_threatened", F.coalesce("n", F.lit(0)))
    every = k._facts(spark, sf_dir).select("cluster_id")
    return every.join(built, "cluster_id", "left").select("cluster_id", F.coalesce("present", F.lit(False)).alias("threat_corridor_present"), "length_km", "n_threatened", "first_eta_hours")


# --- stored state ----------------------------------------------------------------------------------


@query(k._ATTR + """
SELECT cluster_id, facility_id, CAST(rank AS INTEGER) AS rank, round(probability,6) AS probability FROM ranked WHERE rank <= CASE WHEN cluster_id % 2 = 0 THEN 1 ELSE 3 END""")
def store_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribution candidates: a touched cluster's stored rows give way to those of the batch."""
    a = k._attributed(spark, sf_dir).select("cluster_id", "facility_id", "rank", r("probability").alias("probability"))
    batch = a.where("cluster_id % 2 = 0 and rank <= 1")
    return state.replace_children(a.where("rank <= 3"), batch, "cluster_id", k._facts(spark, sf_dir).where("cluster_id % 2 = 0"))


@query(k._FACTS + k._VOTES + """
, won AS (SELECT cluster_id, best.l AS label FROM vr WHERE n_votes > 0 AND NOT coalesce(CAST(best.c AS DOUBLE) - CAST(rival AS DOUBLE) < 0.1, false)),
old AS (SELECT cluster_id, 'mining' AS label, cluster_id % 5 = 0 AS verified FROM facts WHERE cluster_id % 2 = 0)
SELECT coalesce(o.cluster_id, w.cluster_id) AS cluster_id, CASE WHEN o.verified OR w.label IS NULL THEN o.label ELSE w.label END AS label, CASE WHEN o.verified OR w.label IS NULL THEN o.verified ELSE false END AS verified FROM old o FULL JOIN won w ON w.cluster_id = o.cluster_id""")
def store_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: the batch wins, but not over what an analyst has verified."""
    stored = k._facts(spark, sf_dir).where("cluster_id % 2 = 0").select("cluster_id", F.lit("mining").alias("label"), (F.col("cluster_id") % 5 == 0).alias("verified"))
    batch = k.resolve_label(spark, sf_dir).where("label is not null").select("cluster_id", "label", F.lit(False).alias("verified"))
    return state.keep_verified(stored, batch, "cluster_id", "verified")


@query("SELECT facility_id, name, facility_type FROM facilities WHERE facility_id % 3 <> 0")
def insert_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facilities of a load that come twice and are partly stored: only new names go in."""
    f = views.facilities(spark, sf_dir).select("facility_id", "name", "facility_type")
    return state.insert_new(f.where("facility_id % 3 = 0"), f.unionByName(f), ["name"]).select("facility_id", "name", "facility_type")


# --- reads -----------------------------------------------------------------------------------------


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image patches by cluster: several of the embeddings for each, an hour apart."""
    e = views.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("patch_id"), (F.col("vec_id") % 40).alias("cluster_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("vec_id") * 3600).alias("taken"))


_PATCHES = ", patches AS (SELECT vec_id AS patch_id, vec_id % 40 AS cluster_id, CAST(to_timestamp(1704067200 + vec_id*3600) AT TIME ZONE 'UTC' AS TIMESTAMP) AS taken FROM embeddings)"


def newest_patches(df: DataFrame, limit: int = 20) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("taken"), F.desc("patch_id")))
    return df.withColumn("position", newest).where(F.col("position") <= limit)


@query(_PATCHES + " SELECT cluster_id, patch_id, taken, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY taken DESC, patch_id DESC) AS INTEGER) AS position FROM patches QUALIFY position <= 20")
def list_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20 patches of each cluster."""
    return newest_patches(patches(spark, sf_dir)).select("cluster_id", "patch_id", "taken", "position")


@query(_FIRE + _PATCHES + """
, latest AS (SELECT cluster_id, max(patch_id) AS patch_id FROM patches GROUP BY 1)
SELECT cluster_id, round(background_k,4) AS background_k, round(fire_k,3) AS fire_k, patch_id FROM fire FULL JOIN latest USING (cluster_id)""")
def get_imagery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thermal result and latest patch of a cluster; one is enough."""
    thermal = features.fire_temperature(views.detections(spark, sf_dir)).select("cluster_id", r("background_k", 4).alias("background_k"), r("fire_k", 3).alias("fire_k"))
    latest = patches(spark, sf_dir).groupBy("cluster_id").agg(F.max_by("patch_id", F.struct("taken", "patch_id")).alias("patch_id"))
    return thermal.join(latest, "cluster_id", "full_outer")


@query(k._FACTS + " SELECT cluster_id, predicted, CAST(cluster_id * 7 % 101 AS DOUBLE) AS confidence FROM facts WHERE predicted = 'wildfire' AND cluster_id * 7 % 101 >= 20 ORDER BY confidence DESC, cluster_id LIMIT 200")
def list_classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of one class from a least confidence on, surest first."""
    f = k._facts(spark, sf_dir).select("cluster_id", "predicted", (F.col("cluster_id") * 7 % 101).cast("double").alias("confidence"))
    return f.where("predicted = 'wildfire' and confidence >= 20").orderBy(F.desc("confidence"), "cluster_id").limit(200)


_PLACES = ", named AS (SELECT s_suppkey AS place_id, s_name AS place, CAST(700000 + (s_suppkey % 15)*15000 + 400 AS DOUBLE)/1e4 AS p_lon, CAST(80000 + (s_suppkey // 15)*5000 - 300 AS DOUBLE)/1e4 AS p_lat FROM supplier)"


@query(k._FACTS + _PLACES + f"""
, pn AS (SELECT s.cluster_id, place_id, place, {k.hav('s.lon', 's.lat', 'p_lon', 'p_lat')} AS m FROM sites s, named),
pb AS (SELECT * FROM pn WHERE m <= 20000 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY m, place_id) = 1)
SELECT f.cluster_id, round(m,3) AS place_m, CASE WHEN m <= built_m + 1500 THEN place END AS settlement FROM facts f LEFT JOIN pb USING (cluster_id)""")
def nearest_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest named place within 20 km, whose name is used only if it isn't much further than the built-up area."""
    key = F.col("s_suppkey")
    places = views.table(spark, sf_dir, "supplier").select(key.alias("place_id"), F.col("s_name").alias("place"), ((700000 + key % 15 * 15000 + 400).cast("double") / 1e4).alias("f_lon"), ((80000 + F.floor(key / 15) * 5000 - 300).cast("double") / 1e4).alias("f_lat"))
    f = k._facts(spark, sf_dir)
    near = ingest.within_radius(f.select("cluster_id", "lon", "lat"), places, 20_000.0).groupBy("cluster_id").agg(F.min(F.struct("distance_m", "place_id", "place")).alias("p"))
    both = f.join(near, "cluster_id", "left")
    return both.select("cluster_id", r("p.distance_m", 3).alias("place_m"), F.when(scoring.same_site(F.col("p.distance_m"), F.col("built_m"), C.SETTLEMENT_EXCESS_M), F.col("p.place")).alias("settlement"))


def event(spark: SparkSession, sf_dir: str, cluster_id: int | None = None) -> DataFrame:
    """All sections of an event, each null where its stage has nothing; of one cluster if its id is given.

    The id is a filter on every section's grouping key, which reaches the scans.
    """
    want = (lambda df: df) if cluster_id is None else (lambda df: df.where(F.col("cluster_id") == cluster_id))
    out = want(k._facts(spark, sf_dir)).select("cluster_id", "last_seen", "predicted", "facility_id")
    w = k._wui(spark, sf_dir).select("cluster_id", F.struct("eta", "priority").alias("threat"))
    p = k._ptsi(spark, sf_dir).select("cluster_id", F.struct("score", "source_class", "normal").alias("ptsi"))
    f = temporal.kalman(views.detections(spark, sf_dir)).select("cluster_id", F.struct("frp", "rate").alias("forecast"))
    y = temporal.rhythm(views.detections(spark, sf_dir)).select("cluster_id", F.struct("n_observations", "shift_sharpness").alias("rhythm"))
    for part in (w, p, f, y):
        out = out.join(want(part), "cluster_id", "left")
    return out


@query(k._FACTS + k._WUI + k._RHYTHM[k._RHYTHM.index(", spn") :] + k._PTSI[k._PTSI.index(", lasts") :] + k._KALMAN + """
SELECT w.cluster_id, w.last_seen, predicted, facility_id, priority, round(eta,4) AS eta_hours, round(score,6) AS ptsi, source_class, round(kal.f,5) AS frp_now, round(kal.r,6) AS frp_rate, round(CASE WHEN ry.n >= 8 AND k >= 2 THEN greatest(0,least(1,1-h/ln(k))) END,6) AS shift_sharpness
FROM wui w LEFT JOIN ptsi USING (cluster_id) LEFT JOIN kal USING (cluster_id) LEFT JOIN ry USING (cluster_id)""")
def get_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of every event; ``event`` reads one."""
    e = event(spark, sf_dir)
    return e.select(
        "cluster_id", "last_seen", "predicted", "facility_id", F.col("threat.priority").alias("priority"), r("threat.eta", 4).alias("eta_hours"), r("ptsi.score").alias("ptsi"), F.col("ptsi.source_class").alias("source_class"),
        r("forecast.frp", 5).alias("frp_now"), r("forecast.rate").alias("frp_rate"), r("rhythm.shift_sharpness").alias("shift_sharpness"),
    )
