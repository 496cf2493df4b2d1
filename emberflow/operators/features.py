"""Per-cluster aggregates: thermal features, extent, growth, baselines, trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import detection, geo, physics
from ..sources.views import with_means


def thermal(points: DataFrame) -> DataFrame:
    span = (F.max(F.unix_micros("acq_datetime")) - F.min(F.unix_micros("acq_datetime"))) / 8.64e10
    n = F.count("*").cast("double")
    flag = F.when(F.col("daynight") == "N", 1.0).when(F.col("daynight") == "D", 0.0)
    return points.groupBy("cluster_id").agg(
        F.avg("frp").alias("frp_mean"), F.max("frp").alias("frp_max"), F.stddev_pop("frp").alias("frp_std"),
        F.avg("brightness").alias("brightness_mean"), F.max("brightness").alias("brightness_max"), F.avg("confidence").alias("confidence_mean"),
        F.coalesce(span, F.lit(0.0)).alias("persistence_days"), n.alias("n_detections"), (n / F.greatest(F.coalesce(span, F.lit(0.0)), F.lit(1.0))).alias("detections_per_day"),
        F.avg(flag).alias("night_fraction"), F.count_distinct(F.when(F.coalesce("source", F.lit("")) != "", detection.platform(F.col("source")))).cast("double").alias("source_diversity"),
    )


def extent_and_growth(points: DataFrame) -> DataFrame:
    """Largest distance between detections, and its growth from the first half of a cluster's rows to all, a day.

    On a parallel the distance to any point grows with the difference in longitude, so of the detections at one latitude
    only the westernmost and the easternmost can be part of the largest distance: pairs are made of these alone.
    """
    w = Window.partitionBy("cluster_id")
    ordered = points.withColumn("rn", F.row_number().over(w.orderBy("acq_datetime", "id"))).withColumn("n", F.count("*").over(w))
    early = F.col("rn") <= F.floor(F.col("n") / 2)
    first = F.when(early, F.col("lon"))
    rows = ordered.groupBy("cluster_id", "lat").agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min(first).alias("fw"), F.max(first).alias("fe"))
    ends = F.array(*[F.struct(F.col(c).alias("lon"), F.lit(c.startswith("f")).alias("early")) for c in ("w", "e", "fw", "fe")])
    a = rows.select("cluster_id", "lat", F.explode(F.array_distinct(F.filter(ends, lambda p: p["lon"].isNotNull()))).alias("p")).select("cluster_id", F.col("p.lon").alias("lon"), "lat", F.col("p.early").alias("early"))
    b = a.select("cluster_id", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), F.col("early").alias("early2"))
    pair = a.join(b, "cluster_id").where((F.col("lon") < F.col("lon2")) | ((F.col("lon") == F.col("lon2")) & (F.col("lat") < F.col("lat2"))))
    km = geo.haversine_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")) / 1000.0
    wide = pair.groupBy("cluster_id").agg(F.max(km).alias("extent"), F.max(F.when(F.col("early") & F.col("early2"), km)).alias("early_extent"))
    spans = points.groupBy("cluster_id").agg(((F.max(F.unix_micros("acq_datetime")) - F.min(F.unix_micros("acq_datetime"))) / 8.64e10).alias("span"), F.count("*").alias("n"))
    extent, first = F.coalesce("extent", F.lit(0.0)), F.coalesce("early_extent", F.lit(0.0))
    growth = F.when((F.col("n") < 4) | (F.col("span") <= 0), 0.0).otherwise((extent - first) / F.col("span"))
    return spans.join(wide, "cluster_id", "left").select("cluster_id", extent.alias("spatial_extent_km"), growth.alias("spatial_growth_rate"))


def baseline(points: DataFrame, days: int = C.BASELINE_DAYS) -> DataFrame:
    """Statistics of the ``days`` before each cluster's latest detection, which is not part of them."""
    last = points.groupBy("cluster_id").agg(F.max("acq_datetime").alias("last"))
    history = points.join(last, "cluster_id").where((F.col("acq_datetime") < F.col("last")) & (F.col("acq_datetime") >= F.col("last") - F.make_dt_interval(F.lit(days))) & F.col("frp").isNotNull())
    return last.join(history.groupBy("cluster_id").agg(F.count("*").alias("n_base"), F.avg("frp").alias("base_mean"), F.stddev_pop("frp").alias("base_std"), F.percentile("frp", F.lit(0.5)).alias("base_p50"), F.percentile("frp", F.lit(0.95)).alias("base_p95"), F.max("frp").alias("base_max")), "cluster_id", "left")


def zscore(current, mean, std):
    """Distance of the peak from the baseline in deviations; a flat baseline gives 0 or +-3."""
    close = F.abs(current - mean) <= 1e-9 * F.greatest(F.abs(current), F.abs(mean))
    flat = F.when(close, 0.0).when(current > mean, 3.0).otherwise(-3.0)
    return F.when(current.isNull() | mean.isNull(), F.lit(None).cast("double")).when(F.coalesce(std, F.lit(0.0)) == 0, flat).otherwise((current - mean) / std)


def frp_rates(points: DataFrame) -> DataFrame:
    """Steepest rise between consecutive detections, MW an hour; null if nothing rises."""
    w = Window.partitionBy("cluster_id").orderBy("acq_datetime", "id")
    dated = points.where(F.col("frp").isNotNull() & F.col("acq_datetime").isNotNull())
    hours = (F.unix_micros("acq_datetime") - F.lag(F.unix_micros("acq_datetime")).over(w)) / 3.6e9
    rate = F.when(hours > 0, (F.col("frp") - F.lag("frp").over(w)) / hours)
    steps = dated.withColumn("rate", rate)
    return steps.groupBy("cluster_id").agg(F.max("frp").alias("frp_max"), F.max(F.when(F.col("rate") > 0, F.col("rate"))).alias("rate"))


def trajectory(points: DataFrame, hours: float = 12.0, buckets: int = 6) -> DataFrame:
    """Direction and rate of advance over the last buckets of ``hours``, counted from a cluster's first detection."""
    start = F.min(F.unix_micros("acq_datetime")).over(Window.partitionBy("cluster_id"))
    dated = points.withColumn("bucket", F.floor((F.unix_micros("acq_datetime") - start) / (hours * 3.6e9)))
    centred = with_means(dated.select("cluster_id", "bucket", "id", "acq_datetime", "lon", "lat"), ["cluster_id", "bucket"], ["lon", "lat"])
    centres = centred.groupBy("cluster_id", "bucket").agg(F.min(F.unix_micros("acq_datetime")).alias("t"), F.first("lon").alias("lon"), F.first("lat").alias("lat"))
    recent = centres.withColumn("back", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("bucket")))).where(F.col("back") <= buckets)
    w = Window.partitionBy("cluster_id").orderBy("bucket")
    legs = recent.withColumn("leg_m", geo.haversine_m(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))).withColumn("b", geo.bearing_deg(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")))
    moving = F.col("leg_m") >= 1.0
    g = legs.groupBy("cluster_id").agg(
        F.count("*").alias("n_observations"), F.min(F.struct("bucket", "t", "lon", "lat")).alias("a"), F.max(F.struct("bucket", "t", "lon", "lat")).alias("z"),
        (F.sum("leg_m") / 1000.0).alias("path_km"), F.sum(F.when(moving, F.col("leg_m") * F.sin(F.radians("b")))).alias("x"), F.sum(F.when(moving, F.col("leg_m") * F.cos(F.radians("b")))).alias("y"),
        F.min(F.when(moving, F.struct("bucket", "b"))).alias("first_leg"), F.count(F.when(moving, 1)).alias("moves"),
    )
    net = geo.haversine_m(F.col("a.lon"), F.col("a.lat"), F.col("z.lon"), F.col("z.lat")) / 1000.0
    days = (F.col("z.t") - F.col("a.t")) / 8.64e10
    directed = (F.col("moves") > 0) & (days > 0) & (F.col("n_observations") >= 2)
    return g.select(
        "cluster_id", "n_observations", F.when(directed, geo.circular_mean(F.col("x"), F.col("y"), F.col("first_leg.b"))).alias("bearing"),
        F.when(directed, net / days).otherwise(0.0).alias("rate_km_day"), F.when(F.col("n_observations") >= 2, net).otherwise(0.0).alias("net_km"), F.greatest(days, F.lit(0.0)).alias("days"),
        F.when(directed & (F.col("path_km") > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), net / F.col("path_km")))).otherwise(0.0).alias("confidence"),
    )


def dual_band(points: DataFrame) -> DataFrame:
    """Detections of sensors with both bands, and with both measured."""
    two = F.upper("source").contains("VIIRS") | F.upper("source").contains("MODIS")
    return points.where(two & F.col("brightness").isNotNull() & F.col("brightness_tir").isNotNull())


def background(points: DataFrame) -> DataFrame:
    """Ambient temperature of each cluster: a low percentile of the plausible long-wave values, else what is usual by day or night."""
    usable = F.when(F.col("brightness_tir").between(*C.BACKGROUND_K), F.col("brightness_tir"))
    flag = lambda f: F.count(F.when(F.col("daynight") == f, 1))
    g = points.groupBy("cluster_id").agg(F.count(usable).alias("n_usable"), F.percentile(usable, F.lit(C.BACKGROUND_SHARE)).alias("low"), (flag("D") >= flag("N")).alias("day"))
    enough = F.col("n_usable") >= C.MIN_BACKGROUND
    usual = F.when(F.col("day"), C.BACKGROUND_DAY_K).otherwise(C.BACKGROUND_NIGHT_K)
    return g.select("cluster_id", F.when(enough, F.col("low")).otherwise(usual).alias("background_k"), F.when(enough, "percentile").otherwise("climatology").alias("background_source"), F.when(enough, F.col("n_usable")).otherwise(0).alias("n_samples"))


def fire_temperature(points: DataFrame) -> DataFrame:
    """Temperature and size of the fire in each cluster's hottest detection, with the bracket of an uncertain background."""
    both = dual_band(points)
    top = both.groupBy("cluster_id").agg(F.max_by(F.struct("brightness", "brightness_tir", "source", "scan", "track"), F.struct("brightness", -F.col("id"))).alias("h"))
    x = top.join(background(both), "cluster_id").withColumn("s", physics.dozier_bracket(F.col("h.brightness"), F.col("h.brightness_tir"), F.col("background_k"), F.col("h.source")))
    area = F.col("s.fraction") * physics.pixel_area_m2(F.col("h.scan"), F.col("h.track"))
    return x.select("cluster_id", "background_k", "background_source", "n_samples", F.col("s.temperature_k").alias("fire_k"), F.col("s.fraction").alias("fraction"), area.alias("area_m2"), F.col("s.low_k").alias("low_k"), F.col("s.high_k").alias("high_k"), F.col("s.well_constrained").alias("well_constrained"))
