"""Rhythm, periodicity, filtering and forecasts of detection series."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import detection, geo
from ..functions.physics import let


def _span_days() -> Column:
    return (F.max(F.unix_micros("acq_datetime")) - F.min(F.unix_micros("acq_datetime"))) / 8.64e10


def slots(points: DataFrame) -> DataFrame:
    """Detections by platform and daylight with the share of expected passes and the circular mean of solar hours."""
    dated = points.where(F.col("acq_datetime").isNotNull())
    spans = dated.groupBy("cluster_id").agg(_span_days().alias("span_days"))
    angle = geo.solar_hour(F.col("acq_datetime"), F.col("lon")) / 24.0 * 2 * math.pi
    g = dated.groupBy("cluster_id", detection.platform(F.col("source")).alias("platform"), F.coalesce("daynight", F.lit("U")).alias("daynight")).agg(F.count("*").alias("n"), F.avg(F.cos(angle)).alias("x"), F.avg(F.sin(angle)).alias("y"))
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    expected = F.greatest("span_days", F.lit(1.0))
    spread = F.when(r >= 1.0, 0.0).otherwise(F.sqrt(-2.0 * F.log(F.greatest(r, F.lit(1e-12)))) / (2 * math.pi) * 24.0)
    return g.join(spans, "cluster_id").select("cluster_id", "platform", "daynight", "n", "span_days", expected.alias("expected"), F.least(F.col("n") / expected, F.lit(1.0)).alias("rate"), F.pmod(F.atan2("y", "x") / (2 * math.pi) * 24.0, F.lit(24.0)).alias("mean_hour"), spread.alias("spread_hours"))


def rhythm(points: DataFrame) -> DataFrame:
    """Sharpness, day-night contrast, weekend suppression and schedule anomaly of each cluster."""
    s = slots(points)
    total = F.sum("rate").over(Window.partitionBy("cluster_id"))
    p = F.col("rate") / total
    entropy = s.withColumn("h", -p * F.log(p)).groupBy("cluster_id").agg(
        F.first("span_days").alias("span_days"), F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("h").alias("h"),
        F.avg(F.when(F.col("daynight") == "D", F.col("rate"))).alias("day"), F.avg(F.when(F.col("daynight") == "N", F.col("rate"))).alias("night"),
        F.min(F.when((F.col("n") >= 3) & (F.col("spread_hours") > C.SLOT_TOLERANCE_H), 0).otherwise(1)).alias("consistent"),
    )
    sunday = F.weekday("acq_datetime") == 6
    week = points.groupBy("cluster_id").agg(F.sum(F.when(sunday, 1).otherwise(0)).alias("sundays"), F.sum(F.when(sunday, 0).otherwise(1)).alias("others"))
    latest = points.groupBy("cluster_id").agg(F.max(F.struct("acq_datetime", "id", detection.platform(F.col("source")).alias("platform"), F.coalesce("daynight", F.lit("U")).alias("daynight"))).alias("z"))
    last_slot = latest.select("cluster_id", F.col("z.platform").alias("platform"), F.col("z.daynight").alias("daynight")).join(s, ["cluster_id", "platform", "daynight"]).select("cluster_id", (F.least((F.col("n") - 1) / F.col("expected"), F.lit(1.0)) < C.QUIET_RATE).alias("anomaly"))
    all_of = entropy.join(week, "cluster_id").join(last_slot, "cluster_id")
    enough = F.col("n") >= C.MIN_RHYTHM
    clamp = lambda x, low: F.greatest(F.lit(low), F.least(F.lit(1.0), x))
    weeks = F.greatest(F.col("span_days") / 7.0, F.lit(1.0 / 7.0))
    weekday, weekend = F.col("others") / weeks / 6.0, F.col("sundays") / weeks
    suppression = F.when(weekday <= 0, F.when(weekend > 0, -1.0)).otherwise(clamp((weekday - weekend) / weekday, -1.0))
    return all_of.select(
        "cluster_id", F.col("n").alias("n_observations"),
        F.when(enough & (F.col("k") >= 2), clamp(1.0 - F.col("h") / F.log(F.col("k")), 0.0)).alias("shift_sharpness"),
        F.when(enough & (F.col("day") + F.col("night") > 0), (F.col("day") - F.col("night")) / (F.col("day") + F.col("night"))).alias("day_night_contrast"),
        F.when(enough & (F.col("span_days") >= C.MIN_WEEKLY_DAYS), suppression).alias("weekend_suppression"),
        (enough & F.col("anomaly")).alias("schedule_anomaly"), (F.col("consistent") == 1).alias("slots_consistent"),
    )


def daily_series(points: DataFrame) -> DataFrame:
    """Detections a day, with zeros for the days between."""
    days = points.groupBy("cluster_id", F.to_date("acq_datetime").alias("day")).agg(F.count("*").alias("n"))
    grid = days.groupBy("cluster_id").agg(F.min("day").alias("a"), F.max("day").alias("z")).select("cluster_id", F.explode(F.sequence("a", "z")).alias("day"))
    return grid.join(days, ["cluster_id", "day"], "left").select("cluster_id", "day", F.coalesce("n", F.lit(0)).alias("n"))


def periodogram(series: DataFrame, least: float = 2.0, most: float = 30.0, min_days: int = 14) -> DataFrame:
    """Power at the periods from ``least`` to ``most`` days: Fourier sums over a cluster's days and frequencies."""
    w = Window.partitionBy("cluster_id")
    x = series.withColumn("i", F.row_number().over(w.orderBy("day")) - 1).withColumn("size", F.count("*").over(w)).withColumn("v", F.col("n") - F.avg("n").over(w)).where(F.col("size") >= min_days)
    waves = x.withColumn("k", F.explode(F.sequence(F.lit(1), F.floor(F.col("size") / 2).cast("int"))))
    angle = 2 * math.pi * F.col("k") * F.col("i") / F.col("size")
    sums = waves.groupBy("cluster_id", "k", "size").agg(F.sum(F.col("v") * F.cos(angle)).alias("re"), F.sum(F.col("v") * F.sin(angle)).alias("im"))
    period = F.col("size") / F.col("k")
    return sums.select("cluster_id", F.col("k").cast("long").alias("k"), period.alias("period_days"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power")).where((period >= least) & (period <= most))


def dominant_period(power: DataFrame) -> DataFrame:
    g = power.groupBy("cluster_id").agg(F.max(F.struct("power", (-F.col("k")).alias("order"), "period_days")).alias("best"), F.sum("power").alias("total"))
    return g.where("total > 1e-9").select("cluster_id", F.col("best.period_days").alias("period_days"), (F.col("best.power") / F.col("total")).alias("confidence"), (F.abs(F.col("best.period_days") - 7.0) <= 0.75).alias("weekly"))


# --- Kalman filter ---------------------------------------------------------------------------------
# State: f and r (MW, MW an hour), covariance a, b, d, time t, and what has been counted.


def _noise(f: Column) -> Column:
    std = F.greatest(C.RELATIVE_ERROR * F.abs(f), F.lit(C.MIN_NOISE_MW))
    return std * std


def _start(o: Column) -> Column:
    scale = F.greatest(F.abs(o["f"]), F.lit(C.MIN_SCALE_MW)) / 24.0
    return F.struct(o["t"].alias("t"), o["f"].alias("f"), F.lit(0.0).alias("r"), _noise(o["f"]).alias("a"), F.lit(0.0).alias("b"), (scale * scale).alias("d"), F.lit(1).alias("n"), F.lit(0.0).alias("nis"))


def _predicted(s: Column, dt: Column, intensity: Column | float = C.PROCESS_NOISE) -> Column:
    f = s["f"] + s["r"] * dt
    scale = F.greatest(F.abs(F.greatest(f, s["f"])), F.lit(C.MIN_SCALE_MW))
    q = intensity * scale * scale
    return F.struct(f.alias("f"), s["r"].alias("r"), (s["a"] + 2 * dt * s["b"] + dt * dt * s["d"] + q * dt * dt * dt / 3.0).alias("a"), (s["b"] + dt * s["d"] + q * dt * dt / 2.0).alias("b"), (s["d"] + q * dt).alias("d"), s["n"].alias("n"), s["nis"].alias("nis"))


def _updated(p: Column, o: Column) -> Column:
    s, e = p["a"] + _noise(o["f"]), o["f"] - p["f"]
    g, h = p["a"] / s, p["b"] / s
    off = 0.5 * ((p["b"] - g * p["b"]) + (p["b"] - h * p["a"]))
    return F.struct(o["t"].alias("t"), (p["f"] + g * e).alias("f"), (p["r"] + h * e).alias("r"), (p["a"] - g * p["a"]).alias("a"), off.alias("b"), (p["d"] - h * p["b"]).alias("d"), (p["n"] + 1).alias("n"), (p["nis"] + e * e / s).alias("nis"))


def _series(points: DataFrame) -> DataFrame:
    """Time (hours since the cluster's first) and FRP, in order, as one array a cluster; repeats stay in order of id."""
    w = Window.partitionBy("cluster_id")
    usable = points.where("frp is not null and frp >= 0 and acq_datetime is not null")
    hours = (F.unix_micros("acq_datetime") - F.min(F.unix_micros("acq_datetime")).over(w)) / 3.6e9
    return usable.withColumn("t", hours).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("t", "id", F.col("frp").alias("f")))).alias("obs"))


def kalman(points: DataFrame) -> DataFrame:
    """Filtered level and rate after all observations: an ordered fold inside the row."""
    step = lambda s, o: let(_predicted(s, o["t"] - s["t"]), lambda p: _updated(p, o))
    folded = F.aggregate(F.slice("obs", F.lit(2), F.greatest(F.size("obs") - 1, F.lit(0))), _start(F.get("obs", F.lit(0))), step)
    return _series(points).select("cluster_id", folded.alias("s")).select("cluster_id", F.col("s.f").alias("frp"), F.col("s.r").alias("rate"), F.col("s.a").alias("var_frp"), F.col("s.b").alias("cov"), F.col("s.d").alias("var_rate"), F.col("s.n").cast("long").alias("n_updates"), F.when(F.col("s.n") > 1, F.col("s.nis") / (F.col("s.n") - 1)).alias("mean_nis"))


def walk_forward(points: DataFrame, warm: int = 4, window: int = 5) -> DataFrame:
    """Prediction and deviation of every observation after the first ``warm``, from those before it.

    The history is filtered with process noise that follows the last surprises; the prediction itself takes the plain
    noise.  One fold carries the history's state, so a series of n costs n steps.
    """
    empty = F.expr("cast(array() as array<struct<i:int,f:double,p:double,v:double>>)")
    start = F.struct(_start(F.get("obs", F.lit(0))).alias("s"), F.expr("cast(array() as array<double>)").alias("recent"), empty.alias("out"))

    def step(acc: Column, o: Column) -> Column:
        dt = o["t"] - acc["s"]["t"]
        mean = F.aggregate(acc["recent"], F.lit(0.0), lambda a, x: a + x) / F.size(acc["recent"])
        surprise = F.when(F.size(acc["recent"]) < 2, 1.0).otherwise(F.greatest(F.lit(1.0), F.least(mean, F.lit(25.0))))

        def put(p: Column) -> Column:
            ahead, own = p["ahead"], p["own"]
            row = F.struct(acc["s"]["n"].alias("i"), o["f"].alias("f"), ahead["f"].alias("p"), (ahead["a"] + _noise(F.greatest(ahead["f"], F.lit(0.0)))).alias("v"))
            e = o["f"] - own["f"]
            nis = F.array(e * e / (own["a"] + _noise(o["f"])))
            recent = F.concat(F.when(F.size(acc["recent"]) >= window, F.slice(acc["recent"], 2, window - 1)).otherwise(acc["recent"]), nis)
            return F.struct(_updated(own, o).alias("s"), recent.alias("recent"), F.concat(acc["out"], F.array(row)).alias("out"))

        both = F.struct(_predicted(acc["s"], dt).alias("ahead"), _predicted(acc["s"], dt, C.PROCESS_NOISE * surprise).alias("own"))
        return let(both, put)

    folded = F.aggregate(F.slice("obs", F.lit(2), F.greatest(F.size("obs") - 1, F.lit(0))), start, step, lambda acc: acc["out"])
    ordered = _series(points).withColumn("obs", F.array_sort(F.transform("obs", lambda o: F.struct(o["t"].alias("t"), o["f"].alias("f")))))
    rows = ordered.select("cluster_id", F.explode(folded).alias("o")).where(F.col("o.i") >= warm)
    return rows.select("cluster_id", F.col("o.i").cast("long").alias("i"), F.col("o.f").alias("actual"), F.col("o.p").alias("predicted"), (F.sqrt(F.greatest(F.col("o.v"), F.lit(0.0))) * C.STD_MULTIPLIER).alias("std"))


def calibration(predictions: DataFrame) -> DataFrame:
    error = F.abs(F.col("actual") - F.col("predicted"))
    inside = lambda z: F.avg(F.when(error <= z * F.col("std"), 1.0).otherwise(0.0))
    g = predictions.groupBy("cluster_id").agg(F.count("*").alias("n"), inside(C.Z50).alias("coverage_50"), inside(C.Z90).alias("coverage_90"), F.avg(error).alias("mae"), F.percentile(error, F.lit(0.5)).alias("median_error"), F.avg((F.col("actual") - F.col("predicted")) / F.col("std")).alias("mean_normalised"))
    verdict = F.when(F.col("coverage_90") < 0.75, "OVERCONFIDENT").when(F.col("coverage_90") > 0.98, "OVER-CONSERVATIVE").otherwise("CALIBRATED")
    return g.withColumn("verdict", verdict)


def draws(spark: SparkSession, samples: int = C.SAMPLES, seed: int = 42) -> DataFrame:
    """The same normal pairs for every cluster; a fixed number of rows."""
    rng = random.Random(seed)
    return spark.createDataFrame([(rng.gauss(0.0, 1.0), rng.gauss(0.0, 1.0)) for _ in range(samples)], "z1 double, z2 double")


def escalation(states: DataFrame, samples: int = C.SAMPLES, seed: int = 42) -> DataFrame:
    """Time until the threshold over draws of level and rate: states has frp, rate, var_frp, cov, var_rate, threshold."""
    spark, scale = states.sparkSession, C.STD_MULTIPLIER**2
    a, b, d = F.greatest("var_frp", F.lit(0.0)) * scale, F.col("cov") * scale, F.greatest("var_rate", F.lit(0.0)) * scale
    l11 = F.sqrt(a)
    l21 = F.when(l11 > 0, b / l11).otherwise(0.0)
    rest = F.sqrt(F.greatest(d - l21 * l21, F.lit(0.0)))
    open_ = states.where("threshold is not null and frp < threshold").withColumn("l11", l11).withColumn("l21", l21).withColumn("l22", rest)
    # the draws are a fixed number of rows: this side of the product does not grow with the data
    pairs = open_.crossJoin(F.broadcast(draws(spark, samples, seed)))
    level, rate = F.col("frp") + F.col("l11") * F.col("z1"), F.col("rate") + F.col("l21") * F.col("z1") + F.col("l22") * F.col("z2")
    time = F.when(rate > C.MIN_RATE_MW_H, F.when(level >= F.col("threshold"), 0.0).otherwise((F.col("threshold") - level) / rate))
    hits = pairs.withColumn("time", F.when(time <= C.MAX_HORIZON_H, time)).groupBy("cluster_id").agg((F.count("time") / samples).alias("probability"), F.percentile("time", F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)])).alias("q"))
    joined = states.join(hits, "cluster_id", "left")
    critical = F.coalesce(F.col("frp") >= F.col("threshold"), F.lit(False))
    rising = ~critical & F.coalesce(F.col("probability") >= C.MIN_PROBABILITY, F.lit(False))
    q = lambda i: F.when(rising, F.get("q", F.lit(i)))
    return joined.select("cluster_id", "threshold", (critical | rising).alias("escalating"), critical.alias("already_critical"), F.when(critical, 0.0).otherwise(q(2)).alias("hours_to_critical"), q(0).alias("p05"), q(1).alias("p25"), q(3).alias("p75"), q(4).alias("p95"), F.when(critical, 1.0).otherwise(F.coalesce("probability", F.lit(0.0))).alias("probability"))


def cadence(points: DataFrame) -> DataFrame:
    """Median of a cluster's positive gaps in hours; null below three detections."""
    w = Window.partitionBy("cluster_id").orderBy("acq_datetime", "id")
    gap = (F.unix_micros("acq_datetime") - F.lag(F.unix_micros("acq_datetime")).over(w)) / 3.6e9
    g = points.withColumn("gap", gap).groupBy("cluster_id").agg(F.max("acq_datetime").alias("last_seen"), F.count("*").alias("n"), F.percentile(F.when(F.col("gap") > 0, F.col("gap")), F.lit(0.5)).alias("median"))
    return g.select("cluster_id", "last_seen", F.when(F.col("n") >= 3, F.col("median")).alias("cadence_hours"))
