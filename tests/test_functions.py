"""Column functions against known values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from emberflow import constants as C
from emberflow.functions import detection, geo, physics, scoring
from emberflow.operators import ingest, state, temporal
from emberflow.sources import views


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def cases():
    """Columns need a session, so they are made inside the test."""
    return [
        (geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), math.radians(1) * 6371000),
        (geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(-1.0), F.lit(0.0)), 270.0),
        (geo.downwind(F.lit(270.0)), 90.0),
        (geo.angular_difference(F.lit(350.0), F.lit(10.0)), 20.0),
        (geo.angular_difference(F.lit(-10.0), F.lit(10.0)), 20.0),
        (detection.viirs_confidence(F.lit(" N ")), 0.7),
        (detection.modis_confidence(F.lit("130")), 1.0),
        (detection.modis_confidence(F.lit("x")), None),
        (detection.number(F.lit("nan")), None),
        (detection.training_confidence(F.lit("85")), 0.85),
        (detection.training_confidence(F.lit("m")), 0.6),
        (detection.confidence_band(F.lit(0.5)), "NOMINAL"),
        (detection.sensor_family(F.lit("goes_16")), "GOES"),
        (detection.decayed_confidence(F.lit(0.8), F.lit(None).cast("double")), 0.68),
        (detection.decayed_confidence(F.lit(None).cast("double"), F.lit(1.0)), 0.25),
        (detection.risk_score(F.lit(100.0), F.lit(400.0), F.lit("industrial_fire"), F.lit(True)), 100),
        (detection.risk_score(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(False)), 0),
        (detection.is_active(F.lit(False), F.lit(None).cast("boolean")), False),
        (physics.stability(F.lit(1.0), F.lit(True), F.lit(0.1)), "A"),
        (physics.stability(F.lit(4.0), F.lit(False), F.lit(None).cast("double")), "D"),
        (physics.sigma_y(F.lit(1000.0), F.lit("D")), 80 / math.sqrt(1.1)),
        (physics.plume_rise(F.lit(0.0), F.lit(3.0)), 0.0),
        (physics.brightness_temperature(3.74e-6, physics.radiance(3.74e-6, F.lit(350.0))), 350.0),
        (scoring.wui_priority(F.lit(None).cast("double"), F.lit(1.0)), C.MONITOR),
        (scoring.wui_priority(F.lit(8000.0), F.lit(11.0)), C.CRITICAL),
        (scoring.gated_priority(F.lit(C.CRITICAL), F.lit(False), F.lit(False), F.lit(True)), C.WATCH),
        (scoring.proximity_score(F.lit(None).cast("double")), 5.0),
        (scoring.proximity_score(F.lit(10000.0)), 5.0),
        (scoring.trips(F.lit(1.0), 5000.0), 1),
        (scoring.trips(F.lit(0.0), 5000.0), 0),
        (scoring.effective_ha(F.lit(None).cast("double"), F.lit("modis")), 100.0),
        (scoring.hours_to_impact(F.lit(12.0), F.lit(24.0)), 12.0),
        (scoring.freshness(F.lit(13.0), F.lit(None).cast("double")), "MODERATE"),
        (scoring.critical_threshold(F.lit(1.0), F.lit(0.0)), 10.0),
        (scoring.source_class(F.lit(0.6)), "persistent"),
        (geo.tile_name(F.lit(77.1), F.lit(28.7)), "N27E075"),
    ]


def test_values(spark):
    columns, wanted = zip(*cases(), strict=True)
    got = spark.range(1).select(*[c.alias(f"v{i}") for i, c in enumerate(columns)]).first()
    for i, want in enumerate(wanted):
        assert got[i] == (pytest.approx(want, rel=1e-9) if isinstance(want, float) else want), i


def test_ring(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))])
    assert value(spark, geo.point_in_ring(F.lit(1.0), F.lit(1.0), ring)) is True
    assert value(spark, geo.point_in_ring(F.lit(3.0), F.lit(1.0), ring)) is False
    closed = value(spark, geo.close_ring(ring))
    assert closed[0] == closed[-1] and len(closed) == 5
    assert value(spark, geo.ring_area_km2(ring)) == pytest.approx(4 * 111.32**2 * math.cos(math.radians(1)), rel=1e-6)


def test_votes_disagree(spark):
    none = F.lit(None)
    vote = scoring.votes(F.lit(86.3), F.lit(23.7), F.lit(None).cast("timestamp"), F.lit("refinery"), F.lit(100.0), F.lit(20.0), none.cast("double"), none.cast("double"), F.lit(0.9), none.cast("double"), F.lit(False))
    labels = value(spark, F.transform(vote, lambda v: v["label"]))
    assert labels == ["mining", "industrial_fire"]
    assert value(spark, scoring.resolved(vote))["label"] == "industrial_fire"
    alerted = scoring.votes(F.lit(0.0), F.lit(0.0), F.lit(None).cast("timestamp"), F.lit("refinery"), F.lit(100.0), F.lit(20.0), none.cast("double"), none.cast("double"), F.lit(0.9), none.cast("double"), F.lit(True))
    assert value(spark, scoring.resolved(alerted)) is None


def test_components_merge_chains(spark):
    points = spark.createDataFrame([(i, 77.0 + 0.004 * (i if i < 5 else i + 100), 20.0) for i in range(8)] + [(9, 77.0, 20.0)], "id long, lon double, lat double")
    got = {r.id: r.component for r in ingest.clustered(points, 0.005).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 9: 0, 5: 5, 6: 5, 7: 5}


def test_upserts(spark):
    old = spark.createDataFrame([(1, 1.0, "a", True), (2, 2.0, "b", False)], "k long, x double, y string, v boolean")
    new = spark.createDataFrame([(1, None, "z", False), (2, 5.0, "q", False), (3, 3.0, "c", False)], "k long, x double, y string, v boolean")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(state.upsert(old, new, "k", ["x"]))[0][:3] == (1, 1.0, "a")
    assert rows(state.latest_wins(old, new, "k")) == sorted(map(tuple, new.collect()))
    assert (1, 1.0, "a", True) in rows(state.keep_verified(old, new, "k", "v"))
    assert [r.k for r in state.insert_new(old, new.unionByName(new), ["k"]).collect()] == [3]
    assert rows(state.replace_children(old, new.where("k = 3"), "k", new.where("k in (2, 3)"))) == [(1, 1.0, "a", True), (3, 3.0, "c", False)]


def test_cached_null_is_a_hit(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    cache = spark.sql("select 'a' key, cast(null as double) value, timestamp '2024-01-01 00:00:10' stored_at union all select 'b', 1.0D, timestamp '2023-01-01'")
    got = {r.key: r.hit for r in state.cached(asked, cache, "key", F.lit("2024-01-01 00:01:00").cast("timestamp"), 3600).collect()}
    assert got == {"a": True, "b": False, "c": False}


def test_short_series(spark):
    df = spark.sql("select 1L cluster_id, 1L id, timestamp '2024-01-01' acq_datetime, 10D frp union all select 2L, 2L, timestamp '2024-01-01', cast(null as double)")
    got = temporal.kalman(df).collect()
    assert [(r.cluster_id, r.frp, r.rate, r.n_updates) for r in got] == [(1, 10.0, 0.0, 1)]
    assert temporal.walk_forward(df).count() == 0


@pytest.mark.parametrize("radius_m", [5_000.0, 3_200_000.0])
def test_within_radius_at_any_latitude(spark, radius_m):
    rng = random.Random(17)
    rows = []
    for lat in (0.0, 59.9, 65.0, -75.0, 89.0, 89.99, -89.99):
        for base in (0.05, 179.99, -179.99):
            rows += [(len(rows) + k, max(-180.0, min(180.0, base + rng.uniform(-0.3, 0.3))), max(-90.0, min(90.0, lat + rng.uniform(-0.04, 0.04)))) for k in range(10)]
    points = spark.createDataFrame(rows, "a long, lon double, lat double")
    other = spark.createDataFrame(rows, "b long, f_lon double, f_lat double")
    got = [(r.a, r.b) for r in ingest.within_radius(points, other, radius_m).select("a", "b").collect()]
    distance = geo.haversine_m(F.col("lon"), F.col("lat"), F.col("f_lon"), F.col("f_lat"))
    want = {(r.a, r.b) for r in points.crossJoin(other).where(distance <= radius_m).select("a", "b").collect()}
    assert len(got) == len(set(got)) and set(got) == want


def test_within_radius_beyond_the_poles(spark):
    """Latitudes that go on over the pole are met as the distance has them, and near a pole a facility has a few cells."""
    spots = [(float(x), y + d) for x in (70.0, 71.5, 250.0) for y in (60.0, 89.5, 90.0, 120.0, 269.99, 450.0, 1208.0) for d in (0.0, 0.004)]
    p = spark.createDataFrame([(i, *s) for i, s in enumerate(spots)], "a int, lon double, lat double")
    f = spark.createDataFrame([(i, x, y + 0.002) for i, (x, y) in enumerate(spots)], "b int, f_lon double, f_lat double")
    apart = geo.haversine_m(F.col("lon"), F.col("lat"), F.col("f_lon"), F.col("f_lat"))
    want = sorted(map(tuple, p.crossJoin(f).where(apart <= 1000.0).select("a", "b").collect()))
    found = ingest.within_radius(p, f, 1000.0).select("a", "b")
    assert sorted(map(tuple, found.collect())) == want and len(want) > 84
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    poles = spark.range(1000).selectExpr("id AS b", "70.0D AS f_lon", "89.9 + id % 300 AS f_lat")
    assert ingest.placed_around(poles, 1000.0).count() < 40_000


def test_tiles_beyond_two_digits(spark):
    assert value(spark, geo.tile_name(F.lit(72.5), F.lit(104.9))) == "N102E072"
    assert value(spark, geo.tile_name(F.lit(72.5), F.lit(1500.5))) == "N1500E072"


def test_halves_are_rounded_as_sql_does(spark):
    assert value(spark, geo.rounded(F.lit(64.000025), 5)) == 64.00002 and value(spark, geo.rounded(F.lit(-2.5), 0)) == -3.0


def test_means_do_not_depend_on_tasks(spark):
    """A centroid is summed in the order of ids, however the rows are dealt: its last bits decide on which side of an edge it lies."""
    rng = random.Random(3)
    lats = {c: [27.0 + rng.randint(-2, 2) / 1e3 for _ in range(120)] for c in range(40)}
    rows = [(c, i * 40 + c, 70.0, y) for c, own in lats.items() for i, y in enumerate(own)]
    points = spark.createDataFrame(rows, "cluster_id long, id long, lon double, lat double").selectExpr("*", "timestamp '2024-01-01' acq_datetime", "1D frp", "1D brightness")
    want = {}
    for c, own in lats.items():
        total = 0.0
        for y in own:
            total += y
        want[c] = total / 120
    for dealt in (points.coalesce(1), points.orderBy("lat").repartition(7)):
        assert {r.cluster_id: r.lat for r in views.sites(dealt).collect()} == want
