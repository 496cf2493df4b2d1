"""Every query with SQL against DuckDB on the smallest tables; jobs against what they stand for."""

import json
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from emberflow import constants as C
from emberflow.functions import geo
from emberflow.operators import features, ingest, models
from emberflow.plans import catalog, events, jobs, places  # noqa: F401  places registers its queries

SF = "/root/testdata/sf0.001"
TABLES = ("nation", "supplier", "events", "embeddings")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return value + 0.0
    return str(value) if hasattr(value, "isoformat") else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_duckdb(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_verdicts(spark):
    """Verdicts of every cluster: the surest class, confidence by evidence, and reasons that name known values."""
    got = jobs.QUERIES["classify_events"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id div 2").distinct().count()
    for v in got:
        assert abs(sum(v.probabilities) - 1) < 1e-4 and v.predicted_class == C.CLASSES[v.probabilities.index(max(v.probabilities))]
        assert abs(v.confidence - 100 * max(v.probabilities) * (0.5 + 0.5 * v.evidence)) < 0.02
        assert len(v.reasons) <= 5 and abs(v.base + sum(v.contributions) - max(v.probabilities)) < 1e-4


def test_leakage_is_found(spark):
    a, b = spark.createDataFrame([(1, 5)], "cluster_id long, tile long"), spark.createDataFrame([(2, 5)], "cluster_id long, tile long")
    models.verify_no_leakage(a, b, ["cluster_id"])
    with pytest.raises(ValueError, match="tile"):
        models.verify_no_leakage(a, b, ["cluster_id"], ["tile"])


def test_one_event_is_read_by_its_id(spark):
    one = events.event(spark, SF, 3)
    assert [x.cluster_id for x in one.collect()] == [3]
    assert events.event(spark, SF, -1).count() == 0


def test_background_and_area(spark):
    """Too few plausible values give what is usual; saturated and cold pixels give no fire."""
    rows = [(1, 400.0, 300.0, "VIIRS", "N"), (2, 310.0, 300.0, "VIIRS", "D"), (3, 290.0, 300.0, "MODIS", "D")] + [(4, 340.0 + i, 296.0 + i, "VIIRS", "D") for i in range(5)]
    points = spark.createDataFrame([(i, *x, 0.5, 0.0 if x[0] == 2 else 0.5) for i, x in enumerate(rows)], "id long, cluster_id long, brightness double, brightness_tir double, source string, daynight string, scan double, track double")
    got = {x.cluster_id: x for x in features.fire_temperature(points).collect()}
    assert (got[1].background_k, got[2].background_k, got[2].background_source) == (290.0, 305.0, "climatology")
    assert got[1].fire_k is None and got[3].fire_k is None and got[2].area_m2 is None
    assert got[4].background_k == pytest.approx(296.4) and got[4].n_samples == 5
    assert got[4].fire_k is None or (got[4].low_k is None or got[4].low_k <= got[4].fire_k <= got[4].high_k)


def test_rings_as_geojson(spark):
    ring = geo.wedge_ring(F.col("x"), F.lit(10.0), F.lit(90.0), F.col("km"), F.lit(20.0))
    a, b = spark.createDataFrame([(70.0, 5.0), (70.0, 0.0)], "x double, km double").select(geo.geojson(ring).alias("g")).collect()
    shape = json.loads(a.g)
    assert shape["type"] == "Polygon" and len(shape["coordinates"][0]) == 15 and shape["coordinates"][0][0] == shape["coordinates"][0][-1] and b.g is None


def test_ring_is_made_of_its_vertices(spark):
    """All 50 vertices of each ring, beginning and ending at the fire, its flanks opposite each other at the tip."""
    got = catalog.QUERIES["plume_rings"](spark, SF).toPandas().sort_values(["id", "seq"]).groupby("id")
    for (_, ring), _ in zip(got, range(50), strict=False):
        assert list(ring.seq) == list(range(50)) and ring.lon.iloc[0] == ring.lon.iloc[49] and ring.lat.iloc[0] == ring.lat.iloc[49]


def test_plumes_are_described_by_all_vertices(spark):
    """A plume's points, extent, tip and half of its right flank are those of its whole ring."""
    names = ["id", "n_points", "west", "south", "east", "north", "middle_lon", "middle_lat"]
    rings = catalog.QUERIES["plume_rings"](spark, SF)
    half = [F.max(F.when(F.col("seq") == 12, F.col(c))) for c in ("lon", "lat")]
    want = rings.groupBy("id").agg(F.count("*"), F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat"), *half).toDF(*names)
    got = catalog.QUERIES["stability_plume_geometry"](spark, SF).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_calibration_covers(spark):
    got = catalog.QUERIES["walk_forward_calibration"](spark, SF).toPandas()
    assert len(got) and got.coverage_90.between(0, 1).all() and (got.coverage_90 >= got.coverage_50).all()


def test_escalation_is_ordered(spark):
    got = catalog.QUERIES["escalation_forecast"](spark, SF).toPandas()
    rising = got[got.escalating & ~got.already_critical]
    assert ((rising.p05 <= rising.p25) & (rising.p25 <= rising.hours_to_critical) & (rising.hours_to_critical <= rising.p75) & (rising.p75 <= rising.p95)).all()
    assert (got.probability.between(0, 1)).all()


def test_streamed_kalman_equals_the_fold(spark, con):
    df = jobs.QUERIES["stream_kalman"](spark, SF)
    want = con.sql(jobs.ORACLE_SQL["stream_kalman"])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["stream_clusters", "backfill_clusters", "dispatch_gate", "stream_dispatch"])
def test_jobs_against_duckdb(spark, con, name):
    df, want = jobs.QUERIES[name](spark, SF), con.sql(jobs.ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_flagship_reads_only_what_it_needs(spark):
    plan = catalog.QUERIES["thermal_features"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :]
    assert "CartesianProduct" not in plan and "event_type" in schema


def test_corridors_of_any_length(spark):
    """Wedges of 40 to 6,000 km with a facility just inside and one just outside of each."""
    lengths = [40.0, 50.0, 60.0, 150.0, 390.0, 1000.0, 3000.0, 6000.0]
    degree = 6371.0 * 3.141592653589793 / 180
    corridors = [(i, float(i), -20.0, 0.0, x / 3, 1.0, x) for i, x in enumerate(lengths)]
    facilities = [(10 * i + far, float(i), -20.0 + x * (0.99, 1.01)[far] / degree) for i, x in enumerate(lengths) for far in (0, 1)]
    wedges = spark.createDataFrame(corridors, "cluster_id long, lon double, lat double, bearing double, rate_km_day double, half_angle double, length_km double")
    got = catalog._threatened(wedges, spark.createDataFrame(facilities, "facility_id long, f_lon double, f_lat double")).collect()
    assert {(i, 10 * i) for i in range(len(lengths))} <= {(r.cluster_id, r.facility_id) for r in got}
    assert all((r.cluster_id, r.facility_id) != (i, 10 * i + 1) for r in got for i in range(len(lengths)))


def test_long_wedges_against_all_pairs(spark):
    """Wedges of thousands of kilometres over poles, the date line and the far side of the globe."""
    rng = random.Random(5)
    apexes = [(rng.uniform(-180, 180), rng.uniform(-89, 89)) for _ in range(40)] + [(180.0, 0.0), (-180.0, 45.0), (0.0, 89.9), (10.0, -89.9), (75.0, 20.0)]
    wedges = [(i, x, y, rng.uniform(0, 360), 100.0, rng.choice([5.0, 20.0, 60.0, 90.0]), rng.choice([3300.0, 7000.0, 15000.0, 21000.0])) for i, (x, y) in enumerate(apexes)]
    places = [(i, rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for i in range(300)] + [(900, 180.0, 10.0), (901, -180.0, -10.0), (902, 0.0, 90.0), (903, 0.0, -90.0), (904, 20.0, 0.0), (905, None, 3.0)]

    def seen(x0, y0, x1, y1):
        a, b, d = math.radians(y0), math.radians(y1), math.radians(x1 - x0)
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(d / 2) ** 2
        return 12742 * math.asin(math.sqrt(h)), math.degrees(math.atan2(math.sin(d) * math.cos(b), math.cos(a) * math.sin(b) - math.sin(a) * math.cos(b) * math.cos(d))) % 360

    want = set()
    for i, x, y, bearing, _, half, length in wedges:
        for j, fx, fy in places:
            if fx is not None:
                km, to = seen(x, y, fx, fy)
                if km <= length and min(abs(to - bearing), 360 - abs(to - bearing)) <= half:
                    want.add((i, j))
    w = spark.createDataFrame(wedges, "cluster_id long, lon double, lat double, bearing double, rate_km_day double, half_angle double, length_km double")
    f = spark.createDataFrame(places, "facility_id long, f_lon double, f_lat double")
    out = catalog._threatened(w, f)
    got = [(r.cluster_id, r.facility_id) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
    assert not {"CartesianProduct", "BroadcastNestedLoopJoin"} & set(out._jdf.queryExecution().executedPlan().toString().replace("(", " ").split())
    met = ingest.within_wedge(w, f).count()
    assert met < len(wedges) * len(places) / 2
