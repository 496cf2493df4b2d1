"""Readers of raw feeds."""

import json

import pytest
from pyspark.sql import functions as F

from emberflow.sources import feeds


def test_satellite_csv(spark, tmp_path):
    (tmp_path / "v.csv").write_text("latitude,longitude,bright_ti4,bright_ti5,scan,track,acq_date,acq_time,confidence,frp,daynight\n28.7,77.1,330.5,290.1,0.4,0.4,2026-06-01,512,n,10.5,D\nx,77.1,1,1,1,1,2026-06-01,0512,h,1,N\n20,80,nan,,0.4,0.4,2026-06-02,0000,h,,N\n")
    got = feeds.satellite_csv(spark, str(tmp_path / "v.csv"), "VIIRS_SNPP_NRT")
    assert tuple(got.columns) == feeds.CANONICAL
    a, b = got.orderBy("acq_datetime").collect()
    assert (a.lon, a.brightness, a.confidence, a.frp, str(a.acq_datetime)) == (77.1, 330.5, 0.7, 10.5, "2026-06-01 05:12:00")
    assert (b.brightness, b.frp, b.confidence) == (None, None, 0.95)
    assert got.select(feeds.thermal_band(F.col("raw_payload")).alias("t")).where("t = 290.1").count() == 1
    assert feeds.satellite_csv(spark, str(tmp_path / "v.csv"), "VIIRS", bbox=(70, 25, 78, 30), days=("2026-06-01", "2026-06-01")).count() == 1
    assert feeds.union([got, got]).where("feed_seq = 1").count() == 2


def test_cap_xml(spark, tmp_path):
    (tmp_path / "c.xml").write_text('<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><info><severity>Severe</severity><effective>2026-06-01T05:00:00+00:00</effective><area><circle>28.7,77.1 5</circle><circle>bad</circle></area><area><circle>20,80 1</circle></area></info></alert>')
    got = feeds.cap_xml(spark, str(tmp_path / "c.xml")).orderBy("lat").collect()
    assert [(r.lat, r.lon, r.confidence) for r in got] == [(20.0, 80.0, 0.75), (28.7, 77.1, 0.75)]


def test_catalogues(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Longitude,Latitude,Country,Flared_Volume_MCM\n70,20,India,0\n71,21,,5\n")
    got = feeds.flare_csv(spark, str(tmp_path / "f.csv")).orderBy("lon").collect()
    assert [(r.name, r.volume_mcm) for r in got] == [("Flare site (India)", None), (None, 5.0)]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        feeds.flare_csv(spark, str(tmp_path / "bad.csv"))
    with pytest.raises(ValueError):
        feeds.alert_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "a.csv").write_text("LATITUDE,long,date\n20,70,2026-01-01\n,70,2026-01-01\n21,71,\n")
    assert feeds.alert_csv(spark, str(tmp_path / "a.csv")).count() == 2
    (tmp_path / "p.csv").write_text("Plant name,Latitude,Longitude\nP,20,70\nQ,,70\n")
    assert [r.facility_type for r in feeds.plant_csv(spark, str(tmp_path / "p.csv"), "power").collect()] == ["power"]


def test_map_elements(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    rows = [("node", 1, {"power": "plant", "name": "N"}, 70.0, 20.0, None), ("way", 2, {"landuse": "quarry"}, None, None, square), ("way", 3, {}, None, None, square[:3]), ("way", 4, {}, None, None, [])]
    df = spark.createDataFrame(rows, "type string, id long, tags map<string,string>, lon double, lat double, geometry array<struct<lon:double,lat:double>>")
    got = {r.id: r for r in feeds.map_elements(df.unionByName(df)).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].facility_type, got[2].facility_type, got[3].facility_type) == ("power", "mine", "industrial")
    assert (got[2].lon, got[2].lat, len(got[2].ring)) == (1.0, 1.0, 5)
    assert (got[3].lon, got[3].lat, got[3].ring) == (2.0, 0.0, None)


def test_boundaries_grids_weather_tiles(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    features = [{"properties": {"st_nm": "S", "district": "D"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"properties": {"st_nm": "S"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]
    (tmp_path / "b.json").write_text(json.dumps({"features": features}))
    assert feeds.boundaries(spark, str(tmp_path / "b.json")).count() == 3
    g = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], [0.0, 5.0])], "latitude array<double>, longitude array<double>, FRP_MWIR array<double>")
    (row,) = feeds.grid(g, "SENTINEL3_FRP", "FRP_MWIR", F.lit("2026-01-01").cast("timestamp"), 0.8, True).collect()
    assert (row.lat, row.lon, row.frp, row.confidence) == (2.0, 4.0, 5.0, 0.8)
    w = spark.createDataFrame([(1, (["2026-01-01T00:00", "2026-01-01T01:00"], [36.0, None], [90.0, 90.0], [50.0, None], [1, None]))], "cluster_id long, hourly struct<time:array<string>,wind_speed_10m:array<double>,wind_direction_10m:array<double>,cloud_cover:array<double>,is_day:array<int>>")
    (h,) = feeds.hourly_weather(w).collect()
    assert (h.wind_speed, h.cloud, h.is_day) == (10.0, 0.5, True)
    t = feeds.tiles(spark, 68.0, 6.0, 73.0, 9.0).collect()
    assert len(t) == 6 and max(r.east for r in t) == 73.0 and max(r.north for r in t) == 9.0
