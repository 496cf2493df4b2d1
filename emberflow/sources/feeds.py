"""Readers of raw feeds: every one gives a DataFrame of canonical columns and leaves the network to others.

Malformed values become nulls (``try_cast``), rows without what a detection needs go, and NaN counts as missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detection

#: The canonical columns, and what tags and severities mean.
CANONICAL = ("source", "lon", "lat", "acq_datetime", "frp", "brightness", "confidence", "daynight", "scan", "track", "raw_payload")
SEVERITY = {"extreme": 0.9, "severe": 0.75, "moderate": 0.6, "minor": 0.4, "unknown": 0.5}
FACILITY_TAGS = (("power", "plant", "power"), ("landuse", "industrial", "industrial"), ("man_made", "works", "industrial"), ("industrial", "oil", "refinery"), ("industrial", "refinery", "refinery"), ("man_made", "petroleum_well", "oil_well"), ("landuse", "quarry", "mine"))
ALIASES = {
    "lat": ("latitude", "LATITUDE", "Latitude", "lat"),
    "lon": ("longitude", "LONGITUDE", "Longitude", "lon", "long"),
    "date": ("acq_date", "ACQ_DATE", "date", "DATE", "alert_date"),
}

_CSV = "latitude string, longitude string, bright_ti4 string, bright_ti5 string, brightness string, bright_t31 string, scan string, track string, acq_date string, acq_time string, confidence string, frp string, daynight string"


def first_of(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first non-empty of the columns that the frame has."""
    have = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def canonical(df: DataFrame, source: str) -> DataFrame:
    """Satellite CSV rows, as text columns, in canonical form; the sensor decides brightness and confidence."""
    viirs = "VIIRS" in source.upper()
    names = ("bright_ti4",) if viirs else ("brightness", "bright_t31")
    number = lambda *c: detection.number(first_of(df, c))
    out = df.select(
        F.lit(source).alias("source"), number("longitude").alias("lon"), number("latitude").alias("lat"), detection.acquired(F.col("acq_date"), F.col("acq_time")).alias("acq_datetime"),
        number("frp").alias("frp"), number(names[0]).alias("brightness"), (detection.viirs_confidence if viirs else detection.modis_confidence)(F.col("confidence")).alias("confidence"),
        F.when(F.upper(F.trim("daynight")).isin("D", "N"), F.upper(F.trim("daynight"))).alias("daynight"), number("scan").alias("scan"), number("track").alias("track"), F.to_json(F.struct(*df.columns)).alias("raw_payload"),
    )
    return out.where("lon is not null and lat is not null and acq_datetime is not null")


def satellite_csv(spark: SparkSession, path: str, source: str, bbox: tuple[float, float, float, float] | None = None, days: tuple[str, str] | None = None) -> DataFrame:
    """One feed's CSV files; the box and the days are filters, which prune what is parsed further."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    missing = [F.lit(None).cast("string").alias(c.split()[0]) for c in _CSV.split(", ") if c.split()[0] not in raw.columns]
    rows = raw.select("*", *missing).where(~F.coalesce(F.col("latitude"), F.lit("")).startswith("Invalid"))
    if days:
        rows = rows.where(F.col("acq_date").between(*days))
    out = canonical(rows, source)
    if bbox:
        out = out.where(F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3]))
    return out


def union(feeds: list[DataFrame]) -> DataFrame:
    """Feeds in order of precedence, with feed_seq for first-wins deduplication."""
    return reduce(DataFrame.unionByName, [f.withColumn("feed_seq", F.lit(i)) for i, f in enumerate(feeds)])


def thermal_band(payload: Column) -> Column:
    """The background band kept in a detection's payload."""
    return F.coalesce(*[detection.number(F.get_json_object(payload, f"$.{k}")) for k in ("bright_ti5", "bright_t31")])


def grid(df: DataFrame, source: str, value: str, moment: Column, confidence: float | None, is_frp: bool) -> DataFrame:
    """A swath kept as arrays (latitude, longitude, value): pixels with a positive value are detections."""
    cells = df.select(moment.alias("acq_datetime"), F.explode(F.arrays_zip("latitude", "longitude", F.col(value).alias("value"))).alias("p")).where(F.col("p.value") > 0)
    null = F.lit(None).cast("double")
    return cells.select(
        F.lit(source).alias("source"), F.col("p.longitude").cast("double").alias("lon"), F.col("p.latitude").cast("double").alias("lat"), "acq_datetime", (F.col("p.value").cast("double") if is_frp else null).alias("frp"), null.alias("brightness"),
        F.lit(confidence).cast("double").alias("confidence"), F.lit(None).cast("string").alias("daynight"), null.alias("scan"), null.alias("track"), F.lit(None).cast("string").alias("raw_payload"),
    )


def cap_xml(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    """Common Alerting Protocol files: every circle "lat,lon radius" of every area is a detection."""
    area = "area array<struct<circle:array<string>>>"
    schema = f"severity string, effective string, onset string, {area}"
    info = spark.read.format("xml").option("rowTag", "info").option("ignoreNamespace", True).schema(schema).load(path)
    circles = info.select("*", F.explode("area").alias("a")).select("*", F.explode("a.circle").alias("c"))
    parts = F.split(F.trim("c"), " ")
    place = F.split(F.get(parts, F.lit(0)), ",")
    at = lambda i: F.when((F.size(parts) == 2) & (F.size(place) == 2), F.get(place, F.lit(i)).try_cast("double"))
    moment = F.coalesce(F.try_to_timestamp("effective"), F.try_to_timestamp("onset"), now if now is not None else F.current_timestamp())
    null = F.lit(None).cast("double")
    out = circles.select(
        F.lit("EUMETSAT_IODC").alias("source"), at(1).alias("lon"), at(0).alias("lat"), moment.alias("acq_datetime"), null.alias("frp"), null.alias("brightness"), detection.lookup(F.lower("severity"), SEVERITY, 0.5).alias("confidence"),
        F.lit(None).cast("string").alias("daynight"), null.alias("scan"), null.alias("track"), F.to_json(F.struct("severity")).alias("raw_payload"),
    )
    return out.where("lon is not null and lat is not null")


def flare_csv(spark: SparkSession, path: str) -> DataFrame:
    """A flare catalogue as facilities; the coordinates' columns must be there."""
    raw = spark.read.option("header", True).csv(path)
    if missing := {"Longitude", "Latitude"} - set(raw.columns):
        raise ValueError(f"the flare catalogue lacks {sorted(missing)}")
    volume = F.coalesce(*[F.nullif(detection.number(F.col(f"`{c}`")), F.lit(0.0)) for c in ("Flared_Volume_MCM", "Flare Volume (MCM)") if c in raw.columns] or [F.lit(None).cast("double")])
    name = F.when(F.col("Country") != "", F.concat(F.lit("Flare site ("), F.col("Country"), F.lit(")"))) if "Country" in raw.columns else F.lit(None).cast("string")
    return raw.select(name.alias("name"), F.lit("flare").alias("facility_type"), F.lit("GGFR").alias("source"), F.col("Longitude").cast("double").alias("lon"), F.col("Latitude").cast("double").alias("lat"), F.lit(1.0).alias("prior_weight"), volume.alias("volume_mcm"))


def plant_csv(spark: SparkSession, path: str, default_type: str) -> DataFrame:
    """A plant tracker's sheet, exported as CSV, as facilities."""
    raw = spark.read.option("header", True).csv(path)
    lat, lon = (detection.number(first_of(raw, ALIASES[k])) for k in ("lat", "lon"))
    out = raw.select(first_of(raw, ("Plant name", "Plant / Project name")).alias("name"), F.coalesce(first_of(raw, ("Type", "Plant type")), F.lit(default_type)).alias("facility_type"), F.lit("GEM").alias("source"), lon.alias("lon"), lat.alias("lat"), F.lit(1.0).alias("prior_weight"))
    return out.where("lon is not null and lat is not null")


def alert_csv(spark: SparkSession, path: str) -> DataFrame:
    """Forest-fire alerts: columns go by several names; no usable row at all is an error."""
    raw = spark.read.option("header", True).csv(path)
    lat, lon = (detection.number(first_of(raw, ALIASES[k])) for k in ("lat", "lon"))
    out = raw.select(lon.alias("lon"), lat.alias("lat"), F.try_to_timestamp(first_of(raw, ALIASES["date"])).alias("date")).where("lon is not null and lat is not null")
    if out.isEmpty():
        raise ValueError("no alert has coordinates")
    return out


def map_elements(df: DataFrame) -> DataFrame:
    """Map elements (type, id, tags, lon, lat, geometry) as facilities: nodes and open ways are points, closed ways rings."""
    kind = None
    for key, value, name in FACILITY_TAGS:
        hit = F.coalesce(F.try_element_at("tags", F.lit(key)) == value, F.lit(False))
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    g, n = F.filter("geometry", lambda p: p.isNotNull()), F.size(F.filter("geometry", lambda p: p.isNotNull()))
    closed = (n >= 4) & (F.get(g, F.lit(0)) == F.get(g, n - 1))
    middle = F.get(g, F.floor(n / 2).cast("int"))
    ahead = F.concat(F.slice(g, 2, F.greatest(n - 1, F.lit(0))), F.slice(g, 1, 1))
    cross = lambda p, q: p["lon"] * q["lat"] - q["lon"] * p["lat"]
    total = lambda f: F.aggregate(F.zip_with(g, ahead, f), F.lit(0.0), lambda a, x: a + x)
    area = total(cross)
    centre = lambda c: total(lambda p, q: (p[c] + q[c]) * cross(p, q)) / (3 * F.nullif(area, F.lit(0.0)))
    node = F.col("type") == "node"
    pick = lambda c: F.when(node, F.col(c)).when(closed, centre(c)).when(n >= 2, middle[c])
    out = df.dropDuplicates(["type", "id"]).select("type", "id", F.try_element_at("tags", F.lit("name")).alias("name"), kind.otherwise("industrial").alias("facility_type"), F.lit("OSM").alias("source"), pick("lon").alias("lon"), pick("lat").alias("lat"), F.when(~node & closed, g).alias("ring"), F.lit(1.0).alias("prior_weight"))
    return out.where("lon is not null and lat is not null")


def boundaries(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON features as (state, district, ring), one row for each polygon's outer ring."""
    schema = "features array<struct<properties:struct<st_nm:string,district:string>,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f"))
    one = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    polygons = F.when(F.col("f.geometry.type") == "Polygon", F.array(one)).otherwise(many)
    outer = F.transform(polygons, lambda p: F.transform(F.get(p, F.lit(0)), lambda c: F.struct(F.get(c, F.lit(0)).alias("lon"), F.get(c, F.lit(1)).alias("lat"))))
    return f.select(F.col("f.properties.st_nm").alias("state"), F.col("f.properties.district").alias("district"), F.explode(outer).alias("ring"))


def hourly_weather(df: DataFrame) -> DataFrame:
    """Weather payloads (cluster_id, hourly struct of arrays) as one row an hour: km/h to m/s, cloud as a share."""
    h = df.select("cluster_id", F.explode(F.arrays_zip(*[F.col(f"hourly.{c}").alias(c) for c in ("time", "wind_speed_10m", "wind_direction_10m", "cloud_cover", "is_day")])).alias("h"))
    hour = F.to_timestamp("h.time")
    share = F.when(F.col("h.cloud_cover").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("h.cloud_cover") / 100.0)))
    return h.where(F.col("h.wind_speed_10m").isNotNull()).select("cluster_id", hour.alias("hour"), (F.col("h.wind_speed_10m") / 3.6).alias("wind_speed"), F.coalesce("h.wind_direction_10m", F.lit(0.0)).alias("wind_direction"), share.alias("cloud"), F.coalesce(F.col("h.is_day") == 1, F.hour(hour).between(6, 18)).alias("is_day"))


def tiles(spark: SparkSession, west: float, south: float, east: float, north: float, step: float = 2.0) -> DataFrame:
    """A box in tiles of ``step`` degrees at most, row by row."""
    import math

    rows, cols = max(1, math.ceil((north - south) / step)), max(1, math.ceil((east - west) / step))
    n = spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    x, y = F.col("col") * step + west, F.col("row") * step + south
    return n.select("row", "col", x.alias("west"), y.alias("south"), F.least(x + step, F.lit(east)).alias("east"), F.least(y + step, F.lit(north)).alias("north"))
