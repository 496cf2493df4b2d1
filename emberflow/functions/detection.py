"""Normalising and describing single detections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def lookup(key: Column, table: dict, default=None) -> Column:
    """A fixed table as a chain of comparisons: stays in generated code."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out if default is None else out.otherwise(F.lit(default))


def number(text: Column) -> Column:
    """Null for what isn't a number; NaN counts as missing."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def viirs_confidence(raw: Column) -> Column:
    return lookup(F.lower(F.trim(raw)), C.VIIRS_CONFIDENCE)


def modis_confidence(raw: Column) -> Column:
    value = number(raw) / 100.0
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def training_confidence(raw: Column) -> Column:
    value = number(raw)
    words = lookup(F.lower(F.trim(raw)), C.TRAINING_CONFIDENCE, 0.5)
    return F.when(value.isNull(), words).when(value > 1, value / 100.0).otherwise(value)


def confidence(source: Column, raw: Column) -> Column:
    return F.when(F.upper(source).contains("VIIRS"), viirs_confidence(raw)).otherwise(modis_confidence(raw))


def decayed_confidence(base: Column, cloud: Column) -> Column:
    known = F.greatest(F.lit(0.0), F.coalesce(base, F.lit(0.5)) * (1.0 - 0.5 * cloud))
    return F.when(cloud.isNull(), F.coalesce(base, F.lit(0.5)) * C.UNKNOWN_CLOUD_FACTOR).otherwise(known)


def optically_available(cloud: Column) -> Column:
    return F.coalesce(cloud <= C.CLOUD_LIMIT, F.lit(False))


def confidence_band(value: Column) -> Column:
    return F.when(value >= C.CONFIDENCE_HIGH, "HIGH").when(value >= C.CONFIDENCE_NOMINAL, "NOMINAL").when(value.isNotNull(), "LOW")


def sensor_family(source: Column) -> Column:
    up = F.upper(source)
    out = F.when(F.coalesce(source, F.lit("")) == "", F.lit(None).cast("string"))
    for family in ("VIIRS", "MODIS", "INSAT", "HIMAWARI", "SENTINEL"):
        out = out.when(up.contains(family), family)
    return out.otherwise(F.substring_index(up, "_", 1))


def platform(source: Column) -> Column:
    return F.when(F.coalesce(source, F.lit("")) == "", "UNKNOWN").otherwise(F.replace(F.replace(F.upper(source), F.lit("_NRT"), F.lit("")), F.lit("_RT"), F.lit("")))


def acquired(date: Column, time: Column) -> Column:
    """Date and HMM or HHMM, in UTC."""
    return F.try_to_timestamp(F.concat(date, F.lit(" "), F.lpad(F.trim(time), 4, "0")), F.lit("yyyy-MM-dd HHmm"))


def cache_key(namespace: str, lon: Column, lat: Column, *extra: Column) -> Column:
    return F.concat_ws("|", F.lit(namespace), F.format_string("%.2f", lon), F.format_string("%.2f", lat), *extra)


def display_type(predicted: Column, facility: Column) -> Column:
    return (
        F.when(predicted == "agricultural_burning", "agri").when(predicted == "mining", "coal").when(predicted == "gas_flare", "petroleum")
        .when(facility.isin("refinery", "oil_well", "flare", "LNG"), "petroleum").when(facility == "mine", "coal").otherwise("industrial")
    )


def is_active(escalating: Column, normal: Column) -> Column:
    return F.coalesce(escalating, F.lit(False)) | F.coalesce(~normal, F.lit(False))


def status(active: Column, stored: Column, source_class: Column) -> Column:
    return F.when(active, "Active").when(stored == "resolved", "Extinguished").when(source_class == "persistent", "Verified").otherwise("Under Control")


def risk_score(frp: Column, brightness: Column, predicted: Column, escalating: Column) -> Column:
    part = lambda x, low, high: F.greatest(F.lit(0.0), F.least((F.coalesce(x, F.lit(0.0)) - low) / (high - low), F.lit(1.0)))
    heat = F.least(F.coalesce(frp, F.lit(0.0)) / C.RISK_FRP_MW, F.lit(1.0)) * 55.0
    total = heat + part(brightness, C.RISK_BRIGHT_LOW, C.RISK_BRIGHT_HIGH) * 30.0 + F.when(predicted == "industrial_fire", 10.0).otherwise(0.0) + F.when(escalating, 5.0).otherwise(0.0)
    return F.bround(F.least(total, F.lit(100.0)), 0).cast("int")
