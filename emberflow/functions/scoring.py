"""Hazard, demand and suppression scores as Column functions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .detection import lookup


def proximity_weight(distance: Column, weight: Column | float = 1.0) -> Column:
    return F.exp(-distance / C.DECAY_M) * weight


def type_prior(kind: Column) -> Column:
    return F.coalesce(lookup(kind, C.TYPE_PRIORS), F.lit(C.DEFAULT_PRIOR))


def candidate_score(distance: Column, kind: Column, inside: Column) -> Column:
    return type_prior(kind) * F.when(inside, 1.0).otherwise(F.exp(-F.greatest(distance, F.lit(0.0)) / C.DECAY_M))


def wui_priority(distance: Column, eta: Column) -> Column:
    near = (distance <= C.EMBER_M) | F.coalesce(eta.between(0.0, C.CRITICAL_ETA_H), F.lit(False))
    return F.when(distance.isNull(), C.MONITOR).when(near, C.CRITICAL).when(distance <= C.EMBER_M * C.WATCH_MULTIPLIER, C.WATCH).otherwise(C.MONITOR)


def populated(people: Column) -> Column:
    return F.coalesce(people >= C.POPULATED_PEOPLE, F.lit(False))


def gated_priority(raw: Column, named: Column, peopled: Column, active: Column) -> Column:
    return F.when((raw == C.CRITICAL) & ~((named | peopled) & active), C.WATCH).otherwise(raw)


def hours_to_impact(distance_km: Column, rate_km_day: Column) -> Column:
    return F.when(rate_km_day <= 0, F.lit(None).cast("double")).when(distance_km <= 0, F.lit(0.0)).otherwise(distance_km / rate_km_day * 24.0)


def corridor_half_angle(confidence: Column) -> Column:
    return 60.0 - 45.0 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))


def frp_score(frp: Column) -> Column:
    return F.when(frp > 0, F.least(frp / C.RDI_FRP_CAP_MW * C.RDI_FRP_WEIGHT, F.lit(C.RDI_FRP_WEIGHT))).otherwise(0.0)


def proximity_score(distance: Column) -> Column:
    km, ember = distance / 1000.0, C.EMBER_M / 1000.0
    taper = C.RDI_NEAR_WEIGHT - (C.RDI_NEAR_WEIGHT - C.RDI_FAR_SCORE) * ((km - ember) / (C.RDI_TAPER_KM - ember))
    return F.when(km <= ember, C.RDI_NEAR_WEIGHT).when(km <= C.RDI_TAPER_KM, taper).otherwise(C.RDI_FAR_SCORE)


def area_score(ha: Column) -> Column:
    return F.when(ha > 0, F.least(ha / C.RDI_AREA_CAP_HA * C.RDI_AREA_WEIGHT, F.lit(C.RDI_AREA_WEIGHT))).otherwise(0.0)


def footprint_ha(extent_km: Column) -> Column:
    return F.when(extent_km > 0, math.pi * (extent_km / 2) * (extent_km / 2) * 100.0).otherwise(0.0)


def rdi(frp: Column, distance: Column, ha: Column) -> Column:
    return F.round(F.least(frp_score(frp) + proximity_score(distance) + area_score(ha), F.lit(100.0)), 1)


def course_of_action(score: Column) -> Column:
    return F.when(score >= C.RDI_FULL, C.COA_FULL).when(score >= C.RDI_POINT, C.COA_POINT).otherwise(C.COA_MONITOR)


def effective_ha(ha: Column, sensor: Column) -> Column:
    return F.greatest(F.coalesce(ha, F.lit(0.0)), F.coalesce(lookup(F.upper(sensor), C.PIXEL_HA), F.lit(C.PIXEL_HA["VIIRS"])))


def intensity(frp: Column) -> Column:
    return F.when(frp > 0, F.least(1.0 + frp / C.INTENSITY_MW, F.lit(C.INTENSITY_MAX))).otherwise(1.0)


def air_support(frp: Column, ha: Column, coa: Column) -> Column:
    return F.coalesce(coa == C.COA_FULL, F.lit(False)) | F.coalesce(frp >= C.AIR_SUPPORT_FRP_MW, F.lit(False)) | F.coalesce(ha >= C.AIR_SUPPORT_HA, F.lit(False))


def trips(volume: Column, load: float) -> Column:
    return F.when(volume > 0, F.greatest(F.lit(1), F.ceil(volume / load))).otherwise(0).cast("long")


def suppression(predicted: Column, frp: Column, ha: Column, coa: Column, sensor: Column) -> dict[str, Column]:
    """What it takes by class: water, foam, fuel isolation with cooling, or smothering."""
    kind = F.lower(F.coalesce(predicted, F.lit("")))
    area, factor = effective_ha(ha, sensor), intensity(frp)
    air = air_support(frp, area, coa)
    smother, water = kind == "mining", ~kind.isin("industrial_fire", "gas_flare", "mining")
    litres = area * factor * F.when(kind == "industrial_fire", C.FOAM_L_PER_HA).when(kind == "gas_flare", C.COOLING_L_PER_HA).otherwise(F.coalesce(lookup(kind, C.WATER_L_PER_HA), F.lit(C.WATER_L_PER_HA["agricultural_burning"])))
    cubic = area * C.SMOTHER_M3_PER_HA * factor
    return {
        "resource_kind": F.when(kind == "industrial_fire", "foam").when(kind == "gas_flare", "fuel_isolation").when(smother, "excavation_and_smothering").otherwise("water"),
        "effective_ha": F.round(area, 2),
        "multiplier": F.round(factor, 2),
        "air_support": air,
        "volume_l": F.when(~smother, F.round(litres, 0)),
        "volume_m3": F.when(smother, F.round(cubic, 0)),
        "tanker_trips": F.when(smother, F.lit(0).cast("long")).otherwise(trips(litres, C.TANKER_L)),
        "air_drops": F.when(water & air, trips(litres, C.AIR_DROP_L)).otherwise(F.lit(0).cast("long")),
        "truck_loads": F.when(smother, trips(cubic, C.TRUCK_M3)).otherwise(F.lit(0).cast("long")),
        "well_control_units": F.when(kind == "gas_flare", 1).otherwise(0).cast("int"),
    }


# --- persistence index -----------------------------------------------------------------------------


def longevity(days: Column) -> Column:
    return F.when(days > 0, F.least(days / C.LONGEVITY_DAYS, F.lit(1.0))).otherwise(0.0)


def reliability(rate: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.coalesce(rate, F.lit(0.0)), F.lit(1.0)))


def steadiness(mean: Column, std: Column) -> Column:
    return F.when(mean > 0, F.greatest(F.lit(0.0), 1.0 - F.least(std / mean, F.lit(1.0)))).otherwise(0.0)


def ptsi(long: Column, reliable: Column, steady: Column) -> Column:
    return C.LONGEVITY_WEIGHT * long + C.RELIABILITY_WEIGHT * reliable + C.STABILITY_WEIGHT * steady


def source_class(score: Column) -> Column:
    return F.when(score >= C.PERSISTENT, "persistent").when(score >= C.INTERMITTENT, "intermittent").otherwise("transient")


def critical_threshold(mean: Column, std: Column) -> Column:
    spread = F.when(std > 0, std).otherwise(F.greatest(mean * 0.5, F.lit(1.0)))
    return F.when(mean.isNotNull(), F.greatest(mean + C.SIGMA_MULTIPLE * spread, F.lit(C.CRITICAL_FLOOR_MW)))


def freshness(age_h: Column, cadence_h: Column) -> Column:
    own = cadence_h > 0
    fresh = F.when(own, cadence_h * C.FRESH_MULTIPLE).otherwise(C.FALLBACK_FRESH_H)
    moderate = F.when(own, cadence_h * C.MODERATE_MULTIPLE).otherwise(C.FALLBACK_MODERATE_H)
    return F.when(age_h.isNull() | (age_h >= C.STALE_H), "STALE").when(age_h <= fresh, "FRESH").when(age_h <= moderate, "MODERATE").otherwise("STALE")


# --- weak labels -----------------------------------------------------------------------------------


def _inside(lon: Column, lat: Column, box: tuple) -> Column:
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def coalfield(lon: Column, lat: Column) -> Column:
    out = None
    for name, box in C.COALFIELDS.items():
        out = F.when(_inside(lon, lat, box), name) if out is None else out.when(_inside(lon, lat, box), name)
    return out


def votes(lon: Column, lat: Column, moment: Column, kind: Column, distance: Column, persistence: Column, zscore: Column, cropland: Column, forest: Column, growth: Column, alerted: Column) -> Column:
    """Array of struct(confidence, order, label) of the rules that fire, in rule order."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    near = yes(distance <= 500.0)
    flare = F.when(yes(kind == "flare") & near, F.when(yes(persistence >= 3), 0.90).otherwise(0.60))
    mining = F.when(yes(kind == "mine") & near & yes(persistence >= 3.0), 0.85).when(coalfield(lon, lat).isNotNull(), 0.70)
    agri = F.when(_inside(lon, lat, C.AGRI_BELT) & yes(F.month(moment).isin(*C.AGRI_MONTHS)) & yes(cropland >= 0.6) & ~yes(persistence > 5) & ~near, 0.80)
    wild = F.when(yes(alerted), 0.92).when(yes(forest >= 0.5) & ~yes(distance < 1000), F.when(yes(growth > 0.05), 0.75).otherwise(0.60))
    lasting = yes(persistence >= 14)
    industrial = F.when(yes(kind.isin(*C.INDUSTRIAL_TYPES)) & near & (lasting | yes(zscore >= 2.0)), F.when(lasting, 0.85).otherwise(0.70))
    rules = (("gas_flare", flare), ("mining", mining), ("agricultural_burning", agri), ("wildfire", wild), ("industrial_fire", industrial))
    return F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(c.alias("confidence"), F.lit(-i).alias("order"), F.lit(label).alias("label"))) for i, (label, c) in enumerate(rules)]))


def resolved(vote: Column) -> Column:
    """The surest vote (first rule on ties), or null if another label is within the margin."""
    best = F.array_max(vote)
    rival = F.array_max(F.transform(F.filter(vote, lambda v: v["label"] != best["label"]), lambda v: v["confidence"]))
    return F.when((F.size(vote) > 0) & ~F.coalesce(best["confidence"] - rival < C.AMBIGUITY_MARGIN, F.lit(False)), best)


# --- evidence and fusion ---------------------------------------------------------------------------


def group_present(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        value = c.cast("double")
        out = out | F.coalesce(~F.isnan(value), F.lit(False)) & value.isNotNull()
    return out


def evidence_multiplier(present: dict[str, Column]) -> tuple[Column, Column]:
    weight = F.lit(0.0)
    for group, there in present.items():
        weight = weight + F.when(there, C.GROUP_WEIGHTS[group]).otherwise(0.0)
    return weight, C.MIN_CONFIDENCE_MULTIPLIER + (1 - C.MIN_CONFIDENCE_MULTIPLIER) * weight


def aligned(p: Column) -> Column:
    """Class probabilities (map) as an array in class order that sums to 1; uniform if there is nothing, null for null."""
    raw = F.array(*[F.coalesce(F.try_element_at(p, F.lit(c)), F.lit(0.0)) for c in C.CLASSES])
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.when(p.isNotNull(), F.transform(raw, lambda x: F.when(total > 0, x / total).otherwise(1.0 / len(C.CLASSES))))


def fused(tabular: Column, image: Column, weight: float = C.TABULAR_WEIGHT) -> Column:
    return F.when(image.isNull(), tabular).otherwise(F.zip_with(tabular, image, lambda a, b: weight * a + (1 - weight) * b))


def top_class(p: Column) -> Column:
    """Most likely class; the first in class order on ties."""
    return F.element_at(F.array(*map(F.lit, C.CLASSES)), F.array_position(p, F.array_max(p)).cast("int"))


def confidence_score(p: Column, multiplier: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.array_max(p) * multiplier)) * 100.0, 2)


def emissions(kind: Column, predicted: Column) -> tuple[Column, Column]:
    """(hazard, substances) by facility type, else by class, else unknown."""
    industrial = F.lower(predicted).isin("industrial_fire", "gas_flare", "mining")

    def part(of: Callable[[tuple[str, tuple[str, ...]]], str]) -> Column:
        by_type = lookup(F.lower(kind), {k: of(v) for k, v in C.EMISSIONS.items()})
        by_class = lookup(F.lower(predicted), {k: of(v) for k, v in C.CLASS_EMISSIONS.items()})
        return F.coalesce(by_type, by_class, F.when(industrial, of(C.EMISSIONS["industrial"])), F.lit(of(C.UNKNOWN_EMISSIONS)))

    return part(lambda v: v[0]), part(lambda v: ",".join(v[1]))


def same_site(candidate_m: Column, matched_m: Column, excess_m: float) -> Column:
    """Whether a named feature is near enough to what was measured to lend its name."""
    return F.coalesce(candidate_m <= matched_m + excess_m, F.lit(False))
