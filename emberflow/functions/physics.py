"""Radiometry and plume physics as Column functions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .detection import lookup

C1, C2 = 2.0 * C.PLANCK_H * C.LIGHT_C**2, C.PLANCK_H * C.LIGHT_C / C.BOLTZMANN_K


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once for ``body``: an array of one element, transformed."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def radiance(wavelength: Column | float, kelvin: Column) -> Column:
    """Planck spectral radiance; 0 where the exponent is out of range, null for impossible temperatures."""
    w = F.lit(wavelength) if isinstance(wavelength, float) else wavelength
    x = C2 / (w * kelvin)
    return F.when(kelvin <= 0, F.lit(None)).when(x > 700, F.lit(0.0)).otherwise(C1 / (F.pow(w, F.lit(5.0)) * F.expm1(x)))


def brightness_temperature(wavelength: Column | float, value: Column) -> Column:
    w = F.lit(wavelength) if isinstance(wavelength, float) else wavelength
    return F.when(value > 0, C2 / (w * F.log1p(C1 / (F.pow(w, F.lit(5.0)) * value))))


def mixed_radiance(wavelength: Column | float, fraction: Column, fire: Column, background: Column) -> Column:
    return fraction * radiance(wavelength, fire) + (1 - fraction) * radiance(wavelength, background)


def bands(sensor: Column) -> tuple[Column, Column]:
    modis = F.upper(sensor).contains("MODIS")
    pick = lambda i: F.when(modis, C.MODIS_BANDS[i]).otherwise(C.VIIRS_BANDS[i])
    return pick(0), pick(1)


def saturation(sensor: Column) -> Column:
    return F.when(F.upper(sensor).contains("MODIS"), C.MODIS_SATURATION_K).otherwise(C.VIIRS_SATURATION_K)


def dozier(mir_k: Column, tir_k: Column, background: Column, sensor: Column, steps: int = 60) -> Column:
    """struct(temperature_k, fraction) of the fire in a pixel, null if the bands don't allow one.

    The fraction is eliminated by the mid-infrared band; what is left falls strictly with the temperature, so a fixed
    number of bisections finds the root inside the row.
    """
    w4, w5 = bands(sensor)
    glow4, glow5 = radiance(w4, background), radiance(w5, background)
    known = F.struct(w4.alias("w4"), w5.alias("w5"), glow4.alias("g4"), glow5.alias("g5"), (radiance(w4, mir_k) - glow4).alias("e4"), (radiance(w5, tir_k) - glow5).alias("e5"), (mir_k < saturation(sensor)).alias("dark"))
    low, high = C.FIRE_K

    def solved(k: Column) -> Column:
        fraction = lambda t: k["e4"] / (radiance(k["w4"], t) - k["g4"])
        surplus = lambda t: fraction(t) * (radiance(k["w5"], t) - k["g5"]) - k["e5"]
        start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))
        middle = lambda s: (s["lo"] + s["hi"]) / 2
        half = lambda s: lambda m: F.when(surplus(m) > 0, F.struct(m.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), m.alias("hi")))
        root = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: let(middle(s), half(s)), middle)
        solvable = k["dark"] & (k["e4"] > 0) & (k["e5"] > 0) & (surplus(F.lit(low)) > 0) & (surplus(F.lit(high)) < 0)
        return F.when(solvable, let(root, lambda t: let(fraction(t), lambda share: F.when(share.between(*C.FIRE_FRACTION), F.struct(t.alias("temperature_k"), share.alias("fraction"))))))

    return let(known, solved)


def dozier_bracket(mir_k: Column, tir_k: Column, background: Column, sensor: Column) -> Column:
    """struct(temperature_k, fraction, low_k, high_k, well_constrained): the retrieval and how far it moves with the background.

    Null if the pixel allows no fire; a bracket of which neither end can be solved is null and not well constrained.
    """
    at = lambda k: dozier(mir_k, tir_k, background + k, sensor)
    solved = F.struct(at(0.0).alias("mid"), at(-C.BACKGROUND_ERROR_K).alias("cold"), at(C.BACKGROUND_ERROR_K).alias("warm"))

    def judged(s: Column) -> Column:
        mid, ends = s["mid"]["temperature_k"], [s[k]["temperature_k"] for k in ("cold", "warm")]
        some = F.coalesce(*ends).isNotNull()
        low, high = F.when(some, F.least(mid, *ends)), F.when(some, F.greatest(mid, *ends))
        sure = F.coalesce((high - low) / mid <= C.WELL_CONSTRAINED_SPREAD, F.lit(False))
        return F.when(mid.isNotNull(), F.struct(mid.alias("temperature_k"), s["mid"]["fraction"].alias("fraction"), low.alias("low_k"), high.alias("high_k"), sure.alias("well_constrained")))

    return let(solved, judged)


def pixel_area_m2(scan_km: Column, track_km: Column) -> Column:
    """Ground area of a detection, null where a side is unknown or 0."""
    return F.nullif(scan_km, F.lit(0.0)) * F.nullif(track_km, F.lit(0.0)) * 1e6


def stability(wind: Column, day: Column, cloud: Column) -> Column:
    """Pasquill-Gifford class from wind, daylight and cloud."""
    c = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cloud)), F.lit(0.5))
    sun = F.when(c < 0.35, 0).when(c < 0.75, 1).otherwise(2)
    row = lambda a, b, s: F.when(sun == 0, a).when(sun == 1, b).otherwise(s)
    by_day = F.when(wind < 2, row("A", "A", "B")).when(wind < 3, row("A", "B", "C")).when(wind < 5, row("B", "B", "C")).when(wind < 6, row("C", "C", "D")).otherwise(row("C", "D", "D"))
    night = F.when(wind < 2, "F").when(wind < 3, F.when(c < 0.5, "F").otherwise("E")).when(wind < 5, F.when(c < 0.5, "E").otherwise("D")).otherwise("D")
    return F.when(day, by_day).otherwise(night)


def sigma_y(x: Column, cls: Column) -> Column:
    return F.when(x <= 0, F.lit(0.0)).otherwise(lookup(cls, C.SIGMA_Y) * x / F.sqrt(1.0 + 1e-4 * x))


def sigma_z(x: Column, cls: Column) -> Column:
    """Briggs' rural curves."""
    return (
        F.when(x <= 0, F.lit(0.0)).when(cls == "A", 0.20 * x).when(cls == "B", 0.12 * x)
        .when(cls == "C", 0.08 * x / F.sqrt(1.0 + 2e-4 * x)).when(cls == "D", 0.06 * x / F.sqrt(1.0 + 1.5e-3 * x))
        .when(cls == "E", 0.03 * x / (1.0 + 3e-4 * x)).when(cls == "F", 0.016 * x / (1.0 + 3e-4 * x))
    )


def buoyancy_flux(frp: Column) -> Column:
    scale = C.GRAVITY * 1e6 / C.RADIATIVE_FRACTION / (math.pi * C.AIR_DENSITY * C.AIR_CP * C.AMBIENT_K)
    return F.when(frp > 0, frp * scale).otherwise(0.0)


def plume_rise(frp: Column, wind: Column) -> Column:
    f, u = buoyancy_flux(frp), F.greatest(wind, F.lit(C.MIN_WIND))
    return F.when(f <= 0, F.lit(0.0)).when(f < 55, 21.4 * F.pow(f, F.lit(0.75)) / u).otherwise(38.7 * F.pow(f, F.lit(0.6)) / u)


def concentration(x: Column, y: Column, z: Column, rate: Column, wind: Column, height: Column, cls: Column) -> Column:
    """Steady Gaussian plume with ground reflection, g/m3."""
    sy, sz, u = sigma_y(x, cls), sigma_z(x, cls), F.greatest(wind, F.lit(C.MIN_WIND))
    bell = lambda d, s: F.exp(-(d * d) / (2 * s * s))
    return F.when(x <= 0, F.lit(0.0)).otherwise(rate / (2 * math.pi * u * sy * sz) * bell(y, sy) * (bell(z - height, sz) + bell(z + height, sz)))


def plume_length_m(wind: Column, cls: Column, frp: Column) -> Column:
    base = (5000.0 + 2000.0 * F.greatest(wind, F.lit(0.0))) * F.when(cls.isin("E", "F"), 1.5).when(cls.isin("A", "B"), 0.7).otherwise(1.0)
    return F.greatest(F.lit(2000.0), F.least(base * (1.0 + F.least(F.coalesce(frp, F.lit(0.0)) / 500.0, F.lit(1.0))), F.lit(50000.0)))


def plume_vertex(lon: Column, lat: Column, east: Column, north: Column, length: Column, spread: Column, part: Column, side: float) -> Column:
    """struct(lon, lat) of the contour at a part of the plume's length, on the right (1) or the left (-1) flank.

    east and north are the direction of travel, spread the half width at the end; it grows as sigma_y does.
    """
    d = length * part
    w = side * spread * F.sqrt(1 + 1e-4 * length) / length * d / F.sqrt(1 + 1e-4 * d)
    y = lat + d * north / C.METRES_PER_DEGREE
    x = lon + d * east / (C.METRES_PER_DEGREE * F.cos(F.radians(lat))) + w * north / (C.METRES_PER_DEGREE * F.cos(F.radians(y)))
    return F.struct(x.alias("lon"), (y - w * east / C.METRES_PER_DEGREE).alias("lat"))


def plume_ring(lon: Column, lat: Column, east: Column, north: Column, length: Column, spread: Column, steps: int = 24) -> Column:
    """Out along the right flank and back along the left: the contour of a tenth of the centreline's value."""

    def flank(side: float) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: plume_vertex(lon, lat, east, north, length, spread, i / steps, side))

    return F.concat(flank(1.0), F.reverse(flank(-1.0)))
