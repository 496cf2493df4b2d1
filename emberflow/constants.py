"""Fixed values of the domain: thresholds, weights and lookup tables that results depend on."""

from __future__ import annotations

# Geodesy
EARTH_RADIUS_M = 6371000.0
METRES_PER_DEGREE = 111320.0

# Clustering and matching
CLUSTER_EPS_DEGREES = 0.005
TRAINING_EPS_DEGREES = 0.01

# Detection confidence
CONFIDENCE_HIGH, CONFIDENCE_NOMINAL = 0.8, 0.5
VIIRS_CONFIDENCE = {"l": 0.3, "low": 0.3, "n": 0.7, "nominal": 0.7, "h": 0.95, "high": 0.95}
TRAINING_CONFIDENCE = {"l": 0.3, "n": 0.6, "m": 0.6, "nominal": 0.6, "h": 0.9}
CLOUD_LIMIT = 0.3
UNKNOWN_CLOUD_FACTOR = 0.85

# Feature vector: column and group, in order
FEATURES = {
    "pct_cropland": "context", "pct_forest": "context", "pct_urban": "context", "facility_distance_m": "context",
    "facility_prior_weight": "context", "population_density": "context", "near_facility": "context",
    "frp_mean": "thermal", "frp_max": "thermal", "frp_std": "thermal", "frp_zscore": "thermal",
    "brightness_mean": "thermal", "brightness_max": "thermal", "confidence_mean": "thermal",
    "persistence_days": "temporal", "n_detections": "temporal", "detections_per_day": "temporal",
    "night_fraction": "temporal", "source_diversity": "temporal",
    "spatial_extent_km": "spatial", "spatial_growth_rate": "spatial",
    "dozier_temp": "imagery", "ndvi": "imagery", "ndbi": "imagery", "smoke_red_blue_ratio": "imagery",
    "shift_sharpness": "rhythm", "weekend_suppression": "rhythm", "kalman_time_to_critical": "rhythm",
}
GROUP_WEIGHTS = {"context": 0.30, "thermal": 0.25, "temporal": 0.20, "spatial": 0.10, "imagery": 0.10, "rhythm": 0.05}
MIN_CONFIDENCE_MULTIPLIER = 0.5
CLASSES = ("industrial_fire", "gas_flare", "wildfire", "agricultural_burning", "mining")
TABULAR_WEIGHT = 0.7

# Facility attribution
TYPE_PRIORS = {"flare": 1.00, "refinery": 0.95, "oil_well": 0.85, "steel": 0.85, "power": 0.80, "mine": 0.75, "LNG": 0.70, "industrial": 0.50}
DEFAULT_PRIOR = 0.40
DECAY_M = 500.0
SEARCH_RADIUS_M = 5000.0
MAX_CANDIDATES = 25
CONFIDENT_MARGIN = 0.25

# Crown fire
CROWN_FRP_MW, CROWN_RATE_MW_H = 100.0, 40.0

# Wildland-urban interface
EMBER_M, WATCH_MULTIPLIER, CRITICAL_ETA_H, POPULATED_PEOPLE = 2400.0, 3.0, 12.0, 8.0
CRITICAL, WATCH, MONITOR = "CRITICAL_AIR_TANKER_DISPATCH", "WATCH", "MONITOR"

# Resource demand
RDI_FRP_CAP_MW, RDI_FRP_WEIGHT = 150.0, 35.0
RDI_NEAR_WEIGHT, RDI_FAR_SCORE, RDI_TAPER_KM = 40.0, 5.0, 10.0
RDI_AREA_CAP_HA, RDI_AREA_WEIGHT = 500.0, 25.0
RDI_FULL, RDI_POINT = 80.0, 50.0
COA_FULL, COA_POINT, COA_MONITOR = "FULL_SUPPRESSION_AIR_TANKERS", "POINT_ZONE_PROTECTION", "MONITOR_ECOLOGICAL_BENEFIT"

# Suppression
WATER_L_PER_HA = {"agricultural_burning": 3000.0, "wildfire": 10000.0}
FOAM_L_PER_HA = 6.5 * 15.0 * 10000.0
COOLING_L_PER_HA = 500.0
SMOTHER_M3_PER_HA = 0.5 * 10000.0
TANKER_L, AIR_DROP_L, TRUCK_M3 = 5000.0, 3000.0, 10.0
AIR_SUPPORT_HA, AIR_SUPPORT_FRP_MW = 50.0, 100.0
PIXEL_HA = {"VIIRS": 14.0625, "MODIS": 100.0}
INTENSITY_MW, INTENSITY_MAX = 50.0, 3.0

# Dashboard risk
RISK_FRP_MW, RISK_BRIGHT_LOW, RISK_BRIGHT_HIGH = 100.0, 295.0, 360.0

# Persistence index
LONGEVITY_WEIGHT, RELIABILITY_WEIGHT, STABILITY_WEIGHT, LONGEVITY_DAYS = 0.40, 0.35, 0.25, 30.0
PERSISTENT, INTERMITTENT = 0.60, 0.30
BASELINE_DAYS, MIN_BASELINE, MIN_BASELINE_STD, NORMAL_SIGMA = 90, 5, 0.5, 3.0

# Rhythm
MIN_RHYTHM, MIN_WEEKLY_DAYS, QUIET_RATE, SLOT_TOLERANCE_H = 8, 14.0, 0.15, 2.0

# Kalman filter and escalation
PROCESS_NOISE, RELATIVE_ERROR, MIN_SCALE_MW, MIN_NOISE_MW, STD_MULTIPLIER = 1e-7, 0.30, 5.0, 1.0, 2.5
SIGMA_MULTIPLE, CRITICAL_FLOOR_MW = 3.0, 10.0
MAX_HORIZON_H, MIN_RATE_MW_H, MIN_PROBABILITY, SAMPLES = 240.0, 1e-3, 0.10, 4000
Z50, Z90 = 0.6745, 1.6449

# Freshness
STALE_H, FRESH_MULTIPLE, MODERATE_MULTIPLE, FALLBACK_FRESH_H, FALLBACK_MODERATE_H = 72.0, 1.5, 3.0, 12.0, 36.0

# Plume
SIGMA_Y = {"A": 0.22, "B": 0.16, "C": 0.11, "D": 0.08, "E": 0.06, "F": 0.04}
RADIATIVE_FRACTION, GRAVITY, AIR_DENSITY, AIR_CP, AMBIENT_K = 0.17, 9.81, 1.2, 1004.0, 293.0
LATERAL_MULTIPLE, MIN_WIND = 2.146, 0.5

# Corridors and refuges
WEDGE_STEPS, REFUGE_DISTANCE_M, REFUGE_BEARINGS = 12, 8000.0, 12

# Radiometry (CODATA 2018)
PLANCK_H, LIGHT_C, BOLTZMANN_K = 6.62607015e-34, 2.99792458e8, 1.380649e-23
VIIRS_BANDS, MODIS_BANDS = (3.74e-6, 11.45e-6), (3.959e-6, 11.03e-6)
VIIRS_SATURATION_K, MODIS_SATURATION_K = 367.0, 500.0
FIRE_K, FIRE_FRACTION = (400.0, 1800.0), (1e-7, 1.0)
BACKGROUND_DAY_K, BACKGROUND_NIGHT_K, BACKGROUND_K, BACKGROUND_SHARE, MIN_BACKGROUND = 305.0, 290.0, (260.0, 330.0), 0.1, 4
BACKGROUND_ERROR_K, WELL_CONSTRAINED_SPREAD = 1.0, 0.30

# Weak labels
AGRI_BELT = (73.8, 29.5, 77.6, 32.6)
COALFIELDS = {"jharia": (86.1, 23.6, 86.6, 23.9), "korba": (82.5, 22.2, 82.9, 22.5), "singrauli": (82.5, 23.9, 82.9, 24.3)}
AGRI_MONTHS = (4, 5, 10, 11)
INDUSTRIAL_TYPES = ("refinery", "industrial", "power", "oil_well", "steel", "LNG")
AMBIGUITY_MARGIN = 0.10

# Land cover codes
WORLDCOVER = {"forest": (10, 95), "cropland": (40,), "urban": (50,), "bare": (60,), "water": (80,)}

# Emissions: hazard and main substances by facility type; looked up in lower case, so "LNG" falls through to the class
EMISSIONS = {
    "refinery": ("high", ("SO2", "H2S", "VOC", "benzene", "particulates")),
    "flare": ("moderate", ("CO2", "CO", "NOx", "unburnt hydrocarbons", "soot")),
    "oil_well": ("high", ("CH4", "H2S", "VOC", "condensate aerosol")),
    "LNG": ("high", ("CH4", "cryogenic vapour cloud")),
    "power": ("moderate", ("SO2", "NOx", "fly ash", "particulates", "CO")),
    "steel": ("moderate", ("CO", "particulates", "metal oxides", "SO2")),
    "mine": ("moderate", ("CO", "particulates", "coal smoke", "SO2")),
    "industrial": ("moderate", ("particulates", "CO", "VOC")),
}
CLASS_EMISSIONS = {"wildfire": ("moderate", ("PM2.5", "CO", "VOC", "NOx")), "agricultural_burning": ("moderate", ("PM2.5", "CO", "CH4", "NH3"))}
UNKNOWN_EMISSIONS = ("unknown", ("particulates", "CO"))
SETTLEMENT_EXCESS_M, SAME_SITE_EXCESS_M = 1500.0, 400.0
