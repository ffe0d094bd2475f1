"""Published codes, thresholds and physical constants.

These are data, not logic: results are only right when they equal the values of the algorithm document.
"""

# Physical constants (SI).
PLANCK_H = 6.62607015e-34
BOLTZMANN_K = 1.380649e-23
LIGHT_C = 299792458.0
STEFAN_BOLTZMANN = 5.67e-8
EARTH_RADIUS_KM = 6378.137

# Central wavelength per band, metres.
WAVELENGTH_M = {2: 0.64e-6, 7: 3.90e-6, 13: 10.35e-6, 14: 11.20e-6, 15: 12.30e-6}

# Fire codes: six categories and the same six after the temporal filter (+20).
BASE_FIRE_CODES = (10, 11, 12, 13, 14, 15)
TEMPORAL_FIRE_CODES = (30, 31, 32, 33, 34, 35)
FIRE_CODES = BASE_FIRE_CODES + TEMPORAL_FIRE_CODES
TEMPORAL_OFFSET = 20

# Every mask code with its name and quality flag (Table 3.11 / 3.12 of the algorithm document).
# Flag: 0 fire, 1 fire-free land, 2 cloud, 3 bad surface/glint/zenith, 4 bad input, 5 no solution.
MASK_CODES = (
    (0, "out of region", 3),
    (10, "processed fire", 0),
    (11, "saturated fire", 0),
    (12, "cloud contaminated fire", 0),
    (13, "high probability fire", 0),
    (14, "medium probability fire", 0),
    (15, "low probability fire", 0),
    (30, "processed fire, filtered", 0),
    (31, "saturated fire, filtered", 0),
    (32, "cloud contaminated fire, filtered", 0),
    (33, "high probability fire, filtered", 0),
    (34, "medium probability fire, filtered", 0),
    (35, "low probability fire, filtered", 0),
    (40, "space", 3),
    (50, "local zenith block-out", 3),
    (60, "glint or sub-solar block-out", 3),
    (100, "fire free", 1),
    (120, "missing 3.9 um", 4),
    (121, "missing 11.2 um", 4),
    (123, "saturated 3.9 um", 4),
    (124, "saturated 11.2 um", 4),
    (125, "negative radiance", 4),
    (126, "unusable 3.9 um", 4),
    (127, "unusable 11.2 um", 4),
    (150, "invalid ecosystem", 3),
    (151, "sea water", 3),
    (152, "coast fringe", 3),
    (153, "inland water", 3),
    (160, "invalid emissivity", 4),
    (170, "no background", 5),
    (180, "conversion error", 5),
    (188, "invalid pixel area", 5),
    (200, "cloud: cold 11.2 um", 2),
    (201, "too cold", 2),
    (205, "cloud: negative difference", 2),
    (210, "cloud: positive difference", 2),
    (215, "cloud: albedo", 2),
    (220, "cloud: cold 12.3 um", 2),
    (225, "cloud: split window low", 2),
    (230, "cloud: split window high", 2),
    (240, "along-scan, night", 2),
    (245, "along-scan, day", 2),
)

# Last gate passed, and the name of the gate that stops a pixel at that stage.
STAGE_GATES = {
    0: "space", 1: "view zenith", 2: "glint block-out", 3: "missing or saturated", 4: "ecosystem",
    5: "negative radiance", 6: "minimum difference", 7: "cloud flags", 8: "along-scan",
    9: "no background", 10: "quick path", 11: "non-fire", 12: "flag 1", 13: "flag 2",
    14: "water vapour correction", 15: "background correction", 16: "solar or diffraction",
    17: "post-correction", 18: "retrieval", 19: "last chance", 20: "pixel area", 21: "recorded",
    22: "candidate",
}

# Per-pixel gates.
SAT_BT7, SAT_BT14, SAT_BUFFER = 411.86, 340.0, 5.0
SAT_FLAG_BT7, SAT_FLAG_BT14 = 411.76, 339.90
MIN_USABLE_BT = 200.0
MAX_VIEW_ZENITH, GLINT_BLOCK = 80.0, 10.0
MAX_DAY_ZENITH = 85.0
WARM_BT, MIN_BT_DIFF = 273.0, 2.0
FOCAL_PLANE_LIMIT = 90.0
CLOUD_BT14, CLOUD_DIFF_LOW, CLOUD_DIFF_HIGH, CLOUD_BT7 = 270.0, -4.0, 20.0, 285.0
CLOUD_ALBEDO, CLOUD_ALBEDO_MAX_ZENITH, CLOUD_BT15 = 0.38, 70.0, 265.0
SPLIT_LOW, SPLIT_HIGH = -4.0, 60.0
SCAN_REFL, SCAN_BT7_MIN, SCAN_BT7_MAX = 0.2, 150.0, 320.0
BT7_MIN_NIGHT, BT7_MIN_SOLAR = 285.0, 15.0
BT7_REFL_NIGHT, BT7_REFL_SOLAR = 315.0, 5.0
REFL_SENTINEL, REFL_VALID_ABOVE = -9999.0, -9998.0

# Background window.
HALF_WIDTHS = (5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55)
VALID_FRACTION = 0.20
BKG_WARM_NIGHT, BKG_WARM_SOLAR, BKG_COLD = 310.0, 25.0, 270.0
BKG_MIN_VIS, BKG_MAX_ALBEDO = 1.0, 0.38
MAX_PASSES = 10

# Corrections.
SMOKE_LOW, SMOKE_HIGH = 0.025, 0.07
SMOKE_BT7, SMOKE_BT14, CLOUD_BT7_ADD, CLOUD_BT14_ADD = 10.0, 30.0, 0.7, 2.1
DIFFRACTION_7, DIFFRACTION_14 = 0.15, 0.30

# Retrieval and radiative power.
P_LOW, P_HIGH = 1e-6, 1.0
BISECTION_STEPS, REFINED_STEPS = 15, 50
MIN_FIRE_TEMP, MAX_SURFACE_TEMP = 400.0, 350.0
FRP_MIR = 3.0e-3
NOT_RETRIEVED, FRP_SKIPPED, FRP_OVER_PASSES = -999.0, -9.0, -99.0
INITIAL_FIRE_TEMP = -9.05

# Part II.
P2_DAY, P2_DELTA_MIN, P2_WARM, P2_DELTA_MAX, P2_DIFF_MAX, P2_BKG_COLD = 20.0, 2.0, 290.0, 10.0, 25.0, 280.0
P2_REFL = 2.5
EDGE_ALBEDO, EDGE_ALBEDO_DIFF, EDGE_BT7 = 0.25, 0.10, 292.5
FOG_ADD, FOG_DIFF, FOG_DELTA = 5.0, 1.5, 4.0
CONFIDENCE = {"high": (7.0, 5.0), "medium": (5.0, 3.0)}
CONSERVATIVE_DELTA = 6.0

# Temporal filter.
LOOKBACK_SECONDS = 43200
EPOCH_2001 = 978307200

# Scene feature table: identifiers, target, information column, then the 28 features.
FEATURE_IDS = ("timestamp", "i", "j")
FEATURE_TARGET, FEATURE_INFO = "ref_fire", "ref_code"
