"""Constants of the scalar field and its representations."""

# Lattice, zoom and timing.
BASE_GRID = 128
LOOP_SECONDS = 18.0
MIN_ZOOM, MAX_ZOOM = 0.1, 5.5
#: Factor of a zoom step, zoom per wheel pixel (natural logarithm).
ZOOM_STEP, ZOOM_PIXEL = 1.28, 0.00125
TARGET_SPACING = 11.5
MORPH_SECONDS = 0.2
MAX_DELTA = 0.1
OVERSCAN = 4
RASTER_SCALE = 0.42
SUBDIVISIONS = 3
SMOOTH_RADIUS, SMOOTH_SIGMA = 4, 1.2
GENERAL_RADIUS, GENERAL_PASSES = 6, 3
BINS = 1024
SUPPORT_X, SUPPORT_Y = 0.92, 0.76

# Visibility thresholds, marker sizes and exponents by channel.
CHANNELS = ("rain", "storm", "hail")
FLOOR = {"rain": 0.045, "storm": 0.075, "hail": 0.11}
OVERLAP = {"rain": 0.86, "storm": 0.72, "hail": 0.59}
EXPONENT = {"rain": 0.47, "storm": 0.56, "hail": 0.56}
MODERATE_MAX = 0.55

# Colours.
BACKGROUND, RAIN_RGB, STRONG_RGB, STORM_RGB, HAIL_RGB = (8, 11, 18), (0, 144, 255), (0, 0, 255), (255, 0, 255), (255, 212, 0)
RAIN_HEX, STRONG_HEX, STORM_HEX, HAIL_HEX = "#0090FF", "#0000FF", "#FF00FF", "#FFD400"

# Contour bands (channel, band, threshold, colour).
BANDS = (
    ("rain", 0, 0.027, "#0090FF"),
    ("rain", 1, 0.12, "#0078FF"),
    ("rain", 2, 0.25, "#005EFF"),
    ("rain", 3, 0.40, "#003CFF"),
    ("rain", 4, 0.55, "#0000FF"),
    ("storm", 0, 0.03375, "#FF00FF"),
    ("hail", 0, 0.0495, "#FFD400"),
)

# Phases of the waves a, b and c.
PHASES = {"a": 0.02, "b": 0.36, "c": 0.68}
# Components of the field. A pair with a wave runs from the first to the second value with it.
# channel, sign, offset x, centre y, width x, width y, rotation, amplitude
COMPONENTS = (
    ("rain", 1, -0.05, 0.47, (0.17, 0.25, "a"), (0.12, 0.18, "b"), (-0.35, 0.18, "c"), (0.72, 1.05, "a")),
    ("rain", 1, 0.16, 0.39, (0.10, 0.18, "b"), (0.09, 0.14, "a"), 0.62, (0.22, 0.76, "b")),
    ("rain", 1, -0.13, 0.66, (0.07, 0.14, "c"), (0.11, 0.18, "a"), -0.46, (0.18, 0.65, "c")),
    ("rain", -1, 0.02, 0.54, (0.05, 0.12, "b"), (0.04, 0.09, "b"), 0.15, (0.02, 0.26, "b")),
    ("storm", 1, 0.0, 0.47, (0.075, 0.125, "b"), (0.055, 0.095, "c"), -0.25, (0.42, 1.0, "b")),
    ("storm", 1, 0.13, 0.40, (0.045, 0.085, "c"), (0.04, 0.07, "a"), 0.65, (0.18, 0.88, "c")),
    ("storm", 1, -0.11, 0.60, (0.04, 0.075, "a"), (0.045, 0.09, "b"), -0.5, (0.10, 0.67, "a")),
    ("hail", 1, 0.025, 0.445, (0.028, 0.052, "c"), (0.024, 0.046, "a"), -0.2, (0.16, 0.95, "c")),
    ("hail", 1, 0.125, 0.39, (0.018, 0.040, "a"), (0.020, 0.045, "b"), 0.7, (0.04, 0.73, "a")),
    ("hail", 1, -0.08, 0.585, (0.017, 0.034, "b"), (0.021, 0.043, "c"), -0.3, (0.02, 0.55, "b")),
)


def kernel() -> list[float]:
    """The 9 Gaussian weights from -4 to 4, rounded to 32 bits when stored and again after division."""
    import numpy as np

    k = np.arange(-SMOOTH_RADIUS, SMOOTH_RADIUS + 1)
    raw = np.exp(-(k * k) / (2 * SMOOTH_SIGMA**2))
    total = float(raw.sum())
    return [float(np.float32(float(x) / total)) for x in raw.astype(np.float32)]
