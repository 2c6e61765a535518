"""Fixed values of the instrument, the study and the detectors.

These must equal the published values for results to agree; everything else is a parameter.
"""

# Spectrum files: frames x bins of small integers.
N_FRAMES = 1200
N_BINS = 512
BIN_WIDTH_HZ = 250.0
FRAME_SECONDS = 0.25
FILE_SECONDS = 300
NYQUIST_HZ = 128_000.0
AXIS_SLACK_HZ = 125.0
EDGE_EPS_HZ = 1e-6
LEVEL_FLOOR = 0
LEVEL_CEILING = 86
LEVEL_AXIS_MAX = 160
GZIP_MAGIC = b"\x1f\x8b"

# Bin regions (inclusive unless noted).
DC_BIN = 0
DC_MAX_LEVEL = 5
DC_MAX_NONZERO_FRACTION = 0.02
CALIBRATED_BINS = (1, 204)
RELATIVE_CEILING_BIN = 408
ROLLOFF_TAIL_BINS = (419, 424)
HARD_ZERO_BINS = (425, 511)
HUMP_LOW_BINS = (120, 135)  # half-open
HUMP_HIGH_BINS = (168, 180)  # half-open
HUMP_EXCESS_BINS = (135, 170)  # half-open
HUMP_STD_BINS = (130, 175)  # half-open

# Bands in Hz: name -> (low, high, counts as a detection band).
BANDS = {
    "small_craft": (1_000.0, 10_000.0, True),
    "ship_proxy": (250.0, 1_000.0, True),
    "rain": (13_000.0, 25_000.0, False),
    "control": (51_250.0, 102_000.0, False),
}
DISJOINT_BANDS = ((1_000.0, 4_000.0), (4_000.0, 10_000.0), (10_000.0, 25_000.0), (25_000.0, 51_000.0))
LOWEST_HZ = 250.0
HIGHEST_HZ = 102_000.0
DECIDECADE_MIN_CENTRE_HZ = 2_200.0
CONTROL_EXPECTED = 5.0
CONTROL_DRIFT = 5.0
SHAPE_DEADBAND = 3.0

# Events and passages.
AMBIENT_PERCENTILE = 0.10
EVENT_EXCESS = 10.0
EVENT_MIN_SECONDS = 20.0
MERGE_GAP_SECONDS = 10.0
MERGE_GAP_SWEEP = (0, 5, 10, 20, 30, 60, 120)
SMOOTH_SECONDS = 45.0
SEPARATION_SECONDS = 180.0
CROSS_BAND_SECONDS = 60.0
PROFILE_COSINE = 0.95
SPECTRUM_PERCENTILES = (5, 25, 50, 75, 95)
HALF_WINDOW_SECONDS = 900

# Calendar.
BIN_SECONDS = 300
SEASON_MONTHS = (5, 6, 7, 8, 9)
LOCAL_ZONE = "America/Vancouver"
LOCAL_WINDOW = ("09:15:00", "11:45:00")

# Scenes and detections.
REFLECTANCE_QUANT = 10_000.0
LAND_NIR_MIN = 0.05
MIN_LAND_AREA_M2 = 20_000.0
WATER_BUFFER_M = 9.0
MAD_TO_SIGMA = 1.4826
BLOB_MAD = 3.0
BLOB_MAX_ASPECT = 4.0
BLOB_MIN_FILL = 0.35
BLOB_MIN_PIXELS = 2
MAX_LENGTH_M = 150.0
MIN_LENGTH_M = 0.0
WAKE_ASPECT = 2.5
SUPPORT_MAD = 8.0
SUPPORT_WEAK_PX = 2
FUSE_TOLERANCE_M = 30.0
HULL_MARGIN_M = 30.0
SPREADING_K = 15.0
DOMINANCE_MIN = 0.8
SIZE_EDGES_M = (12.0, 24.0)
SIZE_LABELS = ("0-12m", "12-24m", ">24m")
NMS_IOU = 0.5
RAW_CONFIDENCE_FLOOR = 0.02
PERSISTENCE_CELL_DEG = (0.00045, 0.00068)  # latitude, longitude
QUEUE_MIN_SNR = 20.0
COUNT_RATIO_TOLERANCE = 0.3
CLEAR_MIN = 0.95
REVIEW_PANELS = 16
BATCH_SIZE = 26
HUMP_ABSENT = 2.0
TILE_NODATA_FRACTION = 0.01
TILE_FLAT_P99 = 25
EARTH_RADIUS_KM = 6371.0088
WGS84 = (6378137.0, 1 / 298.257223563)  # semi-major axis, flattening
M_PER_DEG = (111_320.0, 110_540.0)  # longitude at the equator, latitude

# Given file-name and metadata formats.
NAME_STAMP = r"(\d{8})_(\d{6})"  # date and time in a scene's file name
NAME_END = r"_3B_|_Visual|\.tif"  # what follows the scene id in a file name
MASKED_NAME = r"(_3B)_[A-Za-z_]*?(_clip)?\.tif$"  # image name that a clear mask is delivered with
BAND_NUMBER = r"<(?:\w+:)?bandNumber>(\d+)</"
BAND_COEFFICIENT = r"<(?:\w+:)?reflectanceCoefficient>([0-9.eE+-]+)</"
