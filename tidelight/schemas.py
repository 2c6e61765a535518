"""Table schemas. Units travel with the column names."""

from pyspark.sql import types as T


_KINDS = {
    "string": T.StringType(), "timestamp": T.TimestampType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "double": T.DoubleType(), "boolean": T.BooleanType(), "array<smallint>": T.ArrayType(T.ShortType()),
}


def _s(text: str) -> T.StructType:
    pairs = [field.rsplit(" ", 1) for field in text.split(", ")]
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


FRAMES = _s("device string, path string, start_utc timestamp, frame_idx int, t_utc_s double, levels array<smallint>")
DECODE_ERRORS = _s("path string, reason string")
FILE_INDEX = _s("name string, container int, start_utc timestamp, end_utc timestamp")
UPTIME = _s("start_utc timestamp, end_utc timestamp, available boolean, deployment_id string")
DEPLOYMENTS = _s("deployment_id string, start_utc timestamp, end_utc timestamp")
SCENES = _s("scene_id string, acquired_utc timestamp, clear_percent double, instrument string")
LABELS = _s("scene_id string, acquired_utc timestamp, label string, n_vessels int, area_km2 double, reviewer string, reviewed_utc string, notes string")
MANUAL_COUNTS = _s("timestamp string, vessel_count int")
DETECTIONS = _s(
    "scene_id string, acq_time_utc string, lon double, lat double, bbox_w_m double, bbox_h_m double, length_class_m double, "
    "confidence double, aspect_ratio double, wake_flag int, range_km double, detector string, nir_snr double")
SCENE_CLASSES = _s(
    "scene_id string, acq_time_utc string, n_detections bigint, dominance double, class string, r_dominant_km double, "
    "wake_flag_dominant int, verified int")
EVENTS = _s("scene_id string, band string, t_start double, t_peak double, duration_s double, peak_excess double")
EVENTS_LONG = _s(
    "scene_id string, band string, n_frames bigint, n_events bigint, n_events_merged bigint, n_events_shuffled bigint, "
    "n_events_shuffled_merged bigint, n_events_shifted bigint, n_events_shifted_merged bigint, baseline double, peak_excess double, "
    "duration_s double, n_outside bigint, note string")
REVIEW = _s(
    "scene_id string, acquired_utc timestamp, coverage string, band string, event_peak_utc timestamp, minutes_from_acquisition double, "
    "duration_s double, peak_excess double, baseline double, reviewer_notes string")
