"""Fixed names, enums and explicit schemas. Nothing in the package infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

# The model features, in model order.
FEATURES = [
    "track_km", "speed_kmh", "load_ton",
    "vib_x_rms_g", "vib_y_rms_g", "vib_z_rms_g", "vib_peak_g", "vib_kurtosis",
    "vib_crest_factor", "vib_dom_freq_hz", "acoustic_rms", "acoustic_peak_freq_hz",
    "axle_box_temp_c", "brake_temp_c", "motor_temp_c", "ambient_temp_c",
    "motor_current_a", "motor_voltage_v", "humidity_pct",
]

# Fault classes (alphabetical, as the label encoder orders them).
CLASSES = ["bearing_fault", "brake_fault", "motor_fault", "normal", "rail_crack", "wheel_flat"]

# Severities, in rank order.
SEVERITIES = ["none", "mild", "moderate", "severe"]

# Identity, label and window constants.
AXLE_COLUMNS = ["train_id", "wagon_id", "axle_id"]
LABELS = ["fault_type", "fault_severity"]
ID_COLUMNS = ["sample_id", "timestamp", "line_id", "train_id", "wagon_id", "axle_id"]
WINDOW_ROWS = 10
WINDOW_STRIDE = 2
TICK_SECONDS = 2.0
HYSTERESIS = 3
ENTROPY_LIMIT = 0.35
METRIC_EVERY = 25

_S, _D, _L = T.StringType(), T.DoubleType(), T.LongType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


_SENSORS = [(c, _D) for c in FEATURES[3:]]

TELEMETRY = _struct(
    ("timestamp", T.TimestampType()), ("line_id", _S), ("train_id", _S), ("wagon_id", _S),
    ("axle_id", _S), ("track_km", _D), ("speed_kmh", _D), ("load_ton", _D), ("lat", _D),
    ("lon", _D), ("next_station", _S), ("at_station", T.BooleanType()), *_SENSORS,
    ("fault_type", _S), ("fault_severity", _S),
)

STREAM = T.StructType(
    [T.StructField("sample_id", _L, True)] + [f for f in TELEMETRY.fields if f.name not in LABELS]
)

ANSWER_KEY = _struct(
    ("sample_id", _L), ("timestamp", T.TimestampType()), ("line_id", _S), ("train_id", _S),
    ("wagon_id", _S), ("axle_id", _S), ("fault_type", _S), ("fault_severity", _S),
)

RUNS = _struct(
    ("id", _L), ("started", T.TimestampType()), ("source", _S), ("blind", T.BooleanType()),
    ("hysteresis", T.IntegerType()), ("axle_count", _L), ("line_count", _L),
)

ALARMS = _struct(
    ("id", _L), ("run_id", _L), ("recorded_at", T.TimestampType()),
    ("sim_time", T.TimestampType()), ("tick", _L), ("axle", _S), ("line_id", _S), ("prior", _S),
    ("new", _S), ("severity", _S), ("conf", _D), ("station", _S), ("kind", _S),
    ("prior_duration_s", _D), ("priority", _D), ("defect_id", _S), ("actual", _S),
)

METRICS = _struct(
    ("id", _L), ("run_id", _L), ("recorded_at", T.TimestampType()), ("tick", _L),
    ("evaluated", _L), ("accuracy", _D), ("severity_accuracy", _D), ("macro_f1", _D),
    ("active_alarms", _L),
)

DEFECTS = _struct(
    ("hat", _S), ("km", _D), ("kusur_id", _S), ("genislik_km", _D), ("siddet", _S),
    ("arasi", _S), ("lat", _D), ("lon", _D),
)

STATIONS_GEOJSON = T.StructType([
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("properties", _struct(
            ("PROJE_ADI", _S), ("PROJE_ASAMA", _S), ("ISTASYON", _S), ("HAT_TURU", _S),
            ("MUDURLUK", _S))),
        T.StructField("geometry", T.StructType([
            T.StructField("coordinates", T.ArrayType(_D))])),
    ]))),
])

# LineString and MultiLineString (likewise Polygon and MultiPolygon) nest at different depths,
# so coordinates are read as text and parsed by geometry type.
LINES_GEOJSON = T.StructType([
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("properties", _struct(
            ("PROJE_ASAMA", _S), ("PROJE_AD_KISA", _S), ("PROJE_ADI", _S), ("UZUNLUK", _D))),
        T.StructField("geometry", _struct(("type", _S), ("coordinates", _S))),
    ]))),
])

DISTRICTS_GEOJSON = T.StructType([
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("properties", _struct(("shapeName", _S))),
        T.StructField("geometry", _S),
    ]))),
])

_PART = _struct(("type", _S), ("coordinates", _S))
GEOMETRY = T.StructType([*_PART.fields, T.StructField("geometries", T.ArrayType(_PART))])
