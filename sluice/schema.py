"""Fixed values of the plant data model."""

from __future__ import annotations

from pyspark.sql import types as T

# The sensor and actuator tags of the six stages, in message order.
SENSOR_TAGS = [
    "FIT101", "LIT101", "MV101", "P101", "P102",
    "AIT201", "AIT202", "AIT203", "FIT201", "MV201", "P201", "P202", "P203", "P204", "P205", "P206",
    "DPIT301", "FIT301", "LIT301", "MV301", "MV302", "MV303", "MV304", "P301", "P302",
    "AIT401", "AIT402", "FIT401", "LIT401", "P401", "P402", "P403", "P404", "UV401",
    "AIT501", "AIT502", "AIT503", "AIT504", "FIT501", "FIT502", "FIT503", "FIT504", "P501", "P502",
    "PIT501", "PIT502", "PIT503",
    "FIT601", "P601", "P602", "P603",
]
TIME_COLUMN = "Timestamp"
LABEL_COLUMN = "Normal_Attack"
LABEL_COLUMNS = ["Normal_Attack", "Label", "Attack"]
ATTACK = "Attack"
NORMAL = "Normal"
NORMAL_LABELS = ["normal", "0", ""]
FORECAST_TAGS = ["AIT201", "FIT301", "LIT101"]

# Accepted time formats with the shape of text each one reads. ISO text of
# any other shape is tried last.
TIME_FORMATS = {
    r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$": "yyyy-M-d H:m:s",
    r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$": "yyyy-M-d'T'H:m:s",
    r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$": "yyyy/M/d H:m:s",
    r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$": "d/M/yyyy H:m:s",
    r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2} [AaPp][Mm]$": "d/M/yyyy h:m:s a",
}

# Rule limits and tag groups of the live metrics.
LEVEL_TAGS = ["LIT101", "LIT401", "LIT301"]
LEVEL_LOW, LEVEL_HIGH = 300.0, 1000.0
FLOW_TAGS = ["FIT101", "FIT201", "FIT301", "FIT401", "FIT501", "FIT601"]
FLOW_SPIKE = 2.5
PRESSURE_TAGS = ["PIT501", "PIT502", "PIT503"]
STAGE5_FLOW_TAGS = ["FIT501", "FIT502", "FIT503", "FIT504"]
PUMP_TAGS = ["P101", "P102", "P201", "P202", "P203", "P204", "P205", "P206", "P401", "P402", "P403", "P404"]
VALVE_TAGS = ["MV101", "MV201", "MV301"]

# Cumulative histogram bounds (latency in seconds; sensor error).
LATENCY_BUCKETS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0]
ERROR_BUCKETS = [0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0, 50.0]

# Stage lags in minutes for the propagation view.
STAGE_OFFSETS = {"P1": 0, "P2": 5, "P3": 10, "P4": 15, "P5": 20, "P6": 25}

# Flow-drop-then-level-rise pattern defaults.
PATTERN_NAME = "FIT_drop_then_LIT_rise"
PATTERN_SENSOR = "FIT101->LIT101"
DROP_BELOW, RISE_ABOVE = 3.0, 512.0
MIN_DROP, MIN_RISE = 0.1, 1.0
FOLLOWUP_SECONDS = COOLDOWN_SECONDS = 60

SEQUENCE_LENGTH = 30
FORECAST_ROWS = FORECAST_STEPS = 10
SCORE_PERCENTILE = 0.9


def text_row_schema() -> T.StructType:
    """The wide row as it travels: every field a string."""
    return T.StructType([T.StructField(c, T.StringType()) for c in [TIME_COLUMN, *SENSOR_TAGS, LABEL_COLUMN]])


def typed_row_schema() -> T.StructType:
    """The wide row with doubles decoded straight from JSON."""
    return T.StructType(
        [T.StructField(TIME_COLUMN, T.StringType())]
        + [T.StructField(c, T.DoubleType()) for c in SENSOR_TAGS]
        + [T.StructField(LABEL_COLUMN, T.StringType())]
    )


LOG_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ["timestamp", "host", "service", "level", "message"]]
    + [T.StructField("anomaly_score", T.DoubleType())]
)
DEVICE_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("measurements", T.ArrayType(T.FloatType())),
])
