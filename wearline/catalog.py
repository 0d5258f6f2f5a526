"""Columns, constants and schemas that the other modules share."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Fixed values of the recordings.
CHANNELS = ("horiz", "vert")
SAMPLING_HZ, SAMPLES_PER_FILE, TEMPERATURE_ROWS = 25_600, 2_560, 600
INTERVAL_SECONDS = 10
N_BANDS = 8
TIME_STATS = ("rms", "kurtosis", "skewness", "crest_factor")
#: Borders in Hz of the half-open bands of the extended spectrum.
EXTENDED_EDGES = [0.0, 1_000.0, 3_000.0, 6_000.0, 10_000.0, 12_800.0]
#: Operating conditions: speed in rpm, load in N.
CONDITIONS = {1: (1800, 4000), 2: (1650, 4200), 3: (1500, 5000)}
#: Names of splits in archives and after canonical naming.
SPLITS = {"Learning_set": "Training_set", "Full_Test_Set": "Validation_Set"}

# Fixed values of the feature sets.
SOURCES = [f"{s}_{c}" for s in ("rms", "kurtosis", "crest_factor") for c in CHANNELS]
ROLLING_WINDOWS, ROLLING_STATS = (6, 30, 60), ("mean", "std", "slope")
EARLY_ROWS = RECENT_ROWS = HEALTHY_ROWS = 60
CUT_FRACTIONS = tuple(round(0.40 + 0.05 * k, 2) for k in range(12))
ROBUST_CLIP = 50.0
HEALTH_SIGNALS = [*SOURCES, "fft_total_horiz", "fft_total_vert"]
METADATA = ["split", "condition", "bearing", "elapsed_time_seconds", "file_index"]
TARGET = "rul_seconds"
BLOCKED = ["split", "bearing", "elapsed_time_seconds", "file_index", TARGET]
NEVER_PREDICTORS = [*BLOCKED, "cut_fraction", "total_life_seconds"]
KEY = ["split", "bearing", "file_index"]
TRUTH_KEY = ["condition", "bearing", "file_index"]
CONTEXT = ["rotation_speed_rpm", "radial_load_n"]


def band_columns(channel: str) -> list[str]:
    return [f"fft_band_{i}_{channel}" for i in range(N_BANDS)]


def band_edges(rate_hz: float = SAMPLING_HZ, bands: int = N_BANDS) -> list[float]:
    return [rate_hz / 2 * i / bands for i in range(bands + 1)]


def signal_columns() -> list[str]:
    """The 24 columns of a snapshot."""
    return [c for ch in CHANNELS for c in (*(f"{s}_{ch}" for s in TIME_STATS), *band_columns(ch))]


def temporal_columns() -> list[str]:
    """The 54 rolling columns."""
    return [f"{s}_roll_{stat}_{w}" for s in SOURCES for w in ROLLING_WINDOWS for stat in ROLLING_STATS]


def prefix_columns() -> list[str]:
    """The 21 predictors of a prefix."""
    return ["observed_age_seconds", *CONTEXT, *(f"{s}_{x}" for s in SOURCES for x in ("current_over_early", "recent_mean_over_early", "recent_slope_per_hour"))]


def health_columns() -> list[str]:
    """The 27 predictors of a health-indicator sample."""
    own = [f"hi_{x}" for x in ("current", "recent_mean", "recent_std", "recent_max", "recent_slope_per_hour", "full_mean", "full_max", "full_slope_per_hour")]
    return ["observed_age_seconds", *CONTEXT, *own, *(f"{s}_robust_z_{x}" for s in HEALTH_SIGNALS for x in ("current", "recent_mean"))]


def feature_schema() -> dict[str, object]:
    """Column roles of the snapshot tables, as plain data."""
    predictors = [*signal_columns(), *temporal_columns()]
    return {
        "metadata_columns": METADATA, "signal_feature_columns": signal_columns(), "temporal_feature_columns": temporal_columns(),
        "default_model_feature_columns": predictors, "optional_context_columns": ["condition"], "blocked_predictor_columns": BLOCKED,
        "target_column": TARGET, "ground_truth_key_columns": TRUTH_KEY, "train_columns": [*METADATA, *predictors, TARGET],
        "test_feature_columns": [*METADATA, *predictors], "test_ground_truth_columns": [*TRUTH_KEY, TARGET],
    }


def write_feature_schema(spark: SparkSession, path: str) -> None:
    """The schema as one JSON text, by Spark's writer."""
    spark.createDataFrame([(json.dumps(feature_schema()),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def conditions(spark: SparkSession) -> DataFrame:
    """The dimension table of operating conditions: always three rows."""
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in CONDITIONS.items()], "condition int, rotation_speed_rpm double, radial_load_n double")


ACC_SCHEMA = T.StructType([T.StructField(c, T.DoubleType()) for c in ("hour", "minute", "second", "microsecond", "horiz_accel_g", "vert_accel_g")])
TEMP_SCHEMA = T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("hour", "minute", "second", "hundredth_second")), T.StructField("temperature_c", T.DoubleType())])
PREDICTION_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()), T.StructField("requested_at", T.TimestampType()),
    *(T.StructField(c, T.StringType()) for c in ("model_name", "model_version", "model_alias", "feature_set_version")),
    *(T.StructField(c, T.DoubleType()) for c in prefix_columns()),
    T.StructField("predicted_rul_seconds", T.DoubleType()), T.StructField("latency_ms", T.DoubleType()),
    T.StructField("status", T.StringType()), T.StructField("error_message", T.StringType()),
])
