"""Decoders for the message payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice import schema as S
from sluice.functions.clean import parse_timestamp, safe_float


def _decoded(df: DataFrame, schema: T.StructType, value: str) -> DataFrame:
    parsed = df.withColumn("_data", F.from_json(F.col(value).cast("string"), schema))
    return parsed.select(*[c for c in df.columns if c != value], "_data.*")


def decode_sensor_json(df: DataFrame, schema: T.StructType | None = None, value: str = "value") -> DataFrame:
    """JSON object to flat string columns; other columns of the message are kept."""
    return _decoded(df, schema or S.text_row_schema(), value)


def decode_typed_json(df: DataFrame, schema: T.StructType | None = None, value: str = "value") -> DataFrame:
    """JSON object straight to typed columns; a field of another type gives null."""
    return _decoded(df, schema or S.typed_row_schema(), value)


def decode_device_arrays(df: DataFrame, value: str = "value") -> DataFrame:
    return _decoded(df, S.DEVICE_SCHEMA, value)


def device_points(decoded: DataFrame) -> DataFrame:
    """One row per measurement, by position; other columns are kept."""
    rest = [c for c in decoded.columns if c != "measurements"]
    return decoded.select(*rest, F.posexplode("measurements").alias("position", "value"))


def decode_logs(df: DataFrame, value: str = "value") -> DataFrame:
    logs = _decoded(df, S.LOG_SCHEMA, value)
    return logs.withColumn("timestamp", parse_timestamp(F.col("timestamp")))


def decode_dynamic_json(df: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(long rows ``key, field_value`` with the other message columns, quarantined messages).

    A bad message is set aside alone; empty messages are skipped.
    """
    text = F.col(value).cast("string")
    rest = [c for c in df.columns if c != value]
    parsed = df.filter(F.coalesce(text, F.lit("")) != "").withColumn(
        "_map", F.from_json(text, T.MapType(T.StringType(), T.StringType()))
    )
    good = parsed.filter(F.col("_map").isNotNull()).select(*rest, F.explode("_map").alias("key", "field_value"))
    bad = parsed.filter(F.col("_map").isNull()).select(*rest, text.alias(value))
    return good, bad


def decode_score(df: DataFrame, value: str = "value", out: str = "anomaly_score") -> DataFrame:
    """Score from an object with ``anomaly_score`` or from a bare number; others are skipped."""
    text = F.col(value).cast("string")
    score = F.coalesce(safe_float(F.get_json_object(text, "$.anomaly_score")), safe_float(F.trim(text, F.lit('"'))))
    return df.withColumn(out, score).filter(F.col(out).isNotNull()).drop(value)
