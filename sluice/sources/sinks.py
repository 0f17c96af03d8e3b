"""Point tables and append sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice import schema as S
from sluice.functions.clean import safe_float


def to_points(df: DataFrame, ids: Sequence[str] = (), measurement: str = "sensor_data",
              time: str = S.TIME_COLUMN, label: str = S.LABEL_COLUMN) -> DataFrame:
    """Wide to long: every column but time, label and ``ids`` that reads as a number is a
    field; the trimmed label is the ``status`` tag."""
    fields = [c for c in df.columns if c not in (time, label, *ids)]
    status = F.coalesce(F.trim(F.col(label)), F.lit(S.NORMAL)) if label in df.columns else F.lit(S.NORMAL)
    flat = df.select(*ids, F.col(time).alias("time"), status.alias("status"),
                     *[safe_float(F.col(c)).alias(c) for c in fields])
    long = flat.unpivot([*ids, "time", "status"], fields, "field", "value").filter(F.col("value").isNotNull())
    return long.select(*ids, "time", F.lit(measurement).alias("measurement"), "status", "field", "value")


def log_points(logs: DataFrame) -> DataFrame:
    """Log records as points; a record without a numeric score is skipped."""
    return logs.filter(F.col("anomaly_score").isNotNull()).select(
        F.col("timestamp").alias("time"), F.lit("log_anomaly").alias("measurement"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("service", "level", "host", "message")],
        F.col("anomaly_score").cast("double").alias("anomaly_score"),
    )


def pattern_points(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return events.select(*keys, F.col("ts").alias("time"), F.lit("pattern_events").alias("measurement"),
                         "pattern", "sensor", F.col("severity").cast("double").alias("severity"), "details")


def score_messages(scores: DataFrame, columns: Sequence[str] = ("entity", "ts", "anomaly_score")) -> DataFrame:
    """Scores as JSON messages that keep their key and time."""
    return scores.select(F.col(columns[0]).cast("string").alias("key"), F.to_json(F.struct(*columns)).alias("value"))


def to_topic(messages: DataFrame, servers: str, topic: str) -> None:
    """Write ``key, value`` messages to a topic (the connector package must be present)."""
    (messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save())


def append_points(path: str, time: str = "time") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer. Each batch owns one folder and overwrites it, so a
    repeated batch leaves no duplicates. Rebalancing splits a crowded (measurement, date)
    over several files and merges thin ones."""

    def write(batch: DataFrame, batch_id: int) -> None:
        dated = batch.withColumn("date", F.to_date(time))
        (dated.hint("rebalance", "measurement", "date").write.mode("overwrite")
         .partitionBy("measurement", "date").parquet(f"{path}/batch_id={batch_id}"))

    return write


def metric_snapshot(samples: DataFrame, labels: Sequence[str], name: str = "metric",
                    value: str = "value", ts: str = "ts") -> DataFrame:
    """Scraped samples as one long table with a label map and one time per scrape."""
    pairs = [e for c in labels for e in (F.lit(c), F.col(c).cast("string"))]
    return samples.select(F.col(name).alias("metric"), F.create_map(*pairs).alias("labels"),
                          F.col(value).cast("double").alias("value"), F.col(ts).alias("ts"))


def latest_per_series(samples: DataFrame, keys: Sequence[str], value: str = "value", ts: str = "ts",
                      tie: str | None = None) -> DataFrame:
    """Latest value of each series; map-side combined, so one busy series is no hot spot."""
    order = F.struct(ts, tie) if tie else F.col(ts)
    return samples.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(ts).alias(ts))


def write_report(data: DataFrame, features: DataFrame, report: DataFrame, path: str) -> None:
    """Cleaned rows as CSV, the feature list as text and the report as JSON."""
    data.write.mode("overwrite").option("header", True).csv(f"{path}/selected_features_dataset")
    features.select("feature").coalesce(1).write.mode("overwrite").text(f"{path}/selected_features")
    report.coalesce(1).write.mode("overwrite").json(f"{path}/feature_selection_report")
