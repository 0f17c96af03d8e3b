"""Running a stream over what has arrived and reading its output table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from sluice.session import STATE_STORE, scratch_path

#: State partitions per core: each costs every batch the start of a Python worker and the opening of a store.
PARTITIONS_PER_CORE = 2
PARTITIONS = "spark.sql.shuffle.partitions"


def stream_settings(spark: SparkSession) -> dict[str, str]:
    """The state store that keyed state needs, and no more state partitions than the cores can use."""
    most = PARTITIONS_PER_CORE * spark.sparkContext.defaultParallelism
    return {**STATE_STORE, PARTITIONS: str(min(int(spark.conf.get(PARTITIONS)), most))}


def started(stream: DataFrame, writer: DataStreamWriter) -> StreamingQuery:
    """The running query, with the settings of streams in any session: a query takes its settings when it starts,
    the session's own are put back."""
    conf, settings = stream.sparkSession.conf, stream_settings(stream.sparkSession)
    before = {k: conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            conf.set(k, v)
        return writer.start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Process everything available, append to a table in the shared folder, read it back."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    writer = (stream.writeStream.format("parquet").outputMode("append").option("path", out)
              .option("checkpointLocation", out + "-state").trigger(availableNow=True))
    started(stream, writer).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, label: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything available, handing each micro-batch to ``each``."""
    state = scratch_path(stream.sparkSession, label + "-state")
    writer = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    started(stream, writer).awaitTermination()
