"""CSV and message sources, batch and streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.series import with_row_index

TOP_ROWS = 100_000


def normalise_headers(df: DataFrame) -> DataFrame:
    """Trim names and drop a byte-order mark; columns that become equal are merged,
    first non-null wins."""
    groups: dict[str, list[str]] = {}
    for name in df.columns:
        groups.setdefault(name.lstrip("﻿").strip(), []).append(name)
    return df.select(*[
        F.coalesce(*[F.col(f"`{n}`") for n in names]).alias(clean) for clean, names in groups.items()
    ])


def source_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Header CSV, every field a string."""
    return normalise_headers(spark.read.option("header", True).csv(path))


def stream_csv(spark: SparkSession, path: str, columns: Sequence[str], files_per_trigger: int = 10) -> DataFrame:
    """The same files as a stream; the column list is fixed up front."""
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return (spark.readStream.schema(text).option("header", True).option("enforceSchema", True)
            .option("maxFilesPerTrigger", files_per_trigger).csv(path))


def source_kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """One topic from the newest offsets on, lost data tolerated. The connector package
    must be on the class path of the cluster."""
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic).option("startingOffsets", "latest").option("failOnDataLoss", "false"))
    return reader.options(**options).load()


def source_files(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                 files_per_trigger: int = 100, glob: str | None = None) -> DataFrame:
    """A folder of message files as a stream, the stand-in for a topic."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


#: Rows expected below the first threshold of a sample, as a multiple of its size, and at least so many more.
SAMPLE_SLACK, SAMPLE_MORE = 1.2, 200


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), chosen by a seeded hash of a unique key.

    A threshold on the hash leaves a little more than ``n`` rows, spread evenly over all tasks; only these are
    ordered. So no task sends ``n`` rows, and a large sample sorts itself alone.
    """
    tag = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    hashed = df.withColumn("_h", tag)
    place = F.conv(F.substring("_h", 1, 15), 16, 10).cast("bigint")
    share = (SAMPLE_SLACK * n + SAMPLE_MORE) / max(df.count(), 1)
    while share < 1:
        below = hashed.filter(place < int(share * (1 << 60)))
        if below.count() >= n:
            hashed = below
            break
        share *= 2
    if n <= TOP_ROWS:
        return hashed.orderBy("_h", *key).limit(n).drop("_h")
    return with_row_index(hashed, ["_h", *key], "_i").filter(F.col("_i") < n).drop("_h", "_i")


def shuffle_rows(df: DataFrame, key: Sequence[str], seed: int = 42) -> DataFrame:
    """All rows in a seeded random order (a range-partitioned sort on a hash)."""
    tag = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    return df.orderBy(tag, *key)
