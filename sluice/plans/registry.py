"""Where the runnable queries and their SQL counterparts are listed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SURVEY_IDS: dict[str, str] = {}


def query(survey_id: str, name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(use_utc(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        SURVEY_IDS[name] = survey_id
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a long stream of sensor points."""
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").alias("entity"), F.col("event_type").alias("field"), "value",
        F.when(F.col("event_type") == "error", "Attack").otherwise("Normal").alias("status"),
    )


POINTS = """points AS (
  SELECT event_id, ts, user_id AS entity, event_type AS field, value,
         CASE WHEN event_type = 'error' THEN 'Attack' ELSE 'Normal' END AS status
  FROM events)"""

WIDE_ORDER = ["ts", "orderkey", "linenumber", "partkey"]
WIDE_FEATURES = ["quantity", "price", "discount", "tax"]


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as wide sensor rows; (entity, ts, orderkey, linenumber, partkey) is unique."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("entity"), F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.when(F.col("l_returnflag") == "R", "Attack").otherwise("Normal").alias("label"),
    )


WIDE = """wide AS (
  SELECT l_suppkey AS entity, l_shipdate AS ts, l_orderkey AS orderkey, l_linenumber AS linenumber,
         l_partkey AS partkey, l_quantity AS quantity, l_extendedprice AS price,
         l_discount AS discount, l_tax AS tax,
         CASE WHEN l_returnflag = 'R' THEN 'Attack' ELSE 'Normal' END AS label
  FROM lineitem)"""


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column, so both engines' last float bits agree."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), special.get(f.name, digits)).alias(f.name)
        if f.dataType.typeName() == "double" else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])
