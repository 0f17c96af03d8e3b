"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.session import scratch_path

MAX_ROUNDS = 60


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, no lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands its neighbours (the larger ones, or the smaller ones and itself) to its
    least neighbour. Only minima are aggregated; no list of neighbours is built."""
    both = edges.select("u", "v")
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = both.join(least, "u")
    if large:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the least node reachable, for every node of ``edges (u, v)``.

    Each round is stored; rounds end when the table no longer changes (a star per component).
    """
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "cc")
    before = None
    for _ in range(MAX_ROUNDS):
        seen = now.agg(F.count(F.lit(1)), mark).first()
        if seen == before or not seen[0]:
            break
        before = seen
        now = stored(_stars(_stars(now, True), False), "cc")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
