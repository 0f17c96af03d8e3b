"""Bounded samples by a threshold on a hash, so that no task sends more than its share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

SLACK, SMALLEST = 1.3, 64


def least_hashed(rows: DataFrame, n: int, key: str, value: str) -> list[Row]:
    """``key, value`` of the ``n`` keys with the least hash (all, if fewer); a key of several rows counts once,
    with its least value.

    The number of keys tells the threshold below which a few more than ``n`` hashes are expected; only these rows are
    grouped and sent. Should they be too few, the threshold is doubled.
    """
    hashed = rows.select(F.shiftrightunsigned(F.xxhash64(key), 1).alias("_hash"), F.col(key).alias("_key"), F.col(value).alias("_value"))
    keys = hashed.agg(F.approx_count_distinct("_hash")).first()[0]
    share = (SLACK * n + SMALLEST) / max(keys, 1)
    while True:
        below = hashed if share >= 1 else hashed.filter(F.col("_hash") < int(share * (1 << 63)))
        found = below.groupBy("_hash", "_key").agg(F.min("_value").alias("_value")).collect()
        if len(found) >= n or share >= 1:
            chosen = sorted(found, key=lambda r: (r["_hash"], str(r["_key"])))[:n]
            return [Row(**{key: r["_key"], value: r["_value"]}) if key != value else Row(**{key: r["_key"]}) for r in chosen]
        share *= 2
