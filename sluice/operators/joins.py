"""Temporal joins without pair explosions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import schema as S
from sluice.operators.series import SERIES_ROWS, carry_last, series_position

BOTH = "_side"


def _stacked(left: DataFrame, right: DataFrame, keys, ts, order, payload: Column, first_side: int) -> DataFrame:
    """Both sides in one frame; ``_pay`` is filled on right rows only. ``first_side`` tells
    which side comes first at equal times (1 = right first)."""
    lrow = left.withColumn("_row", F.struct(*left.columns))
    lefts = lrow.select(*keys, F.col(ts).alias("_t"), F.col(order).alias("_o") if order else F.lit(0).alias("_o"),
                        F.lit(1 - first_side).alias(BOTH), "_row")
    rights = right.select(*keys, F.col(ts).alias("_t"), F.col(order).alias("_o") if order else F.lit(0).alias("_o"),
                          F.lit(first_side).alias(BOTH), payload.alias("_pay"))
    return lefts.unionByName(rights, allowMissingColumns=True)


def asof_latest(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, value: str, out: str,
                tie: str | None = None, max_rows: int = SERIES_ROWS, **sizing) -> DataFrame:
    """Each left row with the right side's latest ``value`` at or before it (null if none)."""
    both = _stacked(left, right, keys, ts, tie, F.struct(F.col(ts).alias("t"), F.col(value).alias("v")), 0)
    # Right rows sort before left rows of the same time (side 0 against 1).
    filled = carry_last(both, keys, ["_t", BOTH, "_o"], "_pay", "_hit", max_rows=max_rows, **sizing)
    return filled.filter(F.col("_row").isNotNull()).select("_row.*", F.col("_hit.v").alias(out))


def followup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], seconds: int, ts: str = "ts",
                  value: str = "value", tie: str | None = None, max_rows: int = SERIES_ROWS, **sizing) -> DataFrame:
    """First right row in (t, t + ``seconds``] for each left row that has one.

    The right side is filtered to qualifying rows beforehand. One backward fill finds the
    first follower of every row, so no pairs are formed however dense a series is.
    """
    both = _stacked(left, right, keys, ts, tie, F.struct(F.col(ts).alias("t"), F.col(value).alias("v")), 0)
    # Walking back in time, a left row must not see right rows of its own time: those
    # (side 0) come after it (side 1) in descending order.
    filled = carry_last(both, keys, ["_t", BOTH, "_o"], "_pay", "_hit", descending=True, max_rows=max_rows, **sizing)
    near = (F.unix_micros(F.col("_hit.t").cast("timestamp")) - F.unix_micros(F.col("_t").cast("timestamp"))
            <= seconds * 1_000_000)
    hits = filled.filter(F.col("_row").isNotNull() & F.col("_hit").isNotNull() & near)
    return hits.select("_row.*", F.col("_hit.t").alias("followup_ts"), F.col("_hit.v").alias("followup_value"))


def positional_align(features: DataFrame, scores: DataFrame, keys: Sequence[str], feature_order: Sequence[str],
                     score_order: Sequence[str], **sizing) -> DataFrame:
    """The last n rows of both sides zipped from the end, n the shorter length."""
    left = series_position(features, keys, feature_order, "from_end", descending=True, **sizing)
    right = series_position(scores, keys, score_order, "from_end", descending=True, **sizing)
    return left.join(right, [*keys, "from_end"])


def offset_align(df: DataFrame, every: str, value: str = "value", stage: str = "stage", ts: str = "ts",
                 offsets: dict[str, int] | None = None) -> DataFrame:
    """Stages shifted by their lag in minutes and lined up on one time axis: latest value
    per stage and window. The shift is a literal per stage, so no join is needed."""
    offsets = S.STAGE_OFFSETS if offsets is None else offsets
    lagged = F.when(F.lit(False), F.col(ts))
    for name, minutes in offsets.items():
        lagged = lagged.when(F.col(stage) == name, F.col(ts) + F.expr(f"INTERVAL '{minutes}' MINUTE"))
    shifted = df.withColumn("_at", lagged.otherwise(F.col(ts)))
    keyed = shifted.groupBy(F.window("_at", every).alias("w"))
    latest = [F.max_by(F.when(F.col(stage) == s, F.col(value)), F.when(F.col(stage) == s, F.col(ts))).alias(s)
              for s in offsets]
    return keyed.agg(*latest).select(F.col("w.start").alias("start"), *offsets)


def union_rows(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; absent columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
