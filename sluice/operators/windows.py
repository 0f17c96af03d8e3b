"""Rolling features, sequences and splits over ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice import schema as S
from sluice.functions.clean import present
from sluice.operators.series import (
    SERIES_ROWS, join_on, largest_series, over_series, series_position, small_side)

EPSILON = 1e-8
#: Stretches of time a frame of ``moving_aggregate`` is cut into; divides a second of microseconds.
FRAME_PARTS = 64
_OWN, _BACK, _INNER = 0, 1, 2


def rolling_features(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
                     window: int = S.SEQUENCE_LENGTH, **sizing) -> DataFrame:
    """Per column: last, mean, population deviation, min, max, slope and z-score of the
    last value over ``window`` rows. Statistics need all ``window`` values present (NaN is none); the
    z-score is null on a constant window. Rows before the first full window are dropped."""

    def compute(frame, ordered):
        span = ordered.rowsBetween(-(window - 1), 0)
        out = []
        for c in columns:
            x = present(F.col(c).cast("double"))
            full = F.count(x).over(span) == window
            mean = F.when(full, F.avg(x).over(span))
            low, high = F.when(full, F.min(x).over(span)), F.when(full, F.max(x).over(span))
            # Equal extremes are an exact test for a constant window; the summed squares may
            # leave a last-bit remainder there.
            std = F.when(low == high, 0.0).otherwise(F.when(full, F.stddev_pop(x).over(span)))
            out += [x.alias(f"{c}__last"), mean.alias(f"{c}__mean"), std.alias(f"{c}__std"), low.alias(f"{c}__min"),
                    high.alias(f"{c}__max"), (x - F.lag(x).over(ordered)).alias(f"{c}__slope")]
        filled = F.count(F.lit(1)).over(span)
        kept = [c for c in frame.columns if c not in columns]
        wide = frame.select(*kept, *out, filled.alias("_filled")).filter(F.col("_filled") == window).drop("_filled")
        return wide.select("*", *[
            F.when(F.col(f"{c}__std") != 0, (F.col(f"{c}__last") - F.col(f"{c}__mean")) / (F.col(f"{c}__std") + EPSILON))
            .alias(f"{c}__zlast") for c in columns
        ])

    return over_series(df, keys, order, compute, before=window - 1, **sizing)


def proxy_score(df: DataFrame, out: str = "anomaly_score_proxy") -> DataFrame:
    """Sum of absolute last-value z-scores, nulls skipped."""
    z = [c for c in df.columns if c.endswith("__zlast")]
    total = sum((F.coalesce(F.abs(F.col(c)), F.lit(0.0)) for c in z), F.lit(0.0))
    return df.withColumn(out, total)


def slope(df, keys, order, value="value", out="slope", **sizing):
    return over_series(df, keys, order, lambda f, w: f.withColumn(out, F.col(value) - F.lag(value).over(w)),
                       before=1, **sizing)


def derivative(df: DataFrame, keys: Sequence[str], order: Sequence[str], unit_seconds: float = 1.0,
               ts: str = "ts", value: str = "value", **sizing) -> DataFrame:
    """Signed change per unit of time, and its absolute value; each series' first row is left out."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))

    def compute(frame, w):
        gap = (micros - F.lag(micros).over(w)) / 1e6
        change = F.col(value) - F.lag(value).over(w)
        out = frame.withColumn("derivative", F.try_divide(change * unit_seconds, gap))
        out = out.withColumn("_n", F.count(F.lit(1)).over(w.rowsBetween(-1, 0))).filter(F.col("_n") == 2).drop("_n")
        return out.withColumn("abs_change", F.abs("derivative"))

    return over_series(df, keys, order, compute, before=1, **sizing)


def sequence_windows(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
                     length: int = S.SEQUENCE_LENGTH, **sizing) -> DataFrame:
    """Every stride-1 window as ``sequence array<array<double>>``. Costs ``length`` times
    the input; only for models that need the whole window."""

    def compute(frame, w):
        span = w.rowsBetween(-(length - 1), 0)
        step = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
        out = frame.withColumn("sequence", F.collect_list(step).over(span))
        return out.filter(F.size("sequence") == length)

    return over_series(df, keys, order, compute, before=length - 1, **sizing)


def last_step(df: DataFrame, keys: Sequence[str], order: Sequence[str], length: int = S.SEQUENCE_LENGTH,
              **sizing) -> DataFrame:
    """The rows that end a full window: no arrays needed."""

    def compute(frame, w):
        filled = F.count(F.lit(1)).over(w.rowsBetween(-(length - 1), 0))
        return frame.withColumn("_n", filled).filter(F.col("_n") == length).drop("_n")

    return over_series(df, keys, order, compute, before=length - 1, **sizing)


def row_rate(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = 10, ts: str = "ts", **sizing):
    """(n - 1) / (newest - oldest) over the last ``rows`` rows; null for one row."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))

    def compute(frame, w):
        span = w.rowsBetween(-(rows - 1), 0)
        seconds = (F.max(micros).over(span) - F.min(micros).over(span)) / 1e6
        n = F.count(F.lit(1)).over(span)
        return frame.withColumn("rate", F.when(n >= 2, F.try_divide((n - 1).cast("double"), seconds)))

    return over_series(df, keys, order, compute, before=rows - 1, **sizing)


def time_split(df: DataFrame, keys: Sequence[str], order: Sequence[str], train: float = 0.7,
               max_rows: int = SERIES_ROWS) -> DataFrame:
    """Chronological split inside each series; the held-out part is rounded up."""
    placed = series_position(df, keys, order, "_pos", max_rows=max_rows)
    if keys and largest_series(df, keys) <= max_rows:
        placed = placed.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    elif keys:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        placed = join_on(placed, small_side(sizes), keys)
    else:
        placed = placed.withColumn("_n", F.lit(df.count()))
    held = F.ceil(F.col("_n") * F.lit(1 - train).cast("decimal(6,4)"))
    part = F.when(F.col("_pos") <= F.col("_n") - held, "train").otherwise("validation")
    return placed.withColumn("part", part).drop("_pos", "_n")


def moving_aggregate(df: DataFrame, keys: Sequence[str], seconds: int, ts: str = "ts", value: str = "value",
                     out: str = "rolling_mean", block_seconds: int | None = None) -> DataFrame:
    """Mean over the last ``seconds`` of each series, both ends included; null for a row
    without a time. NaN is a missing reading.

    A frame is cut into ``FRAME_PARTS`` fixed stretches of time: the end of its oldest one, the whole
    ones between, and the beginning of its newest one. All three are sums of their own readings
    and nothing is ever subtracted, so a huge reading leaves no trace in frames that do not
    hold it. The cost does not grow with the rows in a frame. A long or busy series is spread
    over as many tasks as it has stretches; whole stretches are added up in blocks of
    ``block_seconds``; rows without a time are not shuffled at all.
    """
    span = seconds * 1_000_000
    part = span // FRAME_PARTS
    block = part * max((block_seconds or 64 * seconds) * 1_000_000 // part, FRAME_PARTS)
    reading = present(F.col(value).cast("double"))
    timed = df.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    rows = timed.filter("_at IS NOT NULL").withColumn("_part", F.col("_at") - F.pmod("_at", F.lit(part)))

    whole = rows.groupBy(*keys, "_part").agg(F.sum(reading).alias("_s"), F.count(reading).alias("_c"))
    home = lambda at: at - F.pmod(at, F.lit(block))
    reach = F.sequence(home(F.col("_part")), home(F.col("_part") + (span - part)), F.lit(block))
    between = Window.partitionBy("_block", *keys).orderBy("_part").rangeBetween(part - span, -part)
    inner = (whole.withColumn("_block", F.explode(reach))
             .withColumn("_s", F.sum("_s").over(between)).withColumn("_c", F.sum("_c").over(between))
             .filter(F.col("_block") == home(F.col("_part")))
             .select(*keys, "_part", F.col("_part").alias("_k"), F.lit(_INNER).alias("_kind"), "_s", "_c"))

    # A row stands in its own stretch and, one span later, in the stretch whose frames begin at it.
    places = F.explode(F.array(F.lit(_OWN), F.lit(_BACK)))
    later = F.when(F.col("_kind") == _BACK, F.lit(span)).otherwise(F.lit(0))
    both = rows.withColumn("_kind", places).select(
        *keys, *[F.when(F.col("_kind") == _OWN, F.col(c)).alias(c) for c in df.columns if c not in keys],
        (F.col("_part") + later).alias("_part"), (F.col("_at") + later).alias("_k"), "_kind",
        reading.alias("_s"), reading.isNotNull().cast("bigint").alias("_c"))
    cell = Window.partitionBy("_part", *keys)
    upto = cell.orderBy(F.col("_k").asc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    since = cell.orderBy(F.col("_k").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    back = F.col("_kind") == _BACK

    def total(c):
        return F.coalesce(F.sum(F.when(~back, F.col(c))).over(upto), F.lit(0)) + F.coalesce(F.sum(F.when(back, F.col(c))).over(since), F.lit(0))

    summed = both.unionByName(inner, allowMissingColumns=True).withColumn("_sum", total("_s")).withColumn("_n", total("_c"))
    means = summed.filter(F.col("_kind") == _OWN).select(*df.columns, F.try_divide("_sum", "_n").alias(out))
    untimed = timed.filter("_at IS NULL").select(*df.columns, F.lit(None).cast("double").alias(out))
    return means.unionByName(untimed)


def rolling_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str,
                length: int = S.SEQUENCE_LENGTH, **sizing) -> DataFrame:
    """Sum over the last ``length`` rows, full windows only."""

    def compute(frame, w):
        span = w.rowsBetween(-(length - 1), 0)
        summed = frame.withColumn(out, F.sum(value).over(span)).withColumn("_n", F.count(F.lit(1)).over(span))
        return summed.filter(F.col("_n") == length).drop("_n")

    return over_series(df, keys, order, compute, before=length - 1, **sizing)
