"""Trend forecasts and their errors."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice import schema as S
from sluice.operators import tsquery as Q
from sluice.operators.series import over_series


def forecast(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value",
             rows: int = S.FORECAST_ROWS, steps: int = S.FORECAST_STEPS, least: int = 1) -> DataFrame:
    """(keys, step, forecast): least-squares trend through the last ``rows`` values of each
    series, drawn ``steps`` ahead. A single value is carried on flat; a series of fewer than
    ``least`` rows has no forecast."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    recent = df.select(*keys, F.col(value).alias("_y"), F.row_number().over(w).alias("_r")).filter(F.col("_r") <= rows)
    x = (1 - F.col("_r")).cast("double")
    trend = recent.groupBy(*keys).agg(F.regr_slope("_y", x).alias("_slope"), F.avg("_y").alias("_mean"), F.avg(x).alias("_x"),
                                      F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    step = F.explode(F.sequence(F.lit(1), F.lit(steps)))
    ahead = F.col("_mean") + F.coalesce("_slope", F.lit(0.0)) * (F.col("step") - F.col("_x"))
    return trend.withColumn("step", step).select(*keys, "step", ahead.alias("forecast"))


def forecast_backtest(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value",
                      rows: int = S.FORECAST_ROWS, steps: int = S.FORECAST_STEPS, **sizing) -> DataFrame:
    """The same forecast from every row with ``rows`` values behind it, beside the value
    that came ``steps`` later: (input columns, step, forecast, actual, error)."""

    def compute(frame, w):
        span = w.rowsBetween(-(rows - 1), 0)
        place = frame.withColumn("_x", F.row_number().over(w).cast("double"))
        fitted = place.withColumn("_slope", F.regr_slope(F.col(value), F.col("_x")).over(span)) \
            .withColumn("_mean", F.avg(value).over(span)).withColumn("_n", F.count(value).over(span)) \
            .withColumn("_ahead", F.array(*[F.lead(value, s).over(w) for s in range(1, steps + 1)]))
        out = fitted.filter(F.col("_n") == rows).select("*", F.posexplode("_ahead").alias("_p", "actual"))
        step = F.col("_p") + 1
        line = F.col("_mean") + F.col("_slope") * (step + (rows - 1) / 2)
        return out.filter(F.col("actual").isNotNull()).withColumn("step", step).withColumn("forecast", line).drop(
            "_x", "_slope", "_mean", "_n", "_ahead", "_p")

    out = over_series(df, keys, order, compute, before=rows - 1, after=steps, **sizing)
    return out.withColumn("error", F.abs(F.col("actual") - F.col("forecast")))


def forecast_mae(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return pairs.groupBy(*by).agg(F.avg(F.abs(F.col("actual") - F.col("forecast"))).alias("mae"))


def forecast_error(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("error", F.col("actual") - F.col("forecast"))


def error_distribution(errors: DataFrame, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Signed errors counted in bins of ``width``; ``bin`` is the lower edge."""
    return errors.groupBy(*by, (F.floor(F.col("error") / width) * width).cast("double").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def deviation_pct() -> Column:
    """Percent deviation from the forecast; null where the forecast is 0."""
    return F.abs(F.try_divide(F.col("actual") - F.col("forecast"), F.col("forecast")) * 100.0)


def forecast_deviation(pairs: DataFrame, alert_above: float = 10.0) -> DataFrame:
    out = pairs.withColumn("deviation", deviation_pct())
    return out.withColumn("alert", F.coalesce(F.col("deviation") > alert_above, F.lit(False)))


def deviation_table(deviations: DataFrame, above: float = 15.0) -> DataFrame:
    return deviations.filter(F.col("deviation") > above).orderBy(F.desc("deviation"))


def error_by_step(errors: DataFrame, by: Sequence[str] = ("step",)) -> DataFrame:
    return errors.groupBy(*by).agg(F.avg("error").alias("mae"))


def error_ranking(errors: DataFrame, by: Sequence[str] = ("field",), step: str = "step") -> DataFrame:
    """(step, by, mae, n, rank): per step the groups from the largest mean error down; ties by
    name. Only the aggregate is ranked."""
    means = errors.groupBy(step, *by).agg(F.avg("error").alias("mae"), F.count("error").alias("n"))
    return means.withColumn("rank", F.row_number().over(Window.partitionBy(step).orderBy(F.desc_nulls_last("mae"), *by)))


def error_by_step_window(errors: DataFrame, every: str, by: Sequence[str] = ("step",), ts: str = "ts") -> DataFrame:
    return Q.tumble(errors, every, by, F.avg("error").alias("mae"), ts=ts)


def alert_count(alerts: DataFrame, now: datetime, span: timedelta = timedelta(hours=24), ts: str = "ts") -> DataFrame:
    return Q.range_filter(alerts.filter("alert"), span, now=now, ts=ts).agg(F.count(F.lit(1)).alias("alerts"))


def ops_metrics(metrics: DataFrame, now: datetime, mean_of: Sequence[str], count_of: Sequence[str],
                rate_of: Sequence[str], ts: str = "ts") -> DataFrame:
    """(metric, kind, value): means and counts of the last hour and rates per second of the
    last five minutes, in one pass over the last hour."""
    names = {*mean_of, *count_of, *rate_of}
    recent = Q.range_filter(metrics.filter(F.col("metric").isin(sorted(names))), timedelta(hours=1), now=now, ts=ts)
    edge = F.lit((now - timedelta(seconds=300)).strftime("%Y-%m-%d %H:%M:%S.%f")).cast(metrics.schema[ts].dataType)
    one = recent.groupBy("metric").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).cast("double").alias("count"),
                                       (F.count_if(F.col(ts) >= edge) / 300.0).alias("rate"))
    long = one.unpivot(["metric"], ["mean", "count", "rate"], "kind", "value")
    m, k = F.col("metric"), F.col("kind")
    return long.filter(((k == "mean") & m.isin(list(mean_of))) | ((k == "count") & m.isin(list(count_of)))
                       | ((k == "rate") & m.isin(list(rate_of))))
