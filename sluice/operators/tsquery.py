"""The time-series query layer: range, filter, windowed aggregates, reports.

Every aggregate is map-side combined before its shuffle, so a crowded (window, field)
group costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.clean import stage_of
from sluice.operators.series import QUANTILE_ROWS, group_quantiles


def latest_time(df: DataFrame, ts: str = "ts") -> datetime:
    """The newest time, a caller's stand-in for *now* on stored data."""
    return df.agg(F.max(ts).alias("m")).first()["m"]


def range_filter(df: DataFrame, start: datetime | timedelta, stop: datetime | None = None,
                 now: datetime | None = None, ts: str = "ts") -> DataFrame:
    """Half-open time range; a ``timedelta`` start counts back from ``now``. Bounds are
    literals, so they reach the scan."""
    begin = now - start if isinstance(start, timedelta) else start
    kept = df.filter(F.col(ts) >= _literal(df, ts, begin))
    return kept if stop is None else kept.filter(F.col(ts) < _literal(df, ts, stop))


def _literal(df: DataFrame, ts: str, value: datetime) -> Column:
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(df.schema[ts].dataType)


def field_filter(df: DataFrame, **wanted) -> DataFrame:
    """Equality, or membership when the wanted value is a list."""
    for name, value in wanted.items():
        df = df.filter(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df


def field_regex_filter(df: DataFrame, pattern: str, field: str = "field") -> DataFrame:
    return df.filter(F.col(field).rlike(pattern))


def keep_map(df: DataFrame, keep: Sequence[str], **computed: Column) -> DataFrame:
    """Columns to keep, then computed ones."""
    return df.select(*keep, *[c.alias(n) for n, c in computed.items()])


def log_filter(logs: DataFrame, ts: str, **labels) -> DataFrame:
    """Log lines of a label selector, newest first."""
    return field_filter(logs, **labels).orderBy(F.col(ts).desc())


def tumble(df: DataFrame, every: str, by: Sequence[str], *aggregates: Column, ts: str = "ts") -> DataFrame:
    """Tumbling windows without empty ones; ``time`` is the window's end, ``start`` its start."""
    grouped = df.groupBy(F.window(ts, every).alias("w"), *by).agg(*aggregates)
    plain = [c for c in grouped.columns if c not in ("w", *by)]
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("time"), *by, *plain)


def tumble_mean(df, every, by=("field",), value="value", ts="ts"):
    return tumble(df, every, by, F.avg(value).alias("value"), ts=ts)


def tumble_max(df, every, by=("field",), value="value", ts="ts"):
    return tumble(df, every, by, F.max(value).alias("value"), ts=ts)


def tumble_count(df, every, by=("field",), ts="ts"):
    return tumble(df, every, by, F.count(F.lit(1)).alias("n"), ts=ts)


def tumble_last(df, every, by=("field",), value="value", ts="ts", tie=None):
    order = F.struct(ts, tie) if tie else F.col(ts)
    return tumble(df, every, by, F.max_by(value, order).alias("value"), ts=ts)


def tumble_median(df: DataFrame, every: str, by: Sequence[str] = ("field",), value: str = "value", ts: str = "ts",
                  approximate: bool = False, max_rows: int = QUANTILE_ROWS) -> DataFrame:
    """Exact by default, whatever the window holds; ``approximate`` uses a fixed-size sketch."""
    if approximate:
        return tumble(df, every, by, F.percentile_approx(value, 0.5, 10_000).alias("value"), ts=ts)
    keyed = df.withColumn("_w", F.window(ts, every)).select(
        F.col("_w.start").alias("start"), F.col("_w.end").alias("time"), *by, value)
    middle = group_quantiles(keyed, ["start", "time", *by], value, [0.5], max_rows)
    return middle.select("start", "time", *by, F.col("quantiles")[0].alias("value"))


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """Rows per status and their share of all rows."""
    counts = df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(whole))


def attack_pct(df: DataFrame, status: str = "status") -> DataFrame:
    hits = F.count_if(F.col(status) == "Attack")
    return df.agg(hits.alias("attacks"), F.count(F.lit(1)).alias("total"),
                  (hits * 100.0 / F.count(F.lit(1))).alias("pct"))


def attack_timeline(df: DataFrame, status: str = "status", ts: str = "ts") -> DataFrame:
    span = df.filter(F.col(status) == "Attack").agg(
        F.min(ts).alias("first_attack"), F.max(ts).alias("last_attack"), F.count(F.lit(1)).alias("n"))
    seconds = (F.unix_micros(F.col("last_attack").cast("timestamp"))
               - F.unix_micros(F.col("first_attack").cast("timestamp"))) / 1e6
    return span.withColumn("duration_seconds", seconds)


def top_sensors(df: DataFrame, n: int = 10, field: str = "field", status: str = "status") -> DataFrame:
    """Fields with the most attack rows; ties by name."""
    counts = df.filter(F.col(status) == "Attack").groupBy(field).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), field).limit(n)


def on_count(df: DataFrame, every: str = "1 hour", by: Sequence[str] = ("field",), value: str = "value") -> DataFrame:
    """Rows in state 1 per window."""
    return tumble_count(df.filter(F.col(value) == 1), every, by)


def query_summary(df: DataFrame, top: int = 10, field: str = "field", status: str = "status", ts: str = "ts"):
    """(totals, most frequent fields, status distribution)."""
    per_field = df.groupBy(field).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    totals = per_field.agg(F.sum("n").alias("n"), F.min("lo").alias("first_time"), F.max("hi").alias("last_time"),
                           F.count(field).alias("n_fields"))
    return totals, per_field.select(field, "n").orderBy(F.desc("n"), field).limit(top), status_counts(df, status)


# Precision of a distinct-count sketch: its relative error is about 1.04 / sqrt(2^16) = 0.4 %.
SKETCH_BITS = 16
_SKETCHED = ("int", "bigint", "string", "binary")


def distinct_sketches(df: DataFrame, every: str, by: Sequence[str], column: str, ts: str = "ts",
                      bits: int = SKETCH_BITS) -> DataFrame:
    """(start, time, by, sketch): one mergeable sketch of the distinct values per window, to be stored. Nulls
    are no values; rows without a time are in no window. A sketch is bounded by 2^bits bytes."""
    kind = dict(df.dtypes)[column]
    value = F.col(column) if kind in _SKETCHED else F.col(column).cast("string")
    return tumble(df, every, by, F.hll_sketch_agg(value, bits).alias("sketch"), ts=ts)


def distinct_rollup(sketches: DataFrame, every: str, by: Sequence[str]) -> DataFrame:
    """(start, time, by, n_distinct) of wider windows from stored sketches, without the rows themselves."""
    return tumble(sketches.drop("time"), every, by, F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"), ts="start")


def measurement_catalog(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def tag_values(df: DataFrame, tag: str) -> DataFrame:
    return df.select(tag).distinct()


def event_rate(df: DataFrame, now: datetime, seconds: int = 300, ts: str = "ts") -> DataFrame:
    """Events per second over the last ``seconds``."""
    recent = range_filter(df, timedelta(seconds=seconds), now=now, ts=ts)
    return recent.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / float(seconds)).alias("rate"))


def throughput(df: DataFrame, seconds: int = 10, by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    counts = tumble_count(df, f"{seconds} seconds", by, ts=ts)
    return counts.withColumn("rate", F.col("n") / float(seconds))


def histogram(df: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Cumulative ``le`` buckets with +Inf, plus sum and count, in one aggregate."""
    names = [*[f"{b:g}" for b in bounds], "+Inf"]
    one = df.groupBy(*by).agg(
        *[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)],
        F.count(value).alias(f"b{len(bounds)}"), F.sum(value).alias("total"), F.count(value).alias("n"))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("le"), F.col(f"b{i}").alias("cumulative"))
                               for i, n in enumerate(names)]))
    return one.withColumn("_r", rows).select(*by, "_r.le", "_r.cumulative", "total", "n")


def counters(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Cumulative rule counters as (counter, n), one pass."""
    names = list(rules)
    one = df.agg(*[F.count_if(rules[k]).alias(f"c{i}") for i, k in enumerate(names)])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("counter"), F.col(f"c{i}").alias("n"))
                               for i, k in enumerate(names)]))
    return one.select(rows.alias("r")).select("r.*")


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or df.columns)
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot([], columns, "feature", "nulls")


def stage_anomaly_counts(df: DataFrame, every: str, tag: str = "tag", flag: str = "is_anomaly", ts: str = "ts"):
    staged = df.withColumn("stage", stage_of(F.col(tag)))
    return tumble(staged, every, ["stage"], F.sum(F.col(flag).cast("bigint")).alias("anomalies"), ts=ts)


def anomaly_totals(df: DataFrame, tag: str = "tag", flag: str = "is_anomaly") -> DataFrame:
    """Cumulative anomalies per sensor and stage."""
    return df.groupBy(tag, stage_of(F.col(tag)).alias("stage")).agg(F.sum(F.col(flag).cast("bigint")).alias("anomalies"))


def mean_by_field(df: DataFrame, field: str = "field", value: str = "value") -> DataFrame:
    return df.groupBy(field).agg(F.avg(value).alias("value"))


def widening_range(df: DataFrame, now: datetime, spans: Sequence[timedelta], ts: str = "ts"):
    """(chosen span number, rows) of the first span holding any row; the last is unbounded.

    One aggregate decides, so wide spans are not rescanned one after another. Rows after
    ``now`` are outside every span.
    """
    known = df.filter(F.col(ts) <= _literal(df, ts, now))
    newest = known.agg(F.max(ts).alias("m")).first()["m"]
    chosen = len(spans)
    if newest is not None:
        chosen = next((i for i, s in enumerate(spans) if newest >= now - s), len(spans))
    if chosen == len(spans):
        return chosen, known
    return chosen, range_filter(known, spans[chosen], now=now, ts=ts)


def pivot_fields(df: DataFrame, fields: Sequence[str], key: Sequence[str] = ("ts",), field: str = "field",
                 value: str = "value") -> DataFrame:
    """Long to wide; the field list is always given, so no distinct pass runs."""
    return df.groupBy(*key).pivot(field, list(fields)).agg(F.first(value, ignorenulls=True))


def sort_limit(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Largest first, top ``n`` (each task keeps only its own top ``n``)."""
    return df.orderBy(*[F.desc(c) for c in by]).limit(n)


def limit_per_series(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of each series. The rank filter prunes every task to ``n`` rows
    per series before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def tail_sequence(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 10) -> DataFrame:
    """Last ``n`` rows of each series."""
    return limit_per_series(df, keys, [F.desc(c) for c in order], n)


def join_exact(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner equi join on time (and field). Adaptive execution broadcasts the right side
    when its measured size is small and splits skewed partitions otherwise."""
    return left.join(right, list(on))
