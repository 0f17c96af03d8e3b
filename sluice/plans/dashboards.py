"""The dashboard and report queries over the long stream."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sluice import schema as S
from sluice.functions import clean as C
from sluice.operators import tsquery as Q
from sluice.plans.ingest import TAG_SQL, tag_of
from sluice.plans.registry import POINTS, WIDE, points, query, rounded, table, wide
from sluice.session import scratch_path
from sluice.sources.sinks import latest_per_series

# SQL side of a tumbling window: start and end of the bucket.
def bucket(every: str, source: str = "points") -> str:
    return (f"b AS (SELECT *, time_bucket(INTERVAL '{every}', ts) AS start, "
            f"time_bucket(INTERVAL '{every}', ts) + INTERVAL '{every}' AS time FROM {source})")


@query("C12", "range_filter", sql=f"""
WITH {POINTS}
SELECT event_id, ts, value, 'absolute' AS kind FROM points
WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'
UNION ALL
SELECT event_id, ts, value, 'relative' FROM points WHERE ts >= (SELECT max(ts) FROM points) - INTERVAL '24 hours'""")
def range_filter(spark, sf_dir):
    rows = points(spark, sf_dir).select("event_id", "ts", "value")
    fixed = Q.range_filter(rows, datetime(2024, 1, 5, 6), datetime(2024, 1, 12))
    recent = Q.range_filter(rows, timedelta(hours=24), now=Q.latest_time(rows))
    return fixed.withColumn("kind", F.lit("absolute")).unionByName(recent.withColumn("kind", F.lit("relative")))


@query("C13", "field_filter", sql=f"""
WITH {POINTS} SELECT event_id, field, status FROM points WHERE field IN ('click', 'error') AND status = 'Normal'""")
def field_filter(spark, sf_dir):
    return Q.field_filter(points(spark, sf_dir), field=["click", "error"], status="Normal").select(
        "event_id", "field", "status")


@query("C14", "field_regex_filter", sql=f"""
WITH {POINTS} SELECT event_id, field FROM points WHERE regexp_matches(field, 'i.*[kn]')""")
def field_regex_filter(spark, sf_dir):
    return Q.field_regex_filter(points(spark, sf_dir).select("event_id", "field"), "i.*[kn]")


@query("C15", "keep_map", sql=f"""
WITH {POINTS}
SELECT event_id, ts, round(abs(value - 50) / 50 * 100, 6) AS deviation, 1 AS one FROM points""")
def keep_map(spark, sf_dir):
    v = F.col("value")
    return rounded(Q.keep_map(points(spark, sf_dir), ["event_id", "ts"], deviation=F.abs(v - 50) / 50 * 100,
                              one=F.lit(1)))


@query("C16", "log_filter", sql="""
SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' ORDER BY turn DESC""")
def log_filter(spark, sf_dir):
    logs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return Q.log_filter(logs, "turn", role="assistant").select("conv_id", "turn", "text")


@query("D1", "tumble_mean", sql=f"""
WITH {POINTS}, {bucket('1 hour')}
SELECT start, time, field, round(avg(value), 6) AS value FROM b GROUP BY ALL""")
def tumble_mean(spark, sf_dir):
    return rounded(Q.tumble_mean(points(spark, sf_dir), "1 hour"))


@query("D2", "tumble_median", sql=f"""
WITH {POINTS}, {bucket('6 hours')}
SELECT start, time, field, round(quantile_cont(value, 0.5), 6) AS value FROM b GROUP BY ALL""")
def tumble_median(spark, sf_dir):
    return rounded(Q.tumble_median(points(spark, sf_dir), "6 hours"))


@query("D3", "tumble_last", sql=f"""
WITH {POINTS}, {bucket('1 hour')}
SELECT start, time, field, arg_max(value, ts) AS value FROM b GROUP BY ALL""")
def tumble_last(spark, sf_dir):
    return Q.tumble_last(points(spark, sf_dir), "1 hour")


@query("D4", "tumble_count", sql=f"""
WITH {POINTS}, {bucket('1 hour')}
SELECT start, time, status, count(*) AS n FROM b GROUP BY ALL""")
def tumble_count(spark, sf_dir):
    return Q.tumble_count(points(spark, sf_dir), "1 hour", by=["status"])


@query("D5", "tumble_max", sql=f"""
WITH {POINTS}, {bucket('1 hour')}
SELECT start, time, field, max(value) AS value FROM b GROUP BY ALL""")
def tumble_max(spark, sf_dir):
    return Q.tumble_max(points(spark, sf_dir), "1 hour")


@query("D6", "status_counts", sql=f"""
WITH {POINTS}
SELECT status, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM points), 6) AS pct FROM points GROUP BY 1""")
def status_counts(spark, sf_dir):
    return rounded(Q.status_counts(points(spark, sf_dir)))


@query("D7", "attack_pct", sql=f"""
WITH {POINTS}
SELECT count_if(status = 'Attack')::BIGINT AS attacks, count(*) AS total,
       round(count_if(status = 'Attack') * 100.0 / count(*), 6) AS pct FROM points""")
def attack_pct(spark, sf_dir):
    return rounded(Q.attack_pct(points(spark, sf_dir)))


@query("D8", "attack_timeline", sql=f"""
WITH {POINTS}
SELECT min(ts) AS first_attack, max(ts) AS last_attack, count(*) AS n,
       round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS duration_seconds FROM points WHERE status = 'Attack'""")
def attack_timeline(spark, sf_dir):
    return rounded(Q.attack_timeline(points(spark, sf_dir)))


@query("D9", "top_sensors", sql=f"""
WITH {POINTS}
SELECT concat('S', entity) AS field, count(*) AS n FROM points WHERE status = 'Attack'
GROUP BY 1 ORDER BY n DESC, field LIMIT 10""")
def top_sensors(spark, sf_dir):
    tagged = points(spark, sf_dir).select("status", F.concat(F.lit("S"), F.col("entity")).alias("field"))
    return Q.top_sensors(tagged)


@query("D10", "on_count_hourly", sql=f"""
WITH {POINTS}, s AS (SELECT ts, entity, CASE WHEN value > 50 THEN 1 ELSE 0 END AS value FROM points), {bucket('1 hour', 's')}
SELECT start, time, entity, count(*) AS n FROM b WHERE value = 1 GROUP BY ALL""")
def on_count_hourly(spark, sf_dir):
    states = points(spark, sf_dir).select("ts", "entity", F.when(F.col("value") > 50, 1).otherwise(0).alias("value"))
    return Q.on_count(states, "1 hour", by=["entity"])


@query("D11", "query_summary", sql=f"""
WITH {POINTS}, t AS (SELECT count(*) n, min(ts) lo, max(ts) hi, count(DISTINCT entity) f FROM points)
SELECT 'total' AS part, NULL::VARCHAR AS name, n, lo AS first_time, hi AS last_time, f AS n_fields, NULL::DOUBLE AS pct FROM t
UNION ALL SELECT * FROM (SELECT 'field', CAST(entity AS VARCHAR) AS name, count(*) AS n, NULL, NULL, NULL, NULL FROM points
  GROUP BY 2 ORDER BY n DESC, name LIMIT 10)
UNION ALL SELECT 'status', status, count(*), NULL, NULL, NULL, round(count(*) * 100.0 / (SELECT n FROM t), 6)
  FROM points GROUP BY status""")
def query_summary(spark, sf_dir):
    rows = points(spark, sf_dir).select("ts", "status", F.col("entity").cast("string").alias("field"))
    totals, top, spread = Q.query_summary(rows)
    frames = [totals.withColumn("part", F.lit("total")),
              top.withColumnRenamed("field", "name").withColumn("part", F.lit("field")),
              spread.withColumnRenamed("status", "name").withColumn("part", F.lit("status"))]
    out = frames[0].unionByName(frames[1], True).unionByName(frames[2], True)
    return rounded(out.select("part", "name", "n", "first_time", "last_time", "n_fields", "pct"))


@query("D11", "distinct_rollup", sql=f"""
WITH {POINTS}, b AS (SELECT *, time_bucket(INTERVAL '1 day', ts) AS start FROM points)
SELECT start, start + INTERVAL '1 day' AS time, field, count(DISTINCT entity) AS n_distinct FROM b GROUP BY start, field""")
def distinct_rollup(spark, sf_dir):
    """Entities per day and field, rolled up from stored hourly sketches."""
    path = scratch_path(spark, "sketches")
    Q.distinct_sketches(points(spark, sf_dir), "1 hour", ["field"], "entity").write.parquet(path)
    return Q.distinct_rollup(spark.read.parquet(path), "1 day", ["field"])


@query("D12", "measurement_catalog", sql=f"""
WITH {POINTS} SELECT field AS measurement, status, count(*) AS n FROM points GROUP BY ALL""")
def measurement_catalog(spark, sf_dir):
    return Q.measurement_catalog(points(spark, sf_dir).withColumnRenamed("field", "measurement"), ["measurement", "status"])


@query("D13", "tag_values", sql=f"""WITH {POINTS} SELECT DISTINCT {TAG_SQL} AS tag FROM points""")
def tag_values(spark, sf_dir):
    return Q.tag_values(points(spark, sf_dir).select(tag_of().alias("tag")), "tag")


@query("D14", "event_rate", sql=f"""
WITH {POINTS}
SELECT count(*) AS n, round(count(*) / 43200.0, 6) AS rate FROM points
WHERE ts >= (SELECT max(ts) FROM points) - INTERVAL '43200 seconds'""")
def event_rate(spark, sf_dir):
    rows = points(spark, sf_dir)
    return rounded(Q.event_rate(rows, Q.latest_time(rows), 43_200))


@query("D15", "throughput_10s", sql=f"""
WITH {POINTS}, {bucket('10 seconds')}
SELECT start, time, count(*) AS n, round(count(*) / 10.0, 6) AS rate FROM b GROUP BY ALL""")
def throughput_10s(spark, sf_dir):
    return rounded(Q.throughput(points(spark, sf_dir), 10))


@query("D16", "latency_histogram", sql=f"""
WITH {POINTS}, v AS (SELECT field, value / 20 AS value FROM points),
le AS (SELECT unnest(['0.1', '0.5', '1', '2', '5', '10', '+Inf']) AS le,
              unnest([0.1, 0.5, 1, 2, 5, 10, 1e300]) AS bound)
SELECT field, le, count_if(value <= bound)::BIGINT AS cumulative, round(sum(value), 6) AS total, count(*) AS n
FROM v, le GROUP BY field, le""")
def latency_histogram(spark, sf_dir):
    seconds = points(spark, sf_dir).select("field", (F.col("value") / 20).alias("value"))
    return rounded(Q.histogram(seconds, "value", S.LATENCY_BUCKETS, by=["field"]))


@query("D17", "label_counters", sql=f"""
WITH {WIDE}, c AS (SELECT count(*) AS messages, count_if(label = 'Attack') AS attacks,
  count_if(label = 'Attack' AND linenumber = 1) AS typed, count_if(label = 'Attack' AND linenumber <> 1) AS untyped,
  count_if(quantity * 20 < 300 OR quantity * 20 > 1000) AS outlier, count_if(discount * 50 > 2.5) AS spike FROM wide)
SELECT unnest(['messages', 'attack_rows', 'attack_type:first', 'attack_type:unknown', 'outlier:LIT101', 'spike:FIT101']) AS counter,
       unnest([messages, attacks, typed, untyped, outlier, spike])::BIGINT AS n FROM c""")
def label_counters(spark, sf_dir):
    rows = wide(spark, sf_dir)
    kind = F.coalesce(F.when(F.col("linenumber") == 1, "first"), F.lit("unknown"))
    attack = C.is_attack(F.col("label"))
    return Q.counters(rows, {
        "messages": F.lit(True), "attack_rows": attack,
        "attack_type:first": attack & (kind == "first"), "attack_type:unknown": attack & (kind == "unknown"),
        "outlier:LIT101": C.outside(F.col("quantity") * 20, S.LEVEL_LOW, S.LEVEL_HIGH),
        "spike:FIT101": C.spike(F.col("discount") * 50, S.FLOW_SPIKE),
    })


@query("D18", "latest_gauges", sql=f"""
WITH {POINTS}, t AS (SELECT {TAG_SQL} AS tag, ts, value FROM points)
SELECT tag, arg_max(value, ts) AS value, max(ts) AS ts FROM t GROUP BY tag
UNION ALL SELECT 'current_row_attack', arg_max(CASE WHEN status = 'Attack' THEN 1.0 ELSE 0.0 END, ts), max(ts) FROM points""")
def latest_gauges(spark, sf_dir):
    rows = points(spark, sf_dir)
    gauges = latest_per_series(rows.select(tag_of().alias("tag"), "ts", "value"), ["tag"])
    flag = rows.select(F.lit("current_row_attack").alias("tag"), "ts",
                       C.attack_flag(F.col("status")).cast("double").alias("value"))
    return gauges.unionByName(latest_per_series(flag, ["tag"]))


@query("D19", "null_profile", sql="""
SELECT unnest(['l_quantity', 'l_extendedprice', 'l_returnflag', 'mostly_null']) AS feature,
       unnest([count_if(l_quantity IS NULL), count_if(l_extendedprice IS NULL), count_if(l_returnflag IS NULL),
               count_if(l_linenumber <> 1)])::BIGINT AS nulls FROM lineitem""")
def null_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_returnflag",
        F.when(F.col("l_linenumber") == 1, F.col("l_tax")).alias("mostly_null"))
    return Q.null_profile(rows)


@query("D20", "stage_anomaly_counts", sql=f"""
WITH {POINTS}, t AS (SELECT ts, {TAG_SQL} AS tag, value > 150 AS hit FROM points), {bucket('1 day', 't')}
SELECT start, time, concat('P', regexp_extract(tag, '(\\d)\\d{{2}}$', 1)) AS stage, sum(CASE WHEN hit THEN 1 ELSE 0 END)::BIGINT AS anomalies
FROM b GROUP BY ALL""")
def stage_anomaly_counts(spark, sf_dir):
    rows = points(spark, sf_dir).select("ts", tag_of().alias("tag"), (F.col("value") > 150).cast("int").alias("is_anomaly"))
    return Q.stage_anomaly_counts(rows, "1 day")


@query("D20", "sensor_anomaly_totals", sql=f"""
WITH {POINTS}, t AS (SELECT {TAG_SQL} AS tag, value > 150 AS hit FROM points)
SELECT tag, concat('P', regexp_extract(tag, '(\\d)\\d{{2}}$', 1)) AS stage, count_if(hit)::BIGINT AS anomalies FROM t GROUP BY ALL""")
def sensor_anomaly_totals(spark, sf_dir):
    rows = points(spark, sf_dir).select(tag_of().alias("tag"), (F.col("value") > 150).cast("int").alias("is_anomaly"))
    return Q.anomaly_totals(rows)


@query("D21", "mean_by_field", sql=f"""
WITH {POINTS}
SELECT field, round(avg(value), 6) AS value FROM points
WHERE ts >= (SELECT max(ts) FROM points) - INTERVAL '1 day' GROUP BY 1""")
def mean_by_field(spark, sf_dir):
    rows = points(spark, sf_dir)
    return rounded(Q.mean_by_field(Q.range_filter(rows, timedelta(days=1), now=Q.latest_time(rows))))


@query("E7", "tail_sequence", sql=f"""
WITH {POINTS}
SELECT entity, event_id, ts, value FROM points QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC) <= 10""")
def tail_sequence(spark, sf_dir):
    return Q.tail_sequence(points(spark, sf_dir).select("entity", "event_id", "ts", "value"), ["entity"], ["ts", "event_id"])


@query("E9", "limit_per_series", sql=f"""
WITH {POINTS}
SELECT entity, field, event_id, ts, value FROM points QUALIFY row_number() OVER (PARTITION BY entity, field ORDER BY ts, event_id) <= 5""")
def limit_per_series(spark, sf_dir):
    return Q.limit_per_series(points(spark, sf_dir).select("entity", "field", "event_id", "ts", "value"),
                              ["entity", "field"], [F.asc("ts"), F.asc("event_id")], 5)


@query("F9", "pivot_fields", sql=f"""
WITH {POINTS}
SELECT ts, any_value(value) FILTER (field = 'click') AS click, any_value(value) FILTER (field = 'error') AS error,
       any_value(value) FILTER (field = 'view') AS "view", any_value(value) FILTER (field = 'signup') AS signup,
       any_value(value) FILTER (field = 'purchase') AS purchase FROM points GROUP BY ts""")
def pivot_fields(spark, sf_dir):
    return Q.pivot_fields(points(spark, sf_dir), ["click", "error", "view", "signup", "purchase"])


@query("F10", "sort_limit", sql=f"""
WITH {POINTS} SELECT event_id, ts, value FROM points ORDER BY value DESC, event_id DESC LIMIT 100""")
def sort_limit(spark, sf_dir):
    return Q.sort_limit(points(spark, sf_dir).select("event_id", "ts", "value"), ["value", "event_id"], 100)


@query("F11", "widening_range", sql=f"""
WITH {POINTS}, f AS (SELECT * FROM points WHERE field = 'purchase' AND value > 200),
n AS (SELECT max(ts) AS now FROM points), r AS (SELECT event_id, ts, value, CASE
  WHEN ts >= now - INTERVAL '1 hour' THEN 0 WHEN ts >= now - INTERVAL '24 hours' THEN 1
  WHEN ts >= now - INTERVAL '7 days' THEN 2 ELSE 3 END AS span FROM f, n)
SELECT event_id, ts, value, (SELECT min(span) FROM r)::INTEGER AS span FROM r WHERE span <= (SELECT min(span) FROM r)""")
def widening_range(spark, sf_dir):
    rows = points(spark, sf_dir)
    rare = rows.filter((F.col("field") == "purchase") & (F.col("value") > 200)).select("event_id", "ts", "value")
    spans = [timedelta(hours=1), timedelta(hours=24), timedelta(days=7)]
    span, found = Q.widening_range(rare, Q.latest_time(rows), spans)
    return found.withColumn("span", F.lit(span))
