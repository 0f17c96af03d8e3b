"""Window, sequence, join and reshape queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import joins as J
from sluice.operators import tsquery as Q
from sluice.operators import windows as W
from sluice.plans.ingest import TAG_SQL, tag_of
from sluice.plans.registry import POINTS, WIDE, WIDE_ORDER, points, query, rounded, table, wide
from sluice.functions.clean import stage_of
from sluice.sources.readers import shuffle_rows

ENTITY = ["entity"]
POINT_ORDER = ["ts", "event_id"]
WIN = "PARTITION BY entity ORDER BY ts, event_id"


def _feature_sql(c: str, n: int) -> str:
    full = f"count({c}) OVER f = {n}"
    return f"""{c} AS {c}__last, CASE WHEN {full} THEN avg({c}) OVER f END AS {c}__mean,
      CASE WHEN {full} THEN stddev_pop({c}) OVER f END AS {c}__std, CASE WHEN {full} THEN min({c}) OVER f END AS {c}__min,
      CASE WHEN {full} THEN max({c}) OVER f END AS {c}__max, {c} - lag({c}) OVER o AS {c}__slope"""


def features_sql(columns, n, source="src", order="ts, event_id", keep="entity, event_id, ts"):
    cols = ", ".join(_feature_sql(c, n) for c in columns)
    z = ", ".join(f"CASE WHEN {c}__min <> {c}__max THEN ({c}__last - {c}__mean) / ({c}__std + 1e-8) END AS {c}__zlast"
                  for c in columns)
    return f"""feats AS (SELECT *, {z} FROM (
      SELECT {keep}, {cols}, count(*) OVER f AS filled FROM {source}
      WINDOW f AS (PARTITION BY entity ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW),
             o AS (PARTITION BY entity ORDER BY {order})) WHERE filled = {n})"""


def rounded_sql(columns, digits=6):
    parts = ["last", "mean", "std", "min", "max", "slope", "zlast"]
    return ", ".join(f"round({c}__{p}, {digits}) AS {c}__{p}" for c in columns for p in parts)


def gappy(spark, sf_dir):
    """The long stream with a null in one of ten event numbers and a flat second column."""
    return points(spark, sf_dir).select(
        "entity", "event_id", "ts", F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("a"),
        F.floor(F.col("value") / 100).cast("double").alias("b"))


GAPPY = f"""{POINTS}, src AS (SELECT entity, event_id, ts, CASE WHEN event_id % 97 <> 0 THEN value END AS a,
  CAST(floor(value / 100) AS DOUBLE) AS b FROM points)"""


@query("E1", "rolling_features", sql=f"""
WITH {GAPPY}, {features_sql(['a', 'b'], 3)}
SELECT entity, event_id, ts, {rounded_sql(['a', 'b'])} FROM feats""")
def rolling_features(spark, sf_dir):
    return rounded(W.rolling_features(gappy(spark, sf_dir), ENTITY, POINT_ORDER, ["a", "b"], 3))


@query("E2", "proxy_score", sql=f"""
WITH {GAPPY}, {features_sql(['a', 'b'], 30)}
SELECT entity, event_id, ts, round(coalesce(abs(a__zlast), 0) + coalesce(abs(b__zlast), 0), 6) AS anomaly_score_proxy FROM feats""")
def proxy_score(spark, sf_dir):
    feats = W.rolling_features(gappy(spark, sf_dir), ENTITY, POINT_ORDER, ["a", "b"], 30)
    return rounded(W.proxy_score(feats).select("entity", "event_id", "ts", "anomaly_score_proxy"))


@query("E3", "slope", sql=f"""
WITH {POINTS} SELECT event_id, round(value - lag(value) OVER ({WIN}), 6) AS slope FROM points""")
def slope(spark, sf_dir):
    return rounded(W.slope(points(spark, sf_dir), ENTITY, POINT_ORDER).select("event_id", "slope"))


@query("E4", "derivative", sql=f"""
WITH {POINTS}, d AS (SELECT event_id, (value - lag(value) OVER ({WIN})) * 3600
  / ((epoch_us(ts) - lag(epoch_us(ts)) OVER ({WIN})) / 1e6) AS d, lag(ts) OVER ({WIN}) AS p FROM points)
SELECT event_id, round(d, 6) AS derivative, round(abs(d), 6) AS abs_change FROM d WHERE p IS NOT NULL""")
def derivative(spark, sf_dir):
    out = W.derivative(points(spark, sf_dir), ENTITY, POINT_ORDER, unit_seconds=3600)
    return rounded(out.select("event_id", "derivative", "abs_change"))


@query("E5", "sequence_windows", sql=f"""
WITH {POINTS}, s AS (SELECT event_id, entity, list(value) OVER f AS v, list(epoch_us(ts)) OVER f AS t, count(*) OVER f AS n
  FROM points WINDOW f AS ({WIN} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT event_id, entity, n::INTEGER AS length, v[1] AS first_value, v[30] AS last_value, round(list_sum(v), 6) AS total
FROM s WHERE n = 30""")
def sequence_windows(spark, sf_dir):
    rows = points(spark, sf_dir).select("entity", "event_id", "ts", "value")
    seqs = W.sequence_windows(rows, ENTITY, POINT_ORDER, ["value"])
    s = F.col("sequence")
    return rounded(seqs.select("event_id", "entity", F.size(s).alias("length"), s[0][0].alias("first_value"),
                               s[29][0].alias("last_value"),
                               F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x[0]).alias("total")))


@query("E6", "last_step", sql=f"""
WITH {WIDE}
SELECT entity, orderkey, linenumber, partkey, quantity, price FROM wide
QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ts, orderkey, linenumber, partkey) >= 30""")
def last_step(spark, sf_dir):
    return W.last_step(wide(spark, sf_dir), ENTITY, WIDE_ORDER).select(
        "entity", "orderkey", "linenumber", "partkey", "quantity", "price")


@query("E8", "row_rate", sql=f"""
WITH {POINTS}, r AS (SELECT event_id, count(*) OVER f AS n, (max(epoch_us(ts)) OVER f - min(epoch_us(ts)) OVER f) / 1e6 AS s
  FROM points WINDOW f AS ({WIN} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT event_id, round(CASE WHEN n >= 2 THEN (n - 1) / s END, 9) AS rate FROM r""")
def row_rate(spark, sf_dir):
    return rounded(W.row_rate(points(spark, sf_dir), ENTITY, POINT_ORDER).select("event_id", "rate"), 9)


@query("E10", "time_split", sql=f"""
WITH {POINTS}, p AS (SELECT event_id, row_number() OVER ({WIN}) AS pos, count(*) OVER (PARTITION BY entity) AS n FROM points)
SELECT event_id, CASE WHEN pos <= n - ceil(n * 0.3) THEN 'train' ELSE 'validation' END AS part FROM p""")
def time_split(spark, sf_dir):
    return W.time_split(points(spark, sf_dir), ENTITY, POINT_ORDER).select("event_id", "part")


@query("E11", "moving_aggregate", sql=f"""
WITH {POINTS}
SELECT event_id, entity, ts, round(avg(value) OVER (PARTITION BY entity ORDER BY ts
  RANGE BETWEEN INTERVAL '2 days' PRECEDING AND CURRENT ROW), 6) AS rolling_mean FROM points""")
def moving_aggregate(spark, sf_dir):
    out = W.moving_aggregate(points(spark, sf_dir), ENTITY, 2 * 86_400)
    return rounded(out.select("event_id", "entity", "ts", "rolling_mean"))


# The forecast side: the hourly mean of a field, against each reading of that hour.
HOURLY = f"""{POINTS}, a AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS ts, field, max(value) AS actual FROM points GROUP BY ALL),
f AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS ts, field, round(avg(value), 6) AS forecast FROM points
      WHERE status = 'Normal' GROUP BY ALL)"""


def actual_and_forecast(spark, sf_dir):
    rows = points(spark, sf_dir)
    actual = Q.tumble_max(rows, "1 hour").select(F.col("start").alias("ts"), "field", F.col("value").alias("actual"))
    normal = rows.filter(F.col("status") == "Normal")
    forecast = Q.tumble_mean(normal, "1 hour").select(
        F.col("start").alias("ts"), "field", F.round("value", 6).alias("forecast"))
    return actual, forecast


@query("F1", "join_time_field", sql=f"WITH {HOURLY} SELECT ts, field, actual, forecast FROM a JOIN f USING (ts, field)")
def join_time_field(spark, sf_dir):
    actual, forecast = actual_and_forecast(spark, sf_dir)
    return Q.join_exact(actual, forecast, ["ts", "field"])


@query("F2", "join_time", sql=f"""
WITH {HOURLY} SELECT a.ts, actual, forecast FROM a JOIN f ON a.ts = f.ts AND a.field = 'click' AND f.field = 'click'""")
def join_time(spark, sf_dir):
    actual, forecast = actual_and_forecast(spark, sf_dir)
    one = [Q.field_filter(x, field="click").drop("field") for x in (actual, forecast)]
    return Q.join_exact(*one, ["ts"])


@query("F3", "followup_join", sql=f"""
WITH {POINTS}, l AS (SELECT * FROM points WHERE value < 10), r AS (SELECT * FROM points WHERE value > 100)
SELECT l.event_id, l.entity, l.ts, min(r.ts) AS followup_ts, arg_min(r.value, r.ts) AS followup_value
FROM l JOIN r ON l.entity = r.entity AND r.ts > l.ts AND r.ts <= l.ts + INTERVAL '1 day' GROUP BY ALL""")
def followup_join(spark, sf_dir):
    rows = points(spark, sf_dir).select("event_id", "entity", "ts", "value")
    out = J.followup_join(rows.filter("value < 10"), rows.filter("value > 100"), ENTITY, 86_400, tie="event_id")
    return out.select("event_id", "entity", "ts", "followup_ts", "followup_value")


@query("F4", "positional_align", sql=f"""
WITH {POINTS}, l AS (SELECT entity, event_id, value, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC) AS from_end
  FROM points WHERE field <> 'view'),
r AS (SELECT entity, event_id AS score_id, value AS score, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC) AS from_end
  FROM points WHERE field <> 'click')
SELECT entity, from_end, event_id, value, score_id, score FROM l JOIN r USING (entity, from_end)""")
def positional_align(spark, sf_dir):
    rows = points(spark, sf_dir)
    feats = rows.filter("field <> 'view'").select("entity", "event_id", "ts", "value")
    scores = rows.filter("field <> 'click'").select(
        "entity", F.col("event_id").alias("score_id"), F.col("ts").alias("score_ts"), F.col("value").alias("score"))
    out = J.positional_align(feats, scores, ENTITY, ["ts", "event_id"], ["score_ts", "score_id"])
    return out.select("entity", "from_end", "event_id", "value", "score_id", "score")


_PIVOT = ", ".join(f"arg_max(value, ts) FILTER (stage = 'P{k}') AS P{k}" for k in range(1, 7))


@query("F5", "offset_align", sql=f"""
WITH {POINTS}, s AS (SELECT ts, value, 1 + entity % 6 AS k, concat('P', 1 + entity % 6) AS stage FROM points),
o AS (SELECT *, time_bucket(INTERVAL '1 hour', ts + to_minutes(5 * (k - 1))) AS start FROM s)
SELECT start, {_PIVOT} FROM o GROUP BY start""")
def offset_align(spark, sf_dir):
    rows = points(spark, sf_dir).select("ts", "value", stage_of(tag_of()).alias("stage"))
    return J.offset_align(rows, "1 hour")


@query("F6", "asof_latest", sql=f"""
WITH {POINTS}, l AS (SELECT * FROM points WHERE field = 'purchase'), r AS (SELECT * FROM points WHERE field = 'error')
SELECT l.event_id, l.entity, l.ts, r.value AS latest FROM l ASOF LEFT JOIN r ON l.entity = r.entity AND l.ts >= r.ts""")
def asof_latest(spark, sf_dir):
    rows = points(spark, sf_dir).select("event_id", "entity", "ts", "field", "value")
    out = J.asof_latest(rows.filter("field = 'purchase'"), rows.filter("field = 'error'"), ENTITY, "ts", "value",
                        "latest", tie="event_id")
    return out.select("event_id", "entity", "ts", "latest")


@query("F7", "union_rows", sql="""
SELECT l_orderkey AS id, l_linenumber AS line, l_quantity AS amount, NULL::VARCHAR AS priority FROM lineitem WHERE l_returnflag <> 'R'
UNION ALL SELECT o_orderkey, NULL, o_totalprice, o_orderpriority FROM orders""")
def union_rows(spark, sf_dir):
    normal = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("amount"))
    other = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("priority"))
    return J.union_rows(normal, other)


@query("F8", "shuffle_rows", sql="""
SELECT event_id, value FROM events ORDER BY md5(concat(event_id, '|', 42)), event_id""")
def shuffled(spark, sf_dir):
    return shuffle_rows(table(spark, sf_dir, "events").select("event_id", "value"), ["event_id"], 42)
