"""Anomaly scores, evaluation, forecasts and explanations."""

from __future__ import annotations

from datetime import timedelta

import numpy as np
from pyspark.sql import functions as F

from sluice import schema as S
from sluice.functions import clean as C
from sluice.operators import anomaly as A
from sluice.operators import explain as X
from sluice.operators import forecast as J
from sluice.operators import tsquery as Q
from sluice.operators import windows as W
from sluice.plans.ingest import TAG_SQL, TEXT_CLEAN, tag_of, text_rows
from sluice.plans.registry import POINTS, WIDE, WIDE_FEATURES, WIDE_ORDER, points, query, rounded, wide
from sluice.plans.rolling import HOURLY, actual_and_forecast
from sluice.session import cut_lineage, scratch_path
from sluice.sources.sinks import score_messages

ENTITY = ["entity"]
IDS = ["entity", *WIDE_ORDER]
IDS_SQL = "entity, ts, orderkey, linenumber, partkey"
ORDER_SQL = "ts, orderkey, linenumber, partkey"

# Scaled columns z_<c> from moments of the normal rows; energy per row; rolling sum of 30.
_MOMENTS = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in WIDE_FEATURES)
_SCALED = ", ".join(f"({c} - m_{c}) / s_{c} AS z_{c}" for c in WIDE_FEATURES)
_ENERGY = " + ".join(f"z_{c} * z_{c}" for c in WIDE_FEATURES)
ENERGY = f"""{WIDE}, mo AS (SELECT {_MOMENTS} FROM wide WHERE label = 'Normal'),
z AS (SELECT {IDS_SQL}, label, {_SCALED} FROM wide, mo),
sc AS (SELECT {IDS_SQL}, label, sum({_ENERGY}) OVER f AS anomaly_score, count(*) OVER f AS n FROM z
  WINDOW f AS (PARTITION BY entity ORDER BY {ORDER_SQL} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
score AS (SELECT {IDS_SQL}, label, anomaly_score, time_bucket(INTERVAL '1 year', ts) AS grp FROM sc WHERE n = 30)"""


def normal_of(rows):
    return rows.filter(F.col("label") == S.NORMAL)


def energy(spark, sf_dir, k=0):
    rows = wide(spark, sf_dir)
    model = A.fit_reconstruction(normal_of(rows), WIDE_FEATURES, k)
    return A.reconstruction_score(rows, model, ENTITY, WIDE_ORDER)


def thresholded(spark, sf_dir):
    """Scores are stored once, then read for the thresholds and for the flags."""
    stored = cut_lineage(energy(spark, sf_dir).select(*IDS, "label", "anomaly_score"))
    yearly = stored.withColumn("grp", F.date_trunc("year", "ts").cast("timestamp_ntz"))
    return A.percentile_threshold(yearly, ["grp"])


@query("I1", "reconstruction_score")
def reconstruction_score(spark, sf_dir):
    """Two leading directions; the smaller the residual, the more normal the window."""
    return rounded(energy(spark, sf_dir, k=2).select(*IDS, "anomaly_score"))


# Two scaled columns have their leading direction at half the angle of (spread difference, twice the covariance).
PAIR = ["quantity", "price"]
PAIR_SCORE = f"""
WITH {WIDE}, mo AS (SELECT avg(quantity) AS mq, stddev_pop(quantity) AS sq, avg(price) AS mp, stddev_pop(price) AS sp FROM wide WHERE label = 'Normal'),
z AS (SELECT {IDS_SQL}, label, (quantity - mq) / sq AS zq, (price - mp) / sp AS zp FROM wide, mo),
an AS (SELECT 0.5 * atan2(2 * covar_pop(zq, zp), var_pop(zq) - var_pop(zp)) AS t FROM z WHERE label = 'Normal'),
sc AS (SELECT {IDS_SQL}, sum((zq * sin(t) - zp * cos(t)) * (zq * sin(t) - zp * cos(t))) OVER f AS anomaly_score, count(*) OVER f AS n FROM z, an
  WINDOW f AS (PARTITION BY entity ORDER BY {ORDER_SQL} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT {IDS_SQL}, round(anomaly_score, 6) AS anomaly_score FROM sc WHERE n = 30"""


@query("I1", "reconstruction_pair", sql=PAIR_SCORE)
def reconstruction_pair(spark, sf_dir):
    """Two columns and one direction, which SQL can restate."""
    rows = wide(spark, sf_dir)
    model = A.fit_reconstruction(normal_of(rows), PAIR, 1)
    return rounded(A.reconstruction_score(rows, model, ENTITY, WIDE_ORDER).select(*IDS, "anomaly_score"))


@query("I2", "energy_score", sql=f"WITH {ENERGY} SELECT {IDS_SQL}, round(anomaly_score, 6) AS anomaly_score FROM score")
def energy_score(spark, sf_dir):
    return rounded(energy(spark, sf_dir).select(*IDS, "anomaly_score"))


THRESHOLD = f"""{ENERGY}, th AS (SELECT grp, quantile_cont(anomaly_score, 0.9) AS threshold FROM score GROUP BY grp),
fl AS (SELECT score.*, threshold, CASE WHEN anomaly_score > threshold THEN 1 ELSE 0 END AS is_anomaly FROM score JOIN th USING (grp))"""


@query("I3", "percentile_threshold", sql=f"""
WITH {THRESHOLD} SELECT {IDS_SQL}, grp, round(anomaly_score, 6) AS anomaly_score, round(threshold, 6) AS threshold, is_anomaly FROM fl""")
def percentile_threshold(spark, sf_dir):
    flagged = thresholded(spark, sf_dir)
    return rounded(flagged.select(*IDS, "grp", "anomaly_score", "threshold", "is_anomaly"))


@query("D22", "score_batch_summary", sql=f"""
WITH {THRESHOLD}, l AS (SELECT grp, arg_max(anomaly_score, (ts, orderkey, linenumber, partkey, entity)) AS last_score, max(threshold) AS threshold,
  max(is_anomaly) AS any_anomaly, sum(is_anomaly)::BIGINT AS anomalies, count(*) AS scores FROM fl GROUP BY grp)
SELECT grp, round(last_score, 6) AS last_score, round(threshold, 6) AS threshold, any_anomaly, anomalies, scores,
  round(least(greatest(CASE WHEN threshold > 0 THEN last_score / threshold ELSE last_score END, 0), 1), 6) AS normalised_score FROM l""")
def score_batch_summary(spark, sf_dir):
    flagged = thresholded(spark, sf_dir)
    return rounded(A.score_batch_summary(flagged, ["grp"], [*WIDE_ORDER, "entity"]))


def judged(spark, sf_dir):
    flagged = thresholded(spark, sf_dir)
    return flagged.select((F.col("label") == S.ATTACK).cast("int").alias("truth"), "is_anomaly")


@query("I5", "f1_eval", sql=f"""
WITH {THRESHOLD}, c AS (SELECT count_if(label = 'Attack' AND is_anomaly = 1)::BIGINT AS tp, count_if(label <> 'Attack' AND is_anomaly = 1)::BIGINT AS fp,
  count_if(label = 'Attack' AND is_anomaly = 0)::BIGINT AS fn FROM fl)
SELECT tp, fp, fn, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def f1_eval(spark, sf_dir):
    return rounded(A.f1_eval(judged(spark, sf_dir), "truth", "is_anomaly"))


@query("I6", "confusion_report", sql=f"""
WITH {THRESHOLD}, p AS (SELECT CASE WHEN label = 'Attack' THEN 1 ELSE 0 END AS y, is_anomaly AS p FROM fl),
k AS (SELECT unnest([0, 1]) AS class), s AS (SELECT class, count_if(y = class AND p = class) AS tp, count_if(p = class) AS said,
  count_if(y = class) AS support FROM p, k GROUP BY class)
SELECT class::INTEGER AS class, round(tp / said, 6) AS precision, round(tp / support, 6) AS recall,
  round(2 * tp / (said + support), 6) AS f1, support::BIGINT AS support FROM s""")
def confusion_report(spark, sf_dir):
    _, classes = A.confusion_report(judged(spark, sf_dir), "truth", "is_anomaly")
    return rounded(classes)


_DISTANCE = f"""{WIDE}, mo AS (SELECT {_MOMENTS} FROM wide WHERE label = 'Normal'),
z AS (SELECT {IDS_SQL}, label, {_SCALED} FROM wide, mo), d AS (SELECT {IDS_SQL}, label, {_ENERGY} AS distance FROM z)"""


@query("I7", "oneclass_boundary", sql=f"""
WITH {_DISTANCE}, e AS (SELECT quantile_cont(distance, 0.99) AS edge FROM d WHERE label = 'Normal')
SELECT {IDS_SQL}, round(distance, 6) AS distance, round(edge, 6) AS boundary, CASE WHEN distance > edge THEN -1 ELSE 1 END AS predicted FROM d, e""")
def oneclass_boundary(spark, sf_dir):
    rows = wide(spark, sf_dir)
    out = A.oneclass_boundary(rows, normal_of(rows), WIDE_FEATURES, 0.01)
    return rounded(out.select(*IDS, "distance", "boundary", "predicted"))


@query("I7", "covariance_boundary", sql=f"""
WITH {WIDE}, mo AS (SELECT avg(quantity) AS mq, avg(price) AS mp, var_pop(quantity) AS qq, var_pop(price) AS pp, covar_pop(quantity, price) AS qp
  FROM wide WHERE label = 'Normal'),
d AS (SELECT {IDS_SQL}, label, (pp * (quantity - mq) * (quantity - mq) - 2 * qp * (quantity - mq) * (price - mp) + qq * (price - mp) * (price - mp))
  / (qq * pp - qp * qp) AS distance FROM wide, mo),
e AS (SELECT quantile_cont(distance, 0.99) AS edge FROM d WHERE label = 'Normal')
SELECT {IDS_SQL}, round(distance, 5) AS distance, round(edge, 5) AS boundary, CASE WHEN distance > edge THEN -1 ELSE 1 END AS predicted FROM d, e""")
def covariance_boundary(spark, sf_dir):
    """Quantity and price move together; the distance takes that into account."""
    rows = wide(spark, sf_dir)
    out = A.covariance_boundary(rows, normal_of(rows), ["quantity", "price"], 0.01)
    return rounded(out.select(*IDS, "distance", "boundary", "predicted"), 5)


@query("I8", "grid_search_f1", sql=f"""
WITH {_DISTANCE}, g AS (SELECT unnest([0.001, 0.005, 0.01, 0.02])::DOUBLE AS nu),
e AS (SELECT nu, (SELECT quantile_cont(distance, [0.999, 0.995, 0.99, 0.98]) FROM d WHERE label = 'Normal') AS q FROM g),
b AS (SELECT nu, CASE nu WHEN 0.001 THEN q[1] WHEN 0.005 THEN q[2] WHEN 0.01 THEN q[3] ELSE q[4] END AS boundary FROM e),
f AS (SELECT nu, boundary, 2.0 * count_if(label = 'Attack' AND distance > boundary)
   / (count_if(label = 'Attack') + count_if(distance > boundary)) AS f1 FROM d, b GROUP BY nu, boundary)
SELECT nu, round(boundary, 6) AS boundary, round(f1, 6) AS f1, nu = (SELECT arg_max(nu, f1) FROM f) AS best FROM f""")
def grid_search_f1(spark, sf_dir):
    rows = wide(spark, sf_dir).withColumn("y", C.normal_sign(F.col("label")))
    return rounded(A.grid_search_f1(rows, rows.filter("y = 1"), WIDE_FEATURES, "y"))


@query("I8", "kernel_grid_f1")
def kernel_grid_f1(spark, sf_dir):
    """Four shares by five kernel widths over all four columns."""
    rows = wide(spark, sf_dir).withColumn("y", C.normal_sign(F.col("label")))
    return A.kernel_grid_f1(rows, rows.filter("y = 1"), WIDE_FEATURES, "y")


@query("I9", "score_with_model", sql=f"""
WITH {POINTS}, s AS (SELECT event_id, entity, list(value) OVER f AS v FROM points
  WINDOW f AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT event_id, entity, round(list_sum(list_transform(v, lambda x: (x - 50) * (x - 50))), 6) AS anomaly_score
FROM s WHERE len(v) = 30""")
def score_with_model(spark, sf_dir):
    """A model that compares each window with the constant 50."""

    def model(batch):
        return [float(np.square(np.stack(list(window)) - 50.0).sum()) for window in batch]

    rows = points(spark, sf_dir).select("entity", "event_id", "ts", "value")
    windows = W.sequence_windows(rows, ENTITY, ["ts", "event_id"], ["value"])
    return rounded(A.score_with_model(windows, model).select("event_id", "entity", "anomaly_score"))


def monthly(rows):
    return rows.withColumn("batch", F.date_format("ts", "yyyy-MM"))


_STATE = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, avg({c}) AS mean, var_pop({c}) * count({c}) AS m2 FROM wide" for c in WIDE_FEATURES)


@query("I10", "model_refresh", sql=f"""
WITH {WIDE}, s AS ({_STATE}) SELECT feature, n, round(mean, 9) AS mean, round(sqrt(m2 / n), 6) AS std, 2 AS version FROM s""")
def model_refresh(spark, sf_dir):
    """A fit on part of the history is stored, then one on all of it; readers see the newest."""
    store = A.ParameterStore(spark, scratch_path(spark, "parameters"))
    rows = wide(spark, sf_dir)
    store.save(A.batch_moments(rows.filter("ts < '1998-01-01'"), WIDE_FEATURES), 1)
    store.save(A.batch_moments(rows, WIDE_FEATURES), 2)
    newest = store.latest().withColumn("version", F.lit(store.latest_version()))
    std = F.sqrt(F.col("m2") / F.col("n")).alias("std")
    return rounded(newest.select("feature", "n", "mean", std, "version"), 6, mean=9)


@query("I11", "incremental_fit", sql=f"""
WITH {WIDE}, s AS ({_STATE}) SELECT feature, n, round(mean, 9) AS mean, round(sqrt(m2 / n), 6) AS std FROM s""")
def incremental_fit(spark, sf_dir):
    """Month by month states merged: equal to one fit over everything."""
    states = A.batch_moments(monthly(wide(spark, sf_dir)), WIDE_FEATURES, ["batch"])
    merged = A.merge_moments(states)
    return rounded(merged.select("feature", "n", "mean", F.sqrt(F.col("m2") / F.col("n")).alias("std")), 6, mean=9)


@query("I12", "clean_stream", sql=f"""
WITH {WIDE}, t AS (SELECT {IDS_SQL}, {TEXT_CLEAN} AS q, price AS p, label FROM wide),
m AS (SELECT avg(q) mq, stddev_samp(q) sq, avg(p) mp, stddev_samp(p) sp FROM t)
SELECT orderkey, linenumber, partkey, entity, coalesce(round((q - mq) / (sq + 1e-8), 6), 0) AS "FIT101",
  round((p - mp) / (sp + 1e-8), 6) AS "LIT101", label AS "Normal_Attack" FROM t, m""")
def clean_stream(spark, sf_dir):
    raw = text_rows(spark, sf_dir).drop("AIT201", "P101", "Timestamp")
    return rounded(A.clean_rows(raw, ["FIT101", "LIT101"], ["Normal_Attack"]))


_ERRORS = " UNION ALL ".join(f"SELECT ts, '{c}' AS sensor, z_{c} * z_{c} AS error FROM z" for c in WIDE_FEATURES)


@query("I14", "sensor_error", sql=f"""
WITH {_DISTANCE}, er AS ({_ERRORS}), b AS (SELECT time_bucket(INTERVAL '1 day', ts) AS start, sensor,
  count_if(error > 2.5)::BIGINT AS anomalies, max(error) AS max_error FROM er GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY anomalies DESC, round(max_error, 6) DESC, sensor)::INTEGER AS rank FROM b)
SELECT start, sensor, anomalies, round(max_error, 6) AS max_error, rank FROM r WHERE rank <= 2""")
def sensor_error(spark, sf_dir):
    rows = wide(spark, sf_dir)
    model = A.fit_reconstruction(normal_of(rows), WIDE_FEATURES)
    errors = rounded(A.sensor_error(rows, model, ["ts"]))
    return A.top_anomalous_sensors(errors, "1 day", 2.5, 2).drop("time")


@query("I14", "sensor_error_histogram", sql=f"""
WITH {_DISTANCE}, er AS ({_ERRORS}), le AS (SELECT unnest(['0.01', '0.05', '0.1', '0.5', '1', '5', '10', '50', '+Inf']) AS le,
  unnest([0.01, 0.05, 0.1, 0.5, 1, 5, 10, 50, 1e300])::DOUBLE AS bound)
SELECT sensor, le, count_if(error <= bound)::BIGINT AS cumulative, round(sum(error), 4) AS total, count(*) AS n FROM er, le GROUP BY sensor, le""")
def sensor_error_histogram(spark, sf_dir):
    rows = wide(spark, sf_dir)
    model = A.fit_reconstruction(normal_of(rows), WIDE_FEATURES)
    return rounded(Q.histogram(A.sensor_error(rows, model, ["ts"]), "error", S.ERROR_BUCKETS, ["sensor"]), 4)


@query("B6", "publish_scores", sql=f"""
WITH {ENERGY} SELECT CAST(entity AS VARCHAR) AS key, entity, orderkey, round(anomaly_score, 6) AS anomaly_score FROM score""")
def publish_scores(spark, sf_dir):
    """Messages written as a topic stand-in, then read back and opened."""
    path = scratch_path(spark, "scores")
    score_messages(energy(spark, sf_dir), ["entity", "ts", "orderkey", "anomaly_score"]).write.parquet(path)
    body = F.from_json("value", "entity bigint, ts string, orderkey bigint, anomaly_score double")
    return rounded(spark.read.parquet(path).select("key", body.alias("b")).select("key", "b.entity", "b.orderkey", "b.anomaly_score"))


# J ------------------------------------------------------------------------------------

@query("J1", "forecast", sql=f"""
WITH {POINTS}, r AS (SELECT entity, field, value AS y, (1 - row_number() OVER (PARTITION BY entity, field ORDER BY ts DESC, event_id DESC))::DOUBLE AS x
  FROM points QUALIFY x > -10), t AS (SELECT entity, field, coalesce(regr_slope(y, x), 0) AS k, avg(y) AS m, avg(x) AS mx FROM r GROUP BY ALL)
SELECT entity, field, step::INTEGER AS step, round(m + k * (step - mx), 6) AS forecast FROM t, range(1, 11) AS s(step)""")
def forecast(spark, sf_dir):
    return rounded(J.forecast(points(spark, sf_dir), ["entity", "field"], ["ts", "event_id"]))


_LEADS = ", ".join(f"lead(value, {s}) OVER o" for s in range(1, 11))
BACKTEST = f"""{POINTS}, p AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, event_id)::DOUBLE AS x FROM points),
f AS (SELECT entity, event_id, ts, regr_slope(value, x) OVER w AS k, avg(value) OVER w AS m, count(*) OVER w AS n, [{_LEADS}] AS ahead
  FROM p WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
                o AS (PARTITION BY entity ORDER BY ts, event_id)),
bt AS (SELECT entity, event_id, ts, step::INTEGER AS step, ahead[step] AS actual, m + k * (step + 4.5) AS forecast,
  abs(ahead[step] - (m + k * (step + 4.5))) AS error FROM f, range(1, 11) AS s(step) WHERE n = 10 AND ahead[step] IS NOT NULL)"""


def backtest(spark, sf_dir):
    rows = points(spark, sf_dir).select("entity", "event_id", "ts", "field", "value")
    return J.forecast_backtest(rows, ENTITY, ["ts", "event_id"])


@query("J2", "forecast_backtest", sql=f"""
WITH {BACKTEST} SELECT event_id, step, actual, round(forecast, 6) AS forecast, round(error, 6) AS error FROM bt""")
def forecast_backtest(spark, sf_dir):
    return rounded(backtest(spark, sf_dir).select("event_id", "step", "actual", "forecast", "error"))


PAIRS = f"{HOURLY}, pr AS (SELECT ts, field, actual, forecast FROM a JOIN f USING (ts, field))"


def pairs(spark, sf_dir):
    actual, guess = actual_and_forecast(spark, sf_dir)
    return Q.join_exact(actual, guess, ["ts", "field"])


@query("J3", "forecast_mae", sql=f"""
WITH {PAIRS} SELECT field, round(avg(abs(actual - forecast)), 6) AS mae FROM pr GROUP BY field""")
def forecast_mae(spark, sf_dir):
    return rounded(J.forecast_mae(pairs(spark, sf_dir), ["field"]))


@query("J4", "forecast_error", sql=f"""
WITH {PAIRS} SELECT field, (floor((actual - forecast) / 5) * 5)::DOUBLE AS bin, count(*) AS n FROM pr GROUP BY ALL""")
def forecast_error(spark, sf_dir):
    return J.error_distribution(J.forecast_error(pairs(spark, sf_dir)), 5.0, ["field"])


@query("J5", "forecast_deviation", sql=f"""
WITH {PAIRS}, d AS (SELECT ts, field, CASE WHEN forecast <> 0 THEN abs((actual - forecast) / forecast * 100) END AS deviation FROM pr)
SELECT ts, field, round(deviation, 6) AS deviation, coalesce(deviation > 10, FALSE) AS alert FROM d WHERE deviation > 15""")
def forecast_deviation(spark, sf_dir):
    return rounded(J.deviation_table(J.forecast_deviation(pairs(spark, sf_dir))).select("ts", "field", "deviation", "alert"))


@query("J6", "error_by_step", sql=f"""
WITH {BACKTEST} SELECT 'all' AS part, NULL::TIMESTAMP AS start, step, round(avg(error), 6) AS mae FROM bt GROUP BY step
UNION ALL SELECT 'window', time_bucket(INTERVAL '1 day', ts), step, round(avg(error), 6) FROM bt GROUP BY 2, 3""")
def error_by_step(spark, sf_dir):
    errors = backtest(spark, sf_dir)
    whole = J.error_by_step(errors).withColumn("part", F.lit("all"))
    daily = J.error_by_step_window(errors, "1 day").drop("time").withColumn("part", F.lit("window"))
    return rounded(whole.unionByName(daily, allowMissingColumns=True).select("part", "start", "step", "mae"))


FIELD_BACKTEST = BACKTEST.replace("PARTITION BY entity ", "PARTITION BY entity, field ").replace("SELECT entity, event_id", "SELECT entity, field, event_id")


@query("J6", "error_by_field", sql=f"""
WITH {FIELD_BACKTEST}, m AS (SELECT step, field, avg(error) AS mae, count(*) AS n FROM bt GROUP BY ALL)
SELECT step, field, round(mae, 6) AS mae, n, row_number() OVER (PARTITION BY step ORDER BY mae DESC, field)::INTEGER AS rank FROM m""")
def error_by_field(spark, sf_dir):
    """Each field of a device is forecast by its own trend; per step the worst field comes first."""
    rows = points(spark, sf_dir).select("entity", "event_id", "ts", "field", "value")
    errors = J.forecast_backtest(rows, ["entity", "field"], ["ts", "event_id"])
    return rounded(J.error_ranking(errors))


@query("J7", "alert_count", sql=f"""
WITH {PAIRS} SELECT count(*) AS alerts FROM pr WHERE abs((actual - forecast) / forecast * 100) > 10
  AND ts >= (SELECT max(ts) FROM pr) - INTERVAL '24 hours'""")
def alert_count(spark, sf_dir):
    flagged = J.forecast_deviation(pairs(spark, sf_dir))
    return J.alert_count(flagged, Q.latest_time(flagged))


@query("J8", "ops_metrics", sql=f"""
WITH m AS (SELECT event_type AS metric, value, TIMESTAMP '2024-01-01' + to_microseconds((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 100) AS ts FROM events),
n AS (SELECT max(ts) AS now FROM m), r AS (SELECT metric, avg(value) AS mean, count(*) AS c, count_if(ts >= now - INTERVAL '300 seconds') AS k
  FROM m, n WHERE ts >= now - INTERVAL '1 hour' GROUP BY metric)
SELECT metric, 'mean' AS kind, round(mean, 6) AS value FROM r WHERE metric IN ('view', 'click')
UNION ALL SELECT metric, 'count', c::DOUBLE FROM r WHERE metric IN ('error', 'signup')
UNION ALL SELECT metric, 'rate', round(k / 300, 6) FROM r WHERE metric IN ('click', 'purchase')""")
def ops_metrics(spark, sf_dir):
    """The event stream played a hundred times faster as service metrics."""
    start = 1_704_067_200_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    fast = F.timestamp_micros(F.lit(start) + F.floor((at - start) / 100)).cast("timestamp_ntz")
    metrics = points(spark, sf_dir).select(F.col("field").alias("metric"), "value", fast.alias("ts"))
    return rounded(J.ops_metrics(metrics, Q.latest_time(metrics), ["view", "click"], ["error", "signup"], ["click", "purchase"]))


# K ------------------------------------------------------------------------------------

COLUMNS = WIDE_FEATURES
_PART = ", ".join(f"avg({c}) OVER l AS m_{c}, stddev_samp({c}) OVER l AS d_{c}" for c in COLUMNS)
_Z = ", ".join(f"({c} - m_{c}) / (d_{c} + 1e-8) AS {c}" for c in COLUMNS)
_SQUARES = " + ".join(f"{c} * {c}" for c in COLUMNS)
SURROGATE = f"""{WIDE}, st AS (SELECT *, {_PART} FROM wide WINDOW l AS (PARTITION BY label)),
zz AS (SELECT {IDS_SQL}, label, {_Z} FROM st),
ss AS (SELECT *, sum({_SQUARES}) OVER f AS lstm_score, count(*) OVER f AS n FROM zz
  WINDOW f AS (PARTITION BY label, entity ORDER BY {ORDER_SQL} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
su AS (SELECT {IDS_SQL}, {', '.join(COLUMNS)}, lstm_score, CASE WHEN label = 'Attack' THEN 1 ELSE 0 END AS label FROM ss WHERE n = 30)"""


def surrogate(spark, sf_dir):
    rows = wide(spark, sf_dir)
    attack = rows.filter(F.col("label") == S.ATTACK)
    return X.surrogate_dataset(normal_of(rows).drop("label"), attack.drop("label"), ENTITY, WIDE_ORDER, COLUMNS)


@query("K1", "surrogate_dataset", sql=f"""
WITH {SURROGATE} SELECT {IDS_SQL}, {', '.join(f'round({c}, 6) AS {c}' for c in COLUMNS)}, round(lstm_score, 6) AS lstm_score, label FROM su""")
def surrogate_dataset(spark, sf_dir):
    return rounded(surrogate(spark, sf_dir).select(*IDS, *COLUMNS, "lstm_score", "label"))


@query("K2", "surrogate_fit")
def surrogate_fit(spark, sf_dir):
    """Held-out error of both tree surrogates, with the operator's trees and depth."""
    data = stored_surrogate(spark, sf_dir)
    split, rows = X.surrogate_split(data, COLUMNS, IDS), []
    for kind in ("forest", "boosted"):
        _, quality = X.surrogate_fit(data, COLUMNS, IDS, kind=kind, split=split)
        rows.append((kind, quality["rmse"], quality["r2"]))
    return spark.createDataFrame(rows, "kind string, rmse double, r2 double")


def _solved(rows: str, target: str) -> str:
    """SQL for the least squares of ``target`` on ``COLUMNS``: centred second moments, then elimination of one
    column after another."""
    names = [*COLUMNS, target]
    n = len(COLUMNS)
    means = ", ".join(f"avg({c}) AS mean_{i}" for i, c in enumerate(names))
    cells = ", ".join(f"sum(({names[i]} - mean_{i}) * ({names[j]} - mean_{j})) AS a0_{i}_{j}" for i in range(n) for j in range(n + 1))
    steps = [f"mm AS (SELECT {means} FROM {rows})", f"e0 AS (SELECT {cells} FROM {rows}, mm)"]
    for k in range(n):
        out = ", ".join((f"a{k}_{k}_{j} / a{k}_{k}_{k}" if i == k else f"a{k}_{i}_{j} - a{k}_{i}_{k} * a{k}_{k}_{j} / a{k}_{k}_{k}")
                        + f" AS a{k + 1}_{i}_{j}" for i in range(n) for j in range(n + 1))
        steps.append(f"e{k + 1} AS (SELECT {out} FROM e{k})")
    weights = ", ".join(f"a{n}_{i}_{n} AS w_{i}" for i in range(n))
    constant = f"mean_{n} - " + " - ".join(f"a{n}_{i}_{n} * mean_{i}" for i in range(n))
    steps.append(f"fit AS (SELECT {weights}, {constant} AS intercept, {', '.join(f'mean_{i}' for i in range(n))} FROM e{n}, mm)")
    return ", ".join(steps)


FITTED = f"{SURROGATE}, {_solved('su', 'lstm_score')}"


@query("K3", "linear_surrogate", sql=f"WITH {FITTED} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(w_{i}, 5) AS weight, round(intercept, 5) AS intercept FROM fit" for i, c in enumerate(COLUMNS)))
def linear_surrogate(spark, sf_dir):
    fit = X.linear_surrogate(stored_surrogate(spark, sf_dir), COLUMNS)
    out = spark.createDataFrame([(c, w, fit.intercept) for c, w in zip(COLUMNS, fit.weights)], "feature string, weight double, intercept double")
    return rounded(out, 5)


PHI = f"{FITTED}, phi AS (" + " UNION ALL ".join(
    f"SELECT {IDS_SQL}, label, '{c}' AS feature, ({c} - mean_{i}) * w_{i} AS phi FROM su, fit" for i, c in enumerate(COLUMNS)) + ")"


def stored_surrogate(spark, sf_dir):
    """The data set as a written table: fitting and explaining read it several times."""
    return cut_lineage(surrogate(spark, sf_dir))


def attributed(spark, sf_dir):
    """Contributions of all four columns by the weights fitted to the scores."""
    data = stored_surrogate(spark, sf_dir)
    return X.linear_surrogate(data, COLUMNS).attribution(data, [*IDS, "label"])


@query("K4", "attribution", sql=f"WITH {PHI} SELECT {IDS_SQL}, feature, round(phi, 4) AS phi FROM phi")
def attribution(spark, sf_dir):
    return rounded(attributed(spark, sf_dir).select(*IDS, "feature", "phi"), 4)


@query("K4", "forest_attribution")
def forest_attribution(spark, sf_dir):
    """Exact contributions along the paths of a forest, for every row."""
    data = stored_surrogate(spark, sf_dir)
    model, _ = X.surrogate_fit(data, COLUMNS, IDS)
    return rounded(X.tree_attribution(model, data, IDS, COLUMNS))


@query("K5", "mean_abs_importance", sql=f"""
WITH {PHI}, i AS (SELECT feature, avg(abs(phi)) AS importance FROM phi GROUP BY feature)
SELECT feature, round(importance, 5) AS importance, round(importance / (SELECT max(importance) FROM i), 5) AS normalised FROM i""")
def mean_abs_importance(spark, sf_dir):
    return rounded(X.mean_abs_importance(attributed(spark, sf_dir)), 5)


_LAST = f"""{PHI}, la AS (SELECT entity, feature, arg_max(phi, ({ORDER_SQL}, label)) AS phi FROM phi GROUP BY ALL),
sc AS (SELECT *, phi / max(abs(phi)) OVER (PARTITION BY entity) AS scaled FROM la),
tk AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY abs(scaled) DESC, feature)::INTEGER AS rank FROM sc)"""


@query("K6", "topk_last", sql=f"""
WITH {_LAST} SELECT entity, feature, round(phi, 4) AS phi, round(scaled, 5) AS scaled, rank FROM tk WHERE rank <= 3""")
def topk_last(spark, sf_dir):
    return rounded(X.topk_last(attributed(spark, sf_dir), ENTITY, [*WIDE_ORDER, "label"], 3), 5, phi=4)


@query("K7", "publish_importance", sql=f"""
WITH {_LAST}, i AS (SELECT feature, avg(abs(phi)) AS importance FROM phi GROUP BY feature)
SELECT 'explain_shap_mean_abs' AS metric, feature, NULL::VARCHAR AS rank, round(importance / (SELECT max(importance) FROM i), 4) AS value FROM i
UNION ALL SELECT 'explain_topk_features', feature, CAST(rank AS VARCHAR), round(scaled, 4) FROM tk WHERE rank <= 3
UNION ALL SELECT 'inference_anomaly_score', NULL, NULL, round(arg_max(lstm_score, ({ORDER_SQL}, entity, label)), 4) FROM su""")
def publish_importance(spark, sf_dir):
    phi = attributed(spark, sf_dir)
    top = X.topk_last(phi, ENTITY, [*WIDE_ORDER, "label"], 3)
    newest = surrogate(spark, sf_dir).agg(F.max_by("lstm_score", F.struct(*WIDE_ORDER, "entity", "label")).alias("anomaly_score"))
    rows = X.publish_importance(X.mean_abs_importance(phi), top, newest, 0)
    return rounded(rows.select("metric", F.col("labels")["feature"].alias("feature"), F.col("labels")["rank"].alias("rank"), "value"), 4)


@query("K9", "local_examples", sql=f"""
WITH {PHI} SELECT label, feature, round(arg_min(phi, ({ORDER_SQL}, entity)), 4) AS phi FROM phi GROUP BY ALL""")
def local_examples(spark, sf_dir):
    return rounded(X.local_examples(attributed(spark, sf_dir), "label", [*WIDE_ORDER, "entity"]), 4)
