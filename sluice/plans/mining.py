"""Feature selection and event-pattern queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import patterns as P
from sluice.operators import selection as G
from sluice.plans.registry import POINTS, WIDE, points, query, rounded, wide
from sluice.session import scratch_path
from sluice.sources import sinks as K

# G ------------------------------------------------------------------------------------

FEATURES = ["quantity", "price", "discount", "tax", "net", "charge"]
EXTRA = ["flat", "tiny", "sparse"]

SELECTION = f"""{WIDE}, sel AS (SELECT *, price * (1 - discount) AS net, price * (1 - discount) * (1 + tax) AS charge,
  1.0::DOUBLE AS flat, discount * 0.001 AS tiny, CASE WHEN linenumber = 1 THEN tax END AS sparse FROM wide)"""


def selection_frame(spark, sf_dir):
    """Wide rows with two derived readings, two static columns and a mostly-null one."""
    net = F.col("price") * (1 - F.col("discount"))
    return wide(spark, sf_dir).select(
        "quantity", "price", "discount", "tax", net.alias("net"), (net * (1 + F.col("tax"))).alias("charge"),
        F.lit(1.0).alias("flat"), (F.col("discount") * 0.001).alias("tiny"),
        F.when(F.col("linenumber") == 1, F.col("tax")).alias("sparse"),
        F.col("label").alias("Normal_Attack"), "orderkey", "linenumber", "partkey", "entity")


def _each(columns, expression):
    """One SELECT per column, stacked."""
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {expression.format(c=c)} FROM sel" for c in columns)


_VARIANCES = _each(FEATURES + EXTRA, "var_samp({c}) AS variance, count(DISTINCT {c}) AS unique_values")
_NULLS = _each(FEATURES + EXTRA, "avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS null_share")
_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {i} AS a_pos, {j} AS b_pos, abs(corr({a}, {b})) AS r FROM sel"
    for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if i < j)


@query("G1", "static_features", sql=f"""
WITH {SELECTION}, v AS ({_VARIANCES})
SELECT feature, round(variance, 12) AS variance, unique_values FROM v WHERE variance < 1e-6""")
def static_features(spark, sf_dir):
    return rounded(G.static_features(selection_frame(spark, sf_dir), FEATURES + EXTRA), 12)


@query("G2", "high_null_features", sql=f"""
WITH {SELECTION}, v AS ({_NULLS}) SELECT feature, round(null_share, 6) AS null_share FROM v WHERE null_share > 0.5""")
def high_null_features(spark, sf_dir):
    return rounded(G.high_null_features(selection_frame(spark, sf_dir), FEATURES + EXTRA))


@query("G3", "corr_matrix", sql=f"""
WITH {SELECTION}, p AS ({_PAIRS}) SELECT a, b, a_pos, b_pos, round(r, 6) AS r FROM p""")
def corr_matrix(spark, sf_dir):
    return rounded(G.corr_matrix(selection_frame(spark, sf_dir), FEATURES))


@query("G4", "correlated_features", sql=f"""
WITH {SELECTION}, p AS ({_PAIRS})
SELECT b AS feature, count(*) AS partners, arg_min(a, a_pos) AS first_partner, round(max(r), 6) AS max_r
FROM p WHERE r > 0.98 GROUP BY b""")
def correlated_features(spark, sf_dir):
    return rounded(G.correlated_features(G.corr_matrix(selection_frame(spark, sf_dir), FEATURES)))


@query("G5", "corr_ranking", sql=f"""
WITH {SELECTION}, p AS ({_PAIRS}), m AS (SELECT a AS feature, r FROM p UNION ALL SELECT b, r FROM p
  UNION ALL SELECT unnest({FEATURES}), 1.0)
SELECT feature, round(avg(r), 6) AS mean_r FROM m GROUP BY feature ORDER BY mean_r DESC, feature LIMIT 30""")
def corr_ranking(spark, sf_dir):
    return rounded(G.corr_ranking(G.corr_matrix(selection_frame(spark, sf_dir), FEATURES), FEATURES))


def mutual_info_sql(columns, bins=16, equal_depth=False):
    width = (f"least(floor(({{c}} - lo) / (hi - lo) * {bins}), {bins - 1})::INTEGER AS bin "
             "FROM (SELECT {c}, y, min({c}) OVER () AS lo, max({c}) OVER () AS hi FROM filled)")
    cuts = ", ".join(str(k / bins) for k in range(1, bins))
    depth = (f"len(list_filter(q, lambda e: {{c}} > e))::INTEGER AS bin "
             f"FROM filled, (SELECT list_distinct(quantile_cont({{c}}, [{cuts}])) AS q FROM filled)")
    cells = " UNION ALL ".join(f"SELECT '{c}' AS feature, y, {(depth if equal_depth else width).format(c=c)}" for c in columns)
    filled = ", ".join(f"coalesce({c}, 0) AS {c}" for c in columns)
    return f"""filled AS (SELECT {filled}, CASE WHEN label = 'Attack' THEN 1 ELSE 0 END AS y FROM sel),
cells AS ({cells}), n AS (SELECT feature, bin, y, count(*)::DOUBLE AS n FROM cells GROUP BY ALL),
w AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny,
  sum(n) OVER (PARTITION BY feature) AS t FROM n),
mi AS (SELECT feature, sum(n / t * ln(n * t / (nb * ny))) AS importance FROM w GROUP BY feature)"""


@query("G6", "mutual_info", sql=f"""
WITH {SELECTION}, {mutual_info_sql(FEATURES)} SELECT feature, round(importance, 9) AS importance FROM mi""")
def mutual_info(spark, sf_dir):
    rows = selection_frame(spark, sf_dir).withColumn("label", G.attack_flag(F.col("Normal_Attack")))
    return rounded(G.mutual_info(rows, FEATURES), 9)


@query("G6", "mutual_info_depth", sql=f"""
WITH {SELECTION}, {mutual_info_sql(FEATURES, equal_depth=True)} SELECT feature, round(importance, 9) AS importance FROM mi""")
def mutual_info_depth(spark, sf_dir):
    """Bins that hold equally many rows each: outliers do not stretch them."""
    rows = selection_frame(spark, sf_dir).withColumn("label", G.attack_flag(F.col("Normal_Attack")))
    return rounded(G.mutual_info(rows, FEATURES, equal_depth=True, exact=True), 9)


@query("G7", "forest_importance")
def forest_importance(spark, sf_dir):
    rows = selection_frame(spark, sf_dir).withColumn("label", G.attack_flag(F.col("Normal_Attack")))
    return G.forest_importance(rows, FEATURES)


@query("G8", "top_features", sql=f"""
WITH {SELECTION}, {mutual_info_sql(FEATURES)}, r AS (SELECT feature, importance,
  row_number() OVER (ORDER BY importance DESC, feature)::INTEGER AS rank FROM mi)
SELECT feature, round(importance, 9) AS importance, rank FROM r WHERE rank <= 3""")
def top_features(spark, sf_dir):
    rows = selection_frame(spark, sf_dir).withColumn("label", G.attack_flag(F.col("Normal_Attack")))
    return rounded(G.top_features(G.mutual_info(rows, FEATURES), n=3, threshold=1e-9), 9)


_KEYS = ["orderkey", "linenumber", "partkey", "entity"]
_STEPS = f"""st AS (SELECT feature FROM ({_VARIANCES}) WHERE variance < 1e-6),
hn AS (SELECT feature FROM ({_NULLS}) WHERE null_share > 0.5 AND feature NOT IN (SELECT feature FROM st)),
co AS (SELECT DISTINCT b AS feature FROM ({_PAIRS}) WHERE r > 0.98)"""


@query("G9", "selection_run", sql=f"""
WITH {SELECTION}, {_STEPS}, {mutual_info_sql(['quantity', 'price', 'discount', 'tax'])}
SELECT feature, 'static_features' AS step, NULL::DOUBLE AS importance, FALSE AS kept FROM st
UNION ALL SELECT feature, 'high_null_features', NULL, FALSE FROM hn
UNION ALL SELECT feature, 'correlated_features', NULL, FALSE FROM co
UNION ALL SELECT feature, 'selected', round(importance, 9), TRUE FROM mi""")
def selection_run(spark, sf_dir):
    rows = selection_frame(spark, sf_dir)
    normal, attack = (rows.filter(F.col("Normal_Attack") == v) for v in ("Normal", "Attack"))
    found, _ = G.run_selection(normal, attack, keep=_KEYS)
    return rounded(found.report(spark), 9)


@query("G10", "selection_report", sql=f"""
WITH {SELECTION}, {_STEPS}, n AS (SELECT (SELECT count(*) FROM st) AS s, (SELECT count(*) FROM hn) AS h, (SELECT count(*) FROM co) AS c)
SELECT unnest(['static_features', 'high_null_features', 'correlated_features', 'total_removed', 'final_features']) AS item,
       unnest([s, h, c, s + h + c, 9 - s - h - c])::BIGINT AS n FROM n""")
def selection_report(spark, sf_dir):
    found, _ = G.run_selection(selection_frame(spark, sf_dir), keep=_KEYS, importance=False)
    return spark.createDataFrame(list(found.removal_summary().items()), "item string, n bigint")


@query("B7", "write_report", sql=f"""
WITH {SELECTION}, {_STEPS}, g AS (SELECT feature, 'static_features' AS step, FALSE AS kept FROM st
  UNION ALL SELECT feature, 'high_null_features', FALSE FROM hn UNION ALL SELECT feature, 'correlated_features', FALSE FROM co)
SELECT *, (SELECT count(*) FROM sel) AS dataset_rows FROM (SELECT * FROM g UNION ALL SELECT feature, 'selected', TRUE FROM (
  SELECT unnest({FEATURES + EXTRA}) AS feature) WHERE feature NOT IN (SELECT feature FROM g))""")
def write_report(spark, sf_dir):
    """The cleaned rows, read back from the written report folder."""
    found, kept = G.run_selection(selection_frame(spark, sf_dir), keep=_KEYS, importance=False)
    report, path = found.report(spark), scratch_path(spark, "report")
    K.write_report(kept, report.filter("kept"), report, path)
    stored = spark.read.json(f"{path}/feature_selection_report")
    rows = spark.read.option("header", True).csv(f"{path}/selected_features_dataset").count()
    return stored.select("feature", "step", "kept").withColumn("dataset_rows", F.lit(rows))


# H ------------------------------------------------------------------------------------

DAY, HOUR = 86_400, 3_600
SLOW = P.Thresholds(drop_below=30.0, rise_above=60.0, min_drop=10.0, min_rise=20.0,
                    followup_seconds=12 * HOUR, cooldown_seconds=24 * HOUR)
ENTITY = ["entity"]

MATCHES = f"""{POINTS}, seq AS (SELECT entity, event_id, ts, value, lag(value) OVER (PARTITION BY entity ORDER BY ts, event_id) AS prev FROM points),
m AS (SELECT d.entity, d.event_id AS drop_id, d.ts AS drop_ts, r.ts AS ts, d.prev AS dropped_from, d.value AS dropped_to,
       r.value AS rose_to, r.value - d.value AS rise
  FROM seq d JOIN seq r ON d.entity = r.entity AND r.ts > d.ts AND r.ts <= d.ts + INTERVAL '12 hours'
   AND r.value > 60 AND r.value - d.value >= 20
  WHERE d.prev - d.value >= 10 AND d.value < 30
  QUALIFY row_number() OVER (PARTITION BY d.event_id ORDER BY r.ts) = 1)"""
EVENTS = f"""{MATCHES}, o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY drop_ts, drop_id) AS k FROM m),
rec AS (SELECT entity, k, drop_id, TRUE AS kept, ts AS last FROM o WHERE k = 1
  UNION ALL SELECT o.entity, o.k, o.drop_id, o.drop_ts - rec.last >= INTERVAL '24 hours',
    CASE WHEN o.drop_ts - rec.last >= INTERVAL '24 hours' THEN o.ts ELSE rec.last END
  FROM rec JOIN o ON o.entity = rec.entity AND o.k = rec.k + 1),
ev AS (SELECT m.* FROM m JOIN rec USING (entity, drop_id) WHERE rec.kept)"""

ISO_SQL = "strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({c}) % 1000000 = 0 THEN '' ELSE strftime({c}, '.%f') END"
DETAILS_SQL = ("'FIT dropped from ' || dropped_from || ' to ' || dropped_to || ' at ' || " + ISO_SQL.format(c="drop_ts")
               + " || ', LIT rose to ' || rose_to || ' (Δ=' || printf('%.2f', rise) || ') at ' || " + ISO_SQL.format(c="ts"))


def matches(spark, sf_dir):
    return P.drop_then_rise(points(spark, sf_dir), ENTITY, "value", "value", th=SLOW, block_seconds=7 * DAY)


def events(spark, sf_dir):
    return P.as_events(P.cooldown(matches(spark, sf_dir), ENTITY, SLOW.cooldown_seconds, SLOW.followup_seconds), ENTITY)


@query("H1", "drop_then_rise", sql=f"""
WITH {MATCHES} SELECT entity, drop_id, drop_ts, ts, dropped_from, dropped_to, rose_to, round(rise, 6) AS rise FROM m""")
def drop_then_rise(spark, sf_dir):
    return rounded(matches(spark, sf_dir)).select(
        "entity", "drop_id", "drop_ts", "ts", "dropped_from", "dropped_to", "rose_to", "rise")


@query("H2", "cooldown", sql=f"""WITH RECURSIVE {EVENTS} SELECT entity, drop_id, drop_ts, ts FROM ev""")
def cooldown(spark, sf_dir):
    return events(spark, sf_dir).select("entity", "drop_id", "drop_ts", "ts")


@query("B4", "append_pattern_events", sql=f"""
WITH RECURSIVE {EVENTS}
SELECT entity, ts AS time, 'pattern_events' AS measurement, 'FIT_drop_then_LIT_rise' AS pattern, 'FIT101->LIT101' AS sensor,
  1.0::DOUBLE AS severity, {DETAILS_SQL} AS details FROM ev""")
def append_pattern_events(spark, sf_dir):
    path = scratch_path(spark, "patterns")
    K.append_points(path)(K.pattern_points(events(spark, sf_dir), ENTITY), 0)
    return spark.read.parquet(path).select("entity", "time", "measurement", "pattern", "sensor", "severity", "details")


def _tune_sql(low_ok, high_ok):
    return f"""WITH {WIDE}, q AS (SELECT quantile_cont(quantity, 0.05) AS lo, quantile_cont(price, 0.95) AS hi,
  0.1 * (max(quantity) - min(quantity)) AS d, 0.1 * (max(price) - min(price)) AS r FROM wide WHERE label = 'Normal')
SELECT round(CASE WHEN {low_ok} THEN lo ELSE 3.0 END, 6) AS drop_below, round(CASE WHEN {high_ok} THEN hi ELSE 512.0 END, 6) AS rise_above,
  round(CASE WHEN d < 0.05 THEN 0.1 ELSE d END, 6) AS min_drop, round(CASE WHEN r < 0.5 THEN 1.0 ELSE r END, 6) AS min_rise FROM q"""


@query("H3", "tune_thresholds", sql=_tune_sql("lo > 1.0 AND lo <= 5.0", "hi >= 400 AND hi <= 90000"))
def tune_thresholds(spark, sf_dir):
    th = P.tune_thresholds(wide(spark, sf_dir), "quantity", "price", "label", b_range=(400.0, 90_000.0))
    one = spark.createDataFrame([(th.drop_below, th.rise_above, th.min_drop, th.min_rise)],
                                "drop_below double, rise_above double, min_drop double, min_rise double")
    return rounded(one)


@query("H5", "pattern_report", sql=f"""
WITH RECURSIVE {EVENTS}, w AS (SELECT time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS time, count(*) AS n FROM ev GROUP BY 1)
SELECT 'count' AS part, time, n::DOUBLE AS value FROM w UNION ALL SELECT 'severity', time, 1.0 FROM w
UNION ALL SELECT * FROM (SELECT 'latest', ts, drop_id::DOUBLE FROM ev ORDER BY ts DESC, drop_id DESC LIMIT 100)""")
def pattern_report(spark, sf_dir):
    per_window, worst, latest = P.pattern_report(P.cut_lineage(events(spark, sf_dir)), "1 day")
    return (per_window.select(F.lit("count").alias("part"), "time", F.col("n").cast("double").alias("value"))
            .unionAll(worst.select(F.lit("severity"), "time", "value"))
            .unionAll(latest.select(F.lit("latest"), "ts", F.col("drop_id").cast("double"))))


@query("H6", "pattern_alert", sql=f"""
WITH RECURSIVE {EVENTS} SELECT entity, ts, 'FIT_drop_then_LIT_rise' AS pattern, 1.0::DOUBLE AS severity FROM ev""")
def pattern_alert(spark, sf_dir):
    return P.pattern_alert(events(spark, sf_dir)).select("entity", "ts", "pattern", "severity")
