"""Sources, decoders and sinks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice import schema as S
from sluice.functions import clean as C
from sluice.plans.registry import POINTS, WIDE, points, query, rounded, table, wide
from sluice.session import scratch_path
from sluice.sources import messages as M
from sluice.sources import readers as R
from sluice.sources import sinks as K
from sluice.streaming.jobs import run_to_table

KEY = ["orderkey", "linenumber", "partkey", "entity"]

# Text readings as they travel: padded, blank and non-numeric ones included.
QUANTITY_TEXT = (
    "CASE linenumber WHEN 7 THEN '  ' WHEN 6 THEN 'n/a' ELSE concat(' ', CAST(quantity AS STRING), ' ') END"
)


def text_rows(spark, sf_dir):
    """Wide rows with every reading as text under sensor names."""
    return wide(spark, sf_dir).select(
        *KEY,
        F.date_format("ts", "dd/MM/yyyy hh:mm:ss a").alias("Timestamp"),
        F.expr(QUANTITY_TEXT).alias("FIT101"),
        F.col("price").cast("string").alias("LIT101"),
        F.col("discount").cast("string").alias("AIT201"),
        F.col("tax").cast("string").alias("P101"),
        F.concat(F.lit(" "), "label").alias("Normal_Attack"),
    )


def sensor_messages(spark, sf_dir):
    rows = text_rows(spark, sf_dir)
    return rows.select(*KEY, F.to_json(F.struct(*[c for c in rows.columns if c not in KEY])).alias("value"))


TEXT_CLEAN = """CASE linenumber WHEN 7 THEN NULL WHEN 6 THEN NULL ELSE quantity END"""
KEYS_SQL = "orderkey, linenumber, partkey, entity"


@query("A1", "source_csv", sql="""
SELECT event_id, user_id, event_type, value, ts FROM events""")
def source_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    out = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("﻿event_id"), F.col("user_id").alias(" user_id"), "event_type", "value",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))
    out.write.option("header", True).csv(path)
    return R.source_csv(spark, path).select(
        F.col("event_id").cast("bigint").alias("event_id"), F.col("user_id").cast("bigint").alias("user_id"),
        "event_type", C.safe_float(F.col("value")).alias("value"), F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("A2", "source_kafka", sql="""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def source_kafka(spark, sf_dir):
    """The subscribe-and-decode stream on a folder of messages in place of a topic."""
    schema = table(spark, sf_dir, "events").schema
    topic = R.source_files(spark, sf_dir, schema, glob="events.parquet").select(
        "event_id", F.col("props").cast("binary").alias("value"))
    decoded = M.decode_typed_json(topic, T.StructType([T.StructField("k", T.LongType())]))
    return run_to_table(decoded, "source-kafka")


@query("A3", "decode_sensor_json", sql=f"""
WITH {WIDE}
SELECT {KEYS_SQL}, CASE linenumber WHEN 7 THEN '  ' WHEN 6 THEN 'n/a' ELSE NULL END AS fit101_text,
       {TEXT_CLEAN} AS fit101, price AS lit101, label AS label,
       NULL::VARCHAR AS absent_tag
FROM wide""")
def decode_sensor_json(spark, sf_dir):
    flat = M.decode_sensor_json(sensor_messages(spark, sf_dir))
    return flat.select(
        *KEY, F.when(F.col("linenumber").isin(6, 7), F.col("FIT101")).alias("fit101_text"),
        C.safe_float(F.col("FIT101")).alias("fit101"), C.safe_float(F.col("LIT101")).alias("lit101"),
        F.trim("Normal_Attack").alias("label"), F.col("UV401").alias("absent_tag"))


@query("A4", "decode_typed_json", sql=f"""
WITH {WIDE}
SELECT {KEYS_SQL}, quantity AS "FIT101", price AS "LIT101", discount AS "AIT201", NULL::DOUBLE AS "FIT301" FROM wide""")
def decode_typed_json(spark, sf_dir):
    sent = wide(spark, sf_dir).select(*KEY, F.to_json(F.struct(
        F.col("quantity").alias("FIT101"), F.col("price").alias("LIT101"), F.col("discount").alias("AIT201"),
    )).alias("value"))
    return M.decode_typed_json(sent).select(*KEY, "FIT101", "LIT101", "AIT201", "FIT301")


@query("A5", "decode_device_arrays", sql="""
SELECT TIMESTAMP '2024-01-01 00:00:00' + to_seconds(vec_id) AS ts, CAST(label AS VARCHAR) AS device_id,
       vec_id, CAST(pos - 1 AS INTEGER) AS position, round(CAST(embedding[pos] AS DOUBLE), 6) AS value
FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)""")
def decode_device_arrays(spark, sf_dir):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    sent = table(spark, sf_dir, "embeddings").select("vec_id", F.to_json(F.struct(
        F.date_format(F.timestamp_seconds(F.unix_timestamp(start) + F.col("vec_id")),
                      "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp"),
        F.col("label").cast("string").alias("device_id"), F.col("embedding").alias("measurements"),
    )).alias("value"))
    long = M.device_points(M.decode_device_arrays(sent))
    return rounded(long.select(F.col("timestamp").cast("timestamp_ntz").alias("ts"), "device_id", "vec_id",
                               "position", F.col("value").cast("double").alias("value")))


def log_messages(spark, sf_dir):
    """Conversation turns as log records; system turns carry no score."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct(
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn")),
                      "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.concat(F.lit("host-"), F.col("conv_id") % 5).alias("host"), F.col("role").alias("service"),
        F.when(F.col("turn") % 3 != 2, F.lit("INFO")).alias("level"), F.col("text").alias("message"),
        F.when(F.col("role") != "system", F.length("text") / 1000).alias("anomaly_score"),
    )).alias("value"))


LOGS = """logs AS (
  SELECT conv_id, turn, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 60 + turn) AS ts,
         concat('host-', conv_id % 5) AS host, role AS service,
         CASE WHEN turn % 3 <> 2 THEN 'INFO' END AS level, text AS message,
         CASE WHEN role <> 'system' THEN length(text) / 1000 END AS anomaly_score
  FROM conversations)"""


@query("A6", "decode_logs", sql=f"""
WITH {LOGS}
SELECT conv_id, turn, ts, host, service, level, message, round(anomaly_score, 6) AS anomaly_score FROM logs""")
def decode_logs(spark, sf_dir):
    logs = M.decode_logs(log_messages(spark, sf_dir))
    return rounded(logs.select("conv_id", "turn", F.col("timestamp").cast("timestamp_ntz").alias("ts"), "host",
                               "service", "level", "message", "anomaly_score"))


@query("A7", "decode_dynamic_json", sql="""
SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS field_value, FALSE AS quarantined
FROM events WHERE event_type <> 'signup'
UNION ALL
SELECT event_id, NULL, replace(props, '}', ''), TRUE FROM events WHERE event_type = 'signup'""")
def decode_dynamic_json(spark, sf_dir):
    """Messages of one type are cut short; they alone are quarantined."""
    sent = table(spark, sf_dir, "events").select("event_id", F.when(
        F.col("event_type") == "signup", F.replace("props", F.lit("}"), F.lit(""))).otherwise(F.col("props")).alias("value"))
    good, bad = M.decode_dynamic_json(sent)
    return good.select("event_id", "key", "field_value", F.lit(False).alias("quarantined")).unionByName(
        bad.select("event_id", F.lit(None).cast("string").alias("key"), F.col("value").alias("field_value"),
                   F.lit(True).alias("quarantined")))


@query("A8", "decode_score", sql="""
SELECT event_id, value AS anomaly_score FROM events WHERE event_type <> 'error'""")
def decode_score(spark, sf_dir):
    text = F.col("value").cast("string")
    sent = table(spark, sf_dir, "events").select("event_id", (
        F.when(F.col("event_type") == "click", F.to_json(F.struct(F.col("value").alias("anomaly_score"))))
        .when(F.col("event_type") == "view", F.concat(F.lit('"'), text, F.lit('"')))
        .when(F.col("event_type") == "error", F.lit('{"other": 1}')).otherwise(text)).alias("value"))
    return M.decode_score(sent)


@query("A9", "normalise_headers", sql="""
SELECT o_orderkey AS id, o_totalprice AS "MV101", o_orderpriority AS "P202" FROM orders""")
def normalise_headers(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("﻿id"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias(" MV101"),
        F.when(F.col("o_orderkey") % 2 == 1, F.col("o_totalprice")).alias("MV101 "),
        F.col("o_orderpriority").alias("P202 "))
    return R.normalise_headers(raw)


@query("A10", "sample_n", sql="""
SELECT event_id, ts, value FROM events ORDER BY md5(concat(event_id, '|', 42)), event_id LIMIT 3000""")
def sample_n(spark, sf_dir):
    return R.sample_n(table(spark, sf_dir, "events").select("event_id", "ts", "value"), 3000, ["event_id"], 42)


@query("B1", "to_points", sql=f"""
WITH {WIDE}
SELECT {KEYS_SQL}, ts AS time, 'sensor_data' AS measurement, label AS status, field, value FROM (
  SELECT *, 'FIT101' AS field, {TEXT_CLEAN} AS value FROM wide
  UNION ALL SELECT *, 'LIT101', price FROM wide
  UNION ALL SELECT *, 'AIT201', discount FROM wide
  UNION ALL SELECT *, 'P101', tax FROM wide)
WHERE value IS NOT NULL""")
def to_points(spark, sf_dir):
    rows = text_rows(spark, sf_dir).withColumn(
        "Timestamp", C.parse_timestamp(F.col("Timestamp")).cast("timestamp_ntz"))
    return K.to_points(rows, ids=KEY)


@query("B2", "append_points", sql=f"""
WITH {POINTS}
SELECT event_id, ts AS time, field AS measurement, entity, value, status, CAST(ts AS DATE) AS date FROM points""")
def append_points(spark, sf_dir):
    """Streamed append; the same batch is then delivered twice and must not double."""
    path = scratch_path(spark, "points")
    schema = table(spark, sf_dir, "events").schema
    stream = R.source_files(spark, sf_dir, schema, glob="events.parquet").select(
        "event_id", F.col("ts").alias("time"), F.col("event_type").alias("measurement"),
        F.col("user_id").alias("entity"), "value",
        F.when(F.col("event_type") == "error", "Attack").otherwise("Normal").alias("status"))
    write = K.append_points(path)

    def twice(batch, batch_id):
        write(batch, batch_id)
        write(batch, batch_id)

    (stream.writeStream.foreachBatch(twice).trigger(availableNow=True)
     .option("checkpointLocation", scratch_path(spark, "points-state")).start().awaitTermination())
    return spark.read.parquet(path).select("event_id", "time", "measurement", "entity", "value", "status", "date")


@query("B3", "append_log_points", sql=f"""
WITH {LOGS}
SELECT ts AS time, 'log_anomaly' AS measurement, service, coalesce(level, '') AS level, host, message,
       round(anomaly_score, 6) AS anomaly_score
FROM logs WHERE anomaly_score IS NOT NULL""")
def append_log_points(spark, sf_dir):
    path = scratch_path(spark, "logs")
    K.append_points(path)(K.log_points(M.decode_logs(log_messages(spark, sf_dir))), 0)
    stored = spark.read.parquet(path)
    return rounded(stored.select(F.col("time").cast("timestamp_ntz").alias("time"), "measurement", "service",
                                 "level", "host", "message", "anomaly_score"))


@query("B5", "metric_snapshot", sql="""
SELECT event_type AS metric, CAST(user_id AS VARCHAR) AS user_label,
       arg_max(value, ts) AS value, max(ts) AS ts
FROM events GROUP BY ALL""")
def metric_snapshot(spark, sf_dir):
    samples = K.metric_snapshot(table(spark, sf_dir, "events"), ["user_id"], name="event_type")
    flat = samples.select("metric", F.col("labels")["user_id"].alias("user_label"), "value", "ts")
    return K.latest_per_series(flat, ["metric", "user_label"])


@query("C1", "clean_numeric", sql=f"""
WITH {WIDE}
SELECT {KEYS_SQL}, {TEXT_CLEAN} AS "FIT101", price AS "LIT101", discount AS "AIT201", tax AS "P101" FROM wide""")
def clean_numeric(spark, sf_dir):
    rows = C.clean_numeric(text_rows(spark, sf_dir))
    return rows.select(*KEY, "FIT101", "LIT101", "AIT201", "P101")


@query("C2", "trim_text", sql=f"""
WITH {WIDE}
SELECT {KEYS_SQL}, strftime(ts, '%Y-%m-%d') AS "Timestamp", label AS "Normal_Attack" FROM wide""")
def trim_text(spark, sf_dir):
    padded = wide(spark, sf_dir).select(
        *KEY, F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("  ")).alias("Timestamp"),
        F.concat(F.lit("  "), "label", F.lit(" ")).alias("Normal_Attack"))
    return C.trim_text(padded)


FORMATS_SQL = """CASE o_orderkey % 7
    WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
    WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
    WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d %H:%M:%S')
    WHEN 3 THEN strftime(o_orderdate, '%d/%m/%Y %H:%M:%S')
    WHEN 4 THEN strftime(o_orderdate, '%d/%m/%Y %I:%M:%S %p')
    WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.250000'
    ELSE 'not a time' END"""


@query("C3", "parse_timestamp", sql=f"""
WITH s AS (SELECT o_orderkey, {FORMATS_SQL} AS text FROM orders)
SELECT o_orderkey, text, coalesce(
    try_strptime(text, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y/%m/%d %H:%M:%S', '%d/%m/%Y %H:%M:%S',
                        '%d/%m/%Y %I:%M:%S %p', '%Y-%m-%dT%H:%M:%S.%f'])) AS ts FROM s""")
def parse_timestamp(spark, sf_dir):
    d = F.col("o_orderdate")
    shown = F.element_at(F.array(
        F.date_format(d, "yyyy-MM-dd HH:mm:ss"), F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"),
        F.date_format(d, "yyyy/MM/dd HH:mm:ss"), F.date_format(d, "dd/MM/yyyy HH:mm:ss"),
        F.date_format(d, "dd/MM/yyyy hh:mm:ss a"), F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250000")),
        F.lit("not a time")), (F.col("o_orderkey") % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("text"))
    return rows.withColumn("ts", C.parse_timestamp(F.col("text")).cast("timestamp_ntz"))


@query("C4", "safe_float", sql="""
SELECT doc_id, TRY_CAST(CASE doc_id % 4 WHEN 0 THEN CAST(n_chars AS VARCHAR) WHEN 1 THEN lang
  WHEN 2 THEN concat('-', n_chars, '.5') ELSE '' END AS DOUBLE) AS number FROM documents""")
def safe_float(spark, sf_dir):
    n = F.col("n_chars").cast("string")
    text = (F.when(F.col("doc_id") % 4 == 0, n).when(F.col("doc_id") % 4 == 1, F.col("lang"))
            .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("-"), n, F.lit(".5"))).otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", C.safe_float(text).alias("number"))


@query("C5", "numeric_frame", sql="""
SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, CASE WHEN l_linenumber = 3 THEN 0.0 ELSE l_quantity END AS l_quantity,
       l_tax AS l_tax FROM lineitem""")
def numeric_frame(spark, sf_dir):
    """A leading and a trailing text column go, the text number between is read, nulls are 0."""
    raw = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_orderkey",
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("string")).alias("l_quantity"),
        "l_tax", "l_linestatus")
    return C.numeric_frame(raw)


@query("C6", "align_schema", sql=f"""
WITH {WIDE}
SELECT {KEYS_SQL}, CASE WHEN linenumber = 2 THEN 0.0 ELSE discount END AS "AIT201", 0.0::DOUBLE AS "FIT301",
       price AS "LIT101" FROM wide""")
def align_schema(spark, sf_dir):
    raw = wide(spark, sf_dir).select(
        *KEY, F.col("price").alias("LIT101"), F.when(F.col("linenumber") != 2, F.col("discount")).alias("AIT201"), "tax")
    return C.align_schema(raw, S.FORECAST_TAGS, keep=KEY)


@query("C7", "select_features", sql="""
SELECT l_quantity, l_tax, l_shipdate, l_returnflag, 1 AS n_missing FROM lineitem""")
def select_features(spark, sf_dir):
    kept, missing = C.select_features(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax", "UV401"],
                                      always=["l_shipdate", "l_returnflag"])
    return kept.withColumn("n_missing", F.lit(len(missing)))


@query("C8", "zscore_normalise", sql=f"""
WITH {WIDE}, m AS (SELECT avg(quantity) mq, stddev_samp(quantity) sq, avg(price) mp, stddev_samp(price) sp FROM wide)
SELECT {KEYS_SQL}, round((quantity - mq) / (sq + 1e-8), 6) AS quantity, round((price - mp) / (sp + 1e-8), 6) AS price,
       0.0::DOUBLE AS flat
FROM wide, m""")
def zscore_normalise(spark, sf_dir):
    rows = wide(spark, sf_dir).select(*KEY, "quantity", "price", F.lit(7.0).alias("flat"))
    return rounded(C.zscore_normalise(rows, ["quantity", "price", "flat"]))


@query("C9", "standard_scale", sql=f"""
WITH {WIDE}, m AS (SELECT avg(quantity) mq, stddev_pop(quantity) sq, avg(price) mp, stddev_pop(price) sp
                   FROM wide WHERE label = 'Normal')
SELECT {KEYS_SQL}, label, round((quantity - mq) / sq, 6) AS quantity, round((price - mp) / sp, 6) AS price,
       0.0::DOUBLE AS flat
FROM wide, m""")
def standard_scale(spark, sf_dir):
    rows = wide(spark, sf_dir).select(*KEY, "label", "quantity", "price", F.lit(7.0).alias("flat"))
    columns = ["quantity", "price", "flat"]
    fitted = C.fit_moments(rows.filter(F.col("label") == S.NORMAL), columns)
    return rounded(C.standard_scale(rows, columns, fitted))


@query("C10", "label_binary", sql=f"""
WITH {WIDE}, t AS (SELECT *, CASE linenumber WHEN 1 THEN ' ' || upper(label) || ' ' WHEN 2 THEN '' ELSE label END AS text
                   FROM wide)
SELECT {KEYS_SQL}, CASE WHEN text = 'Normal' THEN 1 ELSE -1 END AS sign, CASE WHEN text = 'Attack' THEN 1 ELSE 0 END AS flag,
       lower(trim(CASE WHEN text = '' THEN 'ATTACK' ELSE text END)) = 'attack' AS attack,
       lower(trim(text)) IN ('normal', '0', '') AS normal
FROM t""")
def label_binary(spark, sf_dir):
    text = (F.when(F.col("linenumber") == 1, F.concat(F.lit(" "), F.upper("label"), F.lit(" ")))
            .when(F.col("linenumber") == 2, "").otherwise(F.col("label")))
    rows = wide(spark, sf_dir).select(*KEY, text.alias("Normal_Attack"), F.lit("ATTACK").alias("Label"))
    label = F.col("Normal_Attack")
    return rows.select(*KEY, C.normal_sign(label).alias("sign"), C.attack_flag(label).alias("flag"),
                       C.is_attack(C.first_label(rows)).alias("attack"), C.is_normal(label).alias("normal"))


TAG_SQL = "concat(CASE entity % 3 WHEN 0 THEN 'FIT' WHEN 1 THEN 'AIT' ELSE 'P' END, 1 + entity % 6, '01')"


def tag_of(entity="entity"):
    """A sensor tag for each entity of the long stream."""
    e = F.col(entity)
    kind = F.when(e % 3 == 0, "FIT").when(e % 3 == 1, "AIT").otherwise("P")
    return F.concat(kind, (1 + e % 6).cast("string"), F.lit("01"))


@query("C11", "stage_of", sql=f"""
WITH {POINTS}, t AS (SELECT event_id, {TAG_SQL} AS tag FROM points)
SELECT event_id, tag, concat('P', regexp_extract(tag, '(\\d)\\d{{2}}$', 1)) AS stage FROM t""")
def stage_of(spark, sf_dir):
    return points(spark, sf_dir).select("event_id", tag_of().alias("tag")).withColumn("stage", C.stage_of(F.col("tag")))


RULES_SQL = """SELECT {keys}, tag, value, flag FROM (
  SELECT *, 'LIT101' AS tag, quantity * 20 AS value, coalesce(quantity * 20 < 300 OR quantity * 20 > 1000, FALSE) AS flag
  FROM wide
  UNION ALL SELECT *, 'LIT301', NULL, TRUE FROM wide) WHERE flag"""


@query("C17", "range_outlier_flag", sql=f"WITH {WIDE} " + RULES_SQL.format(keys=KEYS_SQL))
def range_outlier_flag(spark, sf_dir):
    rows = wide(spark, sf_dir).select(*KEY, (F.col("quantity") * 20).alias("LIT101"),
                                      F.lit(None).cast("double").alias("LIT301"))
    long = rows.unpivot(KEY, ["LIT101", "LIT301"], "tag", "value")
    # An absent column reads as 0; a missing reading of a present one is no outlier.
    reading = F.when(F.col("tag") == "LIT301", F.lit(0.0)).otherwise(F.col("value"))
    flagged = long.withColumn("flag", C.outside(reading, S.LEVEL_LOW, S.LEVEL_HIGH))
    return flagged.filter("flag")


@query("C18", "spike_flag", sql=f"""
WITH {POINTS}
SELECT event_id, {TAG_SQL} AS tag, value, value > 2.5 AS spike FROM points
WHERE {TAG_SQL} IN ('FIT101', 'FIT201', 'FIT301', 'FIT401', 'FIT501', 'FIT601')""")
def spike_flag(spark, sf_dir):
    tagged = points(spark, sf_dir).select("event_id", tag_of().alias("tag"), "value")
    return tagged.filter(F.col("tag").isin(S.FLOW_TAGS)).withColumn("spike", C.spike(F.col("value"), S.FLOW_SPIKE))


@query("C19", "binary_status", sql=f"""
WITH {WIDE}
SELECT {KEYS_SQL}, CASE linenumber WHEN 7 THEN NULL WHEN 6 THEN NULL ELSE CAST(trunc(quantity) AS INTEGER) END AS status
FROM wide""")
def binary_status(spark, sf_dir):
    return text_rows(spark, sf_dir).select(*KEY, C.binary_status(F.col("FIT101")).alias("status"))
