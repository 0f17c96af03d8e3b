"""Edge cases of sources, decoding and cleaning, on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice import schema as S
from sluice.functions import clean as C
from sluice.sources import messages as M
from sluice.sources import readers as R
from sluice.sources import sinks as K


def column(df, name):
    return [r[name] for r in df.collect()]


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string").coalesce(1)


def test_numbers(spark):
    df = texts(spark, [" 1.5 ", "", "  ", "abc", None, "-2e3", "1d", "2.5F", "NaN"])
    got = column(df.select(C.safe_float(F.col("v")).alias("x")), "x")
    assert got == [1.5, None, None, None, None, -2000.0, None, None, None]
    assert column(df.select(C.binary_status(F.col("v")).alias("x")), "x")[:2] == [1, None]


def test_times(spark):
    df = texts(spark, ["2024-01-05 06:07:08", "2024-01-05T06:07:08", "2024/01/05 06:07:08", "05/01/2024 06:07:08",
                       "05/01/2024 06:07:08 PM", "5/1/2024 6:07:08 am", "2024-01-05T06:07:08.250000", "2024-01-05",
                       "2024-13-45 06:07:08", "garbage", "", None])
    at = dt.datetime(2024, 1, 5, 6, 7, 8)
    got = column(df.select(C.parse_timestamp(F.col("v")).cast("timestamp_ntz").alias("t")), "t")
    assert got == [at, at, at, at, at.replace(hour=18), at, at.replace(microsecond=250000), dt.datetime(2024, 1, 5),
                   None, None, None, None]
    later = F.lit("2000-01-01").cast("timestamp")
    filled = column(df.select(C.parse_timestamp(F.col("v"), later).cast("timestamp_ntz").alias("t")), "t")
    assert filled[-1] == dt.datetime(2000, 1, 1) and filled[0] == at


def test_labels(spark):
    df = texts(spark, ["Normal", " normal ", "0", "", None, "Attack", " ATTACK "]).withColumnRenamed("v", "Normal_Attack")
    c = F.col("Normal_Attack")
    assert column(df.select(C.is_normal(c).alias("x")), "x") == [True, True, True, True, True, False, False]
    assert column(df.select(C.is_attack(c).alias("x")), "x") == [False] * 5 + [True, True]
    assert column(df.select(C.attack_flag(c).alias("x")), "x") == [0, 0, 0, 0, 0, 1, 0]
    assert column(df.select(C.normal_sign(c).alias("x")), "x") == [1, -1, -1, -1, -1, -1, -1]
    more = df.withColumn("Label", F.lit("Attack"))
    assert column(more.select(C.first_label(more).alias("x")), "x")[3:5] == ["Attack", "Attack"]


def test_stage_and_rules(spark):
    df = texts(spark, ["FIT101", "P602", "DPIT301", "x", "UV401__zlast"])
    assert column(df.select(C.stage_of(F.col("v")).alias("s")), "s") == ["P1", "P6", "P3", None, None]
    levels = spark.createDataFrame([(299.9,), (300.0,), (1000.0,), (1000.1,), (None,), (float("nan"),)], "v double").coalesce(1)
    assert column(levels.select(C.outside(F.col("v"), 300, 1000).alias("o")), "o") == [True, False, False, True, False, False]


def test_nan_changes_only_its_own_row(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),)], "v double").coalesce(1)
    assert column(C.zscore_normalise(df, ["v"]), "v") == pytest.approx([-0.7071, 0.7071, 0.0], abs=1e-3)


def test_frames(spark):
    raw = spark.createDataFrame([("t", 1, "2.5", None, "end")], "a string, b int, c string, d double, e string")
    assert C.numeric_frame(raw).first().asDict() == {"b": 1.0, "c": 2.5, "d": 0.0}
    assert C.align_schema(raw, ["d", "b", "zz"]).first().asDict() == {"d": 0.0, "b": 1.0, "zz": 0.0}
    kept, missing = C.select_features(raw, ["b", "nope"], always=["e"])
    assert kept.columns == ["b", "e"] and missing == ["nope"]
    flat = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "a double, b double").coalesce(1)
    z = C.zscore_normalise(flat, ["a", "b"]).collect()
    assert [r["a"] for r in z] == [0.0, 0.0] and abs(z[0]["b"] + 0.7071067) < 1e-6
    assert C.standard_scale(flat, ["a"], {"a": (4.0, 0.0)}).first()["a"] == 1.0


def test_headers_and_csv(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("﻿Timestamp, MV101,MV101,P1\nt1,,2,3\nt2,4,,x\n", encoding="utf-8")
    df = R.source_csv(spark, str(path))
    assert df.columns == ["Timestamp", "MV101", "P1"]
    assert [tuple(r) for r in df.collect()] == [("t1", "2", "3"), ("t2", "4", "x")]
    stream = R.stream_csv(spark, str(tmp_path), ["Timestamp", "a", "b", "c"])
    assert stream.isStreaming


def test_json(spark):
    rows = texts(spark, ['{"FIT101": " 2.5 ", "P101": "1"}', "{broken", '{"LIT101": 7}', ""]).withColumnRenamed("v", "value")
    flat = M.decode_sensor_json(rows).orderBy("id").collect()
    assert len(flat) == 4 and flat[0]["FIT101"] == " 2.5 " and flat[1]["FIT101"] is None and flat[2]["LIT101"] == "7"
    good, bad = M.decode_dynamic_json(rows)
    assert {(r["id"], r["key"], r["field_value"]) for r in good.collect()} == {
        (0, "FIT101", " 2.5 "), (0, "P101", "1"), (2, "LIT101", "7")}
    assert [r["value"] for r in bad.collect()] == ["{broken"]
    typed = M.decode_typed_json(rows, T.StructType([T.StructField("LIT101", T.DoubleType())])).orderBy("id").collect()
    assert typed[2]["LIT101"] == 7.0


def test_scores(spark):
    rows = texts(spark, ['{"anomaly_score": 1.5}', "2.5", '"3.5"', '{"other": 1}', "x", '{"anomaly_score": "4"}'])
    assert column(M.decode_score(rows, "v").orderBy("id"), "anomaly_score") == [1.5, 2.5, 3.5, 4.0]


def test_points_and_logs(spark):
    rows = spark.createDataFrame([(1, "t", "2.5", "x", " Attack "), (2, "t", "", None, None)],
                                 "id int, Timestamp string, FIT101 string, note string, Normal_Attack string")
    got = {tuple(r) for r in K.to_points(rows, ["id"]).collect()}
    assert got == {(1, "t", "sensor_data", "Attack", "FIT101", 2.5)}
    logs = spark.createDataFrame([("s", None, "h", "m", 0.5, None), ("s", "l", None, None, None, None)],
                                 "service string, level string, host string, message string, anomaly_score double, timestamp timestamp")
    out = K.log_points(logs).collect()
    assert len(out) == 1 and out[0]["level"] == "" and out[0]["anomaly_score"] == 0.5


def test_sample_is_exact_and_repeatable(spark, monkeypatch):
    df = spark.range(1000).repartition(7)
    first = sorted(r["id"] for r in R.sample_n(df, 100, ["id"]).collect())
    monkeypatch.setattr(R, "TOP_ROWS", 10)
    spread = sorted(r["id"] for r in R.sample_n(df.repartition(3), 100, ["id"]).collect())
    assert len(first) == 100 and first == spread
    assert R.sample_n(df, 5000, ["id"]).count() == 1000


def test_schema_sizes():
    assert len(S.SENSOR_TAGS) == len(set(S.SENSOR_TAGS)) == 51 and len(S.text_row_schema()) == 53
