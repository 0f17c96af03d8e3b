"""Keyed state over many files: rows equal the batch, equal times meet, late and untimed rows are counted."""

import datetime as dt

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.operators import patterns as P
from sluice.operators import windows as W
from sluice.streaming import keyed as K
from sluice.streaming.jobs import run_batches, run_to_table

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id bigint, ts timestamp_ntz, entity string, value double"
TH = P.Thresholds(30.0, 60.0, 10.0, 20.0, 3600, 7200)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def streamed(spark, tmp_path, batches, build):
    """The output table of ``build(stream)`` after one file per batch."""
    source = tmp_path / "in"
    source.mkdir()
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    (build(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(str(tmp_path / "out"))


def random_rows(n=240, seed=3):
    rng = np.random.default_rng(seed)
    minutes = np.sort(rng.integers(0, 150, n)) * 10  # many rows of equal time
    return [(i, at(int(m)), str(rng.integers(3)), float(rng.integers(0, 100))) for i, m in enumerate(minutes)]


def newest(rows):
    return {e: max(r[1] for r in rows if r[2] == e) for e in {r[2] for r in rows}}


def sums(stream, **settings):
    return K.series_windows(stream, ["entity"], ["ts", "event_id"], ["value"], 5, K.window_sums, ["total"], **settings)


def test_windows_equal_the_batch_over_edges_with_equal_times(spark, tmp_path):
    rows = random_rows()
    cuts = [0, 50, 51, 120, 200, 240]
    assert any(rows[c - 1][1] == rows[c][1] for c in cuts[1:-1])
    got = streamed(spark, tmp_path, [rows[a:b] for a, b in zip(cuts, cuts[1:])], sums)
    last = newest(rows)
    want = W.rolling_sum(spark.createDataFrame(rows, SCHEMA), ["entity"], ["ts", "event_id"], F.col("value"), "total", 5).collect()
    want = {r["event_id"]: r["total"] for r in want if r["ts"] < last[r["entity"]]}
    assert {r["event_id"]: r["total"] for r in got.collect()} == want
    assert {r["kind"] for r in got.collect()} == {"row"}


def test_patterns_equal_the_batch(spark, tmp_path):
    rows = random_rows(600, 8)
    cuts = [0, 100, 101, 300, 333, 600]
    got = streamed(spark, tmp_path, [rows[a:b] for a, b in zip(cuts, cuts[1:])],
                   lambda s: K.series_patterns(s, ["entity"], "value", "value", TH))
    last = newest(rows)
    whole = P.drop_then_rise(spark.createDataFrame(rows, SCHEMA), ["entity"], "value", "value", th=TH)
    want = P.cooldown(whole, ["entity"], TH.cooldown_seconds, TH.followup_seconds).collect()
    want = [(r["entity"], r["drop_id"], r["ts"], r["rise"]) for r in want if r["drop_ts"] + dt.timedelta(seconds=3600) < last[r["entity"]]]
    assert len(want) > 5
    assert sorted((r["entity"], r["drop_id"], r["ts"], r["rise"]) for r in got.collect()) == sorted(want)


def test_a_series_has_its_own_clock_and_marks_what_it_cannot_place(spark, tmp_path):
    batches = [[(1, at(100), "fast", 1.0), (2, at(1), "slow", 1.0), (3, None, "slow", 9.0)],
               [(4, at(2), "slow", 2.0), (5, at(90), "fast", 5.0), (6, at(100), "fast", 2.0)],
               [(7, at(101), "fast", 3.0), (8, at(3), "slow", 3.0), (9, None, None, 1.0)]]
    got = streamed(spark, tmp_path, batches, lambda s: K.series_windows(
        s, ["entity"], ["ts", "event_id"], ["value"], 1, K.window_sums, ["total"])).collect()
    assert sorted(r["event_id"] for r in got if r["kind"] == "row") == [1, 2, 4, 6]
    assert [r["event_id"] for r in got if r["kind"] == "late"] == [5]
    assert sorted(r["event_id"] for r in got if r["kind"] == "untimed") == [3, 9]


def test_rows_within_the_delay_are_on_time(spark, tmp_path):
    batches = [[(1, at(10), "a", 1.0)], [(2, at(5), "a", 2.0), (3, at(0), "a", 3.0)], [(4, at(30), "a", 4.0)]]
    got = streamed(spark, tmp_path, batches, lambda s: K.series_windows(
        s, ["entity"], ["ts", "event_id"], ["value"], 2, K.window_sums, ["total"], delay_seconds=300)).collect()
    assert {r["event_id"]: (r["kind"], r["total"]) for r in got} == {1: ("row", 3.0), 3: ("late", None)}


def test_a_timer_settles_a_silent_series(spark, tmp_path):
    batches = [[(1, at(0), "a", 50.0), (2, at(1), "a", 10.0), (3, at(5), "a", 90.0)], [(4, at(0), "b", 1.0)], [(5, at(90), "b", 1.0)]]
    got = streamed(spark, tmp_path, batches, lambda s: K.series_patterns(s, ["entity"], "value", "value", TH, idle_seconds=0))
    assert [(r["entity"], r["drop_id"], r["ts"], r["rise"]) for r in got.collect()] == [("a", 2, at(5), 80.0)]


def test_window_features_equal_the_batch_features(spark):
    rows = [(i, at(i), "a", float((i * 7) % 5)) for i in range(12)] + [(12, at(12), "a", None)] + [(i, at(i), "a", 3.0) for i in range(13, 18)]
    want = W.rolling_features(spark.createDataFrame(rows, SCHEMA), ["entity"], ["ts", "event_id"], ["value"], 3).orderBy("ts").collect()
    values = np.array([[np.nan if r[3] is None else r[3]] for r in rows])
    got = K.window_features(np.lib.stride_tricks.sliding_window_view(values, 3, axis=0))
    names = K.feature_names(["value"])
    for w, g in zip(want, got, strict=True):
        assert [w[n] for n in names] == [None if np.isnan(x) else pytest.approx(x) for x in g]


def test_keyed_streams_run_in_a_session_with_another_state_store(spark, tmp_path):
    rows = random_rows()
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(source)
    name = "spark.sql.streaming.stateStore.providerClass"
    before, plain = spark.conf.get(name), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(name, plain)
    try:
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        settled = run_to_table(sums(stream), "plain").count()
        seen = []
        run_batches(sums(stream), "plain", lambda batch, _: seen.append(batch.count()))
        assert spark.conf.get(name) == plain
    finally:
        spark.conf.set(name, before)
    assert settled == sum(seen) > 100


def test_many_series_share_few_keys_of_the_state_store(spark, tmp_path):
    """The work and the state of a batch go by groups of series, not by series."""
    rows = [(i, at(i // 3000), str(i % 3000), float(i)) for i in range(9000)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    pairs = K.series_windows(stream, ["entity"], ["ts", "event_id"], ["value"], 2, K.window_sums, ["total"])
    query = pairs.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < 3000
    got = {r["event_id"]: r["total"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: 2.0 * i - 3000 for i in range(3000, 6000)}


def test_series_of_one_group_keep_their_own_clocks(spark, tmp_path, monkeypatch):
    """Two keys with nulls, all in three groups: the batch's rows, also across files that bring only some series, and
    rows without a tie."""
    monkeypatch.setattr(K, "GROUPS", 3)
    monkeypatch.setattr(K, "OUT_ROWS", 7)
    rnd = np.random.default_rng(5)
    schema = "event_id bigint, ts timestamp_ntz, name string, part int, value double"
    names, parts = [None, "a", "b", ""], [None, 1, 2]
    rows = [(i if i % 50 else None, at(int(m)), names[rnd.integers(4)], parts[rnd.integers(3)], float(rnd.integers(0, 100)) if rnd.random() > 0.1 else None)
            for i, m in enumerate(np.sort(rnd.permutation(4000)[:400]))]
    source = tmp_path / "in"
    for lo in range(0, 400, 80):
        spark.createDataFrame(rows[lo:lo + 80], schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    got = run_to_table(K.series_windows(stream, ["name", "part"], ["ts", "event_id"], ["value"], 4, K.window_sums, ["total"]), "groups").collect()
    last = {(r[2], r[3]): r[1] for r in rows}
    want = W.rolling_sum(spark.createDataFrame(rows, schema), ["name", "part"], ["ts", "event_id"], F.col("value"), "total", 4).collect()
    want = {(r["name"], r["part"], r["ts"], r["event_id"]): r["total"] for r in want if r["ts"] < last[r["name"], r["part"]]}
    assert len(want) > 300 and {(r["name"], r["part"], r["ts"], r["event_id"]): r["total"] for r in got} == want


def test_a_silent_series_does_not_settle_those_of_its_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "GROUPS", 1)
    batches = [[(1, at(0), "a", 1.0), (2, at(0), "b", 2.0), (3, at(0), "c", 3.0)], [(4, at(1), "a", 4.0), (5, at(2), "c", 5.0)], [(6, at(1), "b", 6.0)]]
    got = streamed(spark, tmp_path, batches, lambda s: K.series_windows(
        s, ["entity"], ["ts", "event_id"], ["value"], 1, K.window_sums, ["total"], idle_seconds=3600)).collect()
    assert sorted((r["event_id"], r["kind"]) for r in got) == [(1, "row"), (2, "row"), (3, "row")]
    settled = K.Windows(["entity"], 1, 0, 60, 1, K.window_sums, ["total"], "double")
    settled.state = type("State", (), {"get": lambda s: getattr(s, "kept", None), "update": lambda s, v: setattr(s, "kept", v)})()
    settled.handle = type("Handle", (), {"listTimers": lambda s: [], "registerTimer": lambda s, ms: None, "deleteTimer": lambda s, ms: None})()

    def now(ms):
        return type("Now", (), {"getCurrentWatermarkInMs": lambda s: ms})()

    def arrive(ms, *rows):
        cells = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.float64()))]
        block = K._to_bytes(pa.table(cells, ["row_k0", "row_us", "row_tie", "row_v0"]))
        return list(settled.handleInputRows((0,), iter([pd.DataFrame({"block": [block]})]), now(ms)))

    arrive(0, ("a", 5, 1, 1.0), ("b", 7, 2, 2.0))
    arrive(30_000, ("b", 7, 3, 3.0))
    expired = type("Expired", (), {"getExpiryTimeInMs": lambda s: 60_000})()
    out = list(settled.handleExpiredTimer((0,), now(70_000), expired))
    assert [r["tie"] for part in out for r in K._to_table(part["made"][0]).to_pylist()] == [1]
    assert not list(settled.handleExpiredTimer((0,), now(70_000), expired))
