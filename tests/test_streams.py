"""A stream in many files gives the batch answer, also after a stop and a restart."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import anomaly as A
from sluice.operators import windows as W
from sluice.sources import sinks as K
from sluice.streaming import processors as R
from sluice.streaming.quantiles import LivePercentile

ENTITY, ORDER = ["entity"], ["ts", "event_id"]


@pytest.fixture(scope="module")
def rows(spark, data_dir):
    ev = spark.read.parquet(f"{data_dir}/events.parquet")
    return ev.select("event_id", "ts", (F.col("user_id") % 3).alias("entity"), "value").cache()


def in_files(rows, folder, parts):
    """One file per stretch of time, in order of arrival."""
    folder.mkdir(exist_ok=True)
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    step = (last - first) / parts
    for k in range(parts):
        lo, hi = first + k * step, first + (k + 1) * step if k + 1 < parts else last + dt.timedelta(days=1)
        yield rows.filter((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1)


def drop_in(frame, folder, k):
    frame.write.mode("append").parquet(str(folder))


def stream_of(spark, rows, folder):
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(stream, job, state, mode="append"):
    (stream.writeStream.foreachBatch(job).outputMode(mode).option("checkpointLocation", str(state))
     .trigger(availableNow=True).start().awaitTermination())


def writer(folder):
    return lambda df, batch_id: df.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")


def test_training_over_batches_and_scoring_with_the_newest_fit(spark, rows, tmp_path):
    store = A.ParameterStore(spark, str(tmp_path / "fit"))
    train = R.train_job(store, ["value"], ENTITY, ORDER)
    parts = list(in_files(rows, tmp_path / "x", 3))
    for k, part in enumerate(parts):
        train(part, k)
    train(parts[2], 2)
    held = [W.time_split(p, ENTITY, ORDER).filter("part = 'train'") for p in parts]
    one = A.batch_moments(held[0].unionByName(held[1]).unionByName(held[2]), ["value"]).first()
    got = store.latest().first()
    assert got["n"] == one["n"] and got["m2"] == pytest.approx(one["m2"]) and store.latest_version() == 3
    out = tmp_path / "scores"
    windows = [W.sequence_windows(p, ENTITY, ORDER, ["value"]).withColumn("kind", F.lit("row")) for p in parts]
    windows[1] = windows[1].unionByName(windows[1].limit(3).withColumn("kind", F.lit("late")))
    live = LivePercentile(spark, str(tmp_path / "live"))
    job = R.score_job(store, ["value"], live, [*ORDER, *ENTITY], writer(out), writer(tmp_path / "notes"))
    for k, part in enumerate(windows):
        job(part, k)
        job(part, k)
    model = A.Reconstruction(["value"], A.moments_of(store.latest()))
    scores = [{r["event_id"]: r["anomaly_score"] for r in A.reconstruction_score(p, model, ENTITY, ORDER).collect()} for p in parts]
    want = {k: v for s in scores for k, v in s.items()}
    scored = {r["event_id"]: r for r in spark.read.parquet(str(out)).collect()}
    assert scored.keys() == want.keys()
    assert all(scored[k]["anomaly_score"] == pytest.approx(want[k]) for k in want)
    notes = {r["batch"]: r for r in spark.read.parquet(str(tmp_path / "notes")).collect()}
    for k, s in enumerate(scores):
        limit = np.percentile(list(s.values()), 90)
        assert notes[k]["threshold"] == pytest.approx(limit) and notes[k]["scores"] == len(s)
        assert notes[k]["anomalies"] == sum(v > limit for v in s.values()) and notes[k]["late"] == (3 if k == 1 else 0)
        assert all(scored[i]["is_anomaly"] == int(v > limit) for i, v in s.items())
    assert [notes[k]["events_total"] for k in range(3)] == [1, 2, 3]


def test_live_percentile_of_large_and_empty_batches(spark, tmp_path):
    rng = np.random.default_rng(1)
    parts = [rng.exponential(1 + k, 20_000) for k in range(4)]
    frames = [spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "id int, anomaly_score double").repartition(5) for p in parts]
    for span in (1, 2):
        live = LivePercentile(spark, str(tmp_path / f"live{span}"), q=0.9, span=span, exact_rows=1000)
        for k, frame in enumerate(frames):
            got = live.threshold(frame, k)
            seen = np.concatenate(parts[max(0, k - span + 1):k + 1])
            assert abs((seen <= got).mean() - 0.9) < 0.01
    flagged, note = live.judge(frames[0].limit(0), 4, ["id"])
    row = note.first()
    assert flagged.count() == 0 and (row["scores"], row["any_anomaly"], row["last_score"]) == (0, 0, None)


def test_windows_and_counters_over_many_files(spark, rows, tmp_path):
    source = tmp_path / "in"
    for k, part in enumerate(in_files(rows, source, 3)):
        drop_in(part, source, k)
    stream = stream_of(spark, rows, source)
    tumbled = R.stream_tumble(stream, "1 day", "1 hour", ["entity"], F.sum("value").alias("total"))
    out = tmp_path / "tumble"
    tumbled.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "s1")).trigger(
        availableNow=True).start().awaitTermination()
    got = {(r["start"].replace(tzinfo=None), r["entity"]): r["total"] for r in spark.read.parquet(str(out)).collect()}
    newest = rows.agg(F.max("ts")).first()[0] - dt.timedelta(hours=1)
    want = {(r["s"], r["entity"]): r["t"] for r in rows.groupBy(F.window("ts", "1 day")["start"].alias("s"), "entity").agg(
        F.sum("value").alias("t")).collect() if r["s"] + dt.timedelta(days=1) <= newest}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    updates = tmp_path / "updates"
    run(stream.groupBy("entity").agg(F.count(F.lit(1)).alias("n")), writer(updates), tmp_path / "s2", "update")
    latest = R.latest_updates(spark.read.parquet(str(updates)), ["entity"], ["n"], "batch_id")
    assert {r["entity"]: r["n"] for r in latest.collect()} == {
        r["entity"]: r["count"] for r in rows.groupBy("entity").count().collect()}


def test_points_are_appended_once(spark, rows, tmp_path):
    write = K.append_points(str(tmp_path / "points"), "ts")
    named = rows.withColumn("measurement", F.lit("m"))
    for batch_id in (0, 1, 1):
        write(named.filter(F.col("event_id") % 2 == batch_id), batch_id)
    assert spark.read.parquet(str(tmp_path / "points")).count() == rows.count()


def test_progress_metrics(spark, rows, tmp_path):
    import time

    from sluice.streaming.metrics import ProgressMetrics

    source, listener = tmp_path / "in", ProgressMetrics()
    for k, part in enumerate(in_files(rows, source, 2)):
        drop_in(part, source, k)
    spark.streams.addListener(listener)
    try:
        run(stream_of(spark, rows, source), lambda df, batch_id: df.count(), tmp_path / "state")
        for _ in range(40):
            if len(listener._rows) >= 8:
                break
            time.sleep(0.25)
    finally:
        spark.streams.removeListener(listener)
    got = listener.drain(spark)
    assert got.filter("metric = 'batch_rows'").agg(F.sum("value")).first()[0] >= rows.count()
    assert listener.drain(spark).count() == 0


def test_scoring_stores_scores_and_not_their_windows(spark, rows, tmp_path, monkeypatch):
    stored, cut = [], R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", lambda df: stored.append(df.columns) or cut(df))
    store = A.ParameterStore(spark, str(tmp_path / "fit"))
    store.save(A.batch_moments(rows, ["value"]), 0)
    windows = W.sequence_windows(rows, ENTITY, ORDER, ["value"]).withColumn("kind", F.lit("row"))
    job = R.score_job(store, ["value"], LivePercentile(spark, str(tmp_path / "live")), [*ORDER, *ENTITY], writer(tmp_path / "s"), writer(tmp_path / "n"))
    job(windows, 0)
    assert len(stored) == 1 and "sequence" not in stored[0]
    assert spark.read.parquet(str(tmp_path / "s")).count() == windows.count()
