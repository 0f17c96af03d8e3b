"""The block way and the plain way give the same rows, one series holding most of them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import joins as J
from sluice.operators import series as R
from sluice.operators import windows as W

SPLIT = {"max_rows": 10, "block_rows": 37}


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(5)
    rows, at = [], 0
    for i in range(900):
        at += rnd.choice([0, 1, 1, 2, 7])
        entity = 1 if rnd.random() < 0.6 else rnd.randrange(2, 9)
        rows.append((entity, at, i, round(rnd.uniform(0, 100), 2) if rnd.random() > 0.1 else None))
    frame = spark.createDataFrame(rows, "entity int, t int, id int, value double")
    return frame.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("t"))).repartition(5).cache()


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def close(a, b):
    """Equal value by value, nulls only against nulls."""
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-9, abs=1e-9)), (a, b)


def test_row_index_is_the_sorted_position(skewed):
    got = R.with_row_index(skewed, ["t", "id"]).select("id", "row_index").collect()
    expected = [r["id"] for r in sorted(skewed.collect(), key=lambda r: (r["t"], r["id"]))]
    assert {r["id"]: r["row_index"] for r in got} == {v: i for i, v in enumerate(expected)}


@pytest.mark.parametrize("descending", [False, True])
def test_position_in_series(skewed, descending):
    plain = R.series_position(skewed, ["entity"], ["t", "id"], descending=descending)
    split = R.series_position(skewed, ["entity"], ["t", "id"], descending=descending, max_rows=10)
    assert rows_of(plain, "id", "position") == rows_of(split, "id", "position")


def test_rolling_features_over_blocks(skewed):
    args = (["entity"], ["t", "id"], ["value"], 5)
    names = ["id"] + [f"value__{p}" for p in ("last", "mean", "std", "min", "max", "slope", "zlast")]
    plain = {r["id"]: r for r in W.rolling_features(skewed, *args).select(*names).collect()}
    split = {r["id"]: r for r in W.rolling_features(skewed, *args, **SPLIT).select(*names).collect()}
    assert plain.keys() == split.keys()
    for k in plain:
        close(plain[k], split[k])


def test_sequences_and_look_ahead_over_blocks(skewed):
    args = (["entity"], ["t", "id"], ["value"], 6)
    assert rows_of(W.sequence_windows(skewed, *args), "id", "sequence") == rows_of(
        W.sequence_windows(skewed, *args, **SPLIT), "id", "sequence")

    def ahead(f, w):
        return f.withColumn("next", F.lead("id", 3).over(w))

    plain = R.over_series(skewed, ["entity"], ["t", "id"], ahead, after=3)
    split = R.over_series(skewed, ["entity"], ["t", "id"], ahead, after=3, **SPLIT)
    assert rows_of(plain, "id", "next") == rows_of(split, "id", "next")


def test_series_without_a_key(skewed):
    out = W.last_step(skewed, [], ["t", "id"], 30, block_rows=50)
    ids = [r["id"] for r in sorted(skewed.collect(), key=lambda r: (r["t"], r["id"]))][29:]
    assert sorted(r["id"] for r in out.collect()) == sorted(ids)


@pytest.mark.parametrize("descending", [False, True])
def test_carry_last(skewed, descending):
    sparse = skewed.withColumn("mark", F.when(F.col("id") % 41 == 0, F.col("id")))
    plain = R.carry_last(sparse, ["entity"], ["t", "id"], "mark", "m", descending)
    split = R.carry_last(sparse, ["entity"], ["t", "id"], "mark", "m", descending, **SPLIT)
    assert rows_of(plain, "id", "m") == rows_of(split, "id", "m")


def test_group_quantiles_equal_numpy(skewed):
    qs = [0.0, 0.05, 0.5, 0.9, 1.0]
    per_entity = {}
    for r in skewed.filter("value is not null").collect():
        per_entity.setdefault(r["entity"], []).append(r["value"])
    for limit in (10_000, 10):
        got = R.group_quantiles(skewed, ["entity"], "value", qs, max_rows=limit).collect()
        assert len(got) == len(per_entity)
        for r in got:
            assert r["quantiles"] == pytest.approx(list(np.quantile(per_entity[r["entity"]], qs)), rel=1e-12)
        whole = R.group_quantiles(skewed, [], "value", qs, max_rows=limit).first()["quantiles"]
        assert whole == pytest.approx(list(np.quantile(sum(per_entity.values(), []), qs)), rel=1e-12)


def test_quantiles_of_one_crowded_value(spark):
    frame = spark.createDataFrame([(5.0,)] * 300 + [(1.0,), (9.0,)], "v double")
    assert R.group_quantiles(frame, [], "v", [0.5, 1.0], max_rows=10).first()["quantiles"] == [5.0, 9.0]


def test_temporal_joins(skewed):
    left, right = skewed.filter("id % 3 = 0"), skewed.filter("value > 60")
    lrows, rrows = left.collect(), right.collect()
    for sizing in ({}, SPLIT):
        asof = {r["id"]: r["latest"] for r in J.asof_latest(left, right, ["entity"], "ts", "value", "latest", "id", **sizing).collect()}
        follow = {r["id"]: r["followup_value"] for r in
                  J.followup_join(left, right, ["entity"], 20, tie="id", **sizing).collect()}
        for l in lrows:
            past = [r for r in rrows if r["entity"] == l["entity"] and r["ts"] <= l["ts"]]
            best = max(past, key=lambda r: (r["ts"], r["id"]), default=None)
            assert asof[l["id"]] == (best["value"] if best else None)
            ahead = [r for r in rrows if r["entity"] == l["entity"] and l["t"] < r["t"] <= l["t"] + 20]
            first = min(ahead, key=lambda r: (r["ts"], r["id"]), default=None)
            assert follow.get(l["id"]) == (first["value"] if first else None)


def test_time_split_and_positional_align(skewed):
    a = W.time_split(skewed, ["entity"], ["t", "id"])
    b = W.time_split(skewed, ["entity"], ["t", "id"], max_rows=10)
    assert rows_of(a, "id", "part") == rows_of(b, "id", "part")
    scores = skewed.select("entity", F.col("t").alias("st"), F.col("id").alias("sid")).filter("sid % 2 = 0")
    feats = skewed.select("entity", "t", "id")
    x = J.positional_align(feats, scores, ["entity"], ["t", "id"], ["st", "sid"])
    y = J.positional_align(feats, scores, ["entity"], ["t", "id"], ["st", "sid"], max_rows=10)
    assert rows_of(x, "id", "sid") == rows_of(y, "id", "sid")


def test_moving_aggregate_equals_one_window(skewed):
    got = {r["id"]: r["rolling_mean"] for r in W.moving_aggregate(skewed, ["entity"], 30, block_seconds=60).collect()}
    rows = skewed.collect()
    for r in rows:
        inside = [s["value"] for s in rows if s["entity"] == r["entity"] and r["t"] - 30 <= s["t"] <= r["t"]
                  and s["value"] is not None]
        assert got[r["id"]] == (pytest.approx(sum(inside) / len(inside)) if inside else None)


def test_a_null_key_is_a_series_too(spark):
    rows = [(None if i % 3 else 1, i, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "entity int, t int, value double")
    for fn in (lambda **kw: R.series_position(df, ["entity"], ["t"], **kw).select("t", "position"),
               lambda **kw: R.carry_last(df, ["entity"], ["t"], "value", "m", **kw).select("t", "m"),
               lambda **kw: W.time_split(df, ["entity"], ["t"], **kw).select("t", "part"),
               lambda **kw: W.last_step(df, ["entity"], ["t"], 7, **kw).select("t"),
               lambda **kw: R.group_quantiles(df, ["entity"], "value", [0.3], **kw).select("entity", "quantiles")):
        plain = sorted(map(str, fn().collect()))
        split = sorted(map(str, fn(max_rows=5).collect()))
        assert plain == split and plain


def test_moving_aggregate_keeps_rows_without_a_time(spark):
    rows = [(1, "a", "2024-01-01 00:00:00", 1.0), (2, "a", None, 9.0), (3, "a", "2024-01-01 00:00:10", 3.0), (4, "a", None, 7.0), (5, "b", None, None)]
    df = spark.createDataFrame(rows, "id int, entity string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["id"]: r["rolling_mean"] for r in W.moving_aggregate(df, ["entity"], 30).collect()}
    assert got == {1: 1.0, 2: None, 3: 2.0, 4: None, 5: None}


@pytest.mark.parametrize("seconds", [1, 13, 600, 200_000])
def test_moving_aggregate_of_mixed_sizes_and_a_hot_stretch(spark, seconds):
    """A huge reading leaves no trace in frames without it; equal times, times before 1970, NaN and null keys."""
    rnd = random.Random(seconds)
    rows = []
    for i in range(500):
        at = rnd.choice([-3_000_000, 0, 5_000_000]) + rnd.randrange(40_000) / 16 if i % 3 else 700.0 + rnd.randrange(30) / 8
        value = rnd.choice([1e17, -1e17, 0.3, 0.1, 2.5, float("nan"), None])
        rows.append((i, None if i % 3 == 0 else i % 2, int(at * 1_000_000), value))
    df = spark.createDataFrame(rows, "id int, entity int, micros bigint, value double").withColumn("ts", F.timestamp_micros("micros"))
    got = {r["id"]: r["rolling_mean"] for r in W.moving_aggregate(df, ["entity"], seconds, block_seconds=2 * seconds).collect()}
    assert len(got) == len(rows)
    for i, entity, at, _ in rows:
        inside = [v for _, e, t, v in rows if e == entity and at - seconds * 1_000_000 <= t <= at and v is not None and v == v]
        if not inside:
            assert got[i] is None
        elif max(map(abs, inside)) < 10:
            assert got[i] == pytest.approx(sum(inside) / len(inside), rel=1e-12)
        else:
            assert got[i] == pytest.approx(np.sum(inside) / len(inside), abs=1e3)


def test_a_busy_stretch_is_spread(spark):
    rows = spark.range(2_000).select(F.lit(1).alias("entity"), F.timestamp_seconds(F.col("id") * 40).alias("ts"), (F.col("id") % 5).cast("double").alias("value"))
    rows = rows.withColumn("task", F.lit(0))
    out = W.moving_aggregate(rows, ["entity"], 2 * 86_400).withColumn("task", F.spark_partition_id())
    with_one = out.groupBy("task").count().agg(F.max("count")).first()[0]
    assert out.count() == 2_000 and with_one < 1_000


def test_group_quantiles_count_only_the_values_near_the_ranks(spark, monkeypatch):
    values = np.random.default_rng(5).normal(size=60_000).round(4)
    df = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(values)], "k bigint, v double")
    counted = []
    total = R.running_total
    monkeypatch.setattr(R, "running_total", lambda df, *rest: counted.append(df.count()) or total(df, *rest))
    qs = [0.9, 0.25, 0.0, 1.0]
    got = {r["k"]: r["quantiles"] for r in R.group_quantiles(df, ["k"], "v", qs, max_rows=5_000).collect()}
    assert got == {k: pytest.approx(np.quantile(values[k::2], qs), abs=1e-12) for k in (0, 1)}
    assert counted[0] < 2_000 and len(counted) == 1
    # A sketch that errs is noticed.
    monkeypatch.setattr(R.F, "percentile_approx", lambda c, ends, accuracy: F.array(*[F.lit(float(e)) for e in ends]))
    got = {r["k"]: r["quantiles"] for r in R.group_quantiles(df, ["k"], "v", qs, max_rows=5_000).collect()}
    assert got == {k: pytest.approx(np.quantile(values[k::2], qs), abs=1e-12) for k in (0, 1)}
    assert len(counted) == 3
