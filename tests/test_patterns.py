"""Pattern mining against a plain sequential statement of its rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import patterns as P

TH = P.Thresholds(drop_below=40.0, rise_above=55.0, min_drop=5.0, min_rise=12.5, followup_seconds=15, cooldown_seconds=20)


def sequential(rows, th):
    """(matches, kept) per the rules, one series at a time; rows are (t, id, a, b)."""
    matches, kept = [], []
    for entity in sorted({r[0] for r in rows}):
        series = sorted((r[1:] for r in rows if r[0] == entity), key=lambda r: (r[0], r[1]))
        last = None
        for (_, _, a0, _), (t, i, a1, b1), place in zip(series, series[1:], range(1, len(series))):
            if a0 is None or a1 is None or a0 - a1 < th.min_drop or a1 >= th.drop_below:
                continue
            hit = next((s for s in series[place + 1:] if s[0] <= t + th.followup_seconds and s[3] is not None
                        and s[3] > th.rise_above and (0.0 if b1 is None else s[3] - b1) >= th.min_rise), None)
            if hit is None:
                continue
            matches.append((entity, i, hit[0]))
            if last is None or t - last >= th.cooldown_seconds:
                kept.append((entity, i, hit[0]))
                last = hit[0]
    return sorted(matches), sorted(kept)


@pytest.fixture(scope="module", params=[1, 2])
def series(request, spark):
    rnd, rows, at = random.Random(request.param), [], 0
    for i in range(1500):
        at += rnd.choice([0, 0, 1, 1, 2, 5]) if rnd.random() > 0.01 else 90
        entity = 1 if rnd.random() < 0.7 else rnd.randrange(2, 5)
        value = lambda: None if rnd.random() < 0.06 else rnd.choice([rnd.uniform(0, 100), float(rnd.randrange(0, 100, 5)) / 2])
        rows.append((entity, at, i, value(), value()))
    df = spark.createDataFrame(rows, "entity int, t int, event_id int, a double, b double").repartition(4)
    return rows, df.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("t"))).cache()


def picked(df):
    seconds = (F.unix_timestamp("ts") - 1704067200).alias("t")
    return sorted(map(tuple, df.select("entity", "drop_id", seconds).collect()))


@pytest.mark.parametrize("th", [TH, P.Thresholds(40.0, 55.0, 5.0, 0.0, 15, 0)])
def test_equal_to_the_sequential_rules(series, th):
    rows, df = series
    matches, kept = sequential(rows, th)
    assert len(matches) > 30
    found = P.cut_lineage(P.drop_then_rise(df, ["entity"], "a", "b", th=th, block_seconds=100))
    assert picked(found) == matches
    assert picked(P.cooldown(found, ["entity"], th.cooldown_seconds, th.followup_seconds)) == kept
    spread = P.cooldown(found, ["entity"], th.cooldown_seconds, None, fold_rows=0)
    assert picked(spread) == kept
    blocks = P.drop_then_rise(df, ["entity"], "a", "b", th=th, block_seconds=3600, max_rows=50, block_rows=80)
    assert picked(blocks) == matches
    held = P.cooldown(found, ["entity"], th.cooldown_seconds, th.followup_seconds, fold_rows=0, max_rows=5, block_rows=9)
    assert picked(held) == kept


def test_one_crowded_instant_and_null_keys(spark):
    """All rows of the follow-up at one time, in list order; a null series is a series."""
    rows = [(None, 0, 0, 9.0, 1.0), (None, 1, 1, 1.0, 1.0)] + [(None, 1, i, 1.0, 10.0 + i) for i in range(2, 60)]
    df = spark.createDataFrame(rows, "entity int, t int, event_id int, a double, b double")
    df = df.withColumn("ts", F.timestamp_seconds("t"))
    th = P.Thresholds(5.0, 20.0, 1.0, 25.0, 0, 0)
    got = P.drop_then_rise(df, ["entity"], "a", "b", th=th).collect()
    assert [(r["drop_id"], r["rose_to"]) for r in got] == [(1, 26.0)]


def test_first_rises():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 100):
        level = rnd.normal(size=n)
        start, need = rnd.integers(0, n + 1, 50), rnd.normal(size=50)
        got = P.first_rises(level, start, need)
        for s, q, g in zip(start, need, got):
            assert g == next((k for k in range(s, n) if level[k] >= q), -1)


def test_least_level_is_the_exact_boundary():
    rnd = np.random.default_rng(4)
    base = rnd.uniform(-1e3, 1e3, 500)
    need = P.least_level(base, 0.1)
    assert (need - base >= 0.1).all() and (np.nextafter(need, -np.inf) - base < 0.1).all()


def test_event_text(spark):
    rows = [(1, 0, 0, 9.0, 500.0), (1, 5, 1, 2.0, 500.0), (1, 9, 2, 2.0, 520.25)]
    df = spark.createDataFrame(rows, "entity int, t int, event_id int, a double, b double").withColumn(
        "ts", F.timestamp_seconds(F.lit(1704067200) + F.col("t")))
    event = P.detect(df, ["entity"], "a", "b").first()
    assert event["details"] == ("FIT dropped from 9.0 to 2.0 at 2024-01-01T00:00:05, LIT rose to 520.25 (Δ=20.25) "
                                "at 2024-01-01T00:00:09")
    assert event["pattern"] == "FIT_drop_then_LIT_rise" and event["severity"] == 1.0
    assert P.pattern_alert(P.detect(df, ["entity"], "a", "b")).count() == 1


def test_thresholds_and_guard_rails(spark):
    rnd = random.Random(8)
    def tuned(a, b, **kw):
        df = spark.createDataFrame([(x, y, "Normal") for x, y in zip(a, b)] + [(1e9, -1e9, "Attack")],
                                   "a double, b double, label string")
        return P.tune_thresholds(df, "a", "b", "label", **kw)

    a, b = [rnd.uniform(2, 4) for _ in range(300)], [rnd.uniform(450, 560) for _ in range(300)]
    th = tuned(a, b)
    assert th.drop_below == pytest.approx(np.quantile(a, 0.05)) and th.rise_above == pytest.approx(np.quantile(b, 0.95))
    assert th.min_drop == pytest.approx(0.1 * (max(a) - min(a))) and th.min_rise == pytest.approx(0.1 * (max(b) - min(b)))
    spread = tuned(a, b, max_rows=10)
    assert spread.drop_below == pytest.approx(th.drop_below) and spread.rise_above == pytest.approx(th.rise_above)
    low = tuned([0.5] * 10, [399.0] * 10)
    assert (low.drop_below, low.rise_above, low.min_drop, low.min_rise) == (3.0, 512.0, 0.1, 1.0)
    high = tuned([6.0] * 10, [601.0] * 10)
    assert (high.drop_below, high.rise_above) == (3.0, 512.0)
    with pytest.raises(ValueError):
        tuned([], [])
