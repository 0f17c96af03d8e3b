"""NaN is a missing reading everywhere."""

import datetime as dt
import subprocess
import sys

import pytest

from sluice.operators import selection as G
from sluice.operators import windows as W

NAN = float("nan")


def test_selection_counts_nan_as_missing(spark):
    rows = [(NAN, 5.0, float(i), i % 2) for i in range(9)] + [(1.0, NAN, NAN, 1)]
    df = spark.createDataFrame(rows, "gone double, same double, moving double, label int")
    assert {r["feature"]: r["null_share"] for r in G.high_null_features(df, ["gone", "same", "moving"]).collect()} == {"gone": 0.9}
    static = {r["feature"]: (r["variance"], r["unique_values"]) for r in G.static_features(df, ["same", "moving"]).collect()}
    assert static == {"same": (0.0, 1)}
    info = {r["feature"]: r["importance"] for r in G.mutual_info(df, ["moving"]).collect()}
    zeros = {r["feature"]: r["importance"] for r in G.mutual_info(df.fillna(0.0), ["moving"]).collect()}
    assert info["moving"] > 0 and info == pytest.approx(zeros)


def test_rolling_features_need_real_values(spark):
    rows = [(i, dt.datetime(2024, 1, 1, 0, i), 1, NAN if i == 2 else float(i)) for i in range(6)]
    out = W.rolling_features(spark.createDataFrame(rows, "event_id int, ts timestamp_ntz, entity int, value double"),
                             ["entity"], ["ts", "event_id"], ["value"], 2).orderBy("ts").collect()
    assert [r["value__mean"] for r in out] == [0.5, None, None, 3.5, 4.5]
    assert out[1]["value__last"] is None


def test_one_nan_leaves_the_other_moving_means(spark):
    rows = [(i, dt.datetime(2024, 1, 1, 0, 0, i), 1, NAN if i == 3 else float(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp_ntz, entity int, value double")
    got = {r["event_id"]: r["rolling_mean"] for r in W.moving_aggregate(df, ["entity"], 1).collect()}
    assert got == {0: 0.0, 1: 0.5, 2: 1.5, 3: 2.0, 4: 4.0, 5: 4.5, 6: 5.5, 7: 6.5}


def test_a_missing_dependency_leaves_the_other_queries():
    script = ("import sys, warnings; sys.modules['corpus_pipeline'] = None; sys.modules['sluice.llm.queries'] = None\n"
              "import __spark_entry__ as E; names = E.queries(); print('tumble_mean' in names, any(n.startswith('op') for n in names if n[2:3].isdigit()))")
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, cwd=str(__import__("pathlib").Path(__file__).parents[1]))
    assert out.stdout.split() == ["True", "False"], out.stderr[-500:]


@pytest.mark.parametrize("n", [1, 40, 2500, 4999, 5000, 9000])
def test_a_sample_is_the_least_hashes(spark, n, monkeypatch):
    from pyspark.sql import functions as F

    from sluice.sources import readers

    df = spark.range(5000).repartition(6)
    tag = F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit("42")))
    want = {r["id"] for r in df.orderBy(tag, "id").limit(n).collect()}
    for top in (readers.TOP_ROWS, 10):
        monkeypatch.setattr(readers, "TOP_ROWS", top)
        assert {r["id"] for r in readers.sample_n(df, n, ["id"]).collect()} == want
