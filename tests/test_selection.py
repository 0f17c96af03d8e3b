"""Feature selection against numpy on small frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import selection as G


@pytest.fixture(scope="module")
def chain(spark):
    """Three columns, each close to the one before it only."""
    rnd = np.random.default_rng(1)
    a = rnd.normal(size=400)
    b = a + 0.15 * rnd.normal(size=400)
    c = b + 0.15 * rnd.normal(size=400)
    far = rnd.normal(size=400)
    rows = [tuple(map(float, r)) for r in zip(a, b, c, far)]
    return np.array(rows), spark.createDataFrame(rows, "a double, b double, c double, far double").cache()


def test_a_dropped_column_still_drops_others(chain):
    values, df = chain
    r = np.abs(np.corrcoef(values.T))
    limit = (r[0, 1] + r[0, 2]) / 2
    assert r[0, 2] < limit < r[1, 2]
    got = {x["feature"]: x["first_partner"] for x in G.correlated_features(G.corr_matrix(df, df.columns), limit).collect()}
    assert got == {"b": "a", "c": "b"}


def test_correlation_of_rows_where_both_are_present(chain):
    values, df = chain
    gappy = df.withColumn("b", F.when(F.col("far") > -1, F.col("b"))).withColumn("flat", F.lit(1.0))
    got = {(x["a"], x["b"]): x["r"] for x in G.corr_matrix(gappy.repartition(5), gappy.columns).collect()}
    there = values[:, 3] > -1
    for i, a in enumerate(df.columns):
        for j, b in enumerate(df.columns[:i]):
            rows = values[there] if "b" in (a, b) else values
            assert got[b, a] == pytest.approx(abs(np.corrcoef(rows[:, i], rows[:, j])[0, 1]), abs=1e-12)
        assert got[a, "flat"] is None
    assert len(got) == 10


def test_static_and_null_limits_are_strict(spark):
    df = spark.createDataFrame([(1.0, 1.0, None), (1.0, 2.0, 1.0), (1.0, 3.0, None), (1.0, 4.0, 2.0)],
                               "flat double, x double, half double")
    assert [tuple(r) for r in G.static_features(df).collect()] == [("flat", 0.0, 1)]
    assert G.high_null_features(df, threshold=0.5).count() == 0
    assert [r["feature"] for r in G.high_null_features(df, threshold=0.49).collect()] == ["half"]


def test_importance_and_top(spark):
    rows = [(float(i % 2), float(i % 7), i % 2) for i in range(700)]
    df = spark.createDataFrame(rows, "exact double, noise double, label int")
    for equal_depth in (False, True):
        got = {r["feature"]: r["importance"] for r in G.mutual_info(df, ["exact", "noise"], bins=7, equal_depth=equal_depth).collect()}
        assert got["exact"] == pytest.approx(np.log(2), rel=1e-6) and abs(got["noise"]) < 1e-3
    forest = {r["feature"]: r["importance"] for r in G.forest_importance(df, ["exact", "noise"], trees=5, depth=3).collect()}
    assert forest["exact"] > 0.9
    imp = spark.createDataFrame([("a", 0.1), ("b", 0.5), ("c", 0.3)], "feature string, importance double")

    def names(**kw):
        return [r["feature"] for r in G.top_features(imp, **kw).orderBy("rank").collect()]

    assert names() == ["b", "c", "a"] and names(threshold=0.3) == ["b", "c"]
    assert names(n=1, threshold=0.3) == ["b"] and names(threshold=9.0) == ["b", "c", "a"]


def test_steps_run_on_survivors(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=300)
    rows = [(i, float(v), float(2 * v), 3.0, None if i % 3 else 1.0 * i, float(rnd.normal()), "Attack" if v > 0 else "Normal")
            for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, x double, twice double, flat double, sparse double, other double, Normal_Attack string")
    normal, attack = (df.filter(F.col("Normal_Attack") == v) for v in ("Normal", "Attack"))
    found, kept = G.run_selection(normal, attack, sample_size=100, sample_key=["id"], keep=["id"], top_n=1)
    assert found.removed == {"static_features": ["flat"], "high_null_features": ["sparse"], "correlated_features": ["twice"]}
    assert found.selected == ["x"] and kept.columns == ["id", "x", "Normal_Attack"] and kept.count() == 150
    assert found.removal_summary() == {"static_features": 1, "high_null_features": 1, "correlated_features": 1,
                                       "total_removed": 3, "final_features": 1}
    assert list(found.top_importance(1)) == ["x"]


def test_equal_depth_bins_of_ties_and_outliers(spark):
    """Exact cuts: a lone outlier does not stretch the bins, equal values share one, no rows give no bins."""
    rows = [(float(i % 8) if i else 1e9, 5.0, int(i % 8 >= 4)) for i in range(800)]
    df = spark.createDataFrame(rows, "x double, flat double, label int")
    got = {r["feature"]: r["importance"] for r in G.mutual_info(df, ["x", "flat"], bins=8, equal_depth=True, exact=True).collect()}
    assert got["x"] > 0.68 and abs(got["flat"]) < 1e-12
    assert G.mutual_info(df.limit(0), ["x", "flat"], equal_depth=True, exact=True).collect() == []
