"""The learners of a surrogate: one split for both, few tasks for short jobs, kept nodes for many trees."""

import numpy as np
import pytest

from sluice.operators import cells as C
from sluice.operators import explain as X
from sluice.plans import scoring

NAMES = ["a", "b"]


@pytest.fixture(scope="module")
def table(spark):
    x = np.random.default_rng(3).normal(size=(3000, 2)).round(1)
    rows = [(i, *map(float, r), float(r[0] * 2 + abs(r[1]))) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id int, a double, b double, y double").repartition(8).cache()


@pytest.mark.parametrize("whole", [500, 200_000])
def test_boosting_steps_take_few_tasks_and_every_row(table, monkeypatch, whole):
    monkeypatch.setattr(C, "WHOLE_ROWS", whole)
    seen = []

    class Learner(X.GBTRegressor):
        def fit(self, df, params=None):
            seen.append((df.rdd.getNumPartitions(), df.count()))
            return super().fit(df, params)

    monkeypatch.setattr(X, "GBTRegressor", Learner)
    split = X.surrogate_split(table, NAMES, ["id"], "y")
    _, quality = X.surrogate_fit(table, NAMES, ["id"], "y", "boosted", trees=5, depth=4, split=split)
    assert seen == [(1, split.learned.count)] and split.learned.rows.count() == split.learned.count
    assert X.surrogate_fit(table, NAMES, ["id"], "y", "boosted", trees=5, depth=4)[1] == pytest.approx(quality, rel=1e-6)
    monkeypatch.setattr(X, "STEP_ROWS", 200)
    X.surrogate_fit(table, NAMES, ["id"], "y", "boosted", trees=2, depth=2, split=split)
    parts = -(-split.learned.count // 200)
    assert seen[-1] == (min(parts, 8), split.learned.count)


def test_kept_nodes_give_the_same_forest(table, monkeypatch):
    def fit():
        model, quality = X.surrogate_fit(table, NAMES, ["id"], "y", trees=10, depth=5)
        return model.getCacheNodeIds(), model.totalNumNodes, quality

    kept, nodes, quality = fit()
    monkeypatch.setattr(X, "NODE_IDS", 1000)
    walked, others, same = fit()
    assert (kept, walked) == (True, False) and others == nodes and same == pytest.approx(quality, rel=1e-9)


def test_both_learners_of_the_query_share_one_split(spark, data_dir, monkeypatch):
    calls = []
    monkeypatch.setattr(X, "grouped", lambda *a, f=X.grouped, **b: calls.append(a[1]) or f(*a, **b))
    monkeypatch.setattr(X.surrogate_fit, "__defaults__", tuple(3 if d == 200 else d for d in X.surrogate_fit.__defaults__))
    rows = scoring.surrogate_fit(spark, data_dir).collect()
    assert [r["kind"] for r in rows] == ["forest", "boosted"] and all(r["rmse"] > 0 for r in rows)
    assert calls == [scoring.COLUMNS]
