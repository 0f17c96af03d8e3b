"""Tree learners on many rows: cells of equal bins stand for all of them."""

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from sluice.operators import cells as C
from sluice.operators import explain as X
from sluice.operators import selection as G
from sluice.operators import trees

NAMES = ["a", "b", "few"]


@pytest.fixture(scope="module")
def table(spark):
    rnd = np.random.default_rng(8)
    x = np.c_[np.round(rnd.normal(size=6000), 1), rnd.integers(0, 9, 6000), rnd.integers(0, 3, 6000)]
    x[5, 0], x[6, 1] = float("inf"), 1e9
    rows = [(i, *map(float, r), float(min(r[0], 5.0) * r[2] + r[1] % 9 + e), int(r[1] % 9 > 5)) for i, (r, e) in enumerate(zip(x, rnd.normal(size=6000)))]
    return spark.createDataFrame(rows, "id int, a double, b double, few double, y double, kind int").cache()


def test_groups_count_every_row_and_keep_the_mean(table, monkeypatch):
    monkeypatch.setattr(C, "WHOLE_ROWS", 500)
    got = C.grouped(table, NAMES, "y")
    assert got.rows.agg(F.sum(C.WEIGHT)).first()[0] == 6000
    assert got.rows.agg(F.sum(F.col(C.WEIGHT) * F.col("y"))).first()[0] == pytest.approx(table.agg(F.sum("y")).first()[0])
    assert got.rows.count() <= 32 * 10 * 3 < table.count()
    assert got.values["few"] == [0.0, 1.0, 2.0] and len(got.values["b"]) == 10 and len(got.values["a"]) <= 32
    for c in NAMES:
        cuts = np.array(C.edges(got.values[c]))
        want = [got.values[c][k] for k in np.searchsorted(cuts, [r[c] for r in table.select(c).collect()], "left")]
        assert [r[c] for r in C.binned(table, got.values).select(c).collect()] == want
    labels = C.grouped(table, NAMES, "kind", classes=True).rows
    assert {tuple(r) for r in labels.groupBy("kind").agg(F.sum(C.WEIGHT).cast("int")).collect()} == {
        tuple(r) for r in table.groupBy(F.col("kind").cast("double")).agg(F.count(F.lit(1))).collect()}


def test_few_cells_are_dealt_over_several_groups(table, monkeypatch):
    monkeypatch.setattr(C, "WHOLE_ROWS", 60)
    got = C.grouped(table, ["few"], "y").rows
    assert 45 <= got.count() <= 60 and got.agg(F.sum(C.WEIGHT)).first()[0] == 6000
    monkeypatch.setattr(C, "WHOLE_ROWS", 6000)
    assert C.grouped(table, ["few"], "y").values is None


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_a_fit_on_cells_is_judged_and_explained_over_all_rows(table, monkeypatch, kind):
    whole = X.surrogate_fit(table, NAMES, ["id"], target="y", trees=8, depth=5, kind=kind)[1]
    monkeypatch.setattr(C, "WHOLE_ROWS", 500)
    model, quality = X.surrogate_fit(table, NAMES, ["id"], target="y", trees=8, depth=5, kind=kind)
    assert quality["r2"] == pytest.approx(whole["r2"], abs=0.05)
    train, test = X.hash_split(table, ["id"])
    scored = model.transform(X._assembled(test, NAMES))
    for m in ("rmse", "r2"):
        assert quality[m] == pytest.approx(RegressionEvaluator(labelCol="y", metricName=m).evaluate(scored), rel=1e-9)
    nodes, _ = trees.node_table(model)
    cuts = {c: C.edges(v) for c, v in C.bin_values(train, NAMES).items()}
    split = nodes[nodes["left"] >= 0]
    assert all(t in cuts[NAMES[int(f)]] for f, t in zip(split["feature"], split["threshold"]))
    # The root of a tree that takes every row holds the rows, not the cells.
    if kind == "forest":
        assert nodes[nodes["node"] == 0]["rows"].mean() == pytest.approx(train.count(), rel=0.1)
    phi = trees.tree_attribution(model, test, ["id"], NAMES).groupBy("id").agg(F.sum("phi").alias("phi"))
    apart = scored.join(phi, "id").select((F.col("prediction") - F.col("phi")).alias("base")).agg(F.max("base") - F.min("base")).first()[0]
    assert apart == pytest.approx(0.0, abs=1e-9)


def test_importance_on_cells_is_that_of_the_rows(table, monkeypatch):
    data = table.filter("a < 100")

    def found():
        return {r["feature"]: r["importance"] for r in G.forest_importance(data, NAMES, "kind", trees=8, depth=4).collect()}

    whole = found()
    monkeypatch.setattr(C, "WHOLE_ROWS", 500)
    assert found() == pytest.approx(whole, abs=0.05)


def test_many_columns_are_binned_in_one_pass(table):
    """Expressions nested over every bin of every column are compiled to code too long to be run fast."""
    values = {c: [float(k) for k in range(32)] for c in NAMES}
    got = C.binned(table.withColumn("few", F.when(F.col("id") == 1, float("nan")).when(F.col("id") > 1, F.col("few"))), values)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN") == 1  # the test's own
    rows = {r["id"]: r for r in got.filter("id < 3").collect()}
    assert rows[0]["few"] is None and np.isnan(rows[1]["few"]) and rows[2]["few"] in (0.0, 1.0, 2.0)
