"""Scores, thresholds, moments, forecasts and attributions on hand-made rows."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import anomaly as A
from sluice.operators import explain as X
from sluice.operators import forecast as J
from sluice.operators import trees
from sluice.operators import tsquery as Q
from sluice.operators import windows as W


def test_threshold_edges(spark):
    equal = spark.createDataFrame([("e", i, 4.0) for i in range(5)] + [("one", 0, 7.0)] +
                                  [("zero", i, -1.0) for i in range(3)], "g string, i int, anomaly_score double")
    flagged = A.percentile_threshold(equal, ["g"])
    assert flagged.agg(F.sum("is_anomaly")).first()[0] == 0
    got = {r["g"]: r for r in A.score_batch_summary(flagged, ["g"], ["i"]).collect()}
    assert got["one"]["threshold"] == 7.0 and got["one"]["normalised_score"] == 1.0
    assert got["zero"]["normalised_score"] == 0.0 and got["e"]["any_anomaly"] == 0
    scores = spark.createDataFrame([("a", i, float(i)) for i in range(101)], "g string, i int, anomaly_score double")
    out = A.percentile_threshold(scores, [])
    assert out.first()["threshold"] == 90.0 and out.filter("is_anomaly = 1").count() == 10


def test_reconstruction_is_the_residual_of_the_leading_directions(spark):
    rnd = np.random.default_rng(0)
    base = rnd.normal(size=(200, 2))
    x = np.c_[base[:, 0], base[:, 0] * 2 + 0.01 * rnd.normal(size=200), base[:, 1]]
    df = spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate(x)], "entity int, t int, a double, b double, c double")
    model = A.fit_reconstruction(df, ["a", "b", "c"], 2)
    z = (x - x.mean(0)) / x.std(0)
    _, _, vt = np.linalg.svd(z - z.mean(0))
    err = ((z - z @ vt[:2].T @ vt[:2]) ** 2).sum(1)
    scored = A.reconstruction_score(df, model, ["entity"], ["t"], 30).orderBy("t").collect()
    expected = np.convolve(err, np.ones(30), "valid")
    assert len(scored) == 171 and [r["anomaly_score"] for r in scored] == pytest.approx(list(expected), rel=1e-6, abs=1e-9)


def test_window_edges(spark):
    def frame(n):
        return spark.createDataFrame([(1, i, 5.0) for i in range(n)], "entity int, t int, v double")

    assert W.last_step(frame(29), ["entity"], ["t"]).count() == 0
    assert W.last_step(frame(30), ["entity"], ["t"]).count() == 1
    assert W.sequence_windows(frame(31), ["entity"], ["t"], ["v"]).count() == 2
    feats = W.proxy_score(W.rolling_features(frame(30), ["entity"], ["t"], ["v"])).first()
    assert feats["v__std"] == 0.0 and feats["v__zlast"] is None and feats["anomaly_score_proxy"] == 0.0
    holed = frame(40).withColumn("v", F.when(F.col("t") != 20, F.col("v")))
    rows = W.rolling_features(holed, ["entity"], ["t"], ["v"], 5).orderBy("t").collect()
    assert [r["t"] for r in rows] == list(range(4, 40))
    assert [r["t"] for r in rows if r["v__mean"] is None] == [20, 21, 22, 23, 24]


def test_moments_merge_to_one_fit(spark):
    rnd = np.random.default_rng(5)
    x = 1e6 + rnd.normal(size=500)
    df = spark.createDataFrame([(int(i % 7), float(v), None if i % 5 else float(i)) for i, v in enumerate(x)], "b int, x double, y double")
    got = A.moments_of(A.merge_moments(A.batch_moments(df, ["x", "y"], ["b"])))
    assert got["x"] == (pytest.approx(x.mean(), rel=1e-12), pytest.approx(x.std(), rel=1e-9))
    assert got["y"][1] == pytest.approx(np.arange(0, 500, 5).std())


def test_evaluation(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "y int, p int")
    assert A.f1_eval(df, "y", "p").first()["f1"] == pytest.approx(4 / 6)
    none = spark.createDataFrame([(0, 0)], "y int, p int")
    assert A.f1_eval(none, "y", "p").first()["f1"] == 0.0
    matrix, classes = A.confusion_report(df, "y", "p")
    assert matrix.agg(F.sum("n")).first()[0] == 5
    by = {r["class"]: r for r in classes.collect()}
    assert by[1]["precision"] == pytest.approx(2 / 3) and by[0]["recall"] == 0.5 and by[1]["support"] == 3


def test_grid_keeps_the_first_best(spark):
    rows = [(float(i), 1) for i in range(100)] + [(1000.0 + i, -1) for i in range(5)]
    df = spark.createDataFrame(rows, "x double, y int")
    got = A.grid_search_f1(df, df.filter("y = 1"), ["x"], "y", [0.0, 0.0, 0.5]).collect()
    assert [r["best"] for r in got] == [True, False, False] and got[0]["f1"] == 1.0


def test_forecast_edges(spark):
    line = spark.createDataFrame([(1, i, 2.0 * i) for i in range(25)] + [(2, 0, 7.0)], "entity int, t int, value double")
    got = {(r["entity"], r["step"]): r["forecast"] for r in J.forecast(line, ["entity"], ["t"]).collect()}
    assert got[1, 10] == pytest.approx(68.0) and got[2, 10] == 7.0 and len(got) == 20
    back = J.forecast_backtest(line, ["entity"], ["t"])
    split = J.forecast_backtest(line, ["entity"], ["t"], max_rows=5, block_rows=12)
    key = ["entity", "t", "step", "actual"]
    assert sorted(map(tuple, back.select(key).collect())) == sorted(map(tuple, split.select(key).collect()))
    assert back.agg(F.max("error")).first()[0] == pytest.approx(0.0, abs=1e-9)
    pairs = spark.createDataFrame([(1.0, 0.0), (1.1, 1.0), (1.2, 1.0)], "actual double, forecast double")
    out = J.forecast_deviation(pairs).collect()
    assert out[0]["deviation"] is None and [r["alert"] for r in out] == [False, True, True]


def test_attributions(spark):
    zero = spark.createDataFrame([(1, 1, "a", 0.0), (1, 1, "b", 0.0)], "entity int, t int, feature string, phi double")
    assert {r["normalised"] for r in X.mean_abs_importance(zero).collect()} == {0.0}
    assert {r["scaled"] for r in X.topk_last(zero, ["entity"], ["t"]).collect()} == {0.0}
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(300, 3))
    rows = [(i, *map(float, r), float(3 * r[0] - r[1])) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, lstm_score double").cache()
    fit = X.linear_surrogate(df, ["a", "b", "c"])
    assert fit.weights == pytest.approx([3.0, -1.0, 0.0], abs=1e-6)
    model, quality = X.surrogate_fit(df, ["a", "b", "c"], ["id"], trees=10, depth=5)
    assert quality["r2"] > 0.5
    few = df.filter("id < 20")
    phi = X.tree_attribution(model, few, ["id"], ["a", "b", "c"])
    mean = {r["feature"]: r["importance"] for r in X.mean_abs_importance(phi).collect()}
    assert mean["a"] > mean["b"] > mean["c"]


@pytest.mark.parametrize("kind, cells", [("forest", 1 << 20), ("forest", 0), ("boosted", 1 << 20)])
def test_tree_contributions_equal_all_subsets(spark, monkeypatch, kind, cells):
    """Against the game itself: every subset of known features, unknown splits followed both ways."""
    monkeypatch.setattr(trees, "GRID_CELLS", cells)
    names, rnd = ["a", "b", "c", "d"], np.random.default_rng(6)
    x = np.round(rnd.normal(size=(300, 4)), 2)
    data = [(i, *map(float, r), float(3 * r[0] * r[3] - r[1])) for i, r in enumerate(x)]
    df = spark.createDataFrame(data, "id int, a double, b double, c double, d double, lstm_score double")
    model, _ = X.surrogate_fit(df, names, ["id"], trees=6, depth=5, kind=kind)
    nodes, weights = trees.node_table(model)
    held = {(r.tree, r.node): r for r in nodes.itertuples()}

    def value(tree, node, row, known):
        n = held[tree, node]
        if n.left < 0:
            return n.prediction
        if n.feature in known:
            return value(tree, n.left if row[n.feature] <= n.threshold else n.right, row, known)
        both = [held[tree, k] for k in (n.left, n.right)]
        return sum(k.rows * value(tree, k.node, row, known) for k in both) / n.rows

    def game(row, known):
        return sum(w * value(t, 0, row, known) for t, w in enumerate(weights))

    few = df.filter("id < 12")
    got = {(r["id"], r["feature"]): r["phi"] for r in trees.tree_attribution(model, few, ["id"], names).collect()}
    predicted = {r["id"]: r["prediction"] for r in model.transform(X._assembled(few, names)).collect()}
    for i in range(12):
        values = {s: game(x[i], s) for k in range(5) for s in itertools.combinations(range(4), k)}
        for f in range(4):
            want = sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (values[tuple(sorted((*s, f)))] - v)
                       for s, v in values.items() if f not in s)
            assert got[i, names[f]] == pytest.approx(want, abs=1e-9)
        assert sum(got[i, n] for n in names) == pytest.approx(predicted[i] - values[()], abs=1e-9)


def test_covariance_distance_and_merging(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(400, 3)) @ rnd.normal(size=(3, 3)) + 5
    rows = [(i, *map(float, r), float(2 * r[0])) for i, r in enumerate(x)]
    df = spark.createDataFrame([*rows, (400, None, 1.0, 1.0, 1.0)], "id int, a double, b double, c double, twice double")
    names = ["a", "b", "c"]
    fit = A.fit_covariance(df, names)
    far = {r["id"]: r["d"] for r in df.filter("id < 400").select("id", fit.distance().alias("d")).collect()}
    inverse = np.linalg.inv(np.cov(x.T, bias=True))
    centred = x - x.mean(axis=0)
    assert [far[i] for i in range(400)] == pytest.approx(np.einsum("ij,jk,ik->i", centred, inverse, centred))
    parts = [A.fit_covariance(df.filter(F.col("id") % 3 == k), names) for k in range(3)]
    whole = parts[0].merged(parts[1]).merged(parts[2])
    assert whole.n == 400 and whole.mean == pytest.approx(fit.mean) and whole.spread == pytest.approx(fit.spread)
    # A column that another determines changes nothing.
    more = A.fit_covariance(df, [*names, "twice"]).distance()
    assert [r["d"] for r in df.filter("id < 20").select(more.alias("d")).collect()] == pytest.approx([far[i] for i in range(20)])
    out = A.covariance_boundary(df, df.filter("id < 400"), names, 0.05)
    assert out.filter("predicted = -1").count() == 20
    assert A.covariance_boundary(df, df.limit(0), names).filter("predicted = -1").count() == 0


def test_widening_range(spark):
    import datetime as dt
    now = dt.datetime(2024, 1, 10)
    spans = [dt.timedelta(hours=1), dt.timedelta(days=1)]
    df = spark.createDataFrame([(now - dt.timedelta(hours=5),), (now - dt.timedelta(days=5),), (now + dt.timedelta(days=1),)],
                               "ts timestamp_ntz")
    span, rows = Q.widening_range(df, now, spans)
    assert span == 1 and rows.count() == 1
    span, rows = Q.widening_range(df.filter("ts < timestamp_ntz'2024-01-06'"), now, spans)
    assert span == 2 and rows.count() == 1


def test_parameter_store_takes_the_newest(spark, tmp_path):
    store = A.ParameterStore(spark, str(tmp_path / "p"))
    assert store.latest() is None
    for v in (1, 12, 3):
        store.save(spark.createDataFrame([(v,)], "v int"), v)
    assert store.latest_version() == 12 and store.latest().first()["v"] == 12


def test_surrogate_queries_do_the_operators_whole_job(spark, data_dir, monkeypatch):
    from sluice.plans import scoring

    fits, explained = [], []

    def fit(data, columns, ids, **options):
        fits.append(options)
        return None, {"rmse": 0.0, "r2": 0.0}

    def explain(model, rows, *others, **options):
        explained.append(rows.count())
        return rows.withColumn("phi", F.lit(0.0))

    monkeypatch.setattr(scoring.X, "surrogate_fit", fit)
    monkeypatch.setattr(scoring.X, "tree_attribution", explain)
    scoring.surrogate_fit(spark, data_dir)
    scoring.forest_attribution(spark, data_dir)
    assert [x.get("kind", "forest") for x in fits] == ["forest", "boosted", "forest"]
    assert not any({"trees", "depth"} & set(x) for x in fits)
    assert explained == [scoring.surrogate(spark, data_dir).count()]


def test_directions_merged_over_batches_are_those_of_one_fit(spark):
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(400, 2))
    x = np.c_[base[:, 0] * 5 + 40, base[:, 0] - base[:, 1], base[:, 1] * 3 + 10, rnd.normal(size=400)]
    rows = [(i, i % 7 if i < 300 else 9, *[None if rnd.random() < 0.05 else float("nan") if rnd.random() < 0.05 else float(v) for v in r]) for i, r in enumerate(x)]
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "t int, part int, a double, b double, c double, d double")
    merged = A.merge_co_moments(A.batch_co_moments(df, names, ["part"]).drop("part"))
    for model in (A.reconstruction_of(merged, names, 2), A.fit_reconstruction(df, names, 2)):
        shown = np.array([[0.0 if v is None or v != v else v for v in r[2:]] for r in rows])
        mean = [np.mean([r[j] for r in rows if r[j] is not None and r[j] == r[j]]) for j in range(2, 6)]
        std = [np.std([r[j] for r in rows if r[j] is not None and r[j] == r[j]]) for j in range(2, 6)]
        z = (shown - mean) / std
        _, _, vt = np.linalg.svd(z - z.mean(0), full_matrices=False)
        want = ((z - z @ vt[:2].T @ vt[:2]) ** 2)
        got = np.array([[r[c] for c in names] for r in model.residuals(df).orderBy("t").collect()])
        assert got == pytest.approx(want, rel=1e-7, abs=1e-9)


def test_a_direction_batch_run_again_counts_once(spark, tmp_path):
    from sluice.streaming.processors import directions_job

    df = spark.createDataFrame([(i, float(i), float(i * i % 11)) for i in range(60)], "t int, a double, b double")
    store = A.ParameterStore(spark, str(tmp_path / "directions"))
    job = directions_job(store, ["a", "b"])
    for batch, number in ((df.filter("t < 20"), 0), (df.filter("t >= 20"), 1), (df.filter("t >= 20"), 1), (df.limit(0), 2)):
        job(batch, number)
    got = {(r["a"], r["b"]): (r["n"], r["mean_a"], r["c"]) for r in store.latest().collect()}
    one = {(r["a"], r["b"]): (r["n"], r["mean_a"], r["c"]) for r in A.batch_co_moments(df, ["a", "b"]).collect()}
    assert store.latest_version() == 3 and set(got) == set(one) == {("a", None), ("b", None), ("a", "a"), ("a", "b"), ("b", "b")}
    assert all(got[p] == pytest.approx(one[p]) for p in one)
    empty = A.reconstruction_of(A.batch_co_moments(df.limit(0), ["a", "b"]), ["a", "b"], 1)
    assert empty.moments == {"a": (0.0, 0.0), "b": (0.0, 0.0)}


def test_errors_ranked_per_step(spark):
    rows = [(1, "a", 2.0), (1, "a", 4.0), (1, "b", 3.0), (1, "c", None), (2, "a", 1.0), (2, "b", 5.0)]
    got = [tuple(r) for r in J.error_ranking(spark.createDataFrame(rows, "step int, field string, error double")).orderBy("step", "rank").collect()]
    assert got == [(1, "a", 3.0, 2, 1), (1, "b", 3.0, 1, 2), (1, "c", None, 0, 3), (2, "b", 5.0, 1, 1), (2, "a", 1.0, 1, 2)]


def test_random_features_approach_the_kernel():
    x = np.random.default_rng(1).normal(size=(60, 4))
    waves = A.kernel_waves(4, [0.25, 0.01], 256)
    phi = A._waves(x, waves)
    gaps = ((x[:, None] - x[None]) ** 2).sum(2)
    for g, gamma in enumerate([0.25, 0.01]):
        assert np.abs(phi[g] @ phi[g].T - np.exp(-gamma * gaps)).max() < 5 * 0.7 / 256 ** 0.5
    assert np.abs(np.diag(phi[0] @ phi[0].T) - 1).max() < 1e-9


def test_kernel_grid_against_the_exact_kernel(spark):
    rnd = np.random.default_rng(2)
    inner, outer = rnd.normal(size=(300, 2)), rnd.normal(size=(30, 2)) + 12
    rows = [(float(a), float(b), 1) for a, b in inner] + [(float(a), float(b), -1) for a, b in outer]
    df = spark.createDataFrame(rows + [(None, float("nan"), 1)], "a double, b double, y int")
    got = A.kernel_grid_f1(df, df.filter("y = 1"), ["a", "b"], "y", nus=[0.01, 0.1], gammas=["scale", 0.01]).collect()
    z = np.vstack([(inner - inner.mean(0)) / inner.std(0), np.zeros((1, 2))])
    assert [(r["nu"], r["gamma"]) for r in got] == [(0.01, "scale"), (0.01, "0.01"), (0.1, "scale"), (0.1, "0.01")]
    assert sum(r["best"] for r in got) == 1
    for r in got:
        exact = np.exp(-r["width"] * ((z[:, None] - z[None]) ** 2).sum(2)).mean(1)
        assert abs(r["boundary"] - np.quantile(exact, r["nu"])) < 0.06
    assert max(r["f1"] for r in got) > 0.9
    none = df.filter("y = 1").limit(0)
    assert A.kernel_grid_f1(df, none, ["a", "b"], "y").count() == 0


def test_rolled_sketches_equal_a_direct_sketch(spark):
    df = spark.range(40000).selectExpr("timestamp_ntz'2024-01-01' + make_dt_interval(0, id % 48) AS ts", "id % 9000 AS e", "cast(id % 7 AS double) AS d",
                                       "id % 2 AS field").unionByName(
        spark.sql("SELECT cast(null AS timestamp_ntz) ts, 1L e, 1D d, 0L field UNION ALL SELECT timestamp_ntz'2024-01-01', null, null, 0L"))
    rolled = Q.distinct_rollup(Q.distinct_sketches(df, "1 hour", ["field"], "e"), "1 day", ["field"])
    direct = Q.distinct_rollup(Q.distinct_sketches(df, "1 day", ["field"], "e"), "1 day", ["field"])
    a = {(r["start"], r["field"]): r["n_distinct"] for r in rolled.collect()}
    assert a == {(r["start"], r["field"]): r["n_distinct"] for r in direct.collect()} and len(a) == 4
    exact = df.filter("ts IS NOT NULL").groupBy(F.window("ts", "1 day").alias("w"), "field").agg(F.countDistinct("e").alias("n"))
    for r in exact.collect():
        assert abs(a[r["w"]["start"], r["field"]] / r["n"] - 1) < 0.02
    sevens = Q.distinct_rollup(Q.distinct_sketches(df, "1 day", [], "d"), "1 day", [])
    assert {r["n_distinct"] for r in sevens.collect()} == {7}


def test_short_series_have_no_live_forecast(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(12)] + [("b", 0, 1.0)], "k string, t int, value double")
    got = {(r["k"], r["step"]): r["forecast"] for r in J.forecast(df, ["k"], ["t"], least=10).collect()}
    assert set(k for k, _ in got) == {"a"} and got["a", 1] == pytest.approx(12.0)


def test_kernel_density_in_blocks_equals_the_features(monkeypatch):
    rnd = np.random.default_rng(4)
    x, waves, centre = rnd.normal(size=(45, 3)), A.kernel_waves(3, [0.3, 0.01], 32), rnd.normal(size=(2, 64))
    monkeypatch.setattr(A, "KERNEL_BLOCK", 20)
    want = np.matmul(A._waves(x, waves), centre[:, :, None])[:, :, 0].T
    assert A.kernel_density(x, waves, centre) == pytest.approx(want, abs=1e-12)
    assert A.kernel_density(x[:0], waves, centre).shape == (0, 2)


def test_wide_contributions_tell_what_the_long_ones_do(spark, monkeypatch):
    """Whole subtrees are looked up at once, whatever fits into a table, and rows need not be made long."""
    names, rnd = [f"f{i}" for i in range(7)], np.random.default_rng(9)
    x = rnd.normal(size=(400, 7))
    rows = [(i, *map(float, r), float(3 * r[0] * r[3] - r[1] + r[6])) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} double" for n in names) + ", lstm_score double").cache()
    model, _ = X.surrogate_fit(df, names, ["id"], trees=5, depth=6)
    monkeypatch.setattr(trees, "GRID_CELLS", 0)
    nodes, weights = trees.node_table(model)
    found = []
    for cells in (1 << 22, 0):
        monkeypatch.setattr(trees, "SUBTREE_CELLS", cells)
        paths = trees.paths_of(nodes, weights, 7)
        found.append((len(paths.subtrees), trees.Contributions(paths)(x)))
    assert found[0][0] * 3 < found[1][0] == len(paths.leaves)
    assert found[0][1] == pytest.approx(found[1][1], abs=1e-12)
    long = X.tree_attribution(model, df, ["id"], names)
    wide = X.tree_attribution(model, df, ["id"], names, wide=True)
    assert wide.columns == ["id", *names] and wide.count() == 400
    for got, want in ((X.mean_abs_importance(wide, names), X.mean_abs_importance(long)),
                      (X.topk_last(wide, [], ["id"], 4, names), X.topk_last(long, [], ["id"], 4))):
        got, want = ({r["feature"]: r for r in f.collect()} for f in (got, want))
        assert got.keys() == want.keys()
        assert all(got[k][c] == pytest.approx(want[k][c]) for k in got for c in want[k].asDict())
