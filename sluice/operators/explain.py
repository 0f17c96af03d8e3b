"""Surrogate models of anomaly scores and the contribution of each feature."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice import schema as S
from sluice.functions.clean import zscore_normalise
from sluice.operators.cells import Grouped, cell_moments, grouped
from sluice.operators.selection import TREE_MEMORY_MB, at_full_width
from sluice.operators.trees import tree_attribution  # noqa: F401 - belongs to the explanations
from sluice.operators.windows import rolling_sum
from sluice.session import cut_lineage

#: Rows that one task of a boosting step takes; starting a task costs as much as some 50,000 of them.
STEP_ROWS = 50_000
#: Up to this many (row, tree) pairs a forest keeps each row's node (4 bytes) from level to level; beyond, rows walk down again.
NODE_IDS = 200_000_000


def surrogate_part(rows: DataFrame, label: int, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
                   length: int = S.SEQUENCE_LENGTH) -> DataFrame:
    """One class: normalised by its own moments, the rows ending a full window, their
    window score and the label."""
    scaled = zscore_normalise(rows, columns)
    energy = sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0))
    scored = rolling_sum(scaled, keys, order, energy, "lstm_score", length)
    return scored.withColumn("label", F.lit(label))


def surrogate_dataset(normal: DataFrame, attack: DataFrame, keys: Sequence[str], order: Sequence[str],
                      columns: Sequence[str], length: int = S.SEQUENCE_LENGTH) -> DataFrame:
    return surrogate_part(normal, 0, keys, order, columns, length).unionByName(
        surrogate_part(attack, 1, keys, order, columns, length))


def _assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(df)


def hash_split(df: DataFrame, key: Sequence[str], test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A split that is the same on every run and every partitioning."""
    share = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(10_000)) < int(test * 10_000)
    return df.filter(~share), df.filter(share)


@dataclass(frozen=True)
class SurrogateSplit:
    """What is learned, and the held-out fifth: its rows, or where cells are learned its cells."""

    learned: Grouped
    test: DataFrame


def surrogate_split(df: DataFrame, columns: Sequence[str], key: Sequence[str], target: str = "lstm_score", seed: int = 42) -> SurrogateSplit:
    """Both sides of ``surrogate_fit``, for several learners to share. Many rows are learned and judged as cells of
    equal bins (``operators.cells``)."""
    train, test = hash_split(at_full_width(df).dropna(subset=list(columns)), key, 0.2, seed)
    learned = grouped(train, columns, target, seed=seed)
    return SurrogateSplit(learned, cut_lineage(cell_moments(test, learned.values, target)) if learned.values else test)


def _for_steps(learned: Grouped) -> DataFrame:
    """Boosting runs ``trees * depth`` short jobs one after another: few rows go to few tasks, whatever the cores."""
    width, parts = learned.rows.sparkSession.sparkContext.defaultParallelism, -(-learned.count // STEP_ROWS)
    return learned.rows.repartition(max(1, parts)) if parts < width else learned.rows


def surrogate_fit(df: DataFrame, columns: Sequence[str], key: Sequence[str], target: str = "lstm_score",
                  kind: str = "forest", trees: int = 200, depth: int | None = None, rate: float = 0.1,
                  subsample: float = 0.8, seed: int = 42, split: SurrogateSplit | None = None):
    """(model, {rmse, r2} on the held-out fifth) for a random forest or boosted trees. ``split`` is that of
    ``surrogate_split`` for the same arguments, if it was made before."""
    split = split or surrogate_split(df, columns, key, target, seed)
    learned = split.learned
    common = {"featuresCol": "features", "labelCol": target, "seed": seed, "maxMemoryInMB": TREE_MEMORY_MB, **learned.settings}
    if kind == "forest":
        rows = learned.rows
        learner = RandomForestRegressor(numTrees=trees, maxDepth=depth or 10, cacheNodeIds=learned.count * trees <= NODE_IDS, **common)
    else:
        rows = _for_steps(learned)
        learner = GBTRegressor(maxIter=trees, maxDepth=depth or 6, stepSize=rate, subsamplingRate=subsample, **common)
    model = learner.fit(_assembled(rows, columns))
    if learned.values:
        return model, _cell_quality(model, split.test, columns, target)
    scored = model.transform(_assembled(split.test, columns))
    quality = {m: RegressionEvaluator(labelCol=target, metricName=m).evaluate(scored) for m in ("rmse", "r2")}
    return model, quality


def _cell_quality(model, cells: DataFrame, columns: Sequence[str], target: str) -> dict[str, float]:
    """Error over the rows of the cells: within a cell all rows have one prediction."""
    scored = cut_lineage(model.transform(_assembled(cells, columns)).select(F.col(target).alias("y"), "prediction", "n", "spread"))
    rows, mean, wrong = scored.agg(F.sum("n"), F.sum(F.col("n") * F.col("y")) / F.sum("n"),
                                   F.sum(F.col("n") * (F.col("y") - F.col("prediction")) ** 2 + F.col("spread"))).first()
    total = scored.agg(F.sum(F.col("n") * (F.col("y") - F.lit(mean)) ** 2 + F.col("spread"))).first()[0]
    return {"rmse": float(np.sqrt(wrong / rows)), "r2": 1 - wrong / total if total else float("nan")}


@dataclass(frozen=True)
class LinearSurrogate:
    columns: list[str]
    weights: list[float]
    intercept: float
    means: list[float]

    def attribution(self, df: DataFrame, ids: Sequence[str]) -> DataFrame:
        """Long (ids, feature, phi): the exact Shapley value of a linear model."""
        parts = [((F.col(c) - m) * w).alias(c) for c, w, m in zip(self.columns, self.weights, self.means)]
        return df.select(*ids, *parts).unpivot(list(ids), self.columns, "feature", "phi")


def linear_surrogate(df: DataFrame, columns: Sequence[str], target: str = "lstm_score") -> LinearSurrogate:
    """Least squares by normal equations: one distributed pass over complete rows for all second moments. Columns
    that others determine share the weight of the shortest solution."""
    columns = list(columns)
    complete = df.filter(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in [*columns, target]))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = complete.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate([*columns, target])],
        *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs],
        *[F.covar_pop(c, target).alias(f"t{i}") for i, c in enumerate(columns)]).first()
    if row["m0"] is None:
        raise ValueError("no complete rows to fit a surrogate to")
    means = [row[f"m{i}"] for i in range(len(columns))]
    spread = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(len(columns))] for i in range(len(columns))])
    weights = np.linalg.lstsq(spread, np.array([row[f"t{i}"] for i in range(len(columns))]), rcond=None)[0]
    return LinearSurrogate(columns, [float(w) for w in weights], float(row[f"m{len(columns)}"] - np.dot(weights, means)), means)


def mean_abs_importance(phi: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, importance, normalised): mean absolute contribution, and over the largest. ``phi`` is long, or wide with ``columns``."""
    if columns is None:
        mean = phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance"))
    else:
        mean = phi.agg(*[F.avg(F.abs(c)).alias(c) for c in columns]).unpivot([], list(columns), "feature", "importance")
    top = F.max("importance").over(Window.partitionBy(F.lit(0)))
    return mean.withColumn("normalised", F.when(top > 0, F.col("importance") / top).otherwise(F.col("importance")))


def topk_last(phi: DataFrame, keys: Sequence[str], order: Sequence[str], k: int = 5, columns: Sequence[str] | None = None) -> DataFrame:
    """Per series: the last row's contributions over the largest of them, the top ``k`` by size. ``phi`` is long, or wide with ``columns``."""
    if columns is None:
        last = phi.groupBy(*keys, "feature").agg(F.max_by("phi", F.struct(*order)).alias("phi"))
    else:
        rows = phi.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
        last = rows.select(*keys, "_last.*").unpivot(list(keys), list(columns), "feature", "phi")
    w = Window.partitionBy(*keys)
    top = F.max(F.abs("phi")).over(w)
    scaled = last.withColumn("scaled", F.when(top > 0, F.col("phi") / top).otherwise(F.col("phi")))
    rank = F.row_number().over(w.orderBy(F.desc(F.abs("scaled")), "feature"))
    return scaled.withColumn("rank", rank).filter(F.col("rank") <= k)


def publish_importance(importance: DataFrame, top: DataFrame, scores: DataFrame, batch: int) -> DataFrame:
    """Metric rows: importance per feature, rank rows, and the latest score, for one batch."""
    number = F.lit(str(batch))

    def rows(df, metric, labels, value):
        pairs = [e for n, c in labels.items() for e in (F.lit(n), c.cast("string"))]
        return df.select(F.lit(metric).alias("metric"), F.create_map(*pairs).alias("labels"), F.col(value).alias("value"))

    return (rows(importance, "explain_shap_mean_abs", {"feature": F.col("feature"), "batch": number}, "normalised")
            .unionAll(rows(top, "explain_topk_features", {"rank": F.col("rank"), "feature": F.col("feature")}, "scaled"))
            .unionAll(rows(scores, "inference_anomaly_score", {"batch": number}, "anomaly_score")))


def local_examples(phi: DataFrame, label: str, order: Sequence[str]) -> DataFrame:
    """The first row of each label with its contributions."""
    return phi.groupBy(label, "feature").agg(F.min_by("phi", F.struct(*order)).alias("phi"))
