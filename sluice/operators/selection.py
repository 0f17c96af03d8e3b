"""Feature selection as aggregates: variance, nulls, correlation, importance.

Only per-feature statistics (columns, not rows) reach the driver, where they decide
which columns the next step reads.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice import schema as S
from sluice.functions.clean import NUMERIC, attack_flag, present
from sluice.operators.cells import grouped
from sluice.operators.series import group_quantiles
from sluice.sources.readers import sample_n

VARIANCE, NULLS, CORRELATION = 1e-6, 0.5, 0.98
LABELS = (S.TIME_COLUMN, S.LABEL_COLUMN, "Normal/Attack")
TREE_MEMORY_MB = 1024


def at_full_width(df: DataFrame) -> DataFrame:
    """Spread a frame read from fewer files than cores before repeated passes over it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def numeric_columns(df: DataFrame, exclude: Sequence[str] = LABELS) -> list[str]:
    return [n for n, t in df.dtypes if t in NUMERIC and n not in exclude]


def readings(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Each column with NaN as a missing reading."""
    kinds = dict(df.dtypes)
    return {c: present(F.col(c)) if kinds[c] in ("double", "float") else F.col(c) for c in columns}


def _per_feature(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def static_features(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = VARIANCE) -> DataFrame:
    """(feature, variance, unique_values) of columns whose sample variance is below the
    threshold. Distinct values are counted for those columns alone."""
    columns = list(columns or numeric_columns(df))
    value = readings(df, columns)
    row = df.agg(*[F.var_samp(value[c]).alias(c) for c in columns]).first()
    static = {c: row[c] for c in columns if row[c] is not None and row[c] < threshold}
    schema = "feature string, variance double, unique_values bigint"
    if not static:
        return _per_feature(df.sparkSession, [], schema)
    values = df.select(*[value[c].cast("double").alias(c) for c in static]).unpivot([], list(static), "feature", "v")
    seen = values.filter(F.col("v").isNotNull()).groupBy("feature", "v").count().groupBy("feature").count().collect()
    unique = {r["feature"]: r["count"] for r in seen}
    return _per_feature(df.sparkSession, [(c, v, unique.get(c, 0)) for c, v in static.items()], schema)


def high_null_features(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = NULLS) -> DataFrame:
    """(feature, null_share) of columns with more than ``threshold`` missing readings (null or NaN), in one aggregate."""
    columns = list(columns or df.columns)
    value = readings(df, columns)
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(value[c].isNull()).alias(c) for c in columns]).first()
    shares = [(c, row[c] / row["_n"]) for c in columns if row["_n"] and row[c] / row["_n"] > threshold]
    return _per_feature(df.sparkSession, shares, "feature string, null_share double")


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, a_pos, b_pos, r): absolute Pearson of every pair over rows where both are
    present; each unordered pair once. Null where undefined."""
    columns = list(columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    table = _pair_moments(df, columns) if pairs else {}
    values = [table.get(p) for p in pairs]
    rows = [(columns[i], columns[j], i, j, None if v is None or np.isnan(v) else abs(float(v)))
            for (i, j), v in zip(pairs, values)]
    return _per_feature(df.sparkSession, rows, "a string, b string, a_pos int, b_pos int, r double")


def _pair_moments(df: DataFrame, columns: Sequence[str]) -> dict[tuple[int, int], float]:
    """Pair sums by matrix products on Arrow batches: each task sends one row per pair."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    shift = np.array([means[c] if means[c] is not None else 0.0 for c in columns])
    width = len(columns)
    upper = np.triu_indices(width, 1)

    def partial(batches):
        sums, cross = np.zeros((5, width, width)), np.zeros((width, width))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float, na_value=np.nan) - shift
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            sums += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x)])
            cross += x.T @ x
        yield pd.DataFrame({"i": upper[0], "j": upper[1], "n": sums[0][upper], "sa": sums[1][upper],
                            "sb": sums[2][upper], "qa": sums[3][upper], "qb": sums[4][upper], "p": cross[upper]})

    schema = "i int, j int, n double, sa double, sb double, qa double, qb double, p double"
    names = ["n", "sa", "sb", "qa", "qb", "p"]
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    total = doubles.mapInPandas(partial, schema).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names])
    spread = F.sqrt((F.col("n") * F.col("qa") - F.col("sa") ** 2) * (F.col("n") * F.col("qb") - F.col("sb") ** 2))
    r = F.try_divide(F.col("n") * F.col("p") - F.col("sa") * F.col("sb"), spread)
    return {(x["i"], x["j"]): x["r"] for x in total.select("i", "j", r.alias("r")).collect()}


def correlated_features(matrix: DataFrame, threshold: float = CORRELATION) -> DataFrame:
    """(feature, partners, first_partner): a column goes when any earlier column, dropped
    or not, correlates above the threshold."""
    over = matrix.filter(F.col("r") > threshold)
    return over.groupBy(F.col("b").alias("feature")).agg(
        F.count(F.lit(1)).alias("partners"), F.min_by("a", "a_pos").alias("first_partner"), F.max("r").alias("max_r"))


def corr_ranking(matrix: DataFrame, columns: Sequence[str], n: int = 30) -> DataFrame:
    """Columns by mean absolute correlation over the whole matrix, own cell (1) included."""
    spark = matrix.sparkSession
    both = matrix.select(F.col("a").alias("feature"), "r").unionAll(matrix.select(F.col("b").alias("feature"), "r"))
    own = spark.createDataFrame([(c, 1.0) for c in columns], "feature string, r double")
    ranked = both.unionAll(own).filter(F.col("r").isNotNull()).groupBy("feature").agg(F.avg("r").alias("mean_r"))
    return ranked.orderBy(F.desc("mean_r"), "feature").limit(n)


def mutual_info(df: DataFrame, columns: Sequence[str], label: str = "label", bins: int = 16,
                equal_depth: bool = False, exact: bool = False) -> DataFrame:
    """(feature, importance): mutual information (nats) between the binned feature and the
    label. Nulls and NaN count as 0. Bins are of equal width, or of equal depth: by a sketch in
    one pass, or by ``exact`` distributed quantiles."""
    filled = df.select(*[F.coalesce(present(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in columns], F.col(label).alias("_y"))
    if equal_depth:
        cuts = [k / bins for k in range(1, bins)]
        if exact:
            tall = filled.select(*columns).unpivot([], list(columns), "feature", "value")
            row = {c: [] for c in columns} | {r["feature"]: r["quantiles"] for r in group_quantiles(tall, ["feature"], "value", cuts).collect()}
        else:
            row = filled.agg(*[F.percentile_approx(c, cuts, 10_000).alias(c) for c in columns]).first()
        binned = [sum(((F.col(c) > e).cast("int") for e in sorted(set(row[c] or []))), F.lit(0)).alias(c) for c in columns]
    else:
        row = filled.agg(*[e for c in columns for e in (F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"))]).first()
        binned = [_equal_width(c, row[f"{c}_lo"], row[f"{c}_hi"], bins) for c in columns]
    cells = filled.select(*binned, "_y").unpivot(["_y"], list(columns), "feature", "bin")
    counts = cells.groupBy("feature", "bin", "_y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    per_bin, per_label, all_rows = (Window.partitionBy("feature", "bin"), Window.partitionBy("feature", "_y"),
                                    Window.partitionBy("feature"))
    share = counts.select("feature", "n", F.sum("n").over(per_bin).alias("nb"), F.sum("n").over(per_label).alias("ny"),
                          F.sum("n").over(all_rows).alias("t"))
    info = F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nb") * F.col("ny")))
    return share.groupBy("feature").agg(F.sum(info).alias("importance"))


def _equal_width(c: str, lo, hi, bins: int):
    if lo is None or hi is None or hi <= lo:
        return F.lit(0).alias(c)
    place = F.floor((F.col(c) - lo) / F.lit(hi - lo) * bins)
    return F.least(place, F.lit(bins - 1)).cast("int").alias(c)


def forest_importance(df: DataFrame, columns: Sequence[str], label: str = "label", trees: int = 100, depth: int = 10,
                      seed: int = 42) -> DataFrame:
    """(feature, importance) of a distributed random forest. Many rows are learned as cells of equal bins and label
    (``operators.cells``)."""
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns],
                       F.col(label).cast("double").alias("_y"))
    learned = grouped(at_full_width(filled), columns, "_y", classes=True, seed=seed)
    rows = VectorAssembler(inputCols=list(columns), outputCol="_x").transform(learned.rows).drop(*columns)
    model = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed,
                                   maxMemoryInMB=TREE_MEMORY_MB, **learned.settings).fit(rows)
    scores = model.featureImportances.toArray()
    return _per_feature(df.sparkSession, [(c, float(s)) for c, s in zip(columns, scores)], "feature string, importance double")


def top_features(importance: DataFrame, n: int | None = None, threshold: float | None = None) -> DataFrame:
    """Selected features with their rank. A count overrides the threshold; when neither
    selects anything all are kept."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "feature")
    ranked = importance.withColumn("rank", F.row_number().over(w))
    if n:
        return ranked.filter(F.col("rank") <= n)
    if threshold:
        any_hit = F.max(F.col("importance") >= threshold).over(Window.partitionBy(F.lit(0)))
        return ranked.withColumn("_any", any_hit).filter(
            (F.col("importance") >= threshold) | ~F.col("_any")).drop("_any")
    return ranked


@dataclass
class Selection:
    """What each step removed, what is left, and why."""

    parameters: dict[str, float]
    removed: dict[str, list[str]] = field(default_factory=dict)
    selected: list[str] = field(default_factory=list)
    importance: dict[str, float] = field(default_factory=dict)

    def removal_summary(self) -> dict[str, int]:
        counts = {step: len(names) for step, names in self.removed.items()}
        return {**counts, "total_removed": sum(counts.values()), "final_features": len(self.selected)}

    def top_importance(self, n: int | None = None) -> dict[str, float]:
        ranked = sorted(self.importance.items(), key=lambda kv: (-kv[1], kv[0]))
        return dict(ranked[:n] if n else ranked)

    def report(self, spark: SparkSession) -> DataFrame:
        """(feature, step, importance, kept), one row per feature."""
        rows = [(f, step, None, False) for step, names in self.removed.items() for f in names]
        rows += [(f, "selected", self.importance.get(f), True) for f in self.selected]
        return spark.createDataFrame(rows, "feature string, step string, importance double, kept boolean")


def run_selection(normal: DataFrame, attack: DataFrame | None = None, sample_size: int | None = None,
                  sample_key: Sequence[str] = (), label: str = S.LABEL_COLUMN, variance_threshold: float = VARIANCE,
                  null_threshold: float = NULLS, correlation_threshold: float = CORRELATION, importance: bool = True,
                  top_n: int | None = None, keep: Sequence[str] = (), bins: int = 16) -> tuple[Selection, DataFrame]:
    """The steps in order, each on the survivors of the one before. A sample takes the
    given number of normal rows and half as many attack rows."""
    parts = []
    for frame, size in ((normal, sample_size), (attack, sample_size // 2 if sample_size else None)):
        if frame is not None:
            parts.append(sample_n(frame, size, sample_key) if size else frame)
    df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    df = df.persist()
    out = Selection({"variance_threshold": variance_threshold, "null_threshold": null_threshold,
                     "correlation_threshold": correlation_threshold})
    fixed = set(LABELS) | set(keep) | {label}
    features = [c for c in df.columns if c not in fixed]
    numbers = [c for c in numeric_columns(df) if c in features]
    names = [r["feature"] for r in static_features(df, numbers, variance_threshold).collect()]
    out.removed["static_features"] = names
    features = [c for c in features if c not in names]
    names = [r["feature"] for r in high_null_features(df, features, null_threshold).collect()]
    out.removed["high_null_features"] = names
    features = [c for c in features if c not in names]
    matrix = corr_matrix(df, [c for c in numbers if c in features])
    names = [r["feature"] for r in correlated_features(matrix, correlation_threshold).collect()]
    out.removed["correlated_features"] = [c for c in features if c in names]
    features = [c for c in features if c not in names]
    numbers = [c for c in numbers if c in features]
    if importance and label in df.columns and numbers:
        y = attack_flag(F.col(label)) if dict(df.dtypes)[label] == "string" else F.col(label)
        scores = mutual_info(df.withColumn("_label", y), numbers, "_label", bins)
        out.importance = {r["feature"]: r["importance"] for r in scores.collect()}
    out.selected = list(out.top_importance(top_n)) if top_n and out.importance else features
    kept = [c for c in df.columns if c in out.selected or c in fixed]
    return out, df.select(*kept)
