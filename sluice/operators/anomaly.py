"""Anomaly scores, thresholds, evaluation and model parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice import schema as S
from sluice.functions.clean import clean_numeric, fit_moments, present, standard_scale, trim_text, zscore_normalise
from sluice.operators import tsquery as Q
from sluice.operators import windows as W
from sluice.operators.series import QUANTILE_ROWS, group_quantiles, join_on, small_side
from sluice.session import cut_lineage


def reading(column: str) -> Column:
    """A column's value; a missing one (null or NaN) counts as 0."""
    return F.coalesce(present(F.col(column).cast("double")), F.lit(0.0))


@dataclass(frozen=True)
class Reconstruction:
    """Scaler moments and the leading directions of the normal rows (none: scaler only)."""

    columns: list[str]
    moments: dict[str, tuple[float, float]]
    directions: list[list[float]] = field(default_factory=list)

    def scaled(self) -> dict[str, Column]:
        return {c: (reading(c) - F.lit(m)) / F.lit(s or 1.0) for c, (m, s) in self.moments.items()}

    def residuals(self, df: DataFrame) -> DataFrame:
        """Each sensor column replaced by its squared reconstruction error."""
        z = self.scaled()
        rest = [c for c in df.columns if c not in self.moments]
        names = [f"_z{i}" for i in range(len(self.columns))]
        stage = df.select(*rest, *[z[c].alias(n) for c, n in zip(self.columns, names)])
        if self.directions:
            dots = [sum((F.col(n) * w for n, w in zip(names, d)), F.lit(0.0)).alias(f"_d{j}")
                    for j, d in enumerate(self.directions)]
            stage = stage.select("*", *dots)
        out = []
        for i, (c, n) in enumerate(zip(self.columns, names)):
            rebuilt = sum((F.col(f"_d{j}") * d[i] for j, d in enumerate(self.directions)), F.lit(0.0))
            out.append(F.pow(F.col(n) - rebuilt, 2).alias(c))
        return stage.select(*rest, *out)


def fit_reconstruction(normal: DataFrame, columns: Sequence[str], k: int = 0) -> Reconstruction:
    """Moments by one aggregate; directions by a distributed PCA of the scaled rows."""
    columns = list(columns)
    moments = fit_moments(normal, columns)
    if not k:
        return Reconstruction(columns, moments)
    scaled = standard_scale(normal.select(*[reading(c).alias(c) for c in columns]), columns, moments)
    rows = VectorAssembler(inputCols=columns, outputCol="_x").transform(scaled).select("_x")
    pc = PCA(k=k, inputCol="_x", outputCol="_p").fit(rows).pc.toArray()
    return Reconstruction(columns, moments, [[float(v) for v in pc[:, j]] for j in range(k)])


def reconstruction_score(df: DataFrame, model: Reconstruction, keys: Sequence[str], order: Sequence[str],
                         length: int = S.SEQUENCE_LENGTH, out: str = "anomaly_score", **sizing) -> DataFrame:
    """Summed squared error of each full window. The error adds up over rows, so a rolling
    sum of row errors replaces the windows themselves."""
    errors = model.residuals(df)
    row_error = sum((F.col(c) for c in model.columns), F.lit(0.0))
    slim = errors.withColumn("_e", row_error).drop(*model.columns)
    return W.rolling_sum(slim, keys, order, F.col("_e"), out, length, **sizing).drop("_e")


def percentile_threshold(scores: DataFrame, group: Sequence[str], q: float = S.SCORE_PERCENTILE,
                         score: str = "anomaly_score", max_rows: int = QUANTILE_ROWS) -> DataFrame:
    """Scores with their group's quantile threshold; a score is anomalous only above it."""
    limits = group_quantiles(scores, group, score, [q], max_rows)
    limits = cut_lineage(limits.select(*group, F.col("quantiles")[0].alias("threshold")))
    if group:
        flagged = join_on(scores, small_side(limits), group)
    else:
        flagged = scores.withColumn("threshold", F.lit(limits.first()["threshold"]))
    return flagged.withColumn("is_anomaly", (F.col(score) > F.col("threshold")).cast("int"))


def normalised(score: Column, threshold: Column) -> Column:
    """Score over threshold (the score itself when the threshold is not positive), kept in [0, 1]."""
    return F.least(F.greatest(F.when(threshold > 0, score / threshold).otherwise(score), F.lit(0.0)), F.lit(1.0))


def score_batch_summary(flagged: DataFrame, group: Sequence[str], order: Sequence[str], score: str = "anomaly_score"):
    """Per group: last and normalised last score, threshold, any-anomaly flag, anomaly count."""
    one = flagged.groupBy(*group).agg(
        F.max_by(score, F.struct(*order)).alias("last_score"), F.max("threshold").alias("threshold"),
        F.max("is_anomaly").alias("any_anomaly"), F.sum("is_anomaly").alias("anomalies"), F.count(F.lit(1)).alias("scores"))
    return one.withColumn("normalised_score", normalised(F.col("last_score"), F.col("threshold")))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def f1_eval(df: DataFrame, label: str, predicted: str, positive=1) -> DataFrame:
    hit, said = F.col(label) == positive, F.col(predicted) == positive
    one = df.agg(F.count_if(hit & said).alias("tp"), F.count_if(~hit & said).alias("fp"), F.count_if(hit & ~said).alias("fn"))
    return one.withColumn("f1", _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def confusion_report(df: DataFrame, label: str, predicted: str) -> tuple[DataFrame, DataFrame]:
    """(confusion counts, precision / recall / F1 / support per class)."""
    matrix = df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    classes = matrix.select(F.col("label").alias("class"), "label", "predicted", "n").unionAll(
        matrix.filter(F.col("label") != F.col("predicted")).select(F.col("predicted"), "label", "predicted", "n"))
    own, said = F.col("label") == F.col("class"), F.col("predicted") == F.col("class")
    sums = classes.groupBy("class").agg(
        F.sum(F.when(own & said, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(said, F.col("n")).otherwise(0)).alias("p"),
        F.sum(F.when(own, F.col("n")).otherwise(0)).alias("support"))
    tp, p, support = F.col("tp"), F.col("p"), F.col("support")
    return matrix, sums.select("class", _ratio(tp, p).alias("precision"), _ratio(tp, support).alias("recall"),
                               _ratio(2 * tp, p + support).alias("f1"), "support")


def _distance(columns: Sequence[str], moments) -> Column:
    return sum((F.pow((F.col(c) - moments[c][0]) / F.lit(moments[c][1] or 1.0), 2) for c in columns), F.lit(0.0))


def oneclass_boundary(df: DataFrame, normal: DataFrame, columns: Sequence[str], nu: float = 0.01,
                      max_rows: int = QUANTILE_ROWS) -> DataFrame:
    """+1 inside and -1 outside the boundary holding all but a share ``nu`` of the normal
    rows, by scaled squared distance from their centre."""
    moments = fit_moments(normal, columns)
    far = _distance(columns, moments)
    edge = group_quantiles(normal.withColumn("_d", far), [], "_d", [1 - nu], max_rows).first()["quantiles"][0]
    return df.withColumn("distance", far).withColumn("boundary", F.lit(edge)).withColumn(
        "predicted", F.when(F.col("distance") > edge, -1).otherwise(1))


@dataclass(frozen=True)
class Covariance:
    """Centre and population covariance of some columns: mergeable sums of one aggregate, or of stored parts."""

    columns: list[str]
    n: int
    mean: np.ndarray
    spread: np.ndarray

    def merged(self, other: Covariance) -> Covariance:
        """Both parts' rows together, as if fitted at once."""
        n = self.n + other.n
        if not n:
            return self
        gap = other.mean - self.mean
        spread = (self.n * self.spread + other.n * other.spread + np.outer(gap, gap) * self.n * other.n / n) / n
        return Covariance(self.columns, n, self.mean + gap * other.n / n, spread)

    def distance(self) -> Column:
        """Squared distance from the centre in units of the spread, by its Cholesky factor. Columns that others
        determine add nothing."""
        centred = [F.col(c) - float(m) for c, m in zip(self.columns, self.mean)]
        scale = float(np.trace(self.spread)) or 1.0
        total, solved = F.lit(0.0), []
        factor = np.zeros_like(self.spread)
        for i in range(len(self.columns)):
            rest = self.spread[i, i] - factor[i, :i] @ factor[i, :i]
            if rest <= 1e-12 * min(scale, max(self.spread[i, i], 1e-300)):
                solved.append(None)
                continue
            factor[i, i] = rest ** 0.5
            for j in range(i + 1, len(self.columns)):
                factor[j, i] = (self.spread[j, i] - factor[j, :i] @ factor[i, :i]) / factor[i, i]
            part = centred[i]
            for k, z in enumerate(solved):
                if z is not None:
                    part = part - z * float(factor[i, k])
            solved.append(part / float(factor[i, i]))
            total = total + solved[-1] * solved[-1]
        return total


def fit_covariance(normal: DataFrame, columns: Sequence[str]) -> Covariance:
    """One aggregate over the complete rows."""
    columns = list(columns)
    whole = normal.filter(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in columns))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = whole.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
                    *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    width = len(columns)
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(width)])
    spread = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(width)] for i in range(width)])
    return Covariance(columns, row["n"], mean, spread)


def covariance_boundary(df: DataFrame, normal: DataFrame, columns: Sequence[str], nu: float = 0.01,
                        max_rows: int = QUANTILE_ROWS) -> DataFrame:
    """Like ``oneclass_boundary``, with the distance that knows how the columns move together. Without normal
    rows there is no boundary: null, and no row is outside."""
    far = fit_covariance(normal, columns).distance()
    edge = group_quantiles(normal.withColumn("_d", far), [], "_d", [1 - nu], max_rows).first()
    edge = F.lit(edge["quantiles"][0] if edge and edge["quantiles"] else None).cast("double")
    return df.withColumn("distance", far).withColumn("boundary", edge).withColumn(
        "predicted", F.when(F.col("distance") > edge, -1).otherwise(1))


# Boundary shares tried by the grid search.
NUS = [0.001, 0.005, 0.01, 0.02]


def grid_search_f1(df: DataFrame, normal: DataFrame, columns: Sequence[str], label: str, nus: Sequence[float] = tuple(NUS),
                   max_rows: int = QUANTILE_ROWS) -> DataFrame:
    """(nu, boundary, f1 of the anomaly class, best): all boundaries are counted in one
    aggregate; the first best share wins."""
    moments = fit_moments(normal, columns)
    far = _distance(columns, moments)
    edges = group_quantiles(normal.withColumn("_d", far), [], "_d", [1 - n for n in nus], max_rows).first()["quantiles"]
    odd = F.col(label) == -1
    counts = df.withColumn("_d", far).agg(F.count_if(odd).alias("pos"), *[
        e for i, edge in enumerate(edges)
        for e in (F.count_if(odd & (F.col("_d") > edge)).alias(f"tp{i}"), F.count_if(F.col("_d") > edge).alias(f"said{i}"))]).first()
    scores = [2 * counts[f"tp{i}"] / ((counts["pos"] + counts[f"said{i}"]) or 1) for i in range(len(nus))]
    best = max(range(len(nus)), key=lambda i: scores[i]) if max(scores) > 0 else None
    rows = [(float(n), float(e), float(s), i == best) for i, (n, e, s) in enumerate(zip(nus, edges, scores))]
    return df.sparkSession.createDataFrame(rows, "nu double, boundary double, f1 double, best boolean")


# Kernel widths tried by the grid search.
GAMMAS = ["scale", "auto", 0.0001, 0.001, 0.01]
#: Rows whose angles are worked on at once.
KERNEL_BLOCK = 128


def kernel_waves(width: int, gammas: Sequence[float], frequencies: int, seed: int = 7) -> np.ndarray:
    """(gammas, frequencies, width) random frequencies: the mean over them of cos(w (x - y)) tends to
    exp(-gamma |x - y|^2), with an error of about 0.7 / sqrt(frequencies) at most."""
    draws = np.random.default_rng(seed).normal(size=(frequencies, width))
    return np.sqrt(2 * np.asarray(gammas, float))[:, None, None] * draws


def _waves(x: np.ndarray, waves: np.ndarray) -> np.ndarray:
    """(gammas, rows, 2 x frequencies) features whose inner products are kernel values."""
    turned = np.matmul(x[None], waves.transpose(0, 2, 1))
    return np.concatenate([np.cos(turned), np.sin(turned)], axis=2) / np.sqrt(waves.shape[1])


def _half_tangents(x: np.ndarray, waves: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, gamma, t, 1 / (1 + t^2)) of small blocks, t = tan(a / 2) of every angle a: cos a = 2 / (1 + t^2) - 1
    and sin a = 2 t / (1 + t^2), so an angle costs one transcendental function and a block stays in the cache."""
    half = waves.transpose(0, 2, 1) / 2
    for at in range(0, len(x), KERNEL_BLOCK):
        for g in range(len(half)):
            t = x[at:at + KERNEL_BLOCK] @ half[g]
            np.tan(t, out=t)
            share = t * t
            share += 1
            np.reciprocal(share, out=share)
            yield at, g, t, share


def kernel_centre(rows: DataFrame, columns: Sequence[str], waves: np.ndarray) -> np.ndarray:
    """(gammas, 2 x frequencies) mean of the features: partial sums by task, merged by a shuffle; what the driver
    gets has the size of the result."""
    columns, size, frequencies = list(columns), waves.shape[0] * waves.shape[1] * 2, waves.shape[1]

    def sums(batches):
        total, n = np.zeros((waves.shape[0], 2 * frequencies)), 0
        for batch in batches:
            for _, g, t, share in _half_tangents(batch[columns].to_numpy(float), waves):
                total[g, :frequencies] += 2 * share.sum(axis=0) - len(share)
                total[g, frequencies:] += 2 * np.einsum("ij,ij->j", t, share)
            n += len(batch)
        if n:
            yield pd.DataFrame({"place": np.arange(size), "total": total.ravel() / np.sqrt(frequencies), "n": n})

    parts = rows.select(*columns).mapInPandas(sums, "place int, total double, n bigint")
    merged = parts.groupBy("place").agg((F.sum("total") / F.sum("n")).alias("mean")).collect()
    centre = np.zeros(size)
    for row in merged:
        centre[row["place"]] = row["mean"]
    return centre.reshape(waves.shape[0], -1)


def kernel_density(x: np.ndarray, waves: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """(rows, gammas): the inner products of the features of ``x`` with their mean."""
    frequencies = waves.shape[1]
    weights = centre / np.sqrt(frequencies)
    even, odd = weights[:, :frequencies], weights[:, frequencies:]
    out = np.empty((len(x), len(waves)))
    for at, g, t, share in _half_tangents(x, waves):
        found = share @ even[g]
        np.multiply(t, share, out=t)
        found += t @ odd[g]
        out[at:at + len(found), g] = 2 * found - even[g].sum()
    return out


def kernel_grid_f1(df: DataFrame, normal: DataFrame, columns: Sequence[str], label: str, nus: Sequence[float] = tuple(NUS),
                   gammas: Sequence[float | str] = tuple(GAMMAS), frequencies: int = 256,
                   max_rows: int = QUANTILE_ROWS) -> DataFrame:
    """(nu, gamma, width, boundary, f1 of the anomaly class, best) for every pair of share and kernel width.

    A row's density is its mean kernel value to all normal rows, by random Fourier features: one inner
    product with their mean, however many they are. The boundary is the density that a share ``nu`` of the
    normal rows stays below; all pairs are counted in one aggregate, and the first best pair wins. ``scale``
    is 1 / (columns x variance) and ``auto`` is 1 / columns, of the scaled columns. A missing reading counts as the
    column's mean. Without normal rows there is no boundary, and the result is empty."""
    columns, moments = list(columns), fit_moments(normal, columns)
    if any(moments[c][0] is None for c in columns):
        return df.sparkSession.createDataFrame([], "nu double, gamma string, width double, boundary double, f1 double, best boolean")
    scaled = [F.coalesce((present(F.col(c).cast("double")) - moments[c][0]) / F.lit(moments[c][1] or 1.0), F.lit(0.0)).alias(c)
              for c in columns]
    spread = sum(1.0 for c in columns if moments[c][1]) / len(columns)
    named = {"scale": 1 / (len(columns) * (spread or 1.0)), "auto": 1 / len(columns)}
    widths = [float(named.get(g, g)) for g in gammas]
    tried = list(dict.fromkeys(widths))
    waves = kernel_waves(len(columns), tried, frequencies)
    centre = kernel_centre(normal.select(*scaled), columns, waves)

    @F.pandas_udf("array<double>")
    def density(*parts: pd.Series) -> pd.Series:
        x = np.column_stack([p.to_numpy(float) for p in parts])
        return pd.Series(list(kernel_density(x, waves, centre)))

    def scored(rows: DataFrame, *more: str) -> DataFrame:
        return cut_lineage(rows.select(*more, *scaled).select(*more, density(*columns).alias("_d")))

    long = scored(normal).select(F.posexplode("_d").alias("_g", "_v"))
    edges = {r["_g"]: r["quantiles"] for r in group_quantiles(long, ["_g"], "_v", list(nus), max_rows).collect()}
    pairs = [(i, g) for i in range(len(nus)) for g in range(len(tried))]
    odd, counts = F.col("_odd") == -1, []
    for i, g in pairs:
        out = F.col("_d")[g] < edges[g][i]
        counts += [F.count_if(odd & out).alias(f"tp{i}_{g}"), F.count_if(out).alias(f"said{i}_{g}")]
    row = scored(df.withColumn("_odd", F.col(label)), "_odd").agg(F.count_if(odd).alias("pos"), *counts).first()
    pairs = [(i, g, tried.index(w)) for i in range(len(nus)) for g, w in enumerate(widths)]
    f1 = [2 * row[f"tp{i}_{t}"] / ((row["pos"] + row[f"said{i}_{t}"]) or 1) for i, _, t in pairs]
    best = int(np.argmax(f1)) if max(f1) > 0 else None
    rows = [(float(nus[i]), str(gammas[g]), widths[g], float(edges[t][i]), float(f1[at]), at == best)
            for at, (i, g, t) in enumerate(pairs)]
    return df.sparkSession.createDataFrame(rows, "nu double, gamma string, width double, boundary double, f1 double, best boolean")


def score_with_model(sequences: DataFrame, model: Callable[[pd.Series], pd.Series], column: str = "sequence",
                     out: str = "anomaly_score") -> DataFrame:
    """Scores from any per-sequence model: ``model`` maps a batch of windows to one score
    each. The callable travels to the executors; rows go over in Arrow batches."""

    @F.pandas_udf("double")
    def apply(batch: pd.Series) -> pd.Series:
        return pd.Series(model(batch))

    return sequences.withColumn(out, apply(F.col(column)))


# Moments that can be merged -------------------------------------------------------------

def batch_moments(df: DataFrame, columns: Sequence[str], batch: Sequence[str] = ()) -> DataFrame:
    """(batch, feature, n, mean, m2), the mergeable state of a scaler."""
    wide = df.groupBy(*batch).agg(*[
        F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), (F.var_pop(c) * F.count(c)).alias("m2")).alias(c)
        for c in columns])
    states = wide.unpivot(list(batch), list(columns), "feature", "s")
    return states.filter("s.n > 0").select(*batch, "feature", "s.*")


def merge_moments(states: DataFrame) -> DataFrame:
    """One state per feature from any number of partial states."""
    n, mean = F.col("n"), F.col("mean")
    centred = states.groupBy("feature").agg(F.sum("n").alias("_n"), (F.sum(n * mean) / F.sum("n")).alias("_mean"))
    joined = states.join(centred, "feature")
    return joined.groupBy("feature").agg(
        F.max("_n").alias("n"), F.max("_mean").alias("mean"),
        F.sum(F.col("m2") + n * F.pow(mean - F.col("_mean"), 2)).alias("m2"))


def moments_of(states: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per feature from merged states."""
    return {r["feature"]: (r["mean"], (max(r["m2"], 0.0) / r["n"]) ** 0.5) for r in states.collect()}


CO_MOMENTS = "a string, b string, n bigint, mean_a double, mean_b double, c double"


def batch_co_moments(df: DataFrame, columns: Sequence[str], batch: Sequence[str] = ()) -> DataFrame:
    """(batch, a, b, n, mean_a, mean_b, c), the mergeable state of scaler and directions: for each
    pair of columns rows, means and summed co-deviation of their readings with 0 for missing ones,
    and per column (``b`` null) the moments of its present readings. One aggregate; the state
    grows with the square of the columns, not with the rows."""
    columns = list(columns)
    name = {c: f"_{i}" for i, c in enumerate(columns)}
    filled = df.select(*batch, *[present(F.col(c).cast("double")).alias(f"p{name[c]}") for c in columns], *[reading(c).alias(name[c]) for c in columns])

    def state(a, b):
        x, y = (f"p{name[a]}",) * 2 if b is None else (name[a], name[b])
        return F.struct(F.lit(a).alias("a"), F.lit(b).cast("string").alias("b"), F.count(x).alias("n"), F.avg(x).alias("mean_a"),
                        F.avg(y).alias("mean_b"), (F.covar_pop(x, y) * F.count(x)).alias("c"))

    pairs = [(a, b) for i, a in enumerate(columns) for b in [None, *columns[i:]]]
    wide = filled.groupBy(*batch).agg(*[state(a, b).alias(f"s{i}") for i, (a, b) in enumerate(pairs)])
    states = wide.select(*batch, F.explode(F.array(*[f"s{i}" for i in range(len(pairs))])).alias("s"))
    return states.filter("s.n > 0").select(*batch, "s.*")


def merge_co_moments(states: DataFrame) -> DataFrame:
    """One state per pair from any number of partial states, as if fitted at once."""
    pair, n = Window.partitionBy("a", "b"), F.col("n")
    centred = states.select("a", "b", "n", "mean_a", "mean_b", "c", (F.sum(n * F.col("mean_a")).over(pair) / F.sum(n).over(pair)).alias("_a"),
                            (F.sum(n * F.col("mean_b")).over(pair) / F.sum(n).over(pair)).alias("_b"))
    apart = n * (F.col("mean_a") - F.col("_a")) * (F.col("mean_b") - F.col("_b"))
    return centred.groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("_a").alias("mean_a"), F.first("_b").alias("mean_b"),
                                         F.sum(F.col("c") + apart).alias("c"))


def reconstruction_of(states: DataFrame, columns: Sequence[str], k: int) -> Reconstruction:
    """Scaler and ``k`` leading directions from merged co-moments. Only they reach the driver:
    one number per pair of columns. A column without a reading has mean 0 and no direction."""
    columns = list(columns)
    at = {c: i for i, c in enumerate(columns)}
    moments = {c: (0.0, 0.0) for c in columns}
    spread = np.zeros((len(columns), len(columns)))
    for r in states.collect():
        if r["b"] is None:
            moments[r["a"]] = (r["mean_a"], (max(r["c"], 0.0) / r["n"]) ** 0.5)
        else:
            spread[at[r["a"]], at[r["b"]]] = spread[at[r["b"]], at[r["a"]]] = r["c"] / r["n"]
    scale = np.array([moments[c][1] or 1.0 for c in columns])
    _, vectors = np.linalg.eigh(spread / np.outer(scale, scale))
    return Reconstruction(columns, moments, [[float(v) for v in vectors[:, -1 - j]] for j in range(k)])


class ParameterStore:
    """Versioned parameter table in a shared folder. Readers take the newest complete
    version, so a job that asks per batch always follows the last fit."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, parameters: DataFrame, version: int) -> None:
        parameters.write.mode("overwrite").parquet(f"{self.path}/version={version:08d}")

    def latest_version(self) -> int | None:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return None
        done = [s.getPath().getName() for s in fs.listStatus(root)
                if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max((int(d.split("=")[1]) for d in done if d.startswith("version=")), default=None)

    def version(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={number:08d}")

    def latest(self) -> DataFrame | None:
        number = self.latest_version()
        return None if number is None else self.version(number)


def clean_rows(df: DataFrame, columns: Sequence[str], text: Sequence[str], moments=None) -> DataFrame:
    """Text rows to cleaned, normalised ones; with fitted ``moments`` also on a stream."""
    return zscore_normalise(trim_text(clean_numeric(df, columns), text), columns, moments)


def sensor_error(df: DataFrame, model: Reconstruction, ids: Sequence[str]) -> DataFrame:
    """Long (ids, sensor, error): squared reconstruction error per sensor."""
    return model.residuals(df.select(*ids, *model.columns)).unpivot(list(ids), model.columns, "sensor", "error")


def top_anomalous_sensors(errors: DataFrame, every: str, limit: float, n: int, ts: str = "ts") -> DataFrame:
    """Sensors with the most flagged errors per window."""
    counts = Q.tumble(errors, every, ["sensor"], F.count_if(F.col("error") > limit).alias("anomalies"),
                      F.max("error").alias("max_error"), ts=ts)
    w = Window.partitionBy("start").orderBy(F.desc("anomalies"), F.desc("max_error"), "sensor")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)

