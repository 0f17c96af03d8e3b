"""Micro-batch jobs over keyed streams (see ``keyed``), and the watermark queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice import schema as S
from sluice.operators import anomaly as A
from sluice.operators import explain as X
from sluice.operators import forecast as J
from sluice.operators import tsquery as Q
from sluice.operators import windows as W
from sluice.session import cut_lineage
from sluice.streaming.quantiles import LivePercentile

def train_job(store: A.ParameterStore, columns: Sequence[str], keys: Sequence[str], order: Sequence[str],
              train: float = 0.7) -> Callable[[DataFrame, int], None]:
    """Each batch adds the moments of its earlier 70 % to the stored parameters."""
    schema = "feature string, n bigint, mean double, m2 double"

    def run(batch: DataFrame, batch_id: int) -> None:
        part = W.time_split(batch, keys, order, train).filter("part = 'train'")
        fresh = A.batch_moments(part, columns).select("feature", "n", "mean", "m2")
        version = store.latest_version()
        if version is not None and version > batch_id:
            return
        older = store.version(batch_id) if batch_id else None
        known = store.spark.createDataFrame([], schema) if older is None else older.select("feature", "n", "mean", "m2")
        store.save(A.merge_moments(known.unionByName(fresh)), batch_id + 1)

    return run


def directions_job(store: A.ParameterStore, columns: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """Each batch adds its co-moments to the stored ones, from which ``reconstruction_of`` derives
    scaler and directions anew. Batch ``i`` reads version ``i`` and writes version ``i + 1``, so a
    batch that is run again counts once; a batch without rows hands the state on."""

    def run(batch: DataFrame, batch_id: int) -> None:
        fresh = A.batch_co_moments(batch, columns)
        known = store.version(batch_id) if batch_id else store.spark.createDataFrame([], A.CO_MOMENTS)
        store.save(A.merge_co_moments(known.unionByName(fresh)), batch_id + 1)

    return run


def score_windows(windows: DataFrame, model: A.Reconstruction, sequence: str = "sequence") -> DataFrame:
    """``anomaly_score`` of windows held as ``array<array<double>>``: the summed squared error of their rows."""
    scaled = [(i, *model.moments[c]) for i, c in enumerate(model.columns)]

    def error(row):
        z = [(row[i] - m) / F.lit(s or 1.0) for i, m, s in scaled]
        parts = []
        for i in range(len(z)):
            off = z[i]
            for d in model.directions:
                off = off - sum((z[k] * d[k] for k in range(len(z))), F.lit(0.0)) * d[i]
            parts.append(off * off)
        return sum(parts, F.lit(0.0))

    return windows.withColumn("anomaly_score", F.aggregate(sequence, F.lit(0.0), lambda total, row: total + error(row)))


def score_job(store: A.ParameterStore, columns: Sequence[str], live: LivePercentile, ids: Sequence[str],
              emit: Callable[[DataFrame, int], None], summarise: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` job over ``keyed.series_windows`` rows: scores, flags against the live percentile and
    one summary row per batch. The newest stored parameters are read in every batch, so a refit takes effect
    without a restart. Rows that were late or without a time carry no window and are only counted."""

    def run(batch: DataFrame, batch_id: int) -> None:
        moments = A.moments_of(store.latest())
        model = A.Reconstruction(list(columns), {c: moments[c] for c in columns})
        # The windows themselves are thirty times a score and are not stored.
        scored = cut_lineage(score_windows(batch, model).drop("sequence"))
        unplaced = scored.agg(F.count_if(F.col("kind") == "late").alias("late"), F.count_if(F.col("kind") == "untimed").alias("untimed"))
        flagged, summary = live.judge(scored.filter("kind = 'row'").drop("kind"), batch_id, ids)
        emit(flagged, batch_id)
        summarise(summary.join(unplaced), batch_id)

    return run


def explain_job(scores: Callable[[], DataFrame], names: Sequence[str], keys: Sequence[str], order: Sequence[str],
                emit: Callable[[DataFrame, int], None], fit: Callable[[DataFrame, list[str]], Callable], top: int = 5):
    """A ``foreachBatch`` job over rolling features: joined to the score table by series and order, a surrogate
    of the scores is fitted (``fit`` returns its wide attribution) and its contributions become metric rows."""
    ts = order[0]

    def explain(batch: DataFrame, batch_id: int) -> None:
        feats = cut_lineage(batch.filter("kind = 'row'").drop("kind").fillna(0.0, subset=list(names)))
        span = feats.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
        if span["lo"] is None:
            return
        # Literal bounds let the scan of the score table skip all other times.
        known = scores().filter(F.col(ts).between(F.lit(span["lo"]), F.lit(span["hi"])))
        data = cut_lineage(feats.join(known, [*keys, *order]))
        if data.isEmpty():
            return
        phi = cut_lineage(fit(data, list(names))(data, [*keys, *order]))
        newest = X.topk_last(phi, [], [*order, *keys], top, names)
        last = data.agg(F.max_by("anomaly_score", F.struct(*order, *keys)).alias("anomaly_score"))
        emit(X.publish_importance(X.mean_abs_importance(phi, names), newest, last, batch_id), batch_id)

    return explain


def forecast_job(keys: Sequence[str], order: Sequence[str], emit: Callable[[DataFrame, int], None], value: str = "value",
                 rows: int = S.FORECAST_ROWS, steps: int = S.FORECAST_STEPS) -> Callable[[DataFrame, int], None]:
    """Each batch's last ``rows`` rows of a series are drawn ``steps`` ahead; a series with fewer rows in the batch
    waits for a fuller one. Rows without a time count as the oldest."""

    def run(batch: DataFrame, batch_id: int) -> None:
        emit(J.forecast(batch, keys, order, value, rows, steps, least=rows), batch_id)

    return run


# Watermark queries ----------------------------------------------------------------------

def stream_tumble(stream: DataFrame, every: str, delay: str, by: Sequence[str], *aggregates, ts: str = "ts") -> DataFrame:
    """Tumbling windows on a stream; a window is final once the watermark passes its end."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return Q.tumble(timed, every, by, *aggregates, ts=ts)


def stream_score_join(features: DataFrame, scores: DataFrame, keys: Sequence[str], delay: str, ts: str = "ts",
                      score_ts: str = "score_ts") -> DataFrame:
    """Feature rows with the score of their series and time; both sides' state is bounded
    by the watermark."""
    left = features.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).alias("f")
    right = scores.withColumn(score_ts, F.col(score_ts).cast("timestamp")).withWatermark(score_ts, delay).alias("s")
    same = F.col(f"f.{ts}") == F.col(f"s.{score_ts}")
    for k in keys:
        same = same & (F.col(f"f.{k}") == F.col(f"s.{k}"))
    plain = [f"s.{c}" for c in scores.columns if c not in (*keys, score_ts)]
    return left.join(right, same).select("f.*", *plain)


def latest_updates(updates: DataFrame, keys: Sequence[str], values: Sequence[str], batch: str = "batch") -> DataFrame:
    """Current counters from a log of update-mode rows."""
    newest = F.max_by(F.struct(*values), F.col(batch)).alias("_v")
    return updates.groupBy(*keys).agg(newest).select(*keys, "_v.*")
