"""A percentile that follows a stream: a mergeable quantile sketch per micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import schema as S
from sluice.operators import anomaly as A

#: Sketch size: rank error of about 1.3 / k ** 0.9, a third of a percent for 800.
SKETCH_K = 800
#: Batches up to this size are answered exactly where the threshold looks at one batch only.
EXACT_ROWS = 100_000


def sketch_of(scores: DataFrame, score: str = "anomaly_score", k: int = SKETCH_K) -> DataFrame:
    """One row ``n, sketch``; partial sketches are merged on the way."""
    value = F.col(score).cast("double")
    return scores.filter(value.isNotNull() & ~F.isnan(value)).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(score, F.lit(k)).alias("sketch"))


class LivePercentile:
    """Threshold, flags and a summary per micro-batch, from the sketches of the last ``span`` batches.

    ``span`` = 1 judges a batch by its own scores. Each batch's sketch is a small table of its own in ``path``; a
    batch that is run again overwrites it, so restarts change nothing.
    """

    def __init__(self, spark: SparkSession, path: str, q: float = S.SCORE_PERCENTILE, span: int = 1, k: int = SKETCH_K,
                 exact_rows: int = EXACT_ROWS, score: str = "anomaly_score"):
        self.spark, self.path, self.q, self.span, self.k, self.exact_rows, self.score = spark, path, q, span, k, exact_rows, score

    def _write(self, row: DataFrame, what: str, batch_id: int) -> None:
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{what}/batch_id={batch_id}")

    def _read(self, what: str, schema: str, first: int, last: int) -> DataFrame:
        kept = self.spark.read.schema(f"{schema}, batch_id bigint").parquet(f"{self.path}/{what}")
        return kept.filter(F.col("batch_id").between(first, last))

    def threshold(self, scores: DataFrame, batch_id: int) -> float | None:
        """None where no score has been seen."""
        self._write(sketch_of(scores, self.score, self.k), "sketches", batch_id)
        seen = self._read("sketches", "n bigint, sketch binary", batch_id - self.span + 1, batch_id).filter("n > 0")
        rows = seen.agg(F.sum("n")).first()[0]
        if not rows:
            return None
        if self.span == 1 and rows <= self.exact_rows:
            value = F.col(self.score)
            return scores.filter(~F.isnan(value)).agg(F.percentile(value, F.lit(self.q))).first()[0]
        merged = seen.agg(F.kll_merge_agg_double("sketch", F.lit(self.k)).alias("sketch"))
        return merged.select(F.kll_sketch_get_quantile_double("sketch", F.lit(float(self.q)))).first()[0]

    def judge(self, scores: DataFrame, batch_id: int, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        """(scores with threshold and flag, one summary row). ``events_total`` counts the batches so far with
        any anomaly."""
        limit = F.lit(self.threshold(scores, batch_id)).cast("double")
        flagged = scores.withColumn("threshold", limit).withColumn(
            "is_anomaly", F.coalesce((F.col(self.score) > limit).cast("int"), F.lit(0)))
        one = flagged.agg(
            F.lit(batch_id).cast("bigint").alias("batch"), F.count(F.lit(1)).alias("scores"), F.max("threshold").alias("threshold"),
            F.coalesce(F.sum("is_anomaly"), F.lit(0)).alias("anomalies"), F.coalesce(F.max("is_anomaly"), F.lit(0)).alias("any_anomaly"),
            F.max_by(self.score, F.struct(*order)).alias("last_score"))
        one = one.withColumn("normalised_score", A.normalised(F.col("last_score"), F.col("threshold")))
        self._write(one.select("any_anomaly"), "events", batch_id)
        total = self._read("events", "any_anomaly int", 0, batch_id).agg(F.coalesce(F.sum("any_anomaly"), F.lit(0)).alias("events_total"))
        return flagged, one.join(total)
