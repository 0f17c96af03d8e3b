"""Rows of equal bins as one weighted row, for learners that only see bins.

A tree learner splits a column at no more than ``bins - 1`` thresholds, so rows that lie between the same thresholds in every
column go the same way in every tree. Their number, mean target and weight are all that the sums of a split need: the mean
leaves out only a spread that no split can part, which cancels in every gain. Every row counts; the number of cells is bounded
by the bins of the columns, not by the rows. What a learner draws at random (the bag of a tree) it draws by groups: where cells
are few, each is dealt out over several groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.session import cut_lineage

BINS = 32
#: The error of a quantile's rank is one in this many rows.
QUANTILE_ACCURACY = 2_000
#: Up to this many rows a learner gets the rows themselves; beyond, groups of them, about as many where cells are few.
WHOLE_ROWS = 200_000
WEIGHT = "_weight"


def bin_values(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Per column the values that stand for its bins: all of them if they are at most ``bins``, otherwise the middles of
    equally deep bins over all rows. Numbers without an end stand for no bin and fall into the outer ones."""
    ends = [(2 * k + 1) / (2 * bins) for k in range(bins)]
    finite = {c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c)) for c in columns}
    row = df.agg(*[F.percentile_approx(finite[c], ends, QUANTILE_ACCURACY).alias(f"q{i}") for i, c in enumerate(columns)],
                 *[F.approx_count_distinct(finite[c]).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    few = [c for i, c in enumerate(columns) if row[f"n{i}"] <= 2 * bins]
    sets = df.agg(*[F.collect_set(finite[c]).alias(f"s{i}") for i, c in enumerate(few)]).first() if few else {}
    out = {}
    for i, c in enumerate(columns):
        values = sets[f"s{few.index(c)}"] if c in few else None
        out[c] = sorted(set(values if values is not None and len(values) <= bins else row[f"q{i}"] or [0.0]))
    return out


def edges(values: Sequence[float]) -> list[float]:
    """The thresholds between values, as the learner sets them."""
    x = np.asarray(values, float)
    return [float(e) for e in (x[1:] + x[:-1]) / 2]


def binned(df: DataFrame, values: dict[str, list[float]]) -> DataFrame:
    """``df`` with each column replaced by the value that stands for its bin, found by halving; a row on a threshold goes below it,
    as in the trees, and NaN stays, for the learner to judge. One pass in Arrow batches: as expressions, many columns
    outgrow what the engine compiles."""
    stand, cuts = {c: np.array(v, float) for c, v in values.items()}, {c: np.array(edges(v)) for c, v in values.items()}
    names = df.columns

    def bins(batches):
        for batch in batches:
            columns = []
            for c, column in zip(names, batch.columns):
                if c in stand:
                    x = column.to_numpy(zero_copy_only=False)
                    found = stand[c][np.searchsorted(cuts[c], x, "left")]
                    column = pa.array(np.where(np.isnan(x), x, found), mask=column.is_null().to_numpy(zero_copy_only=False))
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, names)

    ready = df.withColumns({c: F.col(c).cast("double") for c in values})
    return ready.mapInArrow(bins, ready.schema)


@dataclass(frozen=True)
class Grouped:
    """``rows`` for a learner, ``count`` of them, and its settings for them; without ``values`` they are the rows as given."""

    rows: DataFrame
    count: int
    settings: dict
    values: dict[str, list[float]] | None = None


def grouped(df: DataFrame, columns: Sequence[str], target: str, classes: bool = False, seed: int = 42) -> Grouped:
    """``columns, target`` of all rows, from ``WHOLE_ROWS`` on as groups with their number of rows as weight.

    Rows of a group have equal bins; ``target`` is their mean, or with ``classes`` their common value. The learner is
    given enough bins to look at every group for its thresholds, so these are ``edges`` of the values.
    """
    df = df.select(*[F.col(c).cast("double").alias(c) for c in columns], F.coalesce(F.col(target).cast("double"), F.lit(float("nan"))).alias(target))
    rows = df.count()
    if rows <= WHOLE_ROWS:
        return Grouped(df, rows, {})
    values = bin_values(df, columns)
    keys = [*columns, target] if classes else list(columns)
    rows, width = binned(df, values), df.sparkSession.sparkContext.defaultParallelism

    def dealt(parts: int) -> DataFrame:
        part = F.floor(F.rand(seed) * parts) if parts > 1 else F.lit(0)
        sums = [F.count(F.lit(1)).cast("double").alias(WEIGHT), *([] if classes else [F.avg(target).alias(target)])]
        out = rows.withColumn("_part", part).groupBy(*keys, "_part").agg(*sums)
        return cut_lineage(out.select(*columns, target, WEIGHT).repartition(width))

    out = dealt(1)
    parts = round(WHOLE_ROWS / out.count())
    if parts > 1:
        out = dealt(parts)
    groups = out.count()
    return Grouped(out, groups, {"weightCol": WEIGHT, "maxBins": max(BINS, isqrt(groups) + 1)}, values)


def cell_moments(df: DataFrame, values: dict[str, list[float]], target: str) -> DataFrame:
    """Per cell the columns, ``target`` as the mean, ``n`` rows and ``spread``, their squared distances from the mean."""
    one = F.count(F.lit(1)).cast("double")
    return binned(df.select(*values, target), values).groupBy(*values).agg(F.avg(target).alias(target), one.alias("n"), (F.var_pop(target) * one).alias("spread"))
