"""Ordered work on series that stays balanced when one series holds most of the rows.

A window partitioned by the series key puts a whole series in one task. That is the
cheapest plan (one shuffle) while every series is of ordinary size, so each operator here
first measures the largest series with one narrow, map-side-combined count. Past
``SERIES_ROWS`` the rows get a global position in (key, order), are cut into equal blocks
of ``BLOCK_ROWS``, and each block receives the few neighbouring rows its frames need.
Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sluice.session import cut_lineage

SERIES_ROWS = 4_000_000
BLOCK_ROWS = 500_000
QUANTILE_ROWS = 500_000
SKETCH_ACCURACY = 10_000
BROADCAST_ROWS = 200_000


def largest_series(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group (0 for an empty frame)."""
    if not keys:
        return df.count()
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.max("_n").alias("m")).first()["m"] or 0


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint when the frame has at most ``limit`` rows; otherwise left to AQE."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on ``keys`` in which a null key meets a null key, as in grouping."""
    l, r = left.alias("l"), right.alias("r")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    extra = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return l.join(r, same, how).select("l.*", *extra)


def _in_order(order: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in order]


def _placed(df: DataFrame, keys: Sequence[str], order: Sequence[str], descending: bool) -> DataFrame:
    """Range-partitioned and sorted rows with ``__place``: partition number and place in it."""
    sort = [F.col(k).asc_nulls_first() for k in keys] + _in_order(order, descending)
    ranged = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    return cut_lineage(ranged.withColumn("__place", F.monotonically_increasing_id()))


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    amount: Column | None,
    out: str,
    descending: bool = False,
) -> DataFrame:
    """Sum of ``amount`` over all rows *before* this one in (keys, order), over the whole
    frame. ``amount=None`` counts rows. (keys, order) must be unique.

    Only one number per range partition reaches the driver.
    """
    placed = _placed(df, keys, order, descending).withColumn("__part", F.shiftright("__place", 33))
    one = F.lit(1).cast("bigint") if amount is None else amount
    totals = {
        r["__part"]: r["t"]
        for r in placed.groupBy("__part").agg(F.sum(one).alias("t")).collect()
    }
    starts, seen = [], 0
    for part in sorted(totals):
        starts.append((int(part), seen))
        seen += totals[part]
    bases = df.sparkSession.createDataFrame(starts, "__part bigint, __base bigint")
    placed = placed.join(F.broadcast(bases), "__part")
    if amount is None:
        before = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    else:
        inside = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum(one).over(inside), F.lit(0))
    return placed.withColumn(out, F.col("__base") + before).drop("__part", "__base", "__place")


def with_row_index(
    df: DataFrame, order: Sequence[str], out: str = "row_index", descending: bool = False
) -> DataFrame:
    """0-based position in a total order, without a sort in one task."""
    return running_total(df, [], order, None, out, descending)


def series_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "position",
    descending: bool = False,
    max_rows: int = SERIES_ROWS,
) -> DataFrame:
    """1-based position of each row in its own series."""
    if largest_series(df, keys) <= max_rows and keys:
        w = Window.partitionBy(*keys).orderBy(*_in_order(order, descending))
        return df.withColumn(out, F.row_number().over(w).cast("bigint"))
    indexed = running_total(df, keys, order, None, "_idx", descending)
    if not keys:
        return indexed.withColumn(out, F.col("_idx") + 1).drop("_idx")
    firsts = indexed.groupBy(*keys).agg(F.min("_idx").alias("_first"))
    return (
        join_on(indexed, small_side(firsts), keys)
        .withColumn(out, F.col("_idx") - F.col("_first") + 1)
        .drop("_idx", "_first")
    )


def over_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    before: int = 0,
    after: int = 0,
    max_rows: int = SERIES_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Run ``compute(frame, window)`` where ``window`` is ordered within each series.

    ``compute`` adds columns from frames reaching at most ``before`` rows back and
    ``after`` rows ahead, and may drop rows; it must not depend on anything farther.
    """
    if keys and largest_series(df, keys) <= max_rows:
        return compute(df, Window.partitionBy(*keys).orderBy(*order))
    if max(before, after) > block_rows:
        raise ValueError("frames must fit in one block")
    indexed = running_total(df, keys, order, None, "_idx")
    block = F.floor(F.col("_idx") / block_rows)
    place = F.col("_idx") % block_rows
    homes = [F.struct(block.alias("b"), F.lit(True).alias("own"))]
    if before:
        homes.append(F.when(place >= block_rows - before,
                            F.struct((block + 1).alias("b"), F.lit(False).alias("own"))))
    if after:
        homes.append(F.when((place < after) & (block > 0),
                            F.struct((block - 1).alias("b"), F.lit(False).alias("own"))))
    spread = indexed.withColumn("_home", F.explode(F.array_compact(F.array(*homes))))
    spread = spread.withColumn("_block", F.col("_home.b")).withColumn("_own", F.col("_home.own"))
    w = Window.partitionBy("_block", *keys).orderBy("_idx")
    return compute(spread.drop("_home"), w).filter("_own").drop("_block", "_own", "_idx")


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    column: str,
    out: str,
    descending: bool = False,
    max_rows: int = SERIES_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Last non-null ``column`` at or before each row (after it, when ``descending``)."""
    if keys and largest_series(df, keys) <= max_rows:
        w = Window.partitionBy(*keys).orderBy(*_in_order(order, descending))
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.last(column, ignorenulls=True).over(upto))
    indexed = running_total(df, keys, order, None, "_idx", descending).withColumn(
        "_block", F.floor(F.col("_idx") / block_rows)
    )
    tails = indexed.groupBy("_block", *keys).agg(
        F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col("_idx"))).alias("_tail")
    )
    blocks_before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select("_block", *keys, F.last("_tail", ignorenulls=True).over(blocks_before).alias("_carry"))
    inside = Window.partitionBy("_block", *keys).orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    joined = join_on(indexed, small_side(carried), ["_block", *keys], "left")
    return joined.withColumn(
        out, F.coalesce(F.last(column, ignorenulls=True).over(inside), F.col("_carry"))
    ).drop("_idx", "_block", "_carry")


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Sequence[float],
    max_rows: int = QUANTILE_ROWS,
) -> DataFrame:
    """Exact linear-interpolated quantiles: ``keys`` + ``quantiles array<double>``.

    Groups of ordinary size use the built-in exact aggregate, whose buffer holds the
    distinct values of one group. Beyond that a sketch says between which values each wanted rank lies;
    those are counted one by one, all others only by the stretch between that they fall into. A global
    running total then gives the ranks, and the rows at the wanted ranks are read off. Should a rank lie
    outside its stretch, all values are counted.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if largest_series(rows, keys) <= max_rows:
        wanted = F.percentile("_v", F.array(*[F.lit(float(q)) for q in quantiles]))
        return rows.groupBy(*keys).agg(wanted.alias("quantiles"))
    hits = cut_lineage(_at_ranks(_counted_near(rows, keys, quantiles, max_rows), keys, ["_stretch", "_v"], quantiles))
    if not hits.filter("_missed").isEmpty():
        counted = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
        hits = _at_ranks(counted, keys, ["_v"], quantiles)
    return hits.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_value"))), lambda s: s["_value"]).alias("quantiles")
    )


def _counted_near(rows: DataFrame, keys: Sequence[str], quantiles: Sequence[float], max_rows: int) -> DataFrame:
    """(keys, _stretch, _v, _c): how often each value occurs that may lie at a wanted rank; ``_v`` is null for the
    others, which come before the values of their stretch. Groups of ordinary size keep all their values.

    The sketch errs by a share of 1 / ``SKETCH_ACCURACY`` of the ranks; twice that is kept on either side.
    """
    reach, asked = 2 / SKETCH_ACCURACY + 2 / max_rows, sorted(float(q) for q in quantiles)
    ends = [min(max(q + side, 0.0), 1.0) for side in (-reach, reach) for q in asked]
    sketched = cut_lineage(rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.percentile_approx("_v", ends, SKETCH_ACCURACY).alias("_ends")))
    placed = join_on(rows, small_side(sketched), keys)
    v, end = F.col("_v"), F.col("_ends")

    def passed(lo: int, hi: int) -> Column:
        """How many upper ends lie below the value, which is at least ``lo`` and at most ``hi``, by halving."""
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(v > end[len(asked) + middle], passed(middle + 1, hi)).otherwise(passed(lo, middle))

    placed = placed.withColumn("_stretch", passed(0, len(asked)))
    near = (F.col("_rows") <= max_rows) | ((F.col("_stretch") < len(asked)) & (v >= F.get(end, F.col("_stretch"))))
    return placed.select(*keys, "_stretch", F.when(near, v).alias("_v")).groupBy(*keys, "_stretch", "_v").agg(
        F.count(F.lit(1)).alias("_c"))


def _at_ranks(counted: DataFrame, keys: Sequence[str], order: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """(keys, _i, _value, _missed): the interpolated value at each wanted rank of counted values in ``order``;
    ``_missed`` where the rank meets an uncounted value."""
    ranked = running_total(counted, keys, order, F.col("_c"), "_start")
    groups = ranked.groupBy(*keys).agg(F.min("_start").alias("_base"), F.sum("_c").alias("_n"))
    asked = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(quantiles)])
    if keys:
        placed = join_on(ranked, small_side(cut_lineage(groups)), keys)
    else:
        base = groups.first()
        placed = ranked.withColumn("_base", F.lit(base["_base"])).withColumn("_n", F.lit(base["_n"]))
    rank = F.col("_start") - F.col("_base")
    at = F.col("_q.q") * (F.col("_n") - 1)
    low, high = F.floor(at), F.ceil(at)
    share = at - low
    weight = (
        F.when((low >= rank) & (low < rank + F.col("_c")), 1 - share).otherwise(0.0)
        + F.when((high >= rank) & (high < rank + F.col("_c")), share).otherwise(0.0)
    )
    reach = F.filter(asked, lambda s: (F.ceil(s["q"] * (F.col("_n") - 1)) >= rank)
                     & (F.floor(s["q"] * (F.col("_n") - 1)) < rank + F.col("_c")))
    return placed.withColumn("_q", F.explode(reach)).groupBy(*keys, F.col("_q.i").alias("_i")).agg(
        F.sum(F.col("_v") * weight).alias("_value"), F.bool_or(F.col("_v").isNull()).alias("_missed")
    )


def time_blocks(df: DataFrame, ts: str, block_seconds: int, back_seconds: int = 0, ahead_seconds: int = 0) -> DataFrame:
    """Rows keyed by ``_block`` (fixed stretch of time) with ``_own``; copies of the rows
    up to ``back_seconds`` before a block and ``ahead_seconds`` after it ride along. Rows
    without a time have the null block to themselves.

    Splits one long series over many tasks without any count.
    """
    width = block_seconds * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    home = F.floor(at / width)
    first = F.floor((at - ahead_seconds * 1_000_000) / width)
    last = F.floor((at + back_seconds * 1_000_000) / width)
    return (
        df.withColumn("_block", F.explode_outer(F.sequence(first, last)))
        .withColumn("_own", F.col("_block").eqNullSafe(home))
    )
