"""Event patterns: a drop in one sensor, then a rise in another within some seconds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice import schema as S
from sluice.functions.clean import is_normal
from sluice.operators import tsquery as Q
from sluice.operators.series import (
    BLOCK_ROWS, QUANTILE_ROWS, SERIES_ROWS, carry_last, group_quantiles, join_on, largest_series, over_series,
    running_total, time_blocks)
from sluice.session import cut_lineage

FOLD_ROWS = 2_000

# Fixed value: the text of an event.
DETAILS = "FIT dropped from %s to %s at %s, LIT rose to %s (Δ=%.2f) at %s"


@dataclass(frozen=True)
class Thresholds:
    drop_below: float = S.DROP_BELOW
    rise_above: float = S.RISE_ABOVE
    min_drop: float = S.MIN_DROP
    min_rise: float = S.MIN_RISE
    followup_seconds: int = S.FOLLOWUP_SECONDS
    cooldown_seconds: int = S.COOLDOWN_SECONDS


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def first_rises(level: np.ndarray, start: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For each query the first row at or after ``start`` whose level reaches ``need``
    (-1 if none). Doubling maxima answer all queries of a block at once."""
    n = len(level)
    tables = [level]
    while (1 << len(tables)) <= n:
        prev, half = tables[-1], 1 << (len(tables) - 1)
        tables.append(np.maximum(prev[:-half], prev[half:]))
    pos = start.astype(np.int64)
    for k in range(len(tables) - 1, -1, -1):
        fits = pos + (1 << k) <= n
        top = np.full(len(pos), np.inf)
        top[fits] = tables[k][pos[fits]]
        pos = np.where(fits & (top < need), pos + (1 << k), pos)
    found = pos < n
    found[found] = level[pos[found]] >= need[found]
    return np.where(found, pos, -1)


def least_level(base: np.ndarray, rise: float) -> np.ndarray:
    """Smallest level whose difference to ``base`` is at least ``rise`` in double arithmetic."""
    need = base + rise
    for _ in range(4):
        need = np.where(need - base < rise, np.nextafter(need, np.inf), need)
    for _ in range(4):
        lower = np.nextafter(need, -np.inf)
        need = np.where(lower - base >= rise, lower, need)
    return need


class _Search:
    """Finds, for the drops of sorted whole groups, their first qualifying rise.

    A group is a run of rows with one ``_group``. Visiting drops (from an earlier block)
    stand in front of the rows they are tried on.
    """

    def __init__(self, names: Sequence[str], th: Thresholds):
        self.names, self.above, self.rise = list(names), th.rise_above, th.min_rise
        self.reach = th.followup_seconds * 1_000_000

    def need(self, base: np.ndarray) -> np.ndarray:
        # Without a level at the drop the rise counts as 0.
        blank = np.finfo(float).min if self.rise <= 0 else np.inf
        return np.where(np.isnan(base), blank, least_level(base, self.rise))

    def groups(self, pdf: pd.DataFrame) -> pd.DataFrame:
        at, b_now = pdf["_at"].to_numpy(), pdf["_b"].to_numpy(dtype=float)
        mine = pdf["_group"].to_numpy()
        fresh = np.cumsum(np.r_[True, mine[1:] != mine[:-1]])
        level = np.where((b_now > self.above) & ~pdf["_visit"].to_numpy(dtype=bool), b_now, -np.inf)
        i = np.flatnonzero((pdf["_drop"] & pdf["_own"]).to_numpy(dtype=bool))
        j = first_rises(level, i + 1, self.need(b_now[i]))
        # A first hit in a later group means that the drop's own group has none.
        here = (j >= 0) & (fresh[j] == fresh[i])
        ok = here & (at[j] - at[i] <= self.reach)
        base, top = b_now[i], np.where(ok, b_now[j], np.nan)
        out = {k: pdf[k].to_numpy()[i] for k in [*self.names, "_block", "_series"]}
        out |= {"drop_id": pdf["_tie"].to_numpy()[i], "drop_us": at[i], "rise_us": np.where(ok, at[j], 0), "_base": base,
                "dropped_from": pdf["_before"].to_numpy()[i], "dropped_to": pdf["_now"].to_numpy()[i], "rose_to": top,
                "rise": np.where(np.isnan(base), 0.0, top - base), "_hit": ok, "_open": ~here}
        return pd.DataFrame(out)

    def batches(self, batches):
        """Whole groups at a time: the unfinished last group of a batch waits for the next."""
        held = []
        for pdf in batches:
            if pdf.empty:
                continue
            mine = pdf["_group"].to_numpy()
            breaks = np.flatnonzero(mine[1:] != mine[:-1]) + 1
            if held and held[-1]["_group"].iloc[-1] != mine[0]:
                yield self.groups(pd.concat(held, ignore_index=True))
                held = []
            if len(breaks):
                yield self.groups(pd.concat([*held, pdf.iloc[:breaks[-1]]], ignore_index=True))
                held = []
            held.append(pdf.iloc[breaks[-1]:] if len(breaks) else pdf)
        if held:
            yield self.groups(pd.concat(held, ignore_index=True))

    def over(self, rows: DataFrame, order: Sequence[str], schema: T.StructType) -> DataFrame:
        group = F.xxhash64("_block", "_series")
        placed = rows.repartition("_block", "_series").sortWithinPartitions("_block", "_series", *order)
        columns = [*self.names, "_block", "_series", "_tie", "_at", "_now", "_before", "_b", "_drop", "_own", "_visit"]
        return placed.select(*columns, group.alias("_group")).mapInPandas(self.batches, schema)


def drop_then_rise(df: DataFrame, keys: Sequence[str], a: str, b: str, ts: str = "ts", tie: str = "event_id",
                   th: Thresholds = Thresholds(), block_seconds: int | None = None, max_rows: int = SERIES_ROWS,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each qualifying drop of ``a`` with the first qualifying rise of ``b`` after it.

    Drops are found with one lag. Drops and high levels alone go on, cut into stretches of
    time that carry the follow-up window along, and each stretch is searched without
    forming pairs. Should one stretch of one series be crowded, blocks of equal row count
    are searched instead.
    """
    order, names = [ts, tie], list(keys)

    def drops(frame, w):
        before = F.lag(a).over(w)
        fires = (before - F.col(a) >= th.min_drop) & (F.col(a) < th.drop_below)
        return frame.withColumn("_before", before).withColumn("_drop", F.coalesce(fires, F.lit(False)))

    number = {c: F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in (a, b)}
    rows = df.select(*names, *order, *number.values())
    marked = over_series(rows, keys, order, drops, before=1, max_rows=max_rows, block_rows=block_rows)
    high = F.coalesce(F.col(b) > th.rise_above, F.lit(False))
    series = F.xxhash64(*names, *[F.col(k).isNull() for k in names]) if names else F.lit(0).cast("bigint")
    # Without a time a reading is neither followed up nor a follow-up.
    slim = marked.filter((F.col("_drop") | high) & F.col(ts).isNotNull()).select(
        *names, ts, F.col(tie).alias("_tie"), _micros(ts).alias("_at"), F.col(a).alias("_now"), "_before",
        F.col(b).alias("_b"), "_drop", series.alias("_series"), F.lit(False).alias("_visit"))
    fields = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType(
        [T.StructField(k, fields[k]) for k in names]
        + [T.StructField(c, T.LongType()) for c in ("_block", "_series")]
        + [T.StructField("drop_id", fields[tie]), T.StructField("drop_us", T.LongType()), T.StructField("rise_us", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("_base", "dropped_from", "dropped_to", "rose_to", "rise")]
        + [T.StructField(c, T.BooleanType()) for c in ("_hit", "_open")])
    search = _Search(names, th)
    width = block_seconds or max(3600, 4 * th.followup_seconds)
    blocks = time_blocks(slim, ts, width, ahead_seconds=th.followup_seconds)
    if largest_series(blocks, ["_block", "_series"]) <= max_rows:
        found = search.over(blocks, ["_at", "_tie"], schema).filter("_hit")
    else:
        found = _in_row_blocks(slim.drop(ts), names, search, schema, block_rows)
    kind = fields[ts]
    return found.select(*names, "drop_id", "dropped_from", "dropped_to", "rose_to", "rise",
                        F.timestamp_micros("drop_us").cast(kind).alias("drop_ts"),
                        F.timestamp_micros("rise_us").cast(kind).alias("ts"))


def _in_row_blocks(slim: DataFrame, names: Sequence[str], search: _Search, schema: T.StructType, block_rows: int) -> DataFrame:
    """The same search over blocks of equal row count.

    A drop is tried on its own block first. If the series goes on, the highest level of
    each later block (one number per block) tells the one block that holds its rise, and
    the drop visits that block.
    """
    spark = slim.sparkSession
    indexed = running_total(slim, ["_series"], ["_at", "_tie"], None, "_idx")
    indexed = indexed.withColumn("_block", F.floor(F.col("_idx") / block_rows)).withColumn("_own", F.lit(True))
    local = cut_lineage(search.over(indexed, ["_idx"], schema))
    level = F.when(F.col("_b") > search.above, F.col("_b"))
    tops = indexed.groupBy("_series", "_block").agg(F.max(level).alias("top"), F.min("_at").alias("at"))
    several = F.count(F.lit(1)).over(Window.partitionBy("_series"))
    ahead = tops.withColumn("_n", several).filter("_n > 1").orderBy("_series", "_block").toPandas()
    if ahead.empty:
        return local.filter("_hit")
    known = spark.sparkContext.broadcast(
        (ahead["_series"].to_numpy(), ahead["_block"].to_numpy(), ahead["top"].fillna(-np.inf).to_numpy(dtype=float), ahead["at"].to_numpy()))

    def aim(batches):
        series, block, top, at = known.value
        where = pd.MultiIndex.from_arrays([series, block])
        for pdf in batches:
            place = where.get_indexer(pd.MultiIndex.from_arrays([pdf["_series"], pdf["_block"]]))
            pdf, place = pdf[place >= 0], place[place >= 0]
            j = first_rises(top, place + 1, search.need(pdf["_base"].to_numpy(dtype=float)))
            ok = (j >= 0) & (series[j] == series[place]) & (at[j] - pdf["drop_us"].to_numpy() <= search.reach)
            yield pdf[ok].assign(_block=block[j[ok]])

    open_drops = local.filter("_open AND NOT _hit")
    visits = cut_lineage(open_drops.mapInPandas(aim, schema))
    visitors = visits.select(*names, "_series", "_block", F.col("drop_id").alias("_tie"), F.col("drop_us").alias("_at"),
                             F.col("dropped_to").alias("_now"), F.col("dropped_from").alias("_before"), F.col("_base").alias("_b"),
                             F.lit(True).alias("_drop"), F.lit(True).alias("_own"), F.lit(True).alias("_visit"), F.lit(-1).alias("_idx"))
    visited = visits.select("_series", "_block").distinct()
    hosts = indexed.join(visited, ["_series", "_block"], "left_semi").withColumn("_drop", F.lit(False))
    later = search.over(hosts.unionByName(visitors), ["_idx"], schema)
    return local.filter("_hit").unionByName(later.filter("_hit"))


def _iso(ts: str) -> Column:
    micros = _micros(ts) % 1_000_000
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros == 0, whole).otherwise(F.concat(whole, F.lit("."), F.lpad(micros.cast("string"), 6, "0")))


def as_events(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matches as pattern events: time of the rise, severity 1, the text."""
    text = F.format_string(DETAILS, "dropped_from", "dropped_to", _iso("drop_ts"), "rose_to", "rise", _iso("ts"))
    return matches.select(*keys, "drop_id", F.lit(S.PATTERN_NAME).alias("pattern"), F.lit(S.PATTERN_SENSOR).alias("sensor"),
                          F.lit(1.0).alias("severity"), text.alias("details"), "drop_ts", "ts")


def cooldown(matches: DataFrame, keys: Sequence[str], seconds: int = S.COOLDOWN_SECONDS, followup_seconds: int | None = None,
             start: str = "drop_ts", end: str = "ts", tie: str = "drop_id", fold_rows: int = FOLD_ROWS,
             **sizing) -> DataFrame:
    """Keep a match unless its drop comes less than ``seconds`` after the last kept match's rise.

    Ordinary series are folded in place. When some series has more than ``fold_rows``
    matches, every match points at the one that would be kept next, and the kept ones are
    reached by doubling those pointers: joins on unique ids, no series held in one task.
    """
    matches = cut_lineage(matches)
    if largest_series(matches, keys) <= fold_rows:
        return _fold(matches, keys, seconds, start, end, tie)
    return _follow_pointers(matches, keys, seconds, followup_seconds, start, end, tie, **sizing)


def _fold(matches, keys, seconds, start, end, tie):
    rest = [c for c in matches.columns if c not in keys]
    row = F.struct(_micros(start).alias("_s"), F.col(tie).alias("_i"), _micros(end).alias("_e"), F.struct(*rest).alias("_row"))
    listed = matches.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_all"))
    empty = F.filter("_all", lambda x: F.lit(False))
    first = F.struct(F.lit(None).cast("bigint").alias("last"), empty.alias("kept"))

    def step(acc, x):
        cold = acc["last"].isNotNull() & (x["_s"] - acc["last"] < seconds * 1_000_000)
        return F.when(cold, acc).otherwise(F.struct(x["_e"].alias("last"), F.concat(acc["kept"], F.array(x)).alias("kept")))

    kept = listed.select(*keys, F.explode(F.aggregate("_all", first, step)["kept"]).alias("_k"))
    return kept.select(*keys, "_k._row.*").select(*matches.columns)


def _follow_pointers(matches, keys, seconds, followup_seconds, start, end, tie, **sizing):
    wait = seconds * 1_000_000
    nodes = matches.withColumn("_s", _micros(start)).withColumn("_e", _micros(end))
    # The next kept match is the first whose drop is at or past the end of the cooldown; a
    # match never points at itself or before.
    until = F.col("_e") + wait
    queries = nodes.select(*keys, until.alias("_t"), F.when(until == F.col("_s"), F.col(tie)).alias("_o"),
                           F.lit(1).alias("_side"), F.col(tie).alias("_from"))
    starts = nodes.select(*keys, F.col("_s").alias("_t"), F.col(tie).alias("_o"), F.lit(0).alias("_side"),
                          F.col(tie).alias("_to"))
    both = queries.unionByName(starts, allowMissingColumns=True)
    filled = carry_last(both, keys, ["_t", "_o", "_side"], "_to", "_next", descending=True, **sizing)
    jump = cut_lineage(filled.filter("_side = 1 AND _next IS NOT NULL").select(
        *keys, "_from", F.col("_next").alias("_to")))

    def heads(frame, w):
        gap = F.col("_s") - F.lag("_s").over(w)
        # A longer silence than cooldown and follow-up together clears any history.
        clear = gap >= wait + followup_seconds * 1_000_000 if followup_seconds is not None else F.lit(False)
        return frame.withColumn("_head", gap.isNull() | clear)

    marked = cut_lineage(over_series(nodes, keys, ["_s", tie], heads, before=1, **sizing)
                         .filter("_head").select(*keys, F.col(tie).alias("_from")))
    n = marked.count()
    while True:
        reached = join_on(marked, jump, [*keys, "_from"]).select(*keys, F.col("_to").alias("_from"))
        marked = cut_lineage(marked.unionByName(reached).distinct())
        grown = marked.count()
        if grown == n:
            break
        n = grown
        onward = jump.select(*keys, F.col("_from").alias("_to"), F.col("_to").alias("_far"))
        jump = cut_lineage(join_on(jump, onward, [*keys, "_to"]).select(*keys, "_from", F.col("_far").alias("_to")))
    kept = marked.withColumnRenamed("_from", tie)
    return join_on(nodes, kept, [*keys, tie]).select(*matches.columns)


def detect(df: DataFrame, keys: Sequence[str], a: str, b: str, ts: str = "ts", tie: str = "event_id",
           th: Thresholds = Thresholds()) -> DataFrame:
    """Pattern events of every series: drops, rises and cooldown."""
    matches = drop_then_rise(df, keys, a, b, ts, tie, th)
    return as_events(cooldown(matches, keys, th.cooldown_seconds, th.followup_seconds), keys)


def tune_thresholds(df: DataFrame, a: str, b: str, label: str | None = None, low_q: float = 0.05, high_q: float = 0.95,
                    drop_share: float = 0.10, rise_share: float = 0.10, a_range=(1.0, 5.0), b_range=(400.0, 600.0),
                    least_drop: float = 0.05, least_rise: float = 0.5, defaults: Thresholds = Thresholds(),
                    max_rows: int = QUANTILE_ROWS) -> Thresholds:
    """Thresholds from normal rows: a low quantile of ``a``, a high one of ``b`` and shares
    of their ranges; values outside the guard rails fall back to the defaults."""
    rows = df if label is None else df.filter(is_normal(F.col(label)))
    span = rows.agg(F.min(a).alias("alo"), F.max(a).alias("ahi"), F.min(b).alias("blo"), F.max(b).alias("bhi")).first()
    if span["alo"] is None or span["blo"] is None:
        raise ValueError("no values to tune thresholds from")
    low = group_quantiles(rows, [], a, [low_q], max_rows).first()["quantiles"][0]
    high = group_quantiles(rows, [], b, [high_q], max_rows).first()["quantiles"][0]
    drop, rise = drop_share * (span["ahi"] - span["alo"]), rise_share * (span["bhi"] - span["blo"])
    return Thresholds(
        drop_below=low if a_range[0] < low <= a_range[1] else defaults.drop_below,
        rise_above=high if b_range[0] <= high <= b_range[1] else defaults.rise_above,
        min_drop=drop if drop >= least_drop else defaults.min_drop,
        min_rise=rise if rise >= least_rise else defaults.min_rise,
        followup_seconds=defaults.followup_seconds, cooldown_seconds=defaults.cooldown_seconds)


def pattern_report(events: DataFrame, every: str = "1 minute", latest: int = 100):
    """(events per window, highest severity per window, latest events)."""
    per_window = Q.tumble_count(events, every, ["pattern", "sensor"])
    worst = Q.tumble_max(events, every, ["pattern", "sensor"], value="severity")
    return per_window, worst, Q.sort_limit(events, ["ts", "drop_id"], latest)


def pattern_alert(events: DataFrame, above: float = 0.0) -> DataFrame:
    return events.filter(F.col("severity") > above)
