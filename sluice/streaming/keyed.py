"""Ordered work over streams with one state per series, held in the engine's state store.

A series has its own clock: its horizon is the newest time it has shown less the allowed
delay. Rows before the horizon are settled, in order, once; rows at or past it wait, so rows of equal
time that arrive in different batches are never torn apart. A row that comes before the horizon is late,
a row without a time cannot be placed: both are handed on, marked, and enter no result. A series that falls
silent is settled by a timer on the arrival clock.

Series are dealt by a hash of their key into ``GROUPS`` groups. A group is one key of the state store: the clocks of its
series and the rows they still need, each an Arrow table. Rows reach a group as Arrow blocks and leave it as such, and all
its series are worked on at once, so a batch costs by rows and touched groups, not by series. Only groups with new
rows are touched. One series is worked on by one task of a batch; a batch bounds what that is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from sluice.operators import patterns as P

ROW, LATE, UNTIMED = "row", "late", "untimed"
START, NEVER = -(1 << 62), 1 << 62
#: Series share this many keys of the state store; a running stream keeps the number it began with.
GROUPS = 1024
#: Rows that one task sorts into blocks at once, and rows of one block of results.
PACK_ROWS, OUT_ROWS = 1 << 18, 1 << 16
KINDS = {"double": pa.float64(), "bigint": pa.int64(), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}


def _to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _to_table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all().combine_chunks()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, its rows as one Arrow block), for up to ``PACK_ROWS`` rows of a task at a time."""

    def packed(table: pa.Table) -> pa.RecordBatch:
        order = np.argsort(table["row_group"].to_numpy(), kind="stable")
        table = table.take(order)
        group = table["row_group"].to_numpy()
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        table = table.drop_columns(["row_group"])
        made = [_to_bytes(table.slice(a, b - a)) for a, b in zip(first, np.r_[first[1:], len(group)])]
        return pa.RecordBatch.from_arrays([pa.array(group[first], pa.int32()), pa.array(made, pa.binary())], ["row_group", "block"])

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= PACK_ROWS:
            yield packed(pa.Table.from_batches(held).combine_chunks())
            held, rows = [], 0
    if held:
        yield packed(pa.Table.from_batches(held).combine_chunks())


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.column(0):
            yield from _to_table(block.as_py()).to_batches()


def _series_of(known: Sequence[pa.Array], fresh: Sequence[pa.Array], n: int, more: int) -> np.ndarray:
    """A number for the series of each fresh row: the place of its key among the ``n`` known ones, new ones after them in the
    order they come. A null key is a key."""
    codes = np.zeros(n + more, np.int64)
    for a, b in zip(known, fresh):
        part = pa.concat_arrays([a, b]).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        codes = pd.factorize(codes * (part.max(initial=0) + 1) + part)[0]
    return codes[n:]


def _column(made: np.ndarray) -> pa.Array:
    """Numbers with NaN as null, or one list of lists per row."""
    if made.ndim < 3:
        return pa.array(np.ascontiguousarray(made), from_pandas=True)
    n, length, width = made.shape
    inner = pa.ListArray.from_arrays(np.arange(n * length + 1, dtype=np.int32) * width, pa.array(np.ascontiguousarray(made).reshape(-1)))
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * length, inner)


class Settling(StatefulProcessor):
    """State of a group: the rows its series still need, and per series its newest time, its horizon, a mark of the
    subclass and when its silence ends."""

    CLOCK = ["newest", "horizon", "mark", "due"]

    def __init__(self, keys: Sequence[str], width: int, delay_seconds: int, idle_seconds: int | None):
        self.keys, self.width = list(keys), width
        self.delay, self.idle = delay_seconds * 1_000_000, idle_seconds

    #: Names of what a subclass adds to a row, and their types.
    outputs: list[str] = []
    kinds: list[str] = []
    #: How long after its time a row may still change a result.
    reach = 0

    def settle(self, series, us, tie, values, since, upto, mark) -> tuple[np.ndarray, Callable[[int, int], list[np.ndarray]], np.ndarray, np.ndarray]:
        """Rows come sorted by series, time and tie; ``since``, ``upto`` and ``mark`` are per series. Gives the places of the rows
        whose results became final between the two horizons, a maker of the outputs of a stretch of
        them, which rows to keep, and the new marks."""
        raise NotImplementedError

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("group", "held binary, clock binary")

    def close(self) -> None:
        pass

    def _load(self):
        """(keys of the series, their clock, held rows as series, time, tie and values)."""
        stored = self.state.get()
        if stored is None:
            nothing = np.zeros(0, np.int64)
            return None, {c: nothing for c in self.CLOCK}, (nothing, nothing, nothing, np.zeros((0, self.width)))
        held, clock = (_to_table(bytes(x)) for x in stored)
        keys = [clock.column(i).combine_chunks() for i in range(len(self.keys))]
        rows = [held.column(i).to_numpy() for i in range(3 + self.width)]
        return keys, {c: clock[c].to_numpy() for c in self.CLOCK}, (*rows[:3], np.stack(rows[3:], axis=1))

    def _step(self, keys: list[pa.Array], clock: dict[str, np.ndarray], rows, upto: np.ndarray) -> Iterator[pd.DataFrame]:
        series, us, tie, values = rows
        order = np.lexsort((tie, us, series))
        series, us, tie, values = series[order], us[order], tie[order], values[order]
        at, make, keep, mark = self.settle(series, us, tie, values, clock["horizon"], upto, clock["mark"])
        held = [series, us, tie, *values.T]
        clock = clock | {"horizon": upto, "mark": mark}
        self.state.update((
            _to_bytes(pa.table([pa.array(np.ascontiguousarray(c[keep])) for c in held], [f"h{i}" for i in range(len(held))])),
            _to_bytes(pa.table([*keys, *[pa.array(clock[c]) for c in self.CLOCK]], [*[f"k{i}" for i in range(len(keys))], *self.CLOCK]))))
        for lo in range(0, len(at), OUT_ROWS):
            part = at[lo:lo + OUT_ROWS]
            made = [_column(np.asarray(c)) for c in make(lo, lo + len(part))]
            yield self._named([k.take(pa.array(series[part])) for k in keys], pa.array(us[part]), pa.array(tie[part], mask=tie[part] == START), made, ROW)

    def _named(self, keys: list[pa.Array], us: pa.Array, tie: pa.Array, made: list[pa.Array], kind: str) -> pd.DataFrame:
        made = [m.cast(KINDS[k]) for m, k in zip(made, self.kinds)]
        names = [*self.keys, "us", "tie", *self.outputs, "kind"]
        return pd.DataFrame({"made": [_to_bytes(pa.table([*keys, us, tie, *made, pa.array([kind] * len(us))], names))]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        keys, clock, held = self._load()
        fresh = pa.concat_tables([_to_table(b) for part in rows for b in part["block"]]).combine_chunks()
        columns = [c.combine_chunks() for c in fresh.columns]
        mine, (us, tie), values = columns[:len(self.keys)], columns[len(self.keys):][:2], columns[len(self.keys) + 2:]
        known = len(clock["newest"])
        series = _series_of(keys or [k[:0] for k in mine], mine, known, len(fresh))
        timed, at = us.is_valid().to_numpy(zero_copy_only=False), us.fill_null(0).to_numpy()
        names, first = np.unique(series, return_index=True)
        new = pa.array(first[names >= known])
        keys = [pa.concat_arrays([k, m.take(new)]) for k, m in zip(keys, mine)] if keys else [m.take(new) for m in mine]
        clock = {c: np.r_[v, np.full(int((names >= known).sum()), NEVER if c == "due" else START)] for c, v in clock.items()}
        since = clock["horizon"]
        late = timed & (at < since[series])
        for which, kind in ((~timed, UNTIMED), (late, LATE)):
            for place in np.split(np.flatnonzero(which), range(OUT_ROWS, int(which.sum()), OUT_ROWS)) if which.any() else ():
                some = pa.array(place)
                yield self._named([m.take(some) for m in mine], us.take(some), tie.take(some), [pa.nulls(len(place))] * len(self.outputs), kind)
        usable = timed & ~late
        if not usable.any():
            return
        newest = clock["newest"]
        np.maximum.at(newest, series[usable], at[usable])
        touched = np.unique(series[usable])
        upto = since.copy()
        upto[touched] = np.maximum(since[touched], newest[touched] - self.delay)
        if self.idle is not None:
            due = timerValues.getCurrentWatermarkInMs() + self.idle * 1000
            clock["due"][touched] = due
            for timer in list(self.handle.listTimers()):
                if not (clock["due"] == timer).any():
                    self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        fields = np.stack([v.to_numpy(zero_copy_only=False) for v in values], axis=1)
        # Without a tie a row comes before those of its time that have one.
        arrived = (series, at, tie.fill_null(START).to_numpy(), fields)
        yield from self._step(keys, clock, tuple(np.concatenate([h, a[usable]]) for h, a in zip(held, arrived)), upto)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Of the series to which nothing came for the allowed silence, all that waits is final."""
        keys, clock, held = self._load()
        over = clock["due"] <= expiredTimerInfo.getExpiryTimeInMs()
        if not over.any():
            return
        upto = np.where(over, clock["newest"] + self.reach + 1, clock["horizon"])
        yield from self._step(keys or [], clock | {"due": np.where(over, NEVER, clock["due"])}, held, upto)


def _starts(series: np.ndarray) -> np.ndarray:
    """Whether a row is the first of its series."""
    return np.r_[True, series[1:] != series[:-1]][:len(series)]


class Windows(Settling):
    """What ``compute`` makes of the last ``length`` rows, for every settled row that has them.

    ``compute`` gets windows as (rows, columns, length) and returns (rows, outputs)."""

    def __init__(self, keys, width, delay_seconds, idle_seconds, length: int, compute: Callable[[np.ndarray], np.ndarray], outputs: Sequence[str], kind: str):
        super().__init__(keys, width, delay_seconds, idle_seconds)
        self.length, self.compute, self.outputs, self.kinds = length, compute, list(outputs), [kind] * len(outputs)

    def settle(self, series, us, tie, values, since, upto, mark):
        here = np.arange(len(us))
        place = here - np.maximum.accumulate(np.where(_starts(series), here, 0))
        final = us < upto[series]
        at = np.flatnonzero(final & (us >= since[series]) & (place >= self.length - 1))

        def make(lo, hi):
            windows = np.lib.stride_tricks.sliding_window_view(values, self.length, axis=0)
            made = np.asarray(self.compute(windows[at[lo:hi] - self.length + 1]))
            return [made if made.ndim == 3 else made[:, i] for i in range(len(self.outputs))]

        settled = np.bincount(series[final], minlength=len(upto))
        return at, make, place >= settled[series] - self.length + 1, mark


class Drops(Settling):
    """Drop-then-rise events of a series, decided once the follow-up window lies behind the horizon; the
    mark is the time of the last event, which opens the cooldown."""

    outputs = ["dropped_from", "dropped_to", "rose_to", "rise", "rise_us"]
    kinds = ["double", "double", "double", "double", "bigint"]

    def __init__(self, keys, delay_seconds, idle_seconds, th: P.Thresholds):
        super().__init__(keys, 2, delay_seconds, idle_seconds)
        self.th, self.reach = th, th.followup_seconds * 1_000_000

    def settle(self, series, us, tie, values, since, upto, mark):
        a, b, th = values[:, 0], values[:, 1], self.th
        first = _starts(series)
        before = np.where(first, np.nan, np.r_[np.nan, a[:-1]][:len(a)])
        drop = (before - a >= th.min_drop) & (a < th.drop_below)
        seen = us + self.reach
        i = np.flatnonzero(drop & (seen >= since[series]) & (seen < upto[series]))
        search = P._Search([], th)
        j = P.first_rises(np.where(b > th.rise_above, b, -np.inf), i + 1, search.need(b[i])) if len(i) else i
        # A first hit in a later series means that the drop's own has none.
        hit = (j >= 0) & (series[j] == series[i]) & (us[j] - us[i] <= self.reach)
        i, j, mark, kept = i[hit], j[hit], mark.copy(), []
        for k, (s, down, up) in enumerate(zip(series[i].tolist(), us[i].tolist(), us[j].tolist())):
            if mark[s] == START or down - mark[s] >= th.cooldown_seconds * 1_000_000:
                kept.append(k)
                mark[s] = up
        d, r = i[kept], j[kept]
        made = [before[d], a[d], b[r], np.where(np.isnan(b[d]), 0.0, b[r] - b[d]), us[r]]
        # The row before the first undecided one tells whether that one is a drop.
        undecided = seen >= upto[series]
        last = np.r_[first[1:], True][:len(first)]
        return d, lambda lo, hi: [m[lo:hi] for m in made], undecided | last | np.r_[undecided[1:], True][:len(first)], mark


def _keyed(stream: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], processor: Settling) -> DataFrame:
    ts, tie = order
    fields = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    ready = stream.select(
        F.pmod(F.xxhash64(*keys) if keys else F.lit(0), F.lit(GROUPS)).cast("int").alias("row_group"),
        *[F.col(k).alias(f"row_k{i}") for i, k in enumerate(keys)], F.unix_micros(F.col(ts).cast("timestamp")).alias("row_us"),
        F.col(tie).cast("bigint").alias("row_tie"), *[F.col(c).cast("double").alias(f"row_v{i}") for i, c in enumerate(columns)])
    blocks = ready.mapInArrow(_blocks, "row_group int, block binary")
    if processor.idle is not None:
        # The engine's watermark runs on the arrival clock: it moves timers and never drops a row.
        blocks = blocks.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "0 seconds")
    made = blocks.groupBy("row_group").transformWithStateInPandas(
        processor, "made binary", "Append", "None" if processor.idle is None else "EventTime")
    types = ", ".join(f"`{c}` {kind}" for c, kind in zip(processor.outputs, processor.kinds))
    schema = ", ".join([*[f"`{k}` {fields[k]}" for k in keys], "us bigint, tie bigint", types, "kind string"])
    out = made.mapInArrow(_rows_of, schema)
    rest = [c for c in out.columns if c not in (*keys, "us", "tie")]
    return out.select(*keys, F.timestamp_micros("us").cast(fields[ts]).alias(ts), F.col("tie").cast(fields[tie]).alias(tie), *rest)


def series_windows(stream: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], length: int,
                   compute: Callable[[np.ndarray], np.ndarray], outputs: Sequence[str], kind: str = "double",
                   delay_seconds: int = 0, idle_seconds: int | None = None) -> DataFrame:
    """A stream of ``keys, order, outputs, kind``: each settled row with what ``compute`` makes of its window.

    Late rows and rows without a time come out with ``kind`` 'late' and 'untimed' and empty outputs.
    Nulls reach ``compute`` as NaN.
    """
    return _keyed(stream, keys, order, columns, Windows(keys, len(columns), delay_seconds, idle_seconds, length, compute, outputs, kind))


def window_sums(windows: np.ndarray) -> np.ndarray:
    """The sum of each column, nulls skipped; NaN where a window has no value."""
    total = np.nansum(windows, axis=2)
    return np.where(np.isnan(windows).all(axis=2), np.nan, total)


def window_rows(windows: np.ndarray) -> np.ndarray:
    """The windows themselves as ``array<array<double>>`` (row by row), nulls as 0."""
    return np.nan_to_num(np.swapaxes(windows, 1, 2), nan=0.0)


def window_features(windows: np.ndarray) -> np.ndarray:
    """Per column last, mean, population deviation, least, largest, slope and z-score of the last value;
    statistics need all values, the z-score a window that is not constant."""
    last, before = windows[:, :, -1], windows[:, :, -2] if windows.shape[2] > 1 else np.full(windows.shape[:2], np.nan)
    low, high, mean = windows.min(axis=2), windows.max(axis=2), windows.mean(axis=2)
    std = np.where(low == high, 0.0, windows.std(axis=2))
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.where(std != 0, (last - mean) / (std + 1e-8), np.nan)
    parts = np.stack([last, mean, std, low, high, last - before, z], axis=2)
    return parts.reshape(len(windows), -1)


def feature_names(columns: Sequence[str]) -> list[str]:
    return [f"{c}__{s}" for c in columns for s in ("last", "mean", "std", "min", "max", "slope", "zlast")]


def series_patterns(stream: DataFrame, keys: Sequence[str], a: str, b: str, th: P.Thresholds = P.Thresholds(), ts: str = "ts",
                    tie: str = "event_id", delay_seconds: int = 0, idle_seconds: int | None = None) -> DataFrame:
    """Drop-then-rise events with their cooldown, over any number of batches: ``keys, drop_id, drop_ts,
    dropped_from, dropped_to, rose_to, rise, ts, kind``."""
    processor = Drops(keys, delay_seconds, idle_seconds, th)
    out = _keyed(stream, keys, [ts, tie], [a, b], processor)
    kind = dict(out.dtypes)[ts]
    return out.select(*keys, F.col(tie).alias("drop_id"), F.col(ts).alias("drop_ts"), "dropped_from", "dropped_to", "rose_to", "rise",
                      F.timestamp_micros("rise_us").cast(kind).alias("ts"), "kind")
