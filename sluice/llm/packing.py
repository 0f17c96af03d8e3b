"""Variable-capacity best-fit packing of documents into training sequences.

The plan is made on the histogram of lengths, whose size is bounded by the largest capacity,
however many documents there are: equal lengths are placed together. Documents then look
their places up by (length, rank among equal lengths).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.components import stored

CAPACITIES = (1024, 2048, 4096, 8192)
BIN_OVERHEAD = 64


def padded_cost(capacity: int) -> float:
    """What a bin costs: its tokens, used or not, and a fixed overhead."""
    return capacity + BIN_OVERHEAD


@dataclass
class Plan:
    """``steps``: (length, first rank, end rank, first bin, items a bin, tokens used before);
    ``bins``: (first bin, bins, tokens used)."""

    steps: np.ndarray
    bins: np.ndarray
    capacities: tuple[int, ...]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bin, offset in it and its final capacity, for pieces by length and rank."""
        wide = np.int64(1) << np.int64(44)
        s = self.steps
        at = np.searchsorted(s[:, 0] * wide + s[:, 1], length * wide + rank, "right") - 1
        step = s[at]
        beyond = rank - step[:, 1]
        which = step[:, 3] + beyond // step[:, 4]
        offset = step[:, 5] + beyond % step[:, 4] * length
        used = self.bins[np.searchsorted(self.bins[:, 0], which, "right") - 1, 2]
        allowed = np.array(self.capacities)
        return which, offset, allowed[np.searchsorted(allowed, used)]


def _fill(lengths: list[int], supply: dict[int, int], room: int, first: int) -> dict[int, int]:
    """What a new bin would take: ``first``, then always the largest that fits of what is left."""
    taken = {first: 1}
    room -= first
    while room > 0:
        i = bisect_left(lengths, room + 1) - 1
        while i >= 0 and supply[lengths[i]] <= taken.get(lengths[i], 0):
            i -= 1
        if i < 0:
            break
        n = min(room // lengths[i], supply[lengths[i]] - taken.get(lengths[i], 0))
        taken[lengths[i]] = taken.get(lengths[i], 0) + n
        room -= n * lengths[i]
    return taken


def plan(counts: dict[int, int], capacities: Sequence[int] = CAPACITIES,
         cost: Callable[[int], float] = padded_cost) -> Plan:
    """Best-fit decreasing over all lengths at once.

    The longest pieces come first; each goes to the open bin with the least room that still
    holds it. Where none does, the bin size is opened whose cost per token is least, judged
    by what the pieces not yet promised to another bin can fill it with. In the end each bin
    shrinks to the least capacity that holds its contents.
    """
    sizes = tuple(sorted(capacities))
    lengths = sorted(n for n, c in counts.items() if c)
    supply = {n: counts[n] for n in lengths}
    rooms: list[int] = []
    open_bins: dict[int, list[list[int]]] = {}
    steps, next_bin = [], 0

    def put(room: int, group: list[int]) -> None:
        if group[1]:
            if room not in open_bins:
                open_bins[room] = []
                insort(rooms, room)
            open_bins[room].append(group)

    for length in reversed(lengths):
        left, rank = counts[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                best = None
                for size in sizes:
                    if size < length:
                        continue
                    free = dict.get(supply, length, 0)
                    if not free:
                        supply[length] = 1
                    taken = _fill(lengths, supply, size, length)
                    supply[length] = free
                    price = cost(size) / sum(n * c for n, c in taken.items())
                    if best is None or price <= best[0]:
                        best = price, size, taken
                _, size, taken = best
                most = min([supply[n] // c for n, c in taken.items()] + [-(-left // taken[length])])
                bins = max(1, most)
                for n, c in taken.items():
                    supply[n] = max(0, supply[n] - c * bins)
                put(size, [next_bin, bins, size])
                next_bin += bins
                continue
            room = rooms[i]
            first, bins, size = open_bins[room].pop(0)
            if not open_bins[room]:
                del open_bins[room], rooms[i]
            each = min(room // length, left)
            whole = min(bins, left // each)
            steps.append((length, rank, rank + whole * each, first, each, size - room))
            rank, left = rank + whole * each, left - whole * each
            put(room - each * length, [first, whole, size])
            put(room, [first + whole, bins - whole, size])
    bins = sorted((g[0], g[1], g[2] - room) for room, groups in open_bins.items() for g in groups)
    return Plan(np.array(sorted(steps), np.int64).reshape(-1, 6), np.array(bins, np.int64).reshape(-1, 3), sizes)


def _ranked(batches) -> Iterator[pa.RecordBatch]:
    """Rank of each piece among the pieces of its length in this partition."""
    seen: dict[int, int] = {}
    for batch in batches:
        length = batch.column("length").to_numpy()
        order = np.argsort(length, kind="stable")
        values, first, n = np.unique(length[order], return_index=True, return_counts=True)
        rank = np.empty(len(length), np.int64)
        before = np.array([seen.get(int(v), 0) for v in values], np.int64)
        rank[order] = np.arange(len(length)) - np.repeat(first, n) + np.repeat(before, n)
        for v, b, c in zip(values, before, n):
            seen[int(v)] = int(b + c)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank)], [*batch.schema.names, "local_rank"])


def _placed(batches, plan: Plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length = batch.column("length").to_numpy()
        some = length > 0
        which, offset, capacity = np.zeros((3, len(length)), np.int64)
        if some.any():
            which[some], offset[some], capacity[some] = plan.place(length[some], batch.column("rank").to_numpy()[some])
        cut = lambda x, kind: pa.array(x, kind, mask=~some)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], cut(which, pa.int64()), cut(offset, pa.int64()), cut(capacity, pa.int64())],
            ["doc_id", "piece", "start", "length", "bin_id", "bin_offset", "capacity"])


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("bigint")


def pack(docs: DataFrame, length: Column | None = None, capacities: Sequence[int] = CAPACITIES,
         cost: Callable[[int], float] = padded_cost) -> DataFrame:
    """``doc_id, piece, start, length, bin_id, bin_offset, capacity``: where each piece of each
    document lies.

    ``length`` gives a document's tokens (words by default). A document longer than the largest
    capacity is cut into pieces of that capacity and a rest; every token lies in exactly one
    bin. A null or empty text has one piece of length 0 and no bin. Repeated rows are packed
    each; other columns are ignored; an empty table gives an empty result.
    """
    top = max(capacities)
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                        (word_count() if length is None else length.cast("bigint")).alias("tokens"))
    last = F.greatest(F.ceil(F.col("tokens") / F.lit(top)).cast("int") - 1, F.lit(0))
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("piece").cast("bigint") * top
    cut = cut.select("doc_id", "piece", start.alias("start"), F.least(F.col("tokens") - start, F.lit(top)).alias("length"),
                     F.spark_partition_id().alias("part"))
    rows = stored(cut.mapInArrow(
        _ranked, "doc_id bigint, piece int, start bigint, length bigint, part int, local_rank bigint"), "pieces")
    counts = stored(rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.filter("length > 0").groupBy("length").agg(F.sum("n").alias("n")).collect()}
    made = plan(histogram, capacities, cost)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rows.join(bases, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", (F.col("base") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(
        lambda batches: _placed(batches, made),
        "doc_id bigint, piece int, start bigint, length bigint, bin_id bigint, bin_offset bigint, capacity bigint")
