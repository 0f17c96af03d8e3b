"""Exact contributions of features to the predictions of fitted trees, along their paths.

A feature that is not known sends a row down both ways of its splits, weighted by the training rows on
each. The Shapley values of that game are sums over leaves: a leaf's path says for each of its
features an interval and the share ``z`` of training rows that keep to it, and whether a row lies in the interval is
all that matters. Written out over subsets T of a path's features, a leaf adds ``coefficient(T)`` wherever
the row lies in all intervals of T. With few distinct intervals these boxes are summed once into tables over the grid of
all thresholds, and a row is one look-up per subset; otherwise each subtree has a table over the outcomes of
its splits and the intervals on the way to it. No permutations, no background rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.session import scratch_path

#: Largest grid of thresholds that is tabled; a table of it is 8 MB per feature.
GRID_CELLS = 1 << 20
BATCH_ROWS = 8192
#: Splits and intervals of a subtree that is tabled as one, and numbers in all these tables (32 MB).
SUBTREE_BITS, SUBTREE_CELLS = 10, 1 << 22


@dataclass
class Leaf:
    """``intervals[f]`` = (lowest, highest bin, share of training rows); bins count the thresholds below a value."""

    value: float
    intervals: dict[int, tuple[int, int, float]]


@dataclass
class Subtree:
    """``table[i, case]`` is added to feature ``names[i]``; bit k of the case says whether condition k (feature, lowest, highest
    bin) holds the row."""

    conditions: list[tuple[int, int, int]]
    names: list[int]
    table: np.ndarray


@dataclass
class Paths:
    """All leaves of a fitted ensemble, each value times its tree's weight."""

    thresholds: list[np.ndarray]
    leaves: list[Leaf]
    base: float = 0.0
    tables: dict[tuple[int, ...], np.ndarray] = field(default_factory=dict)
    subtrees: list[Subtree] = field(default_factory=list)


def node_table(model) -> tuple[pd.DataFrame, list[float]]:
    """(tree, node, prediction, rows, left, right, feature, threshold), and the weight of each tree in a prediction;
    ``rows`` are the training rows by their weight.

    The fitted model is written to the shared folder, and its nodes are read back; their number is bounded by
    trees and depth, not by data.
    """
    session = SparkSession.getActiveSession()
    path = scratch_path(session, "trees")
    model.save(path)
    nodes = session.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"), "nodeData.prediction", F.get("nodeData.impurityStats", F.lit(0)).alias("rows"),
        F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"), F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("nodeData.split.numCategories").alias("categories")).toPandas()
    if (nodes["categories"] >= 0).any():
        raise ValueError("splits on categories are not supported")
    weights = list(model.treeWeights)
    if type(model).__name__.startswith("RandomForest"):
        weights = [w / sum(weights) for w in weights]
    return nodes, weights


def paths_of(nodes: pd.DataFrame, weights: Sequence[float], width: int) -> Paths:
    splits = nodes[nodes["left"] >= 0]
    thresholds = [np.unique(splits.loc[splits["feature"] == f, "threshold"].to_numpy(float)) for f in range(width)]
    out = Paths(thresholds, [])
    for tree, part in nodes.groupby("tree"):
        rows = {r.node: r for r in part.itertuples(index=False)}
        stack = [(0, {})]
        while stack:
            at, known = stack.pop()
            n = rows[at]
            if n.left < 0:
                out.leaves.append(Leaf(float(n.prediction) * weights[int(tree)], known))
                continue
            f, cut = int(n.feature), int(np.searchsorted(thresholds[int(n.feature)], n.threshold))
            lo, hi, z = known.get(f, (0, len(thresholds[f]), 1.0))
            for child, a, b in ((int(n.left), lo, min(hi, cut)), (int(n.right), max(lo, cut + 1), hi)):
                stack.append((child, {**known, f: (a, b, z * rows[child].rows / n.rows)}))
    out.base = sum(x.value * float(np.prod([z for _, _, z in x.intervals.values()])) for x in out.leaves)
    if np.prod([len(t) + 1.0 for t in thresholds]) <= GRID_CELLS:
        out.tables = _grid_tables(out, width)
    else:
        out.subtrees = _subtree_tables(nodes, weights, thresholds)
    return out


def _coefficients(leaf: Leaf) -> Iterator[tuple[tuple[int, ...], dict[int, float]]]:
    """For each subset T of the path's features, what a row inside all of T's intervals adds to every feature."""
    names = sorted(leaf.intervals)
    d = len(names)
    share = [factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)]
    for size in range(d + 1):
        for inside in combinations(names, size):
            rest = leaf.value * float(np.prod([leaf.intervals[f][2] for f in names if f not in inside]))
            yield inside, {f: rest * share[size - 1] if f in inside else -rest * share[size] for f in names}


def _grid_tables(paths: Paths, width: int) -> dict[tuple[int, ...], np.ndarray]:
    """Boxes are entered by their corners, all leaves of the same features at once, and spread by running
    sums along every axis."""
    alike: dict[tuple[int, ...], list[Leaf]] = {}
    for leaf in paths.leaves:
        alike.setdefault(tuple(sorted(leaf.intervals)), []).append(leaf)
    tables: dict[tuple[int, ...], np.ndarray] = {}
    for names, leaves in alike.items():
        value = np.array([x.value for x in leaves])
        low, high, share = (np.array([[x.intervals[f][k] for f in names] for x in leaves]).reshape(len(leaves), -1) for k in range(3))
        # A leaf of value 1 and shares 1 tells how the value is dealt out; the shares outside T scale it.
        unit = Leaf(1.0, {f: (0, 0, 1.0) for f in names})
        for inside, adds in _coefficients(unit):
            at = [names.index(f) for f in inside]
            scale = value * np.prod(np.delete(share, at, axis=1), axis=1)
            vector = np.array([adds.get(f, 0.0) for f in range(width)])
            if inside not in tables:
                tables[inside] = np.zeros((*[len(paths.thresholds[f]) + 2 for f in inside], width))
            for corner in range(1 << len(at)):
                cell = tuple((high[:, k] + 1 if corner >> n & 1 else low[:, k]).astype(np.int64) for n, k in enumerate(at))
                sign = 1 if corner.bit_count() % 2 == 0 else -1
                if cell:
                    np.add.at(tables[inside], cell, sign * scale[:, None] * vector)
                else:
                    tables[inside] += scale.sum() * vector
    for inside, table in tables.items():
        for axis in range(len(inside)):
            np.cumsum(table, axis=axis, out=table)
    return tables


def _leaf_table(value: float, shares: Sequence[float]) -> np.ndarray:
    """A leaf's contributions to its features, for every set of its intervals that hold a row."""
    d = len(shares)
    inside = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(bool)
    share = [factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)]
    size = inside.sum(axis=1)[:, None]
    rest = value * np.prod(np.where(inside, 1.0, np.asarray(shares, float)), axis=1)[:, None]
    table = rest * np.where(inside, np.r_[0.0, share][size], -np.r_[share, 0.0][size])
    # A row adds every subset of the intervals that hold it.
    for k in range(d):
        with_k = np.flatnonzero(np.arange(len(table)) >> k & 1)
        table[with_k] += table[with_k ^ (1 << k)]
    return table


def _subtrees(rows: dict, cuts: dict[int, int], splits: dict[int, int], ends: Sequence[int], bits: int) -> Iterator[tuple[int, dict]]:
    """(top node, intervals on the way to it) of the largest subtrees whose splits and intervals are at most ``bits``, or of one leaf."""
    stack = [(0, {})]
    while stack:
        at, known = stack.pop()
        if not splits[at] or len(known) + splits[at] <= bits:
            yield at, known
        else:
            stack += [(child, now) for child, now, _ in _children(rows, cuts, ends, at, known)]


def _children(rows: dict, cuts: dict[int, int], ends: Sequence[int], at: int, known: dict) -> list[tuple[int, dict, int]]:
    n = rows[at]
    f, cut = int(n.feature), cuts[at]
    lo, hi, z = known.get(f, (0, ends[f], 1.0))
    return [(child, {**known, f: (a, b, z * rows[child].rows / n.rows)}, way)
            for child, a, b, way in ((int(n.left), lo, min(hi, cut), 1), (int(n.right), max(lo, cut + 1), hi, 0))]


def _subtree_table(rows: dict, cuts: dict[int, int], ends: Sequence[int], top: int, known: dict, weight: float) -> Subtree:
    conditions = [(f, *known[f][:2]) for f in sorted(known)]
    stack, leaves = [(top, known, {f: [(k, 1)] for k, f in enumerate(sorted(known))})], []
    while stack:
        at, now, held = stack.pop()
        if rows[at].left < 0:
            leaves.append((float(rows[at].prediction) * weight, now, held))
            continue
        f = int(rows[at].feature)
        conditions.append((f, 0, cuts[at]))
        for child, inside, way in _children(rows, cuts, ends, at, now):
            stack.append((child, inside, {**held, f: [*held.get(f, []), (len(conditions) - 1, way)]}))
    names = sorted({f for _, now, _ in leaves for f in now})
    cases = np.arange(1 << len(conditions))
    table = np.zeros((len(names), len(cases)))
    for value, now, held in leaves:
        mine = sorted(now)
        place = np.zeros(len(cases), np.int64)
        for k, f in enumerate(mine):
            place |= np.all([(cases >> bit & 1) == way for bit, way in held[f]], axis=0).astype(np.int64) << k
        table[[names.index(f) for f in mine]] += _leaf_table(value, [now[f][2] for f in mine]).T[:, place]
    return Subtree(conditions, names, table)


def _subtree_tables(nodes: pd.DataFrame, weights: Sequence[float], thresholds: list[np.ndarray]) -> list[Subtree]:
    """All trees as subtrees, as large as ``SUBTREE_BITS`` and ``SUBTREE_CELLS`` allow."""
    ends, trees = [len(t) for t in thresholds], []
    for tree, part in nodes.groupby("tree"):
        rows = {r.node: r for r in part.itertuples(index=False)}
        cuts = {k: int(np.searchsorted(thresholds[int(r.feature)], r.threshold)) for k, r in rows.items() if r.left >= 0}
        splits: dict[int, int] = {}
        for k in sorted(rows, reverse=True):  # children have higher numbers
            splits[k] = 1 + splits[int(rows[k].left)] + splits[int(rows[k].right)] if k in cuts else 0
        trees.append((rows, cuts, splits, weights[int(tree)]))
    for bits in range(SUBTREE_BITS, -1, -1):
        parts = [(t, list(_subtrees(t[0], t[1], t[2], ends, bits))) for t in trees]
        if not bits or sum(1 << len(known) + t[2][at] for t, tops in parts for at, known in tops) * len(ends) <= SUBTREE_CELLS:
            break
    return [_subtree_table(t[0], t[1], ends, at, known, t[3]) for t, tops in parts for at, known in tops]


class Contributions:
    """Contributions of rows as a (rows, features) matrix."""

    def __init__(self, paths: Paths):
        self.paths, self.width = paths, len(paths.thresholds)
        self.kind = np.min_scalar_type(max((len(t) for t in paths.thresholds), default=0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(t, x[:, f], "left").astype(self.kind) for f, t in enumerate(self.paths.thresholds)]
        out = np.zeros(x.shape)
        for inside, table in self.paths.tables.items():
            out += table[tuple(bins[f] for f in inside)]
        if self.paths.subtrees:
            out += self._by_subtrees(bins, len(x)).T
        return out

    def _by_subtrees(self, bins: list[np.ndarray], n: int) -> np.ndarray:
        out, known = np.zeros((self.width, n)), {}
        for part in self.paths.subtrees:
            case = np.zeros(n, np.int64)
            for k, (f, lo, hi) in enumerate(part.conditions):
                if (f, lo, hi) not in known:
                    known[f, lo, hi] = bins[f] <= hi if not lo else (bins[f] >= lo) & (bins[f] <= hi)
                case += np.multiply(known[f, lo, hi], 1 << k, dtype=np.int64)
            for f, row in zip(part.names, part.table):
                out[f] += row.take(case)
        return out


def tree_attribution(model, rows: DataFrame, ids: Sequence[str], columns: Sequence[str], wide: bool = False) -> DataFrame:
    """Long (ids, feature, phi) for every row, or ``wide`` with one column per feature: the exact path-dependent Shapley
    values of a fitted forest or of boosted trees. They add up to the prediction less the mean prediction of the training rows.

    One pass over ``rows`` in Arrow batches, no shuffle. A null value counts as 0.
    """
    columns = list(columns)
    paths = paths_of(*node_table(model), len(columns))
    shared = rows.sparkSession.sparkContext.broadcast(replace(paths, leaves=[]))
    fields = {f.name: f for f in rows.schema.fields}
    schema = T.StructType([fields[i] for i in ids] + [T.StructField(f"phi_{k}", T.DoubleType()) for k in range(len(columns))])
    names = list(ids)

    def explain(batches):
        contributions = Contributions(shared.value)
        for pdf in batches:
            for lo in range(0, len(pdf), BATCH_ROWS):
                part = pdf.iloc[lo:lo + BATCH_ROWS]
                phi = contributions(part[[f"x_{k}" for k in range(len(columns))]].to_numpy(float))
                yield pd.concat([part[names].reset_index(drop=True), pd.DataFrame(phi, columns=[f"phi_{k}" for k in range(len(columns))])], axis=1)

    ready = rows.select(*names, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x_{k}") for k, c in enumerate(columns)])
    explained = ready.mapInPandas(explain, schema)
    if wide:
        return explained.select(*names, *[F.col(f"phi_{k}").alias(c) for k, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"phi_{k}").alias("phi")) for k, c in enumerate(columns)])
    return explained.select(*names, F.explode(pairs).alias("_p")).select(*names, "_p.feature", "_p.phi")
