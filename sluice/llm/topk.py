"""Exact top-k inner products by a dual-tree search over cover trees of queries and data."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DATA_ROWS = 8192
QUERY_ROWS = 2048
LEAF_ROWS = 256
CHILDREN = 16
SHRINK = 0.7


class CoverTree:
    """Points covered by balls. Centres of a node's children lie more than ``SHRINK`` x its radius
    apart (the 16 farthest ones; every other point joins the nearest). A ball's radius is the
    measured distance to its farthest point, so bounds from it always hold."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centre, self.radius, self.rows, self.children = [], [], [], []
        if len(points):
            self._build(np.arange(len(points)))
        self.norm = [float(np.linalg.norm(points[c])) for c in self.centre]

    def _build(self, all_rows: np.ndarray) -> None:
        todo = [(all_rows, int(all_rows[0]), None)]
        while todo:
            rows, centre, parent = todo.pop()
            far = np.sqrt(((self.points[rows] - self.points[centre]) ** 2).sum(1))
            here, radius = len(self.centre), float(far.max())
            self.centre.append(centre)
            self.radius.append(radius)
            self.rows.append(rows)
            self.children.append([])
            if parent is not None:
                self.children[parent].append(here)
            if len(rows) <= LEAF_ROWS or radius == 0:
                continue
            centres, owner = [centre], np.zeros(len(rows), int)
            while len(centres) < CHILDREN and far.max() > SHRINK * radius:
                new = int(far.argmax())
                d = np.sqrt(((self.points[rows] - self.points[rows[new]]) ** 2).sum(1))
                closer = d < far
                owner[closer], far = len(centres), np.minimum(far, d)
                centres.append(int(rows[new]))
            todo += [(rows[owner == i], c, here) for i, c in enumerate(centres)]


def dual_tree(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int,
              exact: np.ndarray | None = None, exact_data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Best ``k`` scores and ids of each query, a mask of the places that are filled, and how many pairs
    of points were scored. ``exact`` and ``exact_data`` hold integers too large for doubles."""
    q, r = CoverTree(queries), CoverTree(data)
    left, right = (queries, data) if exact is None else (exact, exact_data)
    kind = np.float64 if exact is None else object
    none = -np.inf if exact is None else -(1 << 200)
    best = np.full((len(queries), k), none, kind)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
    scored = 0

    def bound(a: int, b: int) -> float:
        centre = float(queries[q.centre[a]] @ data[r.centre[b]])
        spread = q.radius[a] * r.norm[b] + r.radius[b] * q.norm[a] + q.radius[a] * r.radius[b]
        return centre + spread + 1e-9 * (abs(centre) + spread) + 1

    if not len(queries) or not len(data):
        return best, best_id, best != none, 0
    stack = [(bound(0, 0), 0, 0)]
    while stack:
        most, a, b = stack.pop()
        if most < best[q.rows[a], k - 1].min():
            continue
        low, high = q.children[a], r.children[b]
        if low and (not high or q.radius[a] > r.radius[b]):
            stack += sorted((bound(c, b), c, b) for c in low)
        elif high:
            stack += sorted((bound(a, c), a, c) for c in high)
        else:
            mine, theirs = q.rows[a], r.rows[b]
            score = left[mine] @ right[theirs].T
            scored += score.size
            score[query_ids[mine][:, None] == ids[theirs][None, :]] = none
            hit = (score >= best[mine, k - 1][:, None]).any(1)
            mine = mine[hit]
            value = np.concatenate([best[mine], score[hit]], 1)
            name = np.concatenate([best_id[mine], np.broadcast_to(ids[theirs], score[hit].shape)], 1)
            name = np.where(value == none, np.iinfo(np.int64).max, name)
            by_id = np.argsort(name, 1, kind="stable")
            value, name = np.take_along_axis(value, by_id, 1), np.take_along_axis(name, by_id, 1)
            top = np.argsort(-value, 1, kind="stable")[:, :k]
            best[mine], best_id[mine] = np.take_along_axis(value, top, 1), np.take_along_axis(name, top, 1)
    return best, best_id, best != none, scored


def _dense(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    vectors = table.column("vector").combine_chunks()
    offsets = vectors.offsets.to_numpy()
    flat, sizes = vectors.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat[offsets[0]:offsets[-1]]
    return table.column("vec_id").to_numpy(), out


def _block(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    names = ["query_id", "query_key", "vec_id", "score"]
    width = max([0, *(int(np.diff(t.column("vector").combine_chunks().offsets.to_numpy()).max()) for t in (left, right) if t.num_rows)])
    if not left.num_rows or not right.num_rows or not width:
        width = max(width, 1)
    query_ids, queries = _dense(left, width)
    ids, data = _dense(right, width)
    exact = exact_data = None
    if max(np.abs(queries).max(initial=0), 1) * max(np.abs(data).max(initial=0), 1) * width >= 2.0**53:
        exact, exact_data = (np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (queries, data))
    best, best_id, filled, _ = dual_tree(queries, query_ids, data, ids, k, exact, exact_data)
    row, place = np.nonzero(filled)
    score = [min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in best[row, place]]
    return pa.table([pa.array(query_ids[row]), left.column("query_key").combine_chunks().take(pa.array(row)),
                     pa.array(best_id[row, place]), pa.array(score, pa.int64())], names=names)


def scaled(vector: str, scale: int = 1024) -> Column:
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row with ``is_query`` the ``k`` largest inner
    products with all other rows, ties to the smaller id.

    Components are floor(scale * x); sums are exact integers. Queries and data are dealt into
    blocks of bounded size, every query block meets every data block in a dual-tree search, and
    the blocks' best are merged.

    Vectors that are null, or hold null or non-finite components, take no part, nor do null ids;
    a missing component of a shorter vector counts as 0. Identical rows count once; a row never
    meets rows of its own id; an id with several vectors asks with each of them. Scores beyond
    64 bits are clamped. An empty table gives an empty result.
    """
    whole = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & whole).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), scaled(vector, scale).alias("vector"),
        is_query.alias("is_query")).distinct()
    asked = rows.filter("is_query").select("vec_id", "vector")
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q")).first()
    n_data, n_query = -(-max(sizes["n"], 1) // DATA_ROWS), -(-max(sizes["q"], 1) // QUERY_ROWS)
    key = F.xxhash64("vec_id", "vector")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("vec_id", "vector", key.alias("query_key"), F.pmod(key, F.lit(n_query)).cast("int").alias("qb")).withColumn("db", spread(n_data))
    right = rows.select("vec_id", "vector", F.pmod(key, F.lit(n_data)).cast("int").alias("db")).withColumn("qb", spread(n_query))
    found = left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db")).applyInArrow(
        lambda a, b: _block(a, b, k), "query_id bigint, query_key bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
