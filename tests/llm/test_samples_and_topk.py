"""Bounded samples, and the search on ids of any sign."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm.sampling import least_hashed
from sluice.llm.topk import top_k


def test_least_hashed_takes_the_least_keys_once(spark):
    rows = [(i % 3000, f"text {i}") for i in range(9000)] + [(7, "a")] * 500
    df = spark.createDataFrame(rows, "k bigint, v string").repartition(5)
    for n in (1, 50, 2999, 3000, 5000):
        got = least_hashed(df, n, "k", "v")
        order = [r["k"] for r in df.select("k").distinct().orderBy(F.shiftrightunsigned(F.xxhash64("k"), 1)).collect()]
        assert [r["k"] for r in got] == order[:n]
    assert {r["k"]: r["v"] for r in got}[7] == "a"
    assert least_hashed(df.limit(0), 5, "k", "v") == []


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_ids_of_any_sign(spark, scale):
    rng = np.random.default_rng(3)
    ids = [0, 100, -100, -7, -1, 3, -(1 << 63), (1 << 63) - 1, *range(-40, -8), *range(10, 60)]
    rows = [(i, [float(x) for x in rng.normal(size=5) * scale]) for i in ids]
    got = top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 100 == 0, 4).collect()
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    want = []
    for q in ids:
        if q % 100 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in ids if i != q))[:4]
            want += [(q, n + 1, i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for n, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_negative_neighbour_is_found(spark):
    rows = [(0, [1.0]), (-7, [9.0]), (3, [1.0])]
    got = top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0, 2, scale=1).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(-7, 9), (3, 1)]
