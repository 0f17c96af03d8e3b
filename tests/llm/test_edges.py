"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables for every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sluice.llm import language, pii, quality, toxicity
from sluice.llm.decontaminate import contaminated
from sluice.llm.line_dedup import dedup_lines
from sluice.llm.minhash_dedup import near_duplicates
from sluice.llm.packing import pack
from sluice.llm.sharding import byte_shards
from sluice.llm.topk import top_k

PLAIN = "the river runs past the old mill and the children play near its quiet banks all day"
CLASHING = ["score", "predicted", "level", "lines_removed", "shard", "size", "n", "h", "doc", "first", "rows", "_id", "_key", "piece", "length", "w"]
TYPES = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, PLAIN, "en", "a", 1), (2, PLAIN, "en", "a", 1), (2, PLAIN, "en", "a", 1), (3, None, None, None, None), (4, "", "fr", "b", 0),
            (5, " \n\t ", "fr", "b", 3), (6, "7 8 9 !!", "de", "b", 8), (7, f"{PLAIN} " * 3000, "en", "c", 1), (None, PLAIN, "en", "c", 1),
            (8, "x" * 300_000, None, "c", 300_000), (9, "1" * 50_000 + "@" * 10, "de", "d", 1), (10, "der alte mann geht am abend langsam nach hause", "de", "d", 1)]
    df = spark.createDataFrame(rows, TYPES)
    for name in CLASHING:
        df = df.withColumn(name, F.lit("other"))
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, None), (10, 0, 1), (4, None, 0), (None, 1, 1), (1, 1, 0)], "doc_id bigint, quality int, toxic int")


def operators(spark, labels):
    items = spark.createDataFrame([(1, PLAIN), (2, None), (3, ""), (1, PLAIN), (4, "two words")], "item_id bigint, text string")
    train = ~language.held_out(4, 2)
    return {
        "quality": lambda d: quality.quality(d, quality.fit(d, labels, train)),
        "lines": dedup_lines,
        "toxicity": lambda d: toxicity.toxicity(d, toxicity.fit(d, labels, train)),
        "pii": lambda d: pii.personal_data(d, pii.fit(d)),
        "sharding": lambda d: byte_shards(d, 4),
        "leaks": lambda d: contaminated(d, items),
        "language": lambda d: language.identify(d, language.fit(d, train)),
        "near": near_duplicates,
        "pack": pack,
    }


NAMES = ["quality", "lines", "toxicity", "pii", "sharding", "leaks", "language", "near", "pack"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_has_a_result(spark, docs, labels, name):
    got = operators(spark, labels)[name](docs).collect()
    ids = [r["doc_id"] for r in got]
    assert set(ids) == {None, *range(1, 11)}
    if name == "pack":
        assert sum(r["piece"] == 0 for r in got) == docs.count()
    else:
        assert len(ids) == docs.count()
    rows = {i: [tuple(r[c] for c in r.asDict() if c not in ("slot", "shard", "bin_id", "bin_offset", "doc_id")) for r in got if r["doc_id"] == i] for i in (1, 2)}
    if name in ("quality", "toxicity", "pii", "leaks", "language"):
        assert rows[1][0] == rows[2][0] == rows[2][1]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, labels, name):
    assert operators(spark, labels)[name](docs.limit(0)).collect() == []


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [0.5, 0.5]), (5, [0.5, 0.5]), (100, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("x"))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(df, F.col("vec_id") % 100 == 0, 10).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 4, 524288), (0, 2, 5, 524288), (0, 3, 100, 0), (100, 1, 4, 524288), (100, 2, 5, 524288), (100, 3, 0, 0)]
    assert top_k(df.limit(0), F.col("vec_id") % 100 == 0, 10).count() == 0
