"""The manifest against a sequential restatement, and its edges."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from sluice.llm.merkle import descend, grow, manifest_proofs
from sluice.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id bigint, source string, lang string, n_chars int, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def fold(nodes, at):
    """Root of a list of nodes, and the siblings of one of them, level by level."""
    way = []
    while len(nodes) > 1:
        lo = at // 8 * 8
        way.append((nodes[lo:at], nodes[at + 1:lo + 8]))
        nodes, at = [h(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)], at // 8
    return nodes[0], way


def restated(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    leaves = {g: sorted(((r[0] is not None, r[0] or 0, leaf(r), r) for r in rows if r[2] == g), key=lambda x: x[:3]) for g in langs}
    subs = [fold([x[2] for x in leaves[g]], 0)[0] for g in langs]
    out = []
    for n, g in enumerate(langs):
        for at, (_, _, own, r) in enumerate(leaves[g]):
            sub, low = fold([x[2] for x in leaves[g]], at)
            root, high = fold(subs, n)
            way = low + high
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            lowered = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            node = leaf((*r[:4], lowered)) if tampered else own
            for before, after in way:
                node = h(*before, node, *after)
            out.append((r[0], g, own, sub, root, h(*[x for b, a in way for x in (*b, *a)]), node, node == root))
    return out


def key(row):
    return tuple((v is not None, str(v)) for v in row)


def check(spark, rows):
    got = [tuple(r) for r in manifest_proofs(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=key) == sorted(restated(rows), key=key)


def test_groups_of_all_sizes(spark):
    rng = random.Random(1)
    sizes = {None: 3, "": 1, "a": 700, "b": 8, "B": 9, "ß": 64, "zz": 65, **{f"l{i}": 1 for i in range(20)}}
    rows = [(rng.randrange(10**6), rng.choice(["web", None, "é"]), g, rng.choice([None, 5]), rng.choice([None, "", "Some Text", "low", "x" * 3000]))
            for g, n in sizes.items() for _ in range(n)]
    check(spark, rows)


def test_repeated_rows_and_ids_and_null_ids(spark):
    check(spark, [(7, "s", "en", 1, "A")] * 20 + [(7, "s", "en", 1, f"B{i}") for i in range(9)] + [(None, None, "en", None, "C")] * 2)


@pytest.mark.parametrize("rows", [[(1, "s", "en", 1, "Text")], [(1, None, None, None, None)], [(1, "s", "en", 1, "a"), (2, "s", "de", 1, "B")]])
def test_smallest_manifests(spark, rows):
    check(spark, rows)


def test_empty_table_and_clashing_columns(spark):
    assert manifest_proofs(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(i, "s", "en", 1, f"T {i}") for i in range(12)]
    wide = spark.createDataFrame(rows, SCHEMA)
    for c in ("tree", "idx", "rank", "_part", "_pos", "digest", "path", "leaf", "found"):
        wide = wide.withColumn(c, F.lit("x"))
    assert sorted(map(tuple, manifest_proofs(wide).collect())) == sorted(restated(rows))


def test_only_requested_leaves_are_reached(spark):
    nodes = [(3, i, h(str(i))) for i in range(200)]
    forest = grow(spark.createDataFrame(nodes, "tree bigint, idx bigint, digest string"))
    starts = forest.roots.withColumn("path", F.expr("cast(array() as array<struct<before:string,after:string>>)"))
    got = descend(forest, starts, spark.createDataFrame([(3, 5), (3, 199)], "tree bigint, idx bigint"), 0).collect()
    assert {r["idx"]: r["digest"] for r in got} == {5: h("5"), 199: h("199")}
    for r in got:
        assert [(x["before"], x["after"]) for x in reversed(r["path"])] == [tuple(map("".join, w)) for w in fold([n[2] for n in nodes], r["idx"])[1]]


def test_query_and_its_sql(spark, data_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data_dir}/documents.parquet'")
    result = con.execute(ORACLES["op13_merkle_manifest"])
    names, want = [d[0] for d in result.description], result.fetchall()
    got = QUERIES["op13_merkle_manifest"](spark, data_dir).select(*names).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
