"""Groups of texts close to the threshold against brute force on the full sets."""

from __future__ import annotations

import random

import pytest

from sluice.llm import minhash_dedup as M


def texts():
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(3):
        base = [r.choice(words) for _ in range(120)]
        for _ in range(50):
            copy = list(base)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = r.choice(words)
            out.append((len(out), " ".join(copy)))
    return out


def brute(rows, k, percent):
    sets = [{tuple(w[i:i + k]) for i in range(len(w) - k + 1)} for w in (t.split() for _, t in rows)]
    lead = list(range(len(rows)))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                lead[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(len(rows))}


@pytest.mark.parametrize("node_rows, node_shingles, k, percent", [(2048, 1 << 22, 3, 85), (20, 1 << 22, 5, 80), (2048, 2000, 3, 85)])
def test_components(spark, monkeypatch, node_rows, node_shingles, k, percent):
    monkeypatch.setattr(M, "NODE_ROWS", node_rows)
    monkeypatch.setattr(M, "NODE_SHINGLES", node_shingles)
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(docs, k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_different_texts_under_one_id_keep_their_own_links(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (5, b + " end"), (7, b), (9, c), (9, c), (9, None), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in M.near_duplicates(docs).collect()))
    by_id = {i: [(n, lead, kept) for j, n, lead, kept in got if j == i] for i in (0, 1, 5, 7, 9)}
    assert by_id[1] == [(56, 1, True)] and by_id[7] == [(56, 5, False)] and by_id[0] == [(56, 0, True)]
    assert [(n, lead) for n, lead, _ in by_id[5]] == [(56, 1), (56, 5), (57, 5)]
    assert sum(kept for _, lead, kept in by_id[5] if lead == 5) == 1
    assert not any(kept for _, lead, kept in by_id[5] if lead == 1)
    assert by_id[9] == [(0, 9, True), (56, 9, True), (56, 9, True)]


def test_pipeline_stage_keeps_one_text_of_each_group(spark):
    import corpus_pipeline as P

    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = spark.createDataFrame([(1, a, "s"), (5, a, "s"), (5, b, "s"), (7, b, "s"), (7, b, "s")], "doc_id bigint, text string, source string")
    kept = P.near_copies(spark, docs, "")
    assert sorted((r["doc_id"], r["text"][0]) for r in kept.collect()) == [(1, "a"), (5, "b")]


def test_texts_and_sketches_are_dealt_out_once(spark, capsys):
    import corpus_pipeline as P

    docs = spark.createDataFrame([(1, "a", "t"), (1, "a", "s"), (1, "b", "s"), (2, None, "s"), (None, "a", "s"), (3, "c", "s")],
                                 "doc_id bigint, text string, source string")
    chosen = spark.createDataFrame([(1, "0cc175b9c0f1b6a831c399e269772661"), (2, ""), (None, "0cc175b9c0f1b6a831c399e269772661")],
                                   "doc_id bigint, _md5 string")
    named = spark.createDataFrame([(1, "m", b"x"), (1, "m", b"x"), (1, "n", b"y"), (2, "o", b"z")], "doc_id bigint, text_md5 string, low binary")
    first = spark.createDataFrame([(1, "m", 7), (2, "o", 8)], "doc_id bigint, text_md5 string, class bigint")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        for df in (P._least_rows(docs, chosen), M._representatives(named, first)):
            df.explain()
            assert capsys.readouterr().out.count("Exchange hashpartitioning") == 2
        assert sorted(map(tuple, P._least_rows(docs, chosen).collect())) == [(1, "a", "s"), (2, None, "s")]
        assert sorted((r["doc_id"], bytes(r["low"])) for r in M._representatives(named, first).collect()) == [(7, b"x"), (8, b"z")]
    finally:
        spark.conf.set(name, before)
