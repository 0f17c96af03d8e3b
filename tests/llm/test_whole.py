"""Frequent lines, many alike items and dense items get the same treatment as the rest."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sluice.llm.decontaminate import contaminated
from sluice.llm.line_dedup import Side, aligned_lines, dedup_lines, removed_lines


def kept_lines(docs, min_words=5):
    """Each document without the lines of its blocks that an earlier one holds, by trying all runs."""
    lines = {i: [x.strip() for x in text.split("\n") if x.strip()] for i, text in docs}
    spans = lambda x: [(lo, hi) for lo in range(len(x)) for hi in range(lo + 1, len(x) + 1)]
    held = {i: {tuple(x[lo:hi]) for lo, hi in spans(x)} for i, x in lines.items()}
    out = {}
    for i, x in lines.items():
        before = set().union(*[held[j] for j in held if j < i])
        gone = {n for lo, hi in spans(x) if tuple(x[lo:hi]) in before and len(" ".join(x[lo:hi]).split()) >= min_words for n in range(lo, hi)}
        out[i] = [line for n, line in enumerate(x) if n not in gone]
    return out


def test_no_block_of_an_earlier_document_stays(spark):
    rng = random.Random(3)
    pool = [" ".join(f"w{k}x{j}" for j in range(n)) for k, n in enumerate([1, 1, 2, 3, 4, 5, 6, 9])]
    docs = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own {i} {n}" for n in range(14))) for i in range(40)]
    got = dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    want = kept_lines(docs)
    assert {r["doc_id"]: [x.strip() for x in r["text"].split("\n") if x.strip()] for r in got} == want
    assert all(r["lines_removed"] == 14 - len(want[r["doc_id"]]) for r in got)


def test_crossed_and_repeated_frequent_lines_go(spark):
    a, b = "the first line of many words", "the second line of many words"
    docs = [(i, f"{a}\nown {i}\n{b}") for i in range(12)] + [(20, f"{b}\n{a}\n{b}\n{a}\nlast one")]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got[20] == "last one" and got[0] == docs[0][1] and got[11] == "own 11"


def test_one_pair_is_aligned_in_whole_runs():
    a, b, c = b"a", b"b", b"c"
    earlier = Side([(0, (a, b)), (4, (c,)), (7, (a, b)), (9, (a,))])
    assert aligned_lines(Side([(3, (a, b)), (8, (c,))]), earlier) == {3, 4, 8}
    # Crossed and repeated runs stay in the first alignment and go in the next; half a run stays.
    assert aligned_lines(Side([(0, (c,)), (2, (a, b)), (5, (c,)), (6, (a, b))]), earlier) == {0, 2, 3, 5, 6, 7}
    assert aligned_lines(Side([(0, (b, c)), (5, (c, a))]), earlier) == set()


def test_later_documents_split_over_tasks_give_the_same(spark):
    rng = random.Random(5)
    pool = [" ".join(f"v{k}x{j}" for j in range(n)) for k, n in enumerate([1, 2, 3, 5, 6, 9])]
    docs = spark.createDataFrame([(i, "\n".join(rng.choice(pool) for _ in range(9))) for i in range(60)], "doc_id bigint, text string")
    rows = lambda n: {(r["doc_id"], r["version"]): sorted(r["gone"]) for r in removed_lines(docs, pair_rows=n).collect()}
    assert rows(1) == rows(7) == rows(50_000) != {}


def test_lines_keep_every_column(spark):
    line = "a line that has more than five words"
    names = ["_id", "_version", "_gone", "g", "d", "gone", "version", "later", "part", "e_id", "a.b", "lines_removed"]
    docs = spark.createDataFrame([(2, f"{line}\nown"), (1, line)], "doc_id bigint, text string")
    for name in names:
        docs = docs.withColumn(name, F.lit(name))
    got = {r["doc_id"]: r.asDict() for r in dedup_lines(docs).collect()}
    assert got[2]["text"] == "own" and got[2]["lines_removed"] == 1 and got[1]["lines_removed"] == 0
    assert all(got[2][n] == n for n in names[:-1]) and set(got[2]) == set(docs.columns)


ITEM = "A baker sells {} loaves for {} dollars each, and Anna buys {} of the loaves with her friend Peter before noon."


def leaks(spark, docs, items):
    got = contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    return {r["doc_id"]: r for r in got.collect()}


def test_a_template_of_many_items_is_found(spark):
    for n in (10, 11, 30):
        items = [(i, ITEM.format(i + 20, i + 3, i + 50)) for i in range(n)]
        got = leaks(spark, [(1, "Some text before. " + items[4][1]), (2, ITEM.format(900, 800, 700)), (3, "A quiet evening by the lake with no loaves to be sold.")], items)
        assert [got[i]["contaminated"] for i in (1, 2, 3)] == [True, True, False]


def test_dense_items_are_found_as_copies(spark):
    sums = "What is 12 + 7 * 3 - 5 / 2?"
    table = "Rows of the table: 3 14 15 92 65 35 89 79 32 38 46 26 43 38 32 79 50 28 84 19 71"
    docs = [(1, "Now think hard. " + sums), (2, "Then comes " + table + " and no more."), (3, "What is 13 + 8 * 4 - 6 / 9?"),
            (4, "Rows of the table: 1 2 4 8 16 32 64 28 56 12 24 48 96 92 84 68 36 72 44 88 76")]
    got = leaks(spark, docs, [(1, sums), (2, table)])
    assert {i: r["item_id"] for i, r in got.items()} == {1: 1, 2: 2, 3: None, 4: None}


def test_slots_that_disagree_count_against_the_cover_only(spark):
    passage = " ".join(f"then worker number 7 of crew {chr(97 + k) * 3} carried the heavy grey stone over bridge {chr(97 + k) * 4} at dawn" for k in range(6)) + "."
    last = passage.rindex("7")
    docs = [(1, ITEM.format(5, 3, 5)), (2, passage[:last] + "8" + passage[last + 1:]), (3, passage)]
    got = leaks(spark, docs, [(1, ITEM.format(12, 3, 5)), (2, passage)])
    assert {i: r["item_id"] for i, r in got.items()} == {1: 1, 2: 2, 3: 2}
    assert got[2]["windows"] < got[3]["windows"]


def test_values_without_any_agreement_are_no_leak(spark):
    item = "Add 4 to 4 then 4 to 4 then 4 to 4 then 4 to 4"
    got = leaks(spark, [(1, "Add 1 to 2 then 3 to 5 then 6 to 7 then 8 to 9"), (2, item.replace("4", "6"))], [(1, item)])
    assert [got[i]["contaminated"] for i in (1, 2)] == [False, True]
