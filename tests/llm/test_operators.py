"""Results of the operators against brute force, held-out labels and the given SQL."""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import pii
from sluice.llm.line_dedup import patience
from sluice.llm.queries import ORACLES, QUERIES
from sluice.llm.toxicity import Lexicon, fold, toxic_level

TABLES = ["documents", "embeddings", "benchmark", "labels"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, data_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, data_dir).toPandas()[list(want.columns)]
    keys = list(want.columns)
    assert sorted(map(tuple, got[keys].to_numpy().tolist())) == sorted(map(tuple, want[keys].to_numpy().tolist()))


@pytest.mark.parametrize("name, label, parts, fold_no, least", [
    ("op1_quality_convolution", "quality", 3, 1, 0.95), ("op3_toxicity_lexicon", "toxic", 5, 0, 0.93)])
def test_held_out_accuracy(spark, name, label, parts, fold_no, least):
    folder = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, folder).toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % parts == fold_no)).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    both = got[got.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both[label]).mean() >= least


def test_held_out_language(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op8_language_mixture"](spark, folder).toPandas().merge(
        spark.read.parquet(f"{folder}/documents.parquet").toPandas()[["doc_id", "lang"]], on="doc_id")
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() >= 0.98


def plain_spans(text):
    """The contract's patterns, applied as they stand."""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m.group().split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            spans.append((m.start(), 2, m.end()))
    spans += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return [(s, e, k) for s, k, e in sorted(spans)]


ODD = ["a@b.c.@d.e x@@y.z", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.004", "4111 1111-1111 1111 4111111111111112", "+1 (555) 010-9999. +12 +1-2",
       "a@b.c%d@e.f", "é4111111111111111é +49 30 1234567é", "99999.1.1.1.1", ""]


def test_base_spans(spark, data_dir):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("text").collect()]
    for text in texts:
        assert pii.base_spans(text) == plain_spans(text)
    got = QUERIES["op4_pii_semi_markov"](spark, data_dir).toPandas().set_index("doc_id")
    for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect():
        want = plain_spans(r["text"])
        names = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in want)
        row = got.loc[r["doc_id"]]
        assert row.base_sha256 == hashlib.sha256(names.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == i for _, _, k in want) for i in range(4)]
        assert set(filter(None, names.split(","))) <= set(row.spans.split(","))


def test_decode_is_the_best_segmentation():
    rng = np.random.default_rng(1)
    for _ in range(20):
        crf = pii.Field(rng.normal(size=(pii.OTHER, pii.FEATURES)), rng.normal(size=(pii.OTHER + 1, pii.OTHER + 1)))
        masks = tuple(tuple(int(x) for x in rng.integers(1, 1 << pii.FEATURES, min(3, 4 - i))) for i in range(4))

        def best(at, before):
            if at == 4:
                return 0.0
            options = [crf.moves[before, pii.OTHER] + best(at + 1, pii.OTHER)]
            for n, mask in enumerate(masks[at], 1):
                options += [crf.moves[before, k] + s + best(at + n, k) for k, s in enumerate(crf.scores(mask))]
            return max(options)

        value, at, before = 0.0, 0, pii.OTHER
        found = {i: (n, k) for i, n, k in pii.decode(crf, masks)}
        while at < 4:
            n, k = found.get(at, (1, pii.OTHER))
            value += crf.moves[before, k] + (crf.scores(masks[at][n - 1])[k] if k != pii.OTHER else 0)
            at, before = at + n, k
        assert abs(value - best(0, pii.OTHER)) < 1e-9


def test_patience_aligns_and_ends():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 6, 12).tolist(), rng.integers(0, 6, 10).tolist()
        pairs = patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    a = list(range(50))
    b = a[:10] + [99] + a[20:]
    assert len(patience(a, b)) == sum(m.size for m in SequenceMatcher(None, a, b, False).get_matching_blocks())


def test_folding_and_exceptions():
    assert fold("ІD10T 1d1ot ｓcum") == "idiot idiot scum"
    found = Lexicon({"scum": 2.0, "clown": 2.0}).automaton()
    assert toxic_level("such scum", found)[1] == 1
    assert toxic_level("pond scum, scummy, a class clown", found)[1] == 0


def test_shards(spark, data_dir):
    got = QUERIES["op5_sharding"](spark, data_dir).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() <= 2 * got["size"].max()
    assert all(sorted(x) == list(range(len(x))) for x in got.groupby("shard").slot.apply(list))


def test_packing(spark, data_dir):
    got = QUERIES["op10_best_fit_packing"](spark, data_dir).toPandas().dropna(subset=["bin_id"])
    for _, rows in got.groupby("bin_id"):
        rows = rows.sort_values("bin_offset")
        assert rows.bin_offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]]
        assert rows.length.sum() <= rows.capacity.iloc[0] and rows.capacity.nunique() == 1
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").toPandas()
    words = {r.doc_id: len(re.findall(r"[^ \t-\r]+", r.text)) for r in docs.itertuples()}
    assert got.groupby("doc_id").length.sum().to_dict() == words


def test_templates(spark):
    from sluice.llm.decontaminate import contaminated

    item = "A baker sells 12 loaves for 3 dollars each, and Anna buys 5 of the loaves with her friend Peter before noon."
    docs = spark.createDataFrame([
        (1, "Intro text here. " + item + " And more."),
        (2, item.replace("12", "40").replace("3 dollars", "7 euros").replace("Anna", "Maria").replace("5 of", "9 of")),
        (3, "A quiet evening by the lake, with nothing of the kind in it at all, and no loaves to be sold by anyone.")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["contaminated"] for r in contaminated(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()}
    assert got == {1: True, 2: True, 3: False}


def test_pipeline(spark, data_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    kept = docs
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, kept, data_dir)
        assert after.schema.names == docs.schema.names
        assert after.select("doc_id").distinct().count() == after.count() and after.join(kept, "doc_id", "left_anti").count() == 0
        kept = after
    ids = {r["doc_id"] for r in P.run(spark, data_dir).select("doc_id").distinct().collect()}
    assert ids == {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_pipeline_stages_on_odd_rows(spark, data_dir):
    """Nulls, empty and long texts, repeated rows, one id with two texts, clashing and missing columns."""
    import corpus_pipeline as P

    line = "the river runs past the old mill and the children play near its quiet banks all day"
    other = "a lamp stood in the window of the small house while snow fell on the road and the hills"
    rows = [(1, f"{line}\n{other}", "x"), (1, f"{line}\n{other}", "w"), (2, None, "x"), (3, "", "x"), (4, "long words " * 30_000, "x"),
            (5, "one text under an id that another text has too and nothing else is like it here", "x"),
            (5, "this second text stands under the same number and tells of ships and far ports only", "x"), (None, line, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _id string").withColumn("w", F.lit("other")).withColumn("_rest", F.lit(1))
    want = {"language": None, "line_dedup": None, "near_dedup": {1, 4, 5}, "decontamination": {1, 4, 5}}
    kept = docs.filter("doc_id is not null and text <> ''")
    for name, stage in P.STAGES[1:-1]:
        after = stage(spark, kept, data_dir)
        assert after.columns == docs.columns
        got = after.collect()
        assert {r["doc_id"] for r in got} == (want[name] or {1, 4, 5})
        if name == "near_dedup":
            assert sorted((r["doc_id"], r["_id"]) for r in got) == [(1, "w"), (4, "x"), (5, "x"), (5, "x")]
            assert len({r["text"] for r in got}) == 4
        kept = after
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs.withColumn("lang", F.lit("en")).limit(0), data_dir).collect() == []
    lines = P.lines(spark, docs, data_dir).collect()
    assert {r["doc_id"] for r in lines} == {None, 1, 4, 5}
    assert P.packing(spark, docs, data_dir).count() >= docs.count()


def test_marking_equals_the_plain_patterns_in_less_time(spark):
    from sluice.llm import decontaminate as D

    def plain(text):
        names = F.regexp_replace(text, r"(?<=[\p{Ll},;] )(\p{Lu}\p{Ll}+)", D.NAME + "$1")
        numbers = F.regexp_replace(names, r"(?<![\p{L}\p{N}])([0-9]+(?:[.,:/][0-9]+)*)", D.NUMBER + "$1")
        units = F.regexp_replace(
            numbers, rf"(?<={D.NUMBER}[0-9.,:/]{{1,24}} )({'|'.join(D.UNITS)})(?![\p{{L}}\p{{N}}])", D.UNIT + "$1")
        return F.trim(F.regexp_replace(F.regexp_replace(F.lower(units), r"[^\p{L}\p{N}\x01-\x03 \t-\r]+", ""), r"[ \t-\r]+", " "))

    odd = ["", " \n ", "a  b\tc \nd", "\t", "He met Anna, Émile; ÉMILE and o Bo", "x7 7 8mm 3.5 km 3.5. km 1/2 cups, 12:30 m m 4 metresque",
           "\x02 mm \x0212 mm 9 \x03mm", "5 km\n6 km 7\tkm", "1" * 30 + " kg", "Ünit 3 G, 4 g", None]
    words = "the Old mill, near 12 miles Of quiet banks and 3.5 kg of Barley; then Anna ran 7 km again "
    rows = spark.createDataFrame([(x,) for x in odd] + [(words * 40,)] * 300, "text string").coalesce(1).localCheckpoint()
    assert rows.filter(~D.marked(F.col("text")).eqNullSafe(plain(F.col("text")))).count() == 0

    def seconds(how):
        start = time.perf_counter()
        rows.select(how(F.col("text"))).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    assert min(seconds(D.marked) for _ in range(3)) < 0.8 * min(seconds(plain) for _ in range(3))
