"""The alignment against a plain restatement with the libraries themselves, and its parts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sluice.llm import token_alignment as T

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
CHARS = list("abcdefgh ETAOIN  .,'-") + ["é", "ß", "漢", "字", "½", "😀", "\n", "\t", " ", "▁", "<0x41>", "<|endoftext|>", "</s>", "'s", "01", "\x00", "é", "ﬁ"]


@pytest.fixture(scope="module")
def codecs():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def restated(rows, codecs):
    one, two = codecs
    alphabet = T.byte_alphabet()
    held, docs = [], Counter()
    for _, text in rows:
        whole = (" " + (text or "")).encode()
        a = one.encode(whole.decode(), add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        bytes_a = [bytes(alphabet[c] for c in one.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, two.id_to_piece(i)) for i in b)]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            a, b = [], []
        groups, left, right, x, y = [], [], [], 0, 0
        a_at, b_at = iter(zip(a, bytes_a)), iter(zip(b, bytes_b))
        while a and x + y < 2 * len(whole):
            if x <= y:
                i, s = next(a_at)
                left.append(i)
                x += len(s)
            else:
                i, s = next(b_at)
                right.append(i)
                y += len(s)
            if x == y and left and right:
                groups.append((left, right))
                left, right = [], []
        links = Counter((i, j) for g, h in groups for i in g for j in h)
        docs.update(links.keys())
        held.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (i, _), n in docs.items():
        most[i] = max(most[i], n)
    for (doc, _), (n_a, n_b, groups, links) in zip(rows, held):
        named = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        yield (doc, n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if docs[p] == most[p[0]]),
               sum(n * docs[p] for p, n in links.items()), hashlib.sha256(named.encode()).hexdigest() if groups else "")


def key(row):
    return tuple((v is not None, str(v)) for v in row)


def test_whole_table(spark, codecs, monkeypatch):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(CHARS) for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += [(1000 + i, "the same words again and again") for i in range(60)] + [(7, None), (7, ""), (None, "no id"), (8, " "), (9, "ab" * 20000)]
    rows += [(10, "漢字仮名交じり文" * 300), (11, "\U0001F600" * 40), (12, " " * 3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    for c in ("run", "slot", "bucket", "head", "n_a"):
        df = df.withColumn(c, F.lit("x"))
    want = sorted(restated(rows, codecs), key=key)
    assert sorted((tuple(r) for r in T.align_tokens(df, A, B).collect()), key=key) == want
    # Many small runs, several rounds of merging, several groups.
    monkeypatch.setattr(T, "FAN_IN", 2)
    monkeypatch.setattr(T, "RUNS_PER_GROUP", 3)
    assert sorted((tuple(r) for r in T.align_tokens(df, A, B).collect()), key=key) == want


def test_empty_table(spark):
    assert T.align_tokens(spark.createDataFrame([], "doc_id bigint, text string"), A, B).collect() == []


def test_rank_encoder_equals_the_library(codecs):
    rng, ours = random.Random(2), T.ByteSide(A)
    assert ours.ranks is not None
    for _ in range(3000):
        text = "".join(rng.choice(CHARS) for _ in range(rng.randrange(40)))
        assert ours.encode([text])[0] == codecs[0].encode(" " + text, add_special_tokens=False).ids
    blanks = " " * 1_500_000 + "x"
    assert ours.encode([blanks])[0] == codecs[0].encode(" " + blanks, add_special_tokens=False).ids


def test_wide_groups_count_as_all_links(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 50), rng.integers(0, 9, 40)
    in_a, in_b = np.sort(rng.integers(0, 3, 50)), np.sort(rng.integers(0, 3, 40))
    plain = T.linked_pairs(a, b, in_a, in_b, 3)
    monkeypatch.setattr(T, "WIDE_GROUP", 100)
    assert all(np.array_equal(x, y) for x, y in zip(plain, T.linked_pairs(a, b, in_a, in_b, 3)))


def test_merge_and_maxima_over_block_edges(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(T, "BLOCK", 3)
    runs = [Counter(((rng.randrange(4) << T.SECOND_BITS) | rng.randrange(6)) for _ in range(rng.randrange(1, 30))) for _ in range(9)]
    heads = [T._frames(np.array(sorted(r)), np.array([r[k] for k in sorted(r)]), step=3) for r in runs]
    total = sum(runs, Counter())
    most = defaultdict(int)
    for k, n in total.items():
        most[k >> T.SECOND_BITS] = max(most[k >> T.SECOND_BITS], n)
    got = [(k, n, m) for block in T.with_maxima(T.merged(heads)) for k, n, m in zip(*map(list, block))]
    assert got == [(k, total[k], int(total[k] == most[k >> T.SECOND_BITS])) for k in sorted(total)]
