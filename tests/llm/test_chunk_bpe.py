"""Reused chunks against the library on whole texts."""

from __future__ import annotations

import hashlib
import random
from array import array

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluice.llm import chunk_bpe as C

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
WORDS = ("the of And it's we'll İstanbul ΣΑΣ éclair é ́x ½ 漢字 !!' 'sure 'S <|endoftext|> a<|startoftext|>b 12345 ... '     \x1c \x0b "
         "\t \n naïve ﻿ ​ ﬁ Å").split(" ")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def wanted(rows):
    for doc, text in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        yield doc, len(ids), digest(" ".join(map(str, ids))), digest(LIBRARY.decode(ids, skip_special_tokens=False))


def key(row):
    return tuple((v is not None, str(v)) for v in row)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) if rng.random() < 0.3 else "".join(rng.choice("abcdefgABC'") for _ in range(rng.randrange(1, 9))) for _ in range(n))


def test_whole_table(spark):
    rng = random.Random(6)
    passages = [prose(rng, 120) for _ in range(6)]
    rows = [(i, " ".join(rng.choice(passages) if rng.random() < 0.6 else prose(rng, rng.randrange(40)) for _ in range(rng.randrange(6)))) for i in range(150)]
    rows += [(500 + i, passages[0]) for i in range(50)] + [(7, None), (7, ""), (None, passages[1]), (8, " "), (9, "x" * 50000), (10, "漢字" * 9000),
                                                        (11, "-" * 4000 + " " + passages[2]), (12, (passages[3] + "\n") * 40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    for c in ("core", "pos", "ids", "text_key", "parts", "n_tokens"):
        df = df.withColumn(c, F.lit("x"))
    got = C.encode_decode(df, PATH)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(wanted(rows), key=key)


def test_empty_table(spark):
    assert C.encode_decode(spark.createDataFrame([], "doc_id bigint, text string"), PATH).collect() == []


def test_shared_passages_share_cores():
    rng = random.Random(9)
    passage = prose(rng, 400)
    found = []
    for text in (prose(rng, 90) + " " + passage, passage + " " + prose(rng, 30)):
        raw = text.encode()
        candidates = C.cut_candidates(np.frombuffer(raw, np.uint8))
        found.append({C.name(raw[lo:hi]): hi - lo for lo, hi in C.cores(raw, C.cuts(candidates, len(raw)))})
    shared = sum(found[0][c] for c in found[0].keys() & found[1].keys())
    assert shared > 0.5 * len(passage.encode())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([w + " " for w in WORDS] + ["ab", "c\n", " ", "'"]), max_size=60))
def test_any_two_blank_cuts_repair_exactly(pieces):
    text = "".join(pieces)
    blanks = [i + 1 for i, c in enumerate(text) if c in " \n"]
    if len(blanks) < 4:
        return
    codec = C.codec(PATH)
    a, b, c, d = blanks[0], blanks[len(blanks) // 3], blanks[2 * len(blanks) // 3], blanks[-1]
    parts = ["", text[:a], text[a:b], text[b:c], text[c:d], text[d:], ""]
    first, second = codec.encode([parts[2], parts[4]])
    joints = [C.repaired(codec, "", parts[1], parts[2]), C.repaired(codec, parts[2], parts[3], parts[4]), C.repaired(codec, parts[4], parts[5], "")]
    joined = joints[0] + first + joints[1] + second + joints[2]
    assert list(array(codec.kind, joined)) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_words_that_disagree_grow_and_end():
    class Pairs:  # tokens that reach over one blank: agreement needs more words, never reached
        def encode(self, texts):
            return [bytes([len(t)]) for t in texts]

    with pytest.raises(ValueError):
        C.repaired(Pairs(), "a b c", "d", "e f g")
