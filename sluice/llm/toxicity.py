"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton.

Texts are folded first (compatibility forms, homoglyphs, digits that stand for letters). The
lexicon's weights are the log-odds of its words in labelled documents; phrases that are
harmless cancel the words inside them; the sum is normalised by length and calibrated.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEXICON_WORDS = 5000
MIN_LOG_ODDS = 1.5
MIN_Z = 3.0
BASE_WEIGHT = 2.0
LENGTH_FLOOR = 20
PER_WORDS = 100.0

# Words insulting in themselves, used with a weight of their own until labels say more.
BASE_WORDS = ["idiot", "moron", "imbecile", "stupid", "scum", "worthless", "pathetic", "loathsome", "vermin", "dumb"]
# Phrases in which such a word is harmless.
EXCEPTIONS = ["class clown", "clown fish", "pond scum", "dumb luck", "dumb waiter", "pathetic fallacy", "idiot proof"]
# Letters of other scripts that look like Latin ones, and characters used for letters.
LOOKALIKES = str.maketrans(
    "аеорсхуіјѕкмтαεορινυκı",
    "aeopcxyijskmtaeopivuki")
SUBSTITUTES = str.maketrans("01345789@$", "oieastbgas")

_STANDING_IN = re.compile(r"(?<=[^\W\d_])[0-9@$]++|(?<![0-9@$])[0-9@$]++(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case, compatibility forms and homoglyphs replaced, invisible joiners dropped, and
    digits next to letters read as letters."""
    plain = unicodedata.normalize("NFKC", text).replace("\u200b", "").replace("\u200d", "").lower().translate(LOOKALIKES)
    return _STANDING_IN.sub(lambda m: m.group().translate(SUBSTITUTES), plain)


@dataclass
class Lexicon:
    """Weights of words, phrases that cancel them, and the calibration of the normalised sum."""

    weights: dict[str, float]
    exceptions: Sequence[str] = tuple(EXCEPTIONS)
    bias: float = -2.0
    any_hit: float = 0.0
    slope: float = 1.0

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for word, weight in self.weights.items():
            found.add_word(word, (len(word), weight))
        for phrase in self.exceptions:
            if phrase not in self.weights:
                found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found

    def score(self, level: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.any_hit * (level > 0) + self.slope * level, -30, 30)))


def toxic_level(text: str, automaton: ahocorasick.Automaton) -> tuple[float, int]:
    """Normalised sum and number of hits. A hit is a whole word outside every exception phrase."""
    plain = fold(text)
    hits, free = [], []
    if len(automaton):
        for end, (size, weight) in automaton.iter(plain):
            start = end - size + 1
            if (start and plain[start - 1].isalnum()) or (end + 1 < len(plain) and plain[end + 1].isalnum()):
                continue
            (free if weight is None else hits).append((start, end, weight))
    at, total, n = 0, 0.0, 0
    for start, end, weight in sorted(hits):
        while at < len(free) and free[at][1] < start:
            at += 1
        if not any(f[0] <= start and end <= f[1] for f in free[at:at + len(EXCEPTIONS)]):
            total, n = total + weight, n + 1
    words = sum(1 for _ in _WORD.finditer(plain)) if n else 0
    return math.log1p(PER_WORDS * total / (words + LENGTH_FLOOR)), n


def _seen_words(batches) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean documents of the batch each folded word stands."""
    for batch in batches:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            seen[toxic].update(set(_WORD.findall(fold(text.as_py()))))
        words = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), *[pa.array([seen[k][w] for w in words], pa.int64()) for k in (1, 0)]], ["word", "bad", "good"])


def _levels(batches, lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    automaton = lexicon.automaton()
    for batch in batches:
        both = [toxic_level(t.as_py(), automaton) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array([x for x, _ in both], pa.float64()), pa.array([n for _, n in both], pa.int64())],
            [*batch.schema.names[1:], "level", "hits"])


def clean_labels(labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, label``: one 0 or 1 per document. Null labels are left out; where the labels of a
    document differ, the larger one holds."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    return known.groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(F.max(F.col(label).cast("int")).alias(label))


def fit(docs: DataFrame, labels: DataFrame, train: Column) -> Lexicon:
    """Weights and calibration from all labelled rows that ``train`` selects. The counts are made
    by Spark; the driver receives the ``LEXICON_WORDS`` best words at most (a model parameter) and
    the calibration's histogram."""
    rows = docs.filter(train & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # A merge join at every size; the texts are shuffled once, for the words. Later steps join ids and levels.
    marks = clean_labels(labels, "toxic").hint("merge")
    labelled = rows.join(marks, "_id")
    n = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    words = labelled.select("text", "toxic").mapInArrow(_seen_words, "word string, bad bigint, good bigint").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / F.lit(bad + 1.0)) - F.log((F.col("good") + 0.5) / F.lit(good + 1.0))
    z = F.col("odds") / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    best = words.withColumn("odds", odds).withColumn("z", z).filter((F.col("odds") >= MIN_LOG_ODDS) & (F.col("z") >= MIN_Z))
    weights = dict.fromkeys(BASE_WORDS, BASE_WEIGHT)
    weights |= {r["word"]: r["odds"] for r in best.orderBy(F.desc("z"), "word").limit(LEXICON_WORDS).collect()}
    lexicon = Lexicon(weights)
    if not bad or not good:
        return lexicon
    levels = rows.select("text", "_id").mapInArrow(lambda b: _levels(b, lexicon), "_id bigint, level double, hits bigint")
    bins = levels.join(marks, "_id").groupBy(
        F.round("level", 2).alias("level"), "toxic").agg(F.count(F.lit(1)).alias("n")).orderBy("level", "toxic").collect()
    x = np.array([[1.0, float(r["level"] > 0), r["level"]] for r in bins])
    y, count = np.array([r["toxic"] for r in bins], float), np.array([r["n"] for r in bins], float)
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + np.eye(3) * 0.1, x.T @ (count * (p - y)) + 0.1 * w)
    lexicon.bias, lexicon.any_hit, lexicon.slope = map(float, w)
    return lexicon


def toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, score, predicted, level, hits`` for every row of ``docs (doc_id, text)``.

    A null or empty text has level 0 and the score of a text without hits. Equal texts score
    equally, repeated rows each; a null id is kept; other columns are ignored; an empty table
    gives an empty result. The time is linear in the text's length.
    """
    slim = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"))
    scored = slim.mapInArrow(lambda batches: _scored(batches, lexicon), "doc_id bigint, level double, hits bigint, score double")
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "level", "hits")


def _scored(batches, lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    for batch in _levels(batches, lexicon):
        score = lexicon.score(batch.column("level").to_numpy())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])
