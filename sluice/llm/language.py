"""Language of documents by mixture inference over n-gram likelihoods.

A document is read as a sequence of short segments, each written in one language. The
likelihood of a segment in a language is that of its letter trigrams; expectation-maximisation
estimates the proportions of the languages, and languages are given up one by one as long as
the penalised likelihood gains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm import text as X

BUCKET_BITS = 15
SEGMENT = 16
EM_ROUNDS = 12
LANGUAGE_COST = 4.0
SMOOTHING = 0.5
NO_LANGUAGE = "und"

_SPACE = np.uint8(0x20)
_PLAIN = np.full(256, _SPACE, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
_GRAM = X.seeds(3, 7)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram bucket and row of every letter trigram. Case is folded (A-Z and the Latin-1
    letters), all other ASCII becomes one blank; a trigram never crosses rows."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    x = _PLAIN[data]
    upper = np.zeros(len(x), bool)
    upper[1:] = (data[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[1:] != 0x97)
    x = np.where(upper, x + np.uint8(0x20), x)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != _SPACE) | (x[:-1] != _SPACE) | (row[1:] != row[:-1])
    x, row = x[keep].astype(np.uint64), row[keep]
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = X.mixed(x[:-2] * _GRAM[0] + x[1:-1] * _GRAM[1] + x[2:] * _GRAM[2])
    inside = row[2:] == row[:-2]
    return (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)[inside], row[:-2][inside]


def _counted(batches) -> Iterator[pa.RecordBatch]:
    """Trigram counts of each language in this partition."""
    size = 1 << BUCKET_BITS
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        data, offsets = X.flat(batch.column("text"))
        names = sorted(set(langs))
        code = np.array([names.index(n) for n in langs], np.int64)
        for at, to in X.pieces(offsets):
            bucket, row = grams(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
            n = np.bincount(code[at:to][row] * size + bucket, minlength=size * len(names)).reshape(-1, size)
            for i, name in enumerate(names):
                if name in totals:
                    totals[name] += n[i]
                else:
                    totals[name] = n[i].copy()
    for name, n in totals.items():
        where = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(where), pa.string()), pa.array(where.astype(np.int32)), pa.array(n[where])], ["lang", "bucket", "n"])


@dataclass
class LanguageModel:
    """``log_p[bucket, language]``: smoothed log-likelihoods of the trigrams."""

    languages: list[str]
    log_p: np.ndarray


def fit(docs: DataFrame, train: Column) -> LanguageModel:
    """The trigram model of all rows that ``train`` selects and that name a language. Counts
    cover all of these rows; the model has languages x 2^15 numbers, however many rows there are."""
    rows = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_counted, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    table = np.full((1 << BUCKET_BITS, len(languages)), SMOOTHING)
    if languages:
        place = np.searchsorted(np.array(languages, object), counts["lang"].to_numpy(object))
        table[counts["bucket"].to_numpy(), place] += counts["n"].to_numpy()
    return LanguageModel(languages, np.log(table / table.sum(0)).astype(np.float32))


def _mixtures(like: np.ndarray, first: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over all documents of a batch: proportions, and log-likelihood above ``like``'s shift.
    A proportion of zero stays zero."""
    n = np.diff(np.append(first, len(like)))
    row = np.repeat(np.arange(len(first)), n)
    for _ in range(EM_ROUNDS):
        joint = like * weights[row]
        joint /= np.maximum(joint.sum(1, keepdims=True), 1e-300)
        weights = np.add.reduceat(joint, first, axis=0) / n[:, None]
    total = np.add.reduceat(np.log(np.maximum((like * weights[row]).sum(1), 1e-300)), first)
    return weights, total


def infer(log_p: np.ndarray, bucket: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Proportions of the languages in each of ``rows`` documents; all 0 without a trigram."""
    out = np.zeros((rows, log_p.shape[1]))
    if not len(bucket):
        return out
    ends = np.cumsum(np.bincount(row, minlength=rows))
    begin = np.concatenate([[0], ends[:-1]])
    cuts = np.flatnonzero((np.arange(len(row)) - begin[row]) % SEGMENT == 0)
    segments = np.add.reduceat(log_p[bucket], cuts, axis=0).astype(np.float64)
    like = np.exp(segments - segments.max(1, keepdims=True))
    docs, first = np.unique(row[cuts], return_index=True)
    n = np.diff(np.append(first, len(cuts)))
    cost = LANGUAGE_COST + 0.5 * np.log(n)
    weights, total = _mixtures(like, first, np.full((len(docs), log_p.shape[1]), 1 / log_p.shape[1]))
    best, value = weights, total - cost * (log_p.shape[1] - 1)
    for left in range(log_p.shape[1] - 1, 0, -1):
        weakest = np.where(weights > 0, weights, 2).argmin(1)
        alive = (weights > 0).sum(1) > left
        fewer = weights.copy()
        fewer[np.flatnonzero(alive), weakest[alive]] = 0
        weights, total = _mixtures(like, first, fewer / fewer.sum(1, keepdims=True))
        gained = total - cost * (left - 1)
        better = gained >= value
        best, value = np.where(better[:, None], weights, best), np.where(better, gained, value)
    out[docs] = best
    return out


def _predicted(batches, model: LanguageModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = X.flat(batch.column("text"))
        letters = batch.column("letters").to_numpy(zero_copy_only=False)
        names, scores, sets = [], [], []
        for at, to in X.pieces(offsets):
            bucket, row = grams(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
            for share, some in zip(infer(model.log_p, bucket, row, to - at), letters[at:to]):
                if not some or not len(share):
                    names.append(NO_LANGUAGE)
                    scores.append(0.0)
                    sets.append("")
                    continue
                if not share.any():
                    share = np.full(len(share), 1 / len(share))
                names.append(model.languages[int(share.argmax())])
                scores.append(float(min(share.max(), 1.0)))
                sets.append(",".join(f"{model.languages[i]}:{share[i]:.2f}" for i in np.argsort(-share, kind="stable") if share[i] > 0))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in batch.schema.names if c not in ("text", "letters")],
             pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.string())],
            [*[c for c in batch.schema.names if c not in ("text", "letters")], "lang_pred", "score", "languages"])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score, languages`` for every row of ``docs (doc_id, text)``.

    ``score`` is the proportion of the leading language and ``languages`` lists the chosen set
    with its proportions. A null text, and a text without a letter, is ``und`` with score 0 and
    no set. A text whose letters make no trigram gets the first language with an even score.
    Without any learned language everything is ``und``. Equal texts get equal answers; rows with
    a null id are kept; other columns are ignored; an empty table gives an empty result.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    slim = slim.withColumn("letters", F.col("text").rlike(r"\p{L}"))
    return slim.mapInArrow(
        lambda batches: _predicted(batches, model), "doc_id bigint, lang_pred string, score double, languages string")


def held_out(parts: int, fold: int) -> Column:
    """Rows set apart from learning: crc32 of the id as text, modulo ``parts``, is ``fold``. A
    null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == fold, F.lit(False))
