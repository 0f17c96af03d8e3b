"""Quality of documents by a convolutional network over bytes, in numpy.

Learned filters slide over the whole document. Overlapping chunks take the strongest answer of
every filter; the mean and the maximum over all chunks are combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm import text as X
from sluice.llm.sampling import least_hashed
from sluice.llm.toxicity import clean_labels

WIDTH, STRIDE, FILTERS, EMBEDDED = 8, 2, 16, 6
HALF = 64
BLOCK_HALVES = 512
SAMPLE_ROWS, SAMPLE_BYTES = 1200, 1 << 14
EPOCHS, RATE, BATCH = 12, 0.01, 16


@dataclass
class Network:
    """``embed[byte + 1]`` (0: beyond the end), ``kernel[offset]``, filter biases, and the
    weights of chunk mean and maximum."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.5, (257, EMBEDDED)), rng.normal(0, 1 / np.sqrt(WIDTH * EMBEDDED), (WIDTH, EMBEDDED, FILTERS)),
                   np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), np.zeros(1))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.kernel, self.bias, self.out, self.out_bias]


def _codes(data: np.ndarray) -> np.ndarray:
    """Byte codes, padded so that whole halves of a chunk cover the document."""
    halves = max(1, -(-len(data) // (HALF * STRIDE)))
    codes = np.zeros(halves * HALF * STRIDE + WIDTH, np.int64)
    codes[:len(data)] = data.astype(np.int64) + 1
    return codes


def _halves(net: Network, tables: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest answer of every filter in each half chunk, and where it stands; block by block."""
    n = (len(codes) - WIDTH) // (HALF * STRIDE)
    best, place = np.empty((n, FILTERS)), np.empty((n, FILTERS), np.int64)
    for at in range(0, n, BLOCK_HALVES):
        to = min(n, at + BLOCK_HALVES)
        starts = np.arange(at * HALF, to * HALF) * STRIDE
        answer = tables[0][codes[starts]]
        for k in range(1, WIDTH):
            answer = answer + tables[k][codes[starts + k]]
        answer = answer.reshape(to - at, HALF, FILTERS)
        place[at:to] = answer.argmax(1)
        best[at:to] = np.take_along_axis(answer, place[at:to, None], 1)[:, 0]
    return np.maximum(best + net.bias, 0), (place + np.arange(n)[:, None] * HALF) * STRIDE


def _chunks(best: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every chunk is two neighbouring halves, so chunks overlap by one half."""
    if len(best) == 1:
        return best, place
    left = best[:-1] >= best[1:]
    return np.where(left, best[:-1], best[1:]), np.where(left, place[:-1], place[1:])


def _tables(net: Network) -> np.ndarray:
    return np.einsum("be,kef->kbf", net.embed, net.kernel)


def probability(net: Network, tables: np.ndarray, data: np.ndarray) -> float:
    best, place = _halves(net, tables, _codes(data))
    chunk, _ = _chunks(best, place)
    z = np.concatenate([chunk.mean(0), chunk.max(0)]) @ net.out + net.out_bias[0]
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _gradient(net: Network, tables: np.ndarray, data: np.ndarray, label: int, weight: float, into: list[np.ndarray]) -> None:
    """Adds one document's gradient: only the places that won their pool receive any."""
    codes = _codes(data)
    chunk, place = _chunks(*_halves(net, tables, codes))
    top = chunk.argmax(0)
    pooled = np.concatenate([chunk.mean(0), chunk.max(0)])
    p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.out_bias[0], -30, 30)))
    d = weight * (p - label)
    into[3] += d * pooled
    into[4] += d
    back = np.broadcast_to(d * net.out[:FILTERS] / len(chunk), chunk.shape).copy()
    back[top, np.arange(FILTERS)] += d * net.out[FILTERS:]
    back *= chunk > 0
    into[2] += back.sum(0)
    for k in range(WIDTH):
        seen = codes[place + k]
        into[1][k] += np.einsum("cfe,cf->ef", net.embed[seen], back)
        np.add.at(into[0], seen, back[:, :, None] * net.kernel[k].T[None])


def train(texts: list[bytes], labels: list[int], weights: list[float], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam over small batches; the same input always gives the same network."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    data = [np.frombuffer(t, np.uint8) for t in texts]
    first, second, step = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), BATCH):
            some = order[at:at + BATCH]
            grads, tables = [np.zeros_like(p) for p in net.parts()], _tables(net)
            for i in some:
                _gradient(net, tables, data[i], labels[i], weights[i], grads)
            step += 1
            rate = RATE * (0.5 if epoch >= epochs // 2 else 1.0)
            for p, g, m, v in zip(net.parts(), grads, first, second):
                g = g / len(some) + 1e-5 * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, rows: int = SAMPLE_ROWS, longest: int = SAMPLE_BYTES) -> Network:
    """The network, learned from a bounded sample of the labelled rows that ``train_rows`` selects.

    The bound: up to ``rows / 2`` whole texts of each label, of at most ``longest`` bytes each, those
    of the ids with the least hash, one text of an id (the least); every text of a label counts as much as its label's share
    of all labelled rows asks for. Without labels of both kinds the network stays untrained.
    """
    known = docs.filter(train_rows & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Ids and sizes alone meet the labels; texts stay where they are until some are chosen.
    sizes = known.select("_id", F.octet_length("text").alias("_size")).join(clean_labels(labels, "quality").hint("merge"), "_id")
    total = {r["quality"]: r["n"] for r in sizes.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = {r["_id"]: mark for mark in sorted(total) for r in least_hashed(
        sizes.filter((F.col("quality") == mark) & (F.col("_size") <= longest)), rows // 2, "_id", "_id")}
    # At most ``rows`` ids are broadcast, and one text of each comes back.
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], "_id bigint")
    found = known.filter(F.octet_length("text") <= longest).join(F.broadcast(ids), "_id", "left_semi").groupBy("_id").agg(F.min("text").alias("text"))
    some = sorted(found.collect(), key=lambda r: (chosen[r["_id"]], r["_id"]))
    texts, marks = [r["text"].encode() for r in some], [chosen[r["_id"]] for r in some]
    weights = [total[m] / sum(total.values()) / marks.count(m) for m in marks]
    if len(set(marks)) < 2:
        return Network.fresh()
    return train(texts, marks, list(np.array(weights) * len(weights)))


def _scored(batches, net: Network) -> Iterator[pa.RecordBatch]:
    tables = _tables(net)
    for batch in batches:
        data, offsets = X.flat(batch.column("text"))
        scores = [probability(net, tables, data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])


def quality(docs: DataFrame, net: Network) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs (doc_id, text)``.

    The whole text is read, block by block. A null text is read as an empty one, which is one
    chunk of padding. Equal texts score equally, repeated rows each; a null id is kept; other
    columns are ignored; an empty table gives an empty result.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(lambda batches: _scored(batches, net), "doc_id bigint, score double").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
