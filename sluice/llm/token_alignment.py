"""Alignment of two tokenizers over a corpus, with external counting of aligned pairs.

Both tokenizers cut the same bytes; where both end a token, a group ends, and every token of one
side in a group is linked with every token of the other. How many documents hold a pair is counted
outside memory: the pair-document records of some documents form a run, sorted by (first id, second
id), cut by the radix of the first id into buckets and written as zstd frames into a table of the
shared folder. The heads of the runs (pair, documents) are merged by a heap over their blocks, in
rounds of bounded fan-in; in the order of the first id, its pairs stand together, so its highest
count is known as soon as it has passed. The counts go back to groups of runs, whose records give
each document its part of the sums.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.components import stored

# Fixed value: the pattern by which the byte-level vocabulary splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKET_BITS = 4
RUN_PAIRS, RUN_DOCS = 1 << 20, 1 << 15
BLOCK = 1 << 14
FAN_IN, RUNS_PER_GROUP = 64, 256
WIDE_GROUP = 1 << 16
SECOND_BITS = 20

RESULT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
SPILLED = f"run bigint, slot int, doc_id bigint, {RESULT}, bucket int, head binary, records binary"


# Tokenizers ------------------------------------------------------------------------------

def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(others)}


class ByteSide:
    """A byte-level vocabulary file of the tokenizers library.

    Where its merges stand in the order of their ids, ranks decide alone, and a rank encoder made from the
    file gives the same ids faster; other files, and texts on which that encoder gives up, take the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        spec = json.loads(open(path, encoding="utf-8").read())
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet, special = byte_alphabet(), {t["content"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if t not in special}
        pairs = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
        plain = (spec["normalizer"] is None and spec["model"].get("end_of_word_suffix") is None
                 and spec["pre_tokenizer"].get("type") == "ByteLevel" and spec["pre_tokenizer"].get("use_regex")
                 and not spec["pre_tokenizer"].get("add_prefix_space")
                 and all(vocab[p] == 256 + i for i, p in enumerate(pairs)) and len(self.bytes) == 256 + len(pairs))
        self.ranks = None
        if plain:
            import tiktoken

            ranks = {b: i for i, b in self.bytes.items()}
            self.ranks = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._one(" " + t) for t in texts]

    def _one(self, text: str) -> list[int]:
        if self.ranks is not None:
            try:
                return self.ranks.encode_ordinary(text)
            except BaseException as error:  # the rank encoder's split panics on endless blanks
                if type(error).__name__ != "PanicException":
                    raise
        return self.library.encode(text, add_special_tokens=False).ids


class PieceSide:
    """A sentencepiece model; it puts the leading space itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes = {}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes[i] = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def side(kind: str, path: str):
    found = {"byte": ByteSide, "piece": PieceSide}[kind](path)
    size = max(found.bytes) + 1
    found.text = [found.bytes.get(i, b"") for i in range(size)]
    found.length = np.array([len(b) for b in found.text], np.int64)
    found.decimal = [str(i) for i in range(size)]
    return found


# One document -----------------------------------------------------------------------------

def group_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of every token of both sides: they end where both sides end a token."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return np.searchsorted(common, ends_a), np.searchsorted(common, ends_b), len(common)


def linked_pairs(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct pairs (first id above ``SECOND_BITS``), how often each is linked, and all links."""
    n_a, n_b = np.bincount(in_a, minlength=groups), np.bincount(in_b, minlength=groups)
    links = n_a * n_b
    first_b = np.cumsum(n_b) - n_b
    wide = links > WIDE_GROUP
    plain = ~wide[in_a]
    reps = n_b[in_a[plain]]
    place = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(first_b[in_a[plain]], reps)
    keys = [(np.repeat(a[plain], reps) << SECOND_BITS) | b[place]]
    times = [np.ones(len(place), np.int64)]
    for g in np.flatnonzero(wide):  # long stretches without a common end: distinct ids against distinct ids
        ids_a, of_a = np.unique(a[in_a == g], return_counts=True)
        ids_b, of_b = np.unique(b[in_b == g], return_counts=True)
        keys.append(((ids_a[:, None] << SECOND_BITS) | ids_b[None, :]).ravel())
        times.append((of_a[:, None] * of_b[None, :]).ravel())
    if len(keys) == 1:
        found, n = np.unique(keys[0], return_counts=True)
        return found, n.astype(np.int64), int(links.sum())
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.zeros(len(found), np.int64)
    np.add.at(n, place, np.concatenate(times))
    return found, n, int(links.sum())


def groups_text(a: list[int], b: list[int], in_a: np.ndarray, in_b: np.ndarray, groups: int, name_a: list[str], name_b: list[str]) -> str:
    """``a1,a2|b1;a3|b2,b3``."""
    cut_a = np.cumsum(np.bincount(in_a, minlength=groups)).tolist()
    cut_b = np.cumsum(np.bincount(in_b, minlength=groups)).tolist()
    a, b = [name_a[i] for i in a], [name_b[i] for i in b]
    out, at_a, at_b = [], 0, 0
    for to_a, to_b in zip(cut_a, cut_b):
        left = a[at_a] if to_a - at_a == 1 else ",".join(a[at_a:to_a])
        out.append(left + "|" + (b[at_b] if to_b - at_b == 1 else ",".join(b[at_b:to_b])))
        at_a, at_b = to_a, to_b
    return ";".join(out)


# Runs ---------------------------------------------------------------------------------------

def _frames(*columns: np.ndarray, step: int = BLOCK) -> bytes:
    """Blocks of the columns, each a zstd frame behind its length. The first column is stored as
    differences, every column in the least width that holds it."""
    packer, out = zstandard.ZstdCompressor(level=1), []
    for lo in range(0, len(columns[0]), step):
        part = [c[lo:lo + step] for c in columns]
        part[0] = np.diff(part[0], prepend=0)
        part = [c.astype(np.result_type(np.min_scalar_type(c.min()), np.min_scalar_type(c.max()))) for c in part]
        kinds = "".join(c.dtype.char for c in part).encode()
        frame = packer.compress(kinds + b"".join(c.tobytes() for c in part))
        out.append(len(frame).to_bytes(4, "little") + len(part[0]).to_bytes(4, "little") + frame)
    return b"".join(out)


def _blocks(data: bytes, columns: int) -> Iterator[list[np.ndarray]]:
    reader, at = zstandard.ZstdDecompressor(), 0
    while at < len(data):
        size, rows = (int.from_bytes(data[at + k:at + k + 4], "little") for k in (0, 4))
        body, place, out = reader.decompress(data[at + 8:at + 8 + size]), columns, []
        for kind in body[:columns].decode():
            out.append(np.frombuffer(body, kind, rows, place))
            place += out[-1].nbytes
        yield [np.cumsum(out[0], dtype=np.int64), *[c.astype(np.int64) for c in out[1:]]]
        at += 8 + size


def _whole(data: bytes, columns: int) -> list[np.ndarray]:
    parts = list(_blocks(data, columns))
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * columns


@dataclass
class Run:
    """Documents whose pair records are sorted and spilled together."""

    name: int
    rows: list[tuple] = field(default_factory=list)
    keys: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)
    slots: list[np.ndarray] = field(default_factory=list)
    pairs: int = 0

    def add(self, row: tuple, keys: np.ndarray, times: np.ndarray) -> None:
        self.keys.append(keys)
        self.times.append(times)
        self.slots.append(np.full(len(keys), len(self.rows), np.int64))
        self.rows.append(row)
        self.pairs += len(keys)

    def full(self) -> bool:
        return self.pairs >= RUN_PAIRS or len(self.rows) >= RUN_DOCS

    def spilled(self) -> pa.RecordBatch:
        """A row per document, then a row per bucket of records."""
        names = [c.split(" ")[0] for c in SPILLED.split(", ")]
        out = [dict(zip(names, (self.name, slot, *row))) for slot, row in enumerate(self.rows)]
        keys, times, slots = (np.concatenate(x) for x in (self.keys, self.times, self.slots))
        bucket = (keys >> SECOND_BITS) & ((1 << BUCKET_BITS) - 1)
        order = np.lexsort((keys, bucket))  # stable, so documents ascend within a pair
        keys, times, slots, bucket = keys[order], times[order], slots[order], bucket[order]
        edges = np.searchsorted(bucket, np.arange((1 << BUCKET_BITS) + 1))
        for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
            if lo < hi:
                pair, docs = np.unique(keys[lo:hi], return_counts=True)
                out.append({"run": self.name, "bucket": b, "head": _frames(pair, docs), "records": _frames(slots[lo:hi], times[lo:hi])})
        kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.int64()] * 4, pa.string(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_pylist(out, pa.schema(list(zip(names, kinds))))


def _spill(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    one, two = side("byte", path_a), side("piece", path_b)
    base, n = TaskContext.get().partitionId() << 32, 0
    run = Run(base)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = [t or "" for t in part.column("text").to_pylist()]
            full = [t for t in texts if t]
            codes = iter(zip(one.encode(full), two.encode(full)) if full else ())
            for doc, text in zip(part.column("doc_id").to_pylist(), texts):
                a, b = next(codes) if text else ([], [])
                whole = b" " + text.encode()
                if not text or b"".join([one.text[i] for i in a]) != whole or b"".join([two.text[i] for i in b]) != whole:
                    run.add((doc, 0, 0, 0, 0, ""), np.zeros(0, np.int64), np.zeros(0, np.int64))
                else:
                    ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
                    in_a, in_b, groups = group_ends(np.cumsum(one.length[ids_a]), np.cumsum(two.length[ids_b]))
                    keys, times, links = linked_pairs(ids_a, ids_b, in_a, in_b, groups)
                    named = groups_text(a, b, in_a, in_b, groups, one.decimal, two.decimal)
                    run.add((doc, len(a), len(b), groups, links, hashlib.sha256(named.encode()).hexdigest()), keys, times)
                if run.full():
                    yield run.spilled()
                    n += 1
                    run = Run(base + n)
    if run.rows:
        yield run.spilled()


# Counting -----------------------------------------------------------------------------------

def merged(heads: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The heads of sorted runs as one ascending stream of (pairs, documents).

    A heap holds the last pair of every run's current block: all runs are taken up to the least of
    them, so one block of each run is in memory.
    """
    sources = [_blocks(h, 2) for h in heads]
    current = [next(s, None) for s in sources]
    heap = [(int(c[0][-1]), i) for i, c in enumerate(current) if c]
    heapq.heapify(heap)
    while heap:
        bound = heap[0][0]
        taken = []
        for i, c in enumerate(current):
            if c is not None and len(c[0]) and c[0][0] <= bound:
                cut = int(np.searchsorted(c[0], bound, "right"))
                taken.append((c[0][:cut], c[1][:cut]))
                current[i] = [x[cut:] for x in c]
        while heap and heap[0][0] == bound:
            _, i = heapq.heappop(heap)
            current[i] = next(sources[i], None)
            if current[i]:
                heapq.heappush(heap, (int(current[i][0][-1]), i))
        keys = np.concatenate([t[0] for t in taken])
        found, place = np.unique(keys, return_inverse=True)
        docs = np.zeros(len(found), np.int64)
        np.add.at(docs, place, np.concatenate([t[1] for t in taken]))
        yield found, docs


def with_maxima(stream: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Adds whether a pair's count is the highest of its first id; the last id is held back until it has passed."""
    held = [np.zeros(0, np.int64)] * 2

    def marked(keys, docs):
        first = keys >> SECOND_BITS
        starts = np.flatnonzero(np.diff(first, prepend=-1))
        best = np.maximum.reduceat(docs, starts) if len(keys) else docs
        return keys, docs, (docs == np.repeat(best, np.diff(np.append(starts, len(keys))))).astype(np.int64)

    for keys, docs in stream:
        keys, docs = np.concatenate([held[0], keys]), np.concatenate([held[1], docs])
        cut = int(np.searchsorted(keys, (keys[-1] >> SECOND_BITS) << SECOND_BITS))
        if cut:
            yield marked(keys[:cut], docs[:cut])
        held = [keys[cut:], docs[cut:]]
    if len(held[0]):
        yield marked(*held)


def _merge_heads(group):
    out = group.iloc[:1][["bucket", "part"]].copy()
    out["head"] = [b"".join(_frames(*block) for block in merged(list(group["head"])))]
    return out


def _finish(group):
    out = group.iloc[:1][["bucket"]].copy()
    out["counts"] = [b"".join(_frames(*block) for block in with_maxima(merged(list(group["head"]))))]
    return out


def pair_counts(runs: DataFrame) -> DataFrame:
    """``bucket, counts``: (pair, documents, whether its first id's highest) of each bucket.

    Heads are merged in rounds of ``FAN_IN``, so a hot pair costs one number per run, not one per
    document, and no task merges more than about twice the fan-in. Counts are bounded by the two vocabularies.
    """
    heads = runs.select("bucket", "run", "head")
    parts = runs.select("run").distinct().count()
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        dealt = heads.withColumn("part", F.pmod(F.xxhash64("run"), F.lit(parts)))
        merged_heads = dealt.groupBy("bucket", "part").applyInPandas(_merge_heads, "bucket int, part bigint, head binary")
        heads = stored(merged_heads.withColumnRenamed("part", "run"), "heads")
    return heads.groupBy("bucket").applyInPandas(_finish, "bucket int, counts binary")


def _contributions(runs, counts):
    """Each document's part of the sums, from the records of its run and the counts of the bucket."""
    import pandas as pd

    pairs, docs, best = _whole(counts["counts"].iloc[0], 3)
    out = []
    for run, head, records in zip(runs["run"], runs["head"], runs["records"]):
        keys, n = _whole(head, 2)
        place = np.repeat(np.searchsorted(pairs, keys), n)
        slots, times = _whole(records, 2)
        size = int(slots.max()) + 1
        total, top, here = (np.zeros(size, np.int64) for _ in range(3))
        np.add.at(total, slots, times * docs[place])
        np.add.at(top, slots, times * best[place])
        here[slots] = 1
        at = np.flatnonzero(here)
        out.append(pd.DataFrame({"run": run, "slot": at.astype(np.int32), "n_best": top[at], "count_sum": total[at]}))
    return pd.concat(out)


def align_tokens(docs: DataFrame, path_a: str, path_b: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    ``path_a`` names a byte-level vocabulary (it encodes space + text), ``path_b`` a sentencepiece model (it
    puts the space itself). Special tokens inside texts are plain text.

    A null or empty text, or one whose bytes either side does not give back, has no tokens: zeros and an
    empty ``groups_sha256``. Each row is a document of its own, also where ids or texts repeat; null ids
    stay. A very long text is a run of its own. An empty table gives an empty result; other columns are
    ignored. Texts are never shuffled: each is encoded where it is read, and the compressed records travel.
    """
    slim = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    table = stored(slim.mapInArrow(lambda batches: _spill(batches, path_a, path_b), SPILLED), "pair-runs")
    runs = table.filter("bucket is not null").select("run", "bucket", "head", "records")
    counts = stored(pair_counts(runs), "pair-counts")
    groups = -(-max(1, runs.select("run").distinct().count()) // RUNS_PER_GROUP)
    dealt = runs.withColumn("part", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int"))
    spread = counts.select("bucket", "counts", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    back = dealt.groupBy("bucket", "part").cogroup(spread.groupBy("bucket", "part")).applyInPandas(
        _contributions, "run bigint, slot int, n_best bigint, count_sum bigint")
    sums = back.groupBy("run", "slot").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = table.filter("bucket is null").drop("bucket", "head", "records")
    return rows.join(sums, ["run", "slot"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
