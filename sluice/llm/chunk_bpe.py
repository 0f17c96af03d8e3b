"""BPE encoding and decoding with content-defined reuse.

A rolling hash cuts texts where their content says so, so passages that documents share fall into
the same chunks wherever they stand. A chunk's core, the text between its outermost blanks, is
encoded once for the whole corpus where more than one place holds it. The text around each cut
is then encoded anew, from the last word of one core to the first word of the next, growing word by word until
its outer tokens agree exactly with those of the cores beside it.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections import ChainMap, Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import text as X
from sluice.llm.components import stored

WINDOW = 24
CUT_MASK = np.uint64(255)
LEAST_CHUNK, LEAST_CORE = 64, 32
#: Bits of the filter of shared cores (8 MB, whatever the data). A full filter lets cores through that
#: only one place holds; they are then encoded once as well, in another task.
FILTER_BITS = 1 << 26
BATCH_BYTES = 1 << 20
#: Words a worker keeps with their ids; beyond it starts anew.
MEMO_WORDS, MEMO_CHARS = 600_000, 64

PARTS = "array<struct<pos:int,ids:binary,core:binary>>"
ROWS = f"doc_id bigint, text_key binary, n_tokens bigint, ids_sha256 string, decoded_sha256 string, parts {PARTS}"
DONE = "text_key binary, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

_BASE = X.seeds(1, 11)[0]
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CODES = X.seeds(256, 12)


# Chunks -------------------------------------------------------------------------------------

@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def cut_candidates(data: np.ndarray) -> np.ndarray:
    """Places behind a window of ``WINDOW`` bytes whose rolling hash says cut, at the start of a character."""
    n = len(data)
    if n <= WINDOW:
        return np.zeros(0, np.int64)
    up, down = _powers(1 << max(20, int(n).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[data] * up[:n])])
    window = X.mixed((sums[WINDOW:] - sums[:-WINDOW]) * down[:n - WINDOW + 1])
    at = np.flatnonzero((window & CUT_MASK) == 0) + WINDOW
    at = at[at < n]
    for _ in range(3):
        inside = (data[at] & 0xC0) == 0x80
        at = np.minimum(at + inside, n - 1)
    return at


def cuts(candidates: np.ndarray, size: int) -> list[int]:
    """The cuts of one text: candidates in order, none nearer than ``LEAST_CHUNK`` to its neighbours."""
    out, last = [], 0
    for c in candidates.tolist():
        if c - last >= LEAST_CHUNK and size - c >= LEAST_CHUNK:
            out.append(c)
            last = c
    return out


def _outer_blanks(part: bytes) -> tuple[int, int]:
    """First and last place of a space or line end."""
    first = [p for p in (part.find(b" "), part.find(b"\n")) if p >= 0]
    return (min(first), max(part.rfind(b" "), part.rfind(b"\n"))) if first else (-1, -1)


def cores(raw: bytes, edges: list[int]) -> list[tuple[int, int]]:
    """Start and end of the core of every chunk that has one: what stands between its outermost
    blanks, or the text's own edges. Tokens never reach over a blank."""
    out = []
    bounds = [0, *edges, len(raw)]
    for lo, hi in zip(bounds, bounds[1:]):
        first, last = _outer_blanks(raw[lo:hi])
        start = lo if lo == 0 else lo + first + 1 if first >= 0 else hi
        end = hi if hi == len(raw) else lo + last + 1 if last >= 0 else lo
        if end - start >= LEAST_CORE:
            out.append((start, end))
    return out


def name(core: bytes) -> bytes:
    return hashlib.blake2b(core, digest_size=16).digest()


def bit_of(core_name: bytes) -> int:
    return int.from_bytes(core_name[:8], "little") % FILTER_BITS


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes, list[tuple[int, int]]]]:
    """Id, bytes and cores of every row; a null text is empty."""
    for batch in batches:
        data, offsets = X.flat(batch.column("text"))
        ids = batch.column("doc_id").to_pylist()
        for lo, hi in X.pieces(offsets, BATCH_BYTES, len(ids)):
            base = offsets[lo]
            part = data[base:offsets[hi]]
            found = cut_candidates(part)
            for row in range(lo, hi):
                start, end = int(offsets[row] - base), int(offsets[row + 1] - base)
                # A window that began in the text before says nothing about this one.
                own = found[np.searchsorted(found, start + WINDOW):np.searchsorted(found, end)] - start
                raw = part[start:end].tobytes()
                yield ids[row], raw, cores(raw, cuts(own, end - start))


# Encoding -----------------------------------------------------------------------------------

class Codec:
    """The library's tokenizer; ids as the shortest unsigned integers that hold the vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = "H" if size <= 1 << 16 else "I"
        self.decimal = [str(i) for i in range(size)]
        self.plain_join = json.loads(self.library.to_str())["decoder"] is None
        self.tokens = [self.library.id_to_token(i) for i in range(size)]
        if any(self._ask([" ", "\n", " \n "])):
            raise ValueError("blanks are tokens: this vocabulary cannot be cut at blanks")
        self.memo: dict[str, bytes] = {}

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of every text. Blanks are no tokens and end every token, so a worker asks the library
        once for the short words it meets again."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        words = [t.replace("\n", " ").split(" ") for t in texts]
        unknown = list({w for found in words for w in found if w not in self.memo})
        ids = dict(zip(unknown, self._ask(unknown)))
        self.memo.update((w, i) for w, i in ids.items() if len(w) <= MEMO_CHARS)
        known = ChainMap(ids, self.memo) if any(len(w) > MEMO_CHARS for w in unknown) else self.memo
        return [b"".join(map(known.__getitem__, found)) for found in words]

    def decode(self, ids: array) -> str:
        if self.plain_join:  # without a decoder the library joins the tokens by blanks
            return " ".join(map(self.tokens.__getitem__, ids))
        return self.library.decode(list(ids), skip_special_tokens=False)

    def digests(self, packed: bytes) -> tuple[int, str, str]:
        """Number of tokens, digest of their ids in decimal, digest of the decoded text."""
        ids = array(self.kind, packed)
        listed = " ".join(map(self.decimal.__getitem__, ids))
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _words_in(part: str, n: int, last: bool) -> str:
    """The first or last ``n`` words of a core with the blanks around them."""
    pieces = part.rsplit(" ", n + 1) if last else part.split(" ", n + 1)
    if len(pieces) <= n + 1:
        return part
    return " " + " ".join(pieces[1:]) if last else " ".join(pieces[:-1]) + " "


def _agreed(left: bytes, whole: bytes, right: bytes) -> bytes | None:
    """What stands between the tokens of the outer words, if these are as they are alone."""
    if len(whole) >= len(left) + len(right) and whole.startswith(left) and whole.endswith(right):
        return whole[len(left):len(whole) - len(right)]
    return None


def repaired(codec: Codec, before: str, between: str, after: str, words: int = 1) -> bytes:
    """Packed ids of the text between two cores, encoded with words of both beside it, until the tokens of those
    words stand at its ends as they do alone. The whole cores are the last resort."""
    while True:
        left, right = _words_in(before, words, True), _words_in(after, words, False)
        alone_l, alone_r, whole = codec.encode([left, right, left + between + right])
        found = _agreed(alone_l, whole, alone_r)
        if found is not None:
            return found
        if left == before and right == after:
            raise ValueError("tokens reach over a blank: this vocabulary cannot be cut at blanks")
        words *= 2


def _between(codec: Codec, joints: list[tuple[str, str, str]]) -> list[bytes]:
    """``repaired`` for many joints; the first try of all is one call of the library."""
    tries = []
    for before, between, after in joints:
        left, right = _words_in(before, 1, True), _words_in(after, 1, False)
        tries += [left, right, left + between + right]
    packed, out = codec.encode(tries), []
    for n, joint in enumerate(joints):
        left, right, whole = packed[3 * n:3 * n + 3]
        found = _agreed(left, whole, right)
        out.append(repaired(codec, *joint, words=2) if found is None else found)
    return out


# Tasks --------------------------------------------------------------------------------------

def _count_cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("core", pa.binary()), ("bit", pa.int64()), ("n", pa.int64())])
    held = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([bit_of(c) for c in held], pa.int64()),
                                           pa.array(list(held.values()), pa.int64())], schema=schema)

    for _, raw, found in _texts(batches):
        held.update(name(raw[lo:hi]) for lo, hi in found)
        if len(held) >= 1 << 18:
            yield rows()
            held.clear()
    yield rows()


def _shared_texts(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("core", pa.binary()), ("text", pa.string())])
    seen, out = set(), []
    for _, raw, found in _texts(batches):
        for lo, hi in found:
            core = name(raw[lo:hi])
            if core not in seen and _has(bits, core):
                seen.add(core)
                out.append({"core": core, "text": raw[lo:hi].decode()})
        if len(out) >= 4096:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
            if len(seen) >= 1 << 20:
                seen.clear()
    yield pa.RecordBatch.from_pylist(out, schema)


def _has(bits: np.ndarray, core: bytes) -> bool:
    bit = bit_of(core)
    return bool((int(bits[bit >> 6]) >> (bit & 63)) & 1)


def _encode_cores(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    with_ids = codec(path)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            ids = with_ids.encode(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("core"), pa.array(ids, pa.binary())], ["core", "ids"])


def _recipes(batches: Iterator[pa.RecordBatch], path: str, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A text without shared cores is encoded at once; of the others, the text between the shared cores."""
    with_ids, seen = codec(path), set()
    kinds = pa.struct([("pos", pa.int32()), ("ids", pa.binary()), ("core", pa.binary())])
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("decoded_sha256", pa.string()), ("parts", pa.list_(kinds))])

    def rows(held):
        whole = [h for h in held if h[2] is None]
        ids = iter(with_ids.encode([raw.decode() for _, raw, _ in whole]))
        joints, out = [], []
        for doc, raw, used in held:
            key = hashlib.blake2b(raw, digest_size=16).digest()
            row = {"doc_id": doc, "text_key": key}
            if used is None:
                row["n_tokens"], row["ids_sha256"], row["decoded_sha256"] = with_ids.digests(next(ids))
            elif key not in seen:
                seen.add(key)
                row["parts"] = []
                ends = [("", 0), *[(raw[lo:hi].decode(), hi) for lo, hi, _ in used]]
                for n, (before, end) in enumerate(ends):
                    to, after = (used[n][0], raw[used[n][0]:used[n][1]].decode()) if n < len(used) else (len(raw), "")
                    row["parts"].append({"pos": 2 * n, "joint": len(joints)})
                    joints.append((before, raw[end:to].decode(), after))
                row["parts"] += [{"pos": 2 * n + 1, "core": core} for n, (_, _, core) in enumerate(used)]
            out.append(row)
        found = _between(with_ids, joints)
        for row in out:
            for part in row.get("parts") or ():
                if "joint" in part:
                    part["ids"] = found[part.pop("joint")]
        if len(seen) >= 1 << 20:
            seen.clear()
        return pa.RecordBatch.from_pylist(out, schema)

    held, size = [], 0
    for doc, raw, found in _texts(batches):
        used = [(lo, hi, core) for lo, hi in found if _has(bits, core := name(raw[lo:hi]))]
        held.append((doc, raw, used or None))
        size += len(raw) + 1
        if size >= BATCH_BYTES // 2 or len(held) >= 1024:
            yield rows(held)
            held, size = [], 0
    yield rows(held)


def _assemble(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    with_ids = codec(path)
    for batch in batches:
        out = [with_ids.digests(b"".join(parts)) for parts in batch.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("text_key"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()),
             pa.array([o[2] for o in out], pa.string())], ["text_key", "n_tokens", "ids_sha256", "decoded_sha256"])


# Jobs ---------------------------------------------------------------------------------------

def shared_filter(slim: DataFrame) -> np.ndarray:
    """A bit for every core that stands in more than one place, as ``FILTER_BITS`` bits."""
    counted = slim.mapInArrow(_count_cores, "core binary, bit bigint, n bigint")
    shared = counted.groupBy("core").agg(F.first("bit").alias("bit"), F.sum("n").alias("n")).filter("n > 1")
    words = shared.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS >> 6, np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bits


def encode_decode(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row: the ids the library gives the whole
    text without adding special tokens, and the text it decodes from them.

    Only cores that several places hold are shuffled, once per task, and encoded once; documents without any
    are encoded where they are read. Equal texts are put together once. A null text is empty: no
    tokens, the digests of the empty string. Repeated rows and ids keep a row each; null ids stay. A text
    without blanks has no core and is encoded whole, whatever its length. An empty table gives an empty
    result; other columns are ignored.
    """
    slim = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(shared_filter(slim))
    texts = slim.mapInArrow(lambda b: _shared_texts(b, bits.value), "core binary, text string")
    once = texts.groupBy("core").agg(F.first("text").alias("text"))
    known = stored(once.mapInArrow(lambda b: _encode_cores(b, path), "core binary, ids binary"), "cores")
    rows = stored(slim.mapInArrow(lambda b: _recipes(b, path, bits.value), ROWS), "recipes")

    parts = rows.filter("parts is not null").select("text_key", F.explode("parts").alias("p")).select("text_key", "p.*")
    parts = parts.groupBy("text_key", "pos").agg(F.first("ids").alias("ids"), F.first("core").alias("core"))
    reused = parts.filter("core is not null").select("text_key", "pos", "core").join(known, "core").select("text_key", "pos", "ids")
    ordered = reused.unionByName(parts.filter("core is null").select("text_key", "pos", "ids")).groupBy("text_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda p: p["ids"]).alias("parts"))
    built = ordered.mapInArrow(lambda b: _assemble(b, path), DONE)
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    waiting = rows.filter("n_tokens is null").select("doc_id", "text_key").join(built, "text_key")
    return rows.filter("n_tokens is not null").select(*columns).unionByName(waiting.select(*columns))
