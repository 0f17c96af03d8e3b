"""Personal data by rules and a semi-Markov conditional random field.

The rules find e-mail addresses, IP addresses, card and phone numbers. The random field reads
runs of tokens that hold a digit or an at sign: features of whole spans score every candidate
segment of at most ``MAX_TOKENS`` tokens, and dynamic programming chooses boundaries and types
jointly. Its segments add to what the rules found, in text that no rule has taken.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.sampling import least_hashed

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "secret"]
OTHER = len(KINDS)
MAX_TOKENS, MAX_CHARS = 6, 256
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 1 << 14
KNOWN_REGIONS = 50_000
STEPS, RATE, RIDGE = 150, 0.3, 1e-3

# The patterns of the rules.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_NOT_DIGIT = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
_KEYWORD = re.compile(r"(?i)(?:token|secret|password|passwd|api[_-]?key|key|bearer)[\"']?\s{0,2}[=:]?\s{0,2}[\"']?$")
_HEX = re.compile(r"[0-9a-fA-F]+")
_OUTSIDE = "\"'`<>[]{}(),;:!?.*#$%&="

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Equal to the leftmost matches of local part, at sign and domain, in linear time."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """``start, end, kind`` by start, then kind. Per kind leftmost and non-overlapping; a match
    that fails its test is dropped."""
    found = [(s, e, 0) for s, e in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            found.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
    for m in PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda x: (x[0], x[2]))


@dataclass
class Region:
    """A run of neighbouring tokens; ``masks[i][n - 1]`` holds the span features of the segment of
    ``n`` tokens from token ``i`` on (None where it is too long)."""

    tokens: list[tuple[int, int]] = field(default_factory=list)

    def span(self, i: int, n: int) -> tuple[int, int]:
        return self.tokens[i][0], self.tokens[i + n - 1][1]

    def masks(self, text: str) -> tuple:
        out = []
        for i in range(len(self.tokens)):
            row = []
            for n in range(1, min(MAX_TOKENS, len(self.tokens) - i) + 1):
                start, end = self.span(i, n)
                row.append(features(text, start, end, n) if 0 < end - start <= MAX_CHARS else None)
            out.append(tuple(row))
        return tuple(out)


def regions(text: str) -> Iterator[Region]:
    """Runs of tokens with a digit or an at sign, one blank apart, without outer punctuation."""
    now, last = Region(), -2
    for m in _TOKEN.finditer(text):
        token = m.group()
        lead = len(token) - len(token.lstrip(_OUTSIDE))
        start, end = m.start() + lead, m.start() + len(token.rstrip(_OUTSIDE))
        quoted = re.search(r"[=:][\"']?(?=[^=:]*$)", token[lead:end - m.start()]) if end - start <= MAX_CHARS else None
        if quoted and "@" not in token:
            start += quoted.end()
        if now.tokens and (m.start() - last != 1 or text[last] == "\n"):
            yield now
            now = Region()
        now.tokens.append((start, max(start, end)))
        last = m.end()
    if now.tokens:
        yield now


def features(text: str, start: int, end: int, tokens: int) -> int:
    """Bit mask of the features of a whole span."""
    s = text[start:end]
    digits = _NOT_DIGIT.sub("", s)
    n = len(digits)
    parts = s.split(".")
    plain = re.fullmatch(r"[\x20()+.0-9-]+", s) is not None
    letters = any(c.isalpha() for c in s)
    name, _, host = s.partition("@")
    hexed = _HEX.fullmatch(s) is not None
    bits = [
        True, tokens > 1, tokens > 3, s.count("@") == 1, bool(name) and "." in host.strip("."), plain and not letters,
        len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts), s[:1] == "+",
        9 <= n <= 15, 12 <= n <= 19, plain and 12 <= n <= 19 and luhn(digits), n < 9, n > 19,
        letters and n > 0 and len(s) >= 16 and " " not in s and "@" not in s, hexed and letters and len(s) >= 24,
        len(set(s)) >= 10 and " " not in s, len(set(s)) <= 4, _KEYWORD.search(text, max(0, start - 32), start) is not None]
    return sum(1 << i for i, b in enumerate(bits) if b)


FEATURES = 18
_BITS = np.arange(FEATURES)


@dataclass
class Field:
    """``weights[kind, feature]`` of segments and ``moves[kind before, kind]``; other tokens score 0."""

    weights: np.ndarray
    moves: np.ndarray

    def scores(self, mask: int) -> np.ndarray:
        return self.weights @ ((mask >> _BITS) & 1)


def _segments(masks: tuple, i: int) -> Iterator[tuple[int, int]]:
    for n, mask in enumerate(masks[i], 1):
        if mask is not None:
            yield n, mask


def decode(crf: Field, masks: tuple) -> list[tuple[int, int, int]]:
    """The best segmentation: ``token, tokens, kind`` of its entities. Bounded segments make it
    linear in the region's tokens."""
    n = len(masks)
    best = np.full((n + 1, OTHER + 1), -np.inf)
    best[0, OTHER] = 0
    back: list[list] = [[None] * (OTHER + 1) for _ in range(n + 1)]
    for i in range(n):
        into = best[i][:, None] + crf.moves
        prior, value = into.argmax(0), into.max(0)
        if value[OTHER] > best[i + 1, OTHER]:
            best[i + 1, OTHER], back[i + 1][OTHER] = value[OTHER], (i, int(prior[OTHER]))
        for size, mask in _segments(masks, i):
            gained = value[:OTHER] + crf.scores(mask)
            for kind in np.flatnonzero(gained > best[i + size, :OTHER]):
                best[i + size, kind], back[i + size][kind] = gained[kind], (i, int(prior[kind]))
    out, at, kind = [], n, int(best[n].argmax())
    while at:
        start, before = back[at][kind]
        if kind != OTHER:
            out.append((start, at - start, kind))
        at, kind = start, before
    return out[::-1]


def _expected(crf: Field, masks: tuple, gold: tuple) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the given segmentation and its gradient, by forward and backward sums."""
    n, kinds = len(masks), OTHER + 1
    arcs = [(i, i + 1, OTHER, 0, 0.0) for i in range(n)]
    for i in range(n):
        for size, mask in _segments(masks, i):
            arcs += [(i, i + size, k, mask, s) for k, s in enumerate(crf.scores(mask))]
    ahead, behind = np.full((n + 1, kinds), -np.inf), np.full((n + 1, kinds), -np.inf)
    ahead[0, OTHER], behind[n] = 0, 0
    arcs.sort(key=lambda x: x[0])
    for i, j, k, _, s in arcs:
        ahead[j, k] = np.logaddexp(ahead[j, k], np.logaddexp.reduce(ahead[i] + crf.moves[:, k]) + s)
    for i, j, k, _, s in reversed(arcs):
        behind[i] = np.logaddexp(behind[i], crf.moves[:, k] + s + behind[j, k])
    total = np.logaddexp.reduce(ahead[n])
    g_weights, g_moves, value = np.zeros_like(crf.weights), np.zeros_like(crf.moves), -total
    for i, j, k, mask, s in arcs:
        p = np.exp(ahead[i] + crf.moves[:, k] + s + behind[j, k] - total)
        g_moves[:, k] -= p
        if k != OTHER:
            g_weights[k] -= p.sum() * ((mask >> _BITS) & 1)
    at, before, marked = 0, OTHER, {g[0]: g for g in gold}
    while at < n:
        _, size, k = marked.get(at, (at, 1, OTHER))
        g_moves[before, k] += 1
        value += crf.moves[before, k]
        if k != OTHER:
            bits = (masks[at][size - 1] >> _BITS) & 1
            g_weights[k] += bits
            value += crf.weights[k] @ bits
        at, before = at + size, k
    return value, g_weights, g_moves


def examples(text: str) -> Iterator[tuple[tuple, tuple]]:
    """Regions with the segments the rules name: base spans that a segment covers exactly, and long
    mixed tokens after a word such as ``token =``. Regions that a span meets otherwise are left out."""
    base = base_spans(text)
    for region in regions(text):
        masks, gold, taken, fair = region.masks(text), [], set(), True
        low, high = region.tokens[0][0], region.tokens[-1][1]
        where = {region.span(i, n): (i, n) for i in range(len(masks)) for n, _ in _segments(masks, i)}
        for start, end, kind in base:
            if start < high and end > low:
                i, n = where.get((start, end), (-1, 0))
                fair &= i >= 0 and not taken & set(range(i, i + n))
                taken |= set(range(i, i + n))
                gold.append((i, n, kind))
        for i, row in enumerate(masks):
            if i not in taken and row[0] is not None and row[0] >> 17 & 1 and row[0] >> 13 & 1:
                gold.append((i, 1, OTHER - 1))
        if fair:
            yield masks, tuple(sorted(gold))


def train(texts: Sequence[str]) -> Field:
    """Maximum likelihood over the texts' regions; equal regions are counted, not repeated."""
    crf = Field(np.zeros((OTHER, FEATURES)), np.zeros((OTHER + 1, OTHER + 1)))
    seen = Counter(e for t in texts for e in examples(t) if len(e[0]) <= 4 * MAX_TOKENS)
    if not seen:
        crf.weights[:, 0] = -1.0
        return crf
    crf.weights[:, 0] = -1.0
    share = {e: np.sqrt(c) for e, c in seen.items()}
    whole = sum(share.values())
    sums = [np.zeros_like(crf.weights), np.zeros_like(crf.moves)]
    for _ in range(STEPS):
        grads = [-RIDGE * crf.weights, -RIDGE * crf.moves]
        for (masks, gold), c in share.items():
            _, gw, gm = _expected(crf, masks, gold)
            grads[0] += gw * (c / whole)
            grads[1] += gm * (c / whole)
        for p, g, s in zip((crf.weights, crf.moves), grads, sums):
            s += g * g
            p += RATE * g / np.sqrt(s + 1e-8)
    return crf


def fit(docs: DataFrame, rows: int = SAMPLE_DOCS, longest: int = SAMPLE_BYTES) -> Field:
    """The field, learned from a bounded sample: at most ``rows`` whole texts of at most
    ``longest`` bytes that hold a digit or an at sign, those of the least hash; equal texts count once."""
    some = docs.filter(F.col("text").rlike("[0-9@]") & (F.octet_length("text") <= longest)).select("text")
    return train([r["text"] for r in least_hashed(some, rows, "text", "text")])


def added_spans(text: str, crf: Field, base: list[Span], known: dict) -> list[Span]:
    """What the random field finds in text that no rule has taken."""
    out: list[Span] = []
    starts: list[int] = []
    ends: list[int] = []
    for start, end, _ in base:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    for region in regions(text):
        masks = region.masks(text)
        if masks not in known:
            if len(known) > KNOWN_REGIONS:
                known.clear()
            known[masks] = decode(crf, masks)
        for i, n, kind in known[masks]:
            start, end = region.span(i, n)
            if bisect_right(ends, start) == bisect_left(starts, end):
                out.append((start, end, kind))
    return out


def written(spans: Sequence[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2])))


def _found(batches, crf: Field) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            text = text.as_py() or ""
            base = base_spans(text)
            kinds = Counter(k for _, _, k in base)
            added = added_spans(text, crf, base, known)
            rows.append((*[kinds[k] for k in range(len(BASE_KINDS))], hashlib.sha256(written(base).encode()).hexdigest(),
                         written(base + added), len(added)))
        columns = list(zip(*rows)) if rows else [()] * 7
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]],
            ["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans", "n_added"])


def personal_data(docs: DataFrame, crf: Field) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` for every row.

    The counts and the checksum cover the spans of the rules; ``spans`` holds these and the added
    ones. Offsets are code points. A null text is an empty one, and has no spans; equal texts
    have equal spans, repeated rows each; spans of the rules of different kinds may overlap; a
    null id is kept; other columns are ignored; an empty table gives an empty result.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(
        lambda batches: _found(batches, crf),
        "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")
