"""Line dedup by pairwise alignment of overlapping documents.

A block is a run of lines that follow each other in two documents. Every block is made of the
shortest runs of enough words. The digest of such a run brings each later document together
with the first one that holds it, which is the rarest overlap there is: pairs grow with the
lines, however many documents share a line. Each pair is aligned with patience diff on the
lines both sides share, and aligned blocks go from the later document. What one alignment
leaves, because it stands there crossed or more than once, is aligned again by itself.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Hashable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.components import stored

MIN_WORDS = 5
#: Runs that are aligned with one earlier document before its later documents are split over more tasks.
PAIR_ROWS = 4_000
_BLANKS = "[ \\t-\\r]+"


def unique_anchors(a: Sequence[Hashable], b: Sequence[Hashable], alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    """The longest increasing run of lines that stand exactly once in both ranges."""
    def once(x, lo, hi):
        at: dict[Hashable, int] = {}
        for i in range(lo, hi):
            at[x[i]] = -1 if x[i] in at else i
        return at

    in_a, in_b = once(a, alo, ahi), once(b, blo, bhi)
    both = [(i, in_b[h]) for h, i in in_a.items() if i >= 0 and in_b.get(h, -1) >= 0]
    both.sort()
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(both)
    for n, (_, j) in enumerate(both):
        k = bisect_left(tails, j)
        before[n] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(j)
            ends.append(n)
        else:
            tails[k], ends[k] = j, n
    chain, n = [], ends[-1] if ends else -1
    while n >= 0:
        chain.append(both[n])
        n = before[n]
    return chain[::-1]


def patience(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Aligned positions of two lists of lines: equal ends are taken first, then unique common lines
    split the rest."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        anchors = unique_anchors(a, b, alo, ahi, blo, bhi)
        for i, j in anchors:
            todo.append((alo, i, blo, j))
            out.append((i, j))
            alo, blo = i + 1, j + 1
        if anchors:
            todo.append((alo, ahi, blo, bhi))
    return sorted(out)


Runs = Iterable[tuple[int, tuple[bytes, ...]]]


class Side:
    """What one document brings to an alignment: its runs as (number of the first line, lines)."""

    def __init__(self, runs: Runs):
        self.runs: dict[tuple[int, tuple[bytes, ...]], None] = {}
        self.at: dict[int, bytes] = {}
        self.first: dict[tuple[bytes, ...], int] = {}
        for lo, lines in runs:
            self.runs[lo, lines] = None
            self.at.update(enumerate(lines, lo))
            self.first[lines] = min(lo, self.first.get(lines, lo))
        self.places = sorted(self.at)
        self.lines = [self.at[n] for n in self.places]


def aligned_lines(later: Side, earlier: Side) -> set[int]:
    """Line numbers of ``later`` that lie in blocks aligned with ``earlier``.

    A run goes when its lines stand in one piece on both sides of the alignment. Runs that stay
    are aligned once more, each with the stretch of ``earlier`` where it stands first.
    """
    met = {later.places[i]: earlier.places[j] for i, j in patience(later.lines, earlier.lines)}
    gone: set[int] = set()
    rest = []
    for lo, lines in later.runs:
        to = met.get(lo)
        if to is not None and all(met.get(lo + k) == to + k for k in range(1, len(lines))):
            gone.update(range(lo, lo + len(lines)))
        else:
            rest.append((lo, lines))
    for lo, lines in rest:
        start = earlier.first.get(lines)
        if start is None or gone.issuperset(range(lo, lo + len(lines))):
            continue
        stretch = [earlier.at[start + k] for k in range(len(lines))]
        if len(patience(lines, stretch)) == len(lines):
            gone.update(range(lo, lo + len(lines)))
    return gone


def _align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted: an earlier document's runs, then each later document's. One earlier and
    one later document are held at a time."""
    pair = doc = earlier = None
    runs: list = []
    ids, versions, gone = [], [], []

    def close():
        nonlocal earlier
        if doc is None:
            return
        if not doc[0]:
            earlier = Side(runs)
            return
        lines = aligned_lines(Side(runs), earlier)
        if lines:
            ids.append(doc[1])
            versions.append(doc[2])
            gone.append(sorted(lines))

    def found():
        out = pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(versions, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["doc_id", "version", "gone"])
        for x in (ids, versions, gone):
            x.clear()
        return out

    names = ["e_id", "e_version", "part", "later", "doc_id", "version", "lo", "h", "parts"]
    for batch in batches:
        for e, ev, part, later, d, v, lo, h, parts in zip(*[batch.column(c).to_pylist() for c in names]):
            if (e, ev, part) != pair or (later, d, v) != doc:
                close()
                pair, doc, runs = (e, ev, part), (later, d, v), []
            runs.append((lo, tuple(parts) if parts else (h,)))
        yield found()
    close()
    yield found()


def filled_lines(text: str) -> Column:
    """The lines that hold more than blanks, trimmed."""
    trimmed = F.transform(F.split(F.col(text), "\n"), lambda x: F.regexp_replace(x, "^[ \\t-\\r]+|[ \\t-\\r]+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def _digest(x: Column) -> Column:
    return F.unhex(F.md5(x))


def _run(span: Column, min_words: int) -> Column:
    """Digests of the first lines of ``span`` that hold ``min_words`` words together, null where it ends before."""
    none = F.struct(F.lit(0).alias("w"), F.array().cast("array<binary>").alias("h"))
    longer = lambda a, x: F.when(a["w"] >= min_words, a).otherwise(
        F.struct((a["w"] + x["w"]).alias("w"), F.concat(a["h"], F.array(x["h"])).alias("h")))
    return F.aggregate(span, none, longer, lambda a: F.when(a["w"] >= min_words, a["h"]))


def shortest_runs(lines: str, min_words: int) -> Column:
    """``lo, h, parts`` of the runs that blocks are made of: each line of ``min_words`` words alone
    (its own digest, no parts), and from each shorter line the shortest run on and the shortest run
    back. A line of a block always lies in one of them that is inside the block."""
    def several(lo, parts):
        joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
        return F.struct(lo.alias("lo"), _digest(joined).alias("h"), parts.alias("parts"))

    def runs(x, n):
        on = _run(F.slice(lines, n + 1, min_words), min_words)
        back = F.reverse(_run(F.reverse(F.slice(lines, F.greatest(n + 2 - min_words, F.lit(1)), F.least(n + 1, F.lit(min_words)))), min_words))
        one = F.struct(n.alias("lo"), x["h"].alias("h"), F.lit(None).cast("array<binary>").alias("parts"))
        both = F.filter(F.array(several(n, on), several(n + 1 - F.size(back), back)), lambda r: r["parts"].isNotNull())
        return F.when(x["w"] >= min_words, F.array(one)).otherwise(both)

    return F.flatten(F.transform(lines, runs))


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """``doc_id, version, gone``: the numbers of the filled lines that go from a document.

    The later documents of an earlier one that more than ``pair_rows`` runs refer to are split
    over several tasks, each of which receives the earlier document's shared runs. A part is at
    least as large as the runs of the earlier document, so the copies at most double the rows.
    """
    doc = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("version"), F.size("lines").alias("filled"))
    hashed = F.transform(filled_lines("text"), lambda x: F.struct(_digest(x).alias("h"), F.size(F.split(x, _BLANKS)).alias("w")))
    lines = docs.filter("doc_id is not null and text is not null").select(
        "doc_id", F.xxhash64("text").alias("version"), hashed.alias("lines")).select(doc.alias("doc"), "lines")
    runs = lines.select("doc", F.explode(shortest_runs("lines", min_words)).alias("run")).select("doc", "run.*")
    spread = runs.groupBy("h").agg(F.min("doc").alias("earlier"), F.max("doc.doc_id").alias("last"), F.count(F.lit(1)).alias("rows"))
    spread = stored(spread.filter("last > earlier.doc_id").select("h", "earlier", "rows"), "first_holders")
    part_rows = F.greatest(F.lit(pair_rows), 2 * F.col("earlier.filled"))
    cuts = spread.groupBy("earlier").agg(F.sum("rows").alias("rows")).select(
        "earlier", F.ceil(F.col("rows") / part_rows).cast("int").alias("cuts"))
    # Stored, both sides of the join on ``h`` are plain shuffles, so a run of every document can be split.
    first = stored(spread.join(cuts, "earlier").select("h", "earlier", "cuts"), "first_holders")
    later = F.col("doc.doc_id") > F.col("earlier.doc_id")
    part = F.when(later, F.array(F.pmod("doc.version", "cuts").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("cuts") - 1))
    met = runs.join(first, "h").filter(later | (F.col("doc") == F.col("earlier"))).select(
        F.col("earlier.doc_id").alias("e_id"), F.col("earlier.version").alias("e_version"), F.explode(part).alias("part"),
        later.alias("later"), "doc.doc_id", "doc.version", "lo", "h", "parts")
    sides = met.repartition("e_id", "e_version", "part").sortWithinPartitions(
        "e_id", "e_version", "part", "later", "doc_id", "version")
    found = sides.mapInArrow(_align, "doc_id bigint, version bigint, gone array<int>")
    return found.groupBy("doc_id", "version").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` freed of repeated blocks, and ``lines_removed``.

    Lines are compared by 128-bit digests, without the blanks around them; empty lines do not
    count. A block of ``min_words`` words or more that a document with a smaller id holds goes,
    each time it stands in a document and in any order; no line is too frequent or too rare to
    be treated, and the work grows with the lines only. The first document that holds a block
    keeps it.

    Unchanged texts stay as they are; a changed text is its remaining filled lines, perhaps
    none. Null texts and rows with a null id stay unchanged. Rows of one id are never compared
    with each other, and repeated rows are treated alike. An empty table gives an empty result.
    Further columns are carried along, whatever their names; ``lines_removed`` replaces a column
    of that name.
    """
    gone = stored(removed_lines(docs, min_words), "gone").alias("g")
    plain = docs.drop("lines_removed").alias("d")
    match = (F.col("d.doc_id").cast("bigint") == F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.version"))
    left = F.filter(filled_lines("d.text"), lambda x, n: ~F.array_contains(F.col("g.gone"), n))
    text = F.when(F.col("g.gone").isNull(), F.col("d.text")).otherwise(F.array_join(left, "\n"))
    carried = [text.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in docs.columns if c != "lines_removed"]
    return plain.join(gone, match, "left").select(
        *carried, F.coalesce(F.size("g.gone"), F.lit(0)).alias("lines_removed"))
