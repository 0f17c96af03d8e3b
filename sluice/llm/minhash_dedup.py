"""Near-duplicate documents by a chosen-path set similarity join.

Documents are sets of word shingles. Every independent tree sends a document down the path
chosen by its minwise tokens: the documents of a node share all tokens chosen so far. Nodes
of one document end; small nodes are compared exhaustively on sketches; large nodes branch
again. Pairs that the sketches leave open are confirmed on the full sets, and the confirmed
links are contracted to components. Nothing but counts reaches the driver.

The number of trees follows from the wanted recall: a linked pair meets in one tree with the
probability ``p = j^2`` (two tokens choose the first node), so ``trees = log(miss) / log(1 - p)``.
In nodes crowded with more than ``NODE_ROWS`` classes it must also meet in one of two branches a
level, and may be lost in all of them: at j = 0.8 the chance per tree falls from 0.64 to 0.44 or
more, so 16 trees miss such a pair with up to 1e-4. A lost pair is a lost link only where no
other links join its groups.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import text as X
from sluice.llm.components import components, stored

#: The texts (doc_id, text) of the classes whose number stands in a table (doc_id).
Texts = Callable[[DataFrame], DataFrame]

SKETCH = 128
BRANCHES = 2
NODE_ROWS = 2048
NODE_SHINGLES = 1 << 22
FIRST_TREES = 3
MAX_LEVELS = 8
MISS = 1e-7
SIGMAS = 5.0

_XOR, _MUL = X.seeds(SKETCH, 4).astype(np.uint32), X.seeds(SKETCH, 5).astype(np.uint32) | np.uint32(1)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def trees_for(percent: int, miss: float = MISS) -> int:
    """Independent trees so that a pair right at the threshold is missed with at most ``miss``."""
    p = (percent / 100) ** 2
    trees = math.ceil(math.log(miss) / math.log(1 - p))
    if not 0 < trees <= SKETCH // 2:
        raise ValueError("the threshold is too low for the sketch")
    return trees


def minwise(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, SKETCH) least hash of each row's set under each of the hash functions."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.full((len(offsets) - 1, SKETCH), np.uint32(0xFFFFFFFF))
    if len(full):
        x = ((sets * _FOLD) >> np.uint64(32)).astype(np.uint32)
        starts = offsets[:-1][full]
        for i in range(SKETCH):
            out[full, i] = np.minimum.reduceat((x ^ _XOR[i]) * _MUL[i], starts)
    return out


def _fixed(a: np.ndarray) -> pa.Array:
    """Rows of a 2-D array as binaries."""
    n, width = a.shape
    offsets = (np.arange(n + 1) * (width * a.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(a))])


def _features(batches, k: int, trees: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, sets, offsets in X.shingle_sets(batch.column("text"), k):
            sizes = np.diff(offsets)
            low = minwise(sets, offsets)
            base = low[:, :2 * trees].astype(np.uint64)
            base = (X.mixed(base[:, 0::2] << np.uint64(32) | base[:, 1::2]) >> np.uint64(32)).astype(np.uint32)
            digest = [hashlib.blake2b(sets[a:b], digest_size=16).digest() if b > a else None
                      for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(at, to - at), batch.column("text_md5").slice(at, to - at),
                 pa.array(sizes, pa.int64()), pa.array(digest, pa.binary()),
                 _fixed(low), _fixed((low >> np.uint32(13)).astype(np.uint8)), _fixed(base)],
                ["doc_id", "text_md5", "n_shingles", "digest", "low", "sketch", "base"])


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    """Equal-length binaries as rows of a 2-D array."""
    data, offsets = np.frombuffer(column.buffers()[2], np.uint8), np.frombuffer(column.buffers()[1], np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1]
    return data[offsets[0]:offsets[-1]].view(dtype).reshape(len(column), -1)


def _strongest_forest(i: np.ndarray, j: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Which of the edges make a maximum spanning forest (all components grow at once)."""
    order = np.argsort(weight, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    group, chosen, live = np.arange(n), np.zeros(len(order), bool), np.arange(len(order))
    while True:
        live = live[group[i[live]] != group[j[live]]]
        if not len(live):
            return chosen
        best = np.full(n, -1, np.int64)
        np.maximum.at(best, group[i[live]], rank[live])
        np.maximum.at(best, group[j[live]], rank[live])
        own = np.flatnonzero(best >= 0)
        edge = order[best[own]]
        chosen[edge] = True
        parent = np.arange(n)
        parent[own] = group[i[edge]] + group[j[edge]] - own
        twice = (parent[parent] == np.arange(n)) & (np.arange(n) < parent)
        parent[twice] = np.flatnonzero(twice)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        group = parent[group]


def _open_in_nodes(table: pa.Table, percent: int, trees: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the pairs within nodes whose sketches leave a link open and whose groups differ, and
    their agreement. ``table`` is sorted by node.

    A pair is left to the first tree in which both meet in a small first-level node.
    """
    group = table.column("grp").to_numpy()
    node = table.column("node").to_numpy()
    size, crowded = table.column("n_shingles").to_numpy(), table.column("crowded").to_numpy()
    seen_in, sketch = table.column("upto").to_numpy(), _matrix(table.column("sketch").combine_chunks(), np.uint8)
    base = _matrix(table.column("base").combine_chunks(), np.uint32)
    last = np.searchsorted(node, node, "right")
    t = percent / 100
    cut = SKETCH * t - SIGMAS * math.sqrt(SKETCH * t * (1 - t))
    order = np.arange(trees)
    left, right, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    here, d = np.arange(len(node)), 1
    while True:
        here = here[here + d < last[here]]
        if not len(here):
            break
        i, j = here, here + d
        small, big = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        ok = (100 * small >= percent * big) & (group[i] != group[j])
        i, j = i[ok], j[ok]
        agree = (sketch[i] == sketch[j]).sum(1)
        ok = agree >= cut
        i, j, agree = i[ok], j[ok], agree[ok]
        if len(i):
            met = (base[i] == base[j]) & (order < seen_in[i, None]) & ((crowded[i, None] >> order) & 1 == 0)
            ok = ~met.any(1)
            left.append(i[ok])
            right.append(j[ok])
            weight.append(agree[ok])
        d += 1
    return np.concatenate(left), np.concatenate(right), np.concatenate(weight)


def _ends(table: pa.Table, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("doc_id").to_numpy()
    return np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])


def _forest(table: pa.Table, percent: int, trees: int) -> pa.RecordBatch:
    """Pairs of a maximum spanning forest by agreement of the sketches, and the nodes with further
    open pairs. A row is a pair, or a node that has further pairs."""
    i, j, weight = _open_in_nodes(table, percent, trees)
    keep = _strongest_forest(i, j, weight, table.num_rows)
    a, b = _ends(table, i[keep], j[keep])
    more = np.unique(table.column("node").to_numpy()[i[~keep]])
    none_a, none_m = pa.nulls(len(a), pa.int64()), pa.nulls(len(more), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([pa.array(a), none_m]), pa.concat_arrays([pa.array(b), none_m]), pa.concat_arrays([none_a, pa.array(more)])],
        ["a", "b", "more"])


def _shared(tokens: np.ndarray, offsets: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many tokens the sets ``i`` and ``j`` share; ``tokens`` are numbers from 0, distinct in each set."""
    out, mark = np.zeros(len(i), np.int64), np.zeros(int(tokens.max()) + 1 if len(tokens) else 1, bool)
    order = np.argsort(i, kind="stable")
    firsts = np.flatnonzero(np.diff(i[order], prepend=-1))
    for at, to in zip(firsts, [*firsts[1:], len(order)]):
        own = tokens[offsets[i[order[at]]]:offsets[i[order[at]] + 1]]
        mark[own] = True
        for pair in order[at:to]:
            out[pair] = np.count_nonzero(mark[tokens[offsets[j[pair]]:offsets[j[pair] + 1]]])
        mark[own] = False
    return out


def _exact_forest(table: pa.Table, percent: int, trees: int) -> pa.RecordBatch:
    """The open pairs confirmed on the full sets; of the links, a forest that joins the same rows."""
    i, j, weight = _open_in_nodes(table, percent, trees)
    if len(i):
        lists = table.column("shingles").combine_chunks()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        tokens = np.unique(lists.values.to_numpy()[offsets[0]:offsets[-1]], return_inverse=True)[1]
        offsets = offsets - offsets[0]
        both, sizes = _shared(tokens, offsets, i, j), np.diff(offsets)
        ok = 100 * both >= percent * (sizes[i] + sizes[j] - both)
        i, j, weight = i[ok], j[ok], both[ok]
        keep = _strongest_forest(i, j, weight, table.num_rows)
        i, j = i[keep], j[keep]
    a, b = _ends(table, i, j)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _whole_nodes(batches) -> Iterator[pa.Table]:
    """Runs of whole nodes, of about ``NODE_ROWS`` rows or one node; the last node of a batch waits
    for the next batch."""
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if kept is not None:
            table = pa.concat_tables([kept, table])
        node = table.column("node").to_numpy()
        at, cut = 0, int(np.searchsorted(node, node[-1], "left"))
        while at < cut:
            to = max(int(np.searchsorted(node, node[min(at + NODE_ROWS, cut)], "left")), int(np.searchsorted(node, node[at], "right")))
            yield table.slice(at, to - at).combine_chunks()
            at = to
        kept = table.slice(cut)
    if kept is not None:
        yield kept.combine_chunks()


def _with_counts(entries: DataFrame) -> DataFrame:
    """Entries of nodes with company, and how many they are."""
    counts = entries.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    return entries.join(counts, "node")


def _branch(crowd: DataFrame, reps: DataFrame, level: int) -> DataFrame:
    """The next level below crowded nodes: in each branch two more tokens are chosen."""
    steps = F.array(*[F.lit(b) for b in range(BRANCHES)])
    wide = crowd.join(reps.select("doc_id", "low"), "doc_id").withColumn("branch", F.explode(steps))
    place = F.pmod(F.xxhash64(F.lit(level), "tree", "branch"), F.lit(SKETCH // 2)).cast("int")
    chosen = F.substring(F.col("low"), place * 8 + 1, F.lit(8))
    return wide.select(F.xxhash64("node", "branch", chosen).alias("node"), "tree", "doc_id")


def _blocks(crowd: DataFrame) -> DataFrame:
    """Nodes that no level could thin out: block against block, so every pair still meets."""
    n = F.ceil(F.col("rows") * 2 / F.lit(NODE_ROWS)).cast("int")
    cells = crowd.withColumn("n", n).withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return cells.select(F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("node"), "tree", "doc_id")


def tree_nodes(reps: DataFrame, percent: int, miss: float = MISS) -> DataFrame:
    """``node, tree, doc_id, upto, crowded``: the documents of all end nodes of all trees.

    ``reps`` needs ``doc_id, low, base``.
    """
    trees = trees_for(percent, miss)
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    entries = reps.select("doc_id", "base", tree.alias("tree"))
    entries = entries.select(
        F.xxhash64("tree", F.substring(F.col("base"), F.col("tree") * 4 + 1, F.lit(4))).alias("node"), "tree", "doc_id")
    first = stored(_with_counts(entries), "nodes")
    crowd = first.filter(F.col("rows") > NODE_ROWS)
    busy = crowd.groupBy("doc_id").agg(F.expr("bit_or(shiftleft(1L, tree))").alias("crowded"))
    ended = first.filter(F.col("rows") <= NODE_ROWS).select("node", "tree", "doc_id", F.col("tree").alias("upto"))
    level = 0
    while not crowd.isEmpty():
        level += 1
        if level > MAX_LEVELS:
            rest = _blocks(crowd)
            ended = ended.unionByName(rest.select("node", "tree", "doc_id", F.lit(trees).alias("upto")))
            break
        below = stored(_with_counts(_branch(crowd, reps, level)), "nodes")
        ended = ended.unionByName(
            below.filter(F.col("rows") <= NODE_ROWS).select("node", "tree", "doc_id", F.lit(trees).alias("upto")))
        crowd = below.filter(F.col("rows") > NODE_ROWS)
    return ended.join(busy, "doc_id", "left").select(
        "node", "tree", "doc_id", F.col("upto").cast("int").alias("upto"), F.coalesce("crowded", F.lit(0)).cast("bigint").alias("crowded"))


def _by_node(rows: DataFrame, reps: DataFrame, *more: str) -> DataFrame:
    """Entries with the sketches of their documents, whole nodes together."""
    rows = rows.join(reps.select("doc_id", "n_shingles", "sketch", "base"), "doc_id").select(
        "node", "doc_id", "grp", "n_shingles", "crowded", "upto", "sketch", "base", *more)
    return rows.repartition("node").sortWithinPartitions("node", "doc_id")


def forest_pairs(nodes: DataFrame, reps: DataFrame, percent: int, trees: int) -> DataFrame:
    """``a, b, more``: the strongest open pairs of each node, or a node with further ones."""
    return _by_node(nodes.withColumn("grp", F.col("doc_id")), reps).mapInArrow(
        lambda batches: (_forest(table, percent, trees) for table in _whole_nodes(batches)), "a bigint, b bigint, more bigint")


def exact_links(nodes: DataFrame, reps: DataFrame, texts: Texts, k: int, percent: int, trees: int) -> DataFrame:
    """``a, b``: confirmed links that join whatever the links of each node join between groups.

    The full sets travel to the nodes, so no pair leaves a task unless it is a link. A node with
    many shingles is dealt block against block: every pair still meets, in bounded memory.
    """
    sets = texts(nodes.select("doc_id").distinct()).mapInArrow(
        lambda batches: _sets(batches, k), "doc_id bigint, shingles array<bigint>")
    weights = nodes.join(reps.select("doc_id", "n_shingles"), "doc_id").groupBy("node").agg(
        F.ceil(F.sum("n_shingles") * 2 / F.lit(NODE_SHINGLES)).cast("int").alias("n"))
    cells = nodes.join(weights, "node").withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.greatest("n", F.lit(1))).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest("n", F.lit(1)) - 1)))
    cells = cells.withColumn("node", F.when(F.col("n") > 1, F.xxhash64(
        "node", F.least("mine", "other"), F.greatest("mine", "other"))).otherwise(F.col("node")))
    return _by_node(cells.join(sets, "doc_id"), reps, "shingles").mapInArrow(
        lambda batches: (_exact_forest(table, percent, trees) for table in _whole_nodes(batches)), "a bigint, b bigint")


def linked(reps: DataFrame, texts: Texts, k: int, percent: int, miss: float = MISS) -> DataFrame:
    """``node, component`` of all documents with links, as :func:`components` gives them.

    First the nodes of ``FIRST_TREES`` trees give the pairs of a maximum spanning forest by sketch
    agreement; they are confirmed and contracted, which joins most groups with few pairs. Then
    every node that may link two groups (further open pairs, or of another tree) compares on the
    full sets, in the node. So no link between groups is left out, and no pair is made that
    is not a link.
    """
    trees = trees_for(percent, miss)
    nodes = stored(tree_nodes(reps, percent, miss), "ends")
    early = F.col("tree") < FIRST_TREES
    first = stored(forest_pairs(nodes.filter(early), reps, percent, trees).distinct(), "pairs")
    links = stored(confirmed(first.filter("more is null").select("a", "b"), texts, k, percent), "links")
    joined = stored(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "joined")
    again = nodes.filter(early).join(first.filter("more is not null").select(F.col("more").alias("node")), "node", "left_semi")
    again = again.unionByName(nodes.filter(~early))
    again = again.join(joined.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn(
        "grp", F.coalesce("component", "doc_id")).drop("component")
    split = again.groupBy("node").agg(F.min("grp").alias("least"), F.max("grp").alias("most")).filter("least < most")
    again = stored(again.join(split.select("node"), "node", "left_semi"), "again")
    more = exact_links(again, reps, texts, k, percent, trees)
    return components(links.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v")))


def _sets(batches, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, sets, offsets in X.shingle_sets(batch.column("text"), k):
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(sets.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), lists], ["doc_id", "shingles"])


def confirmed(pairs: DataFrame, texts: Texts, k: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold. Only texts that stand in a pair are read on."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = texts(wanted).mapInArrow(
        lambda batches: _sets(batches, k), "doc_id bigint, shingles array<bigint>")
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(a, "a").join(b, "b")
    shared = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("bigint").alias("shared"),
                         F.size("sa").cast("bigint").alias("na"), F.size("sb").cast("bigint").alias("nb"))
    return shared.filter(f"100 * shared >= {percent} * (na + nb - shared)").select("a", "b")


def _representatives(named: DataFrame, first: DataFrame) -> DataFrame:
    """One row of ``named`` for each class of ``first (doc_id, text_md5, class)``, under the class's number.

    Copies of a row go by the join's own columns and the class: the sketches are not dealt out again.
    """
    chosen = named.join(first, ["doc_id", "text_md5"]).dropDuplicates(["doc_id", "text_md5", "class"])
    return chosen.drop("text_md5", "doc_id").withColumnRenamed("class", "doc_id")


def near_rows(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """``doc_id, text_md5, n_shingles, component_id, kept``: what :func:`near_duplicates` gives, with
    the digest of the text, so that rows of one id can be told apart.

    Inside, a class of equal sets goes by a number of its own in the column ``doc_id``, never by
    the id of a document: several texts under one id are several classes.
    """
    trees = trees_for(percent, miss)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slim = slim.withColumn("text_md5", F.md5("text"))
    features = stored(slim.mapInArrow(
        lambda batches: _features(batches, k, trees), "doc_id bigint, text_md5 string, n_shingles bigint, "
        "digest binary, low binary, sketch binary, base binary"), "features")
    named = features.filter("doc_id is not null and digest is not null")
    classes = named.groupBy("digest").agg(F.min(F.struct("doc_id", "text_md5")).alias("rep"))
    classes = stored(classes.select("digest", F.col("rep.doc_id").alias("rep"), F.col("rep.text_md5").alias("text_md5"),
                                    F.monotonically_increasing_id().alias("class")), "classes")
    first = classes.select(F.col("rep").alias("doc_id"), "text_md5", "class")
    reps = stored(_representatives(named.drop("digest"), first), "reps")

    def texts(wanted: DataFrame) -> DataFrame:
        chosen = first.join(wanted.select(F.col("doc_id").alias("class")), "class", "left_semi")
        return slim.join(chosen, ["doc_id", "text_md5"]).select(F.col("class").alias("doc_id"), "text")

    groups = linked(reps, texts, k, percent, miss)
    members = stored(groups.withColumnRenamed("node", "class").join(classes.drop("text_md5"), "class"), "members")
    leads = members.groupBy("component").agg(F.min(F.struct("rep", "digest")).alias("lead"))
    joined = members.select("digest", "component").join(leads, "component").select("digest", "lead")
    out = features.select("doc_id", "text_md5", "n_shingles", "digest").join(
        classes.select("digest", F.struct("rep", "digest").alias("own")), "digest", "left").join(joined, "digest", "left")
    lead = F.coalesce("lead", "own")
    is_lead = (F.col("doc_id") == lead["rep"]) & (F.col("digest") == lead["digest"])
    return out.select("doc_id", "text_md5", "n_shingles",
                      F.when(F.col("doc_id").isNotNull(), F.coalesce(lead["rep"], F.col("doc_id"))).alias("component_id"),
                      F.coalesce(is_lead, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs (doc_id, text)``.

    Two documents are linked when 100 x shared shingles >= ``percent`` x all shingles of both;
    components are what links reach; ``component_id`` is the least id in it and its row is
    kept. Documents with the same set are one class, compared once. Nulls and texts without
    words have no shingles and stand alone; repeated rows share one decision. Different texts
    under one id are different documents, each linked by its own text; where the least id of a
    component holds several of its texts, one of them (by the digest of its set) is kept. Rows
    with a null id keep a null component and are kept. Other columns are ignored. An empty table
    gives an empty result.
    """
    return near_rows(docs, k, percent, miss).drop("text_md5")
