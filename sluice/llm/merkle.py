"""Merkle manifest of a data set: a content-addressed store of digest-to-children records, and
proofs read from it by descending from the root along the digits of a leaf's rank.

Leaves of one group (``lang``) stand in the order of their ids; every ``WIDTH`` consecutive nodes
become one, level by level, down to the group's root; the group roots, in the order of the
groups, are the leaves of the top tree. Requests that share a part of their way travel it as one
row: the rows of a level are its nodes, not the leaves below them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.components import stored

WIDTH, BITS, BUNDLE = 8, 3, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(**changed: Column) -> Column:
    """The digest of a row; ``changed`` replaces columns."""
    return F.sha2(F.concat(*[_field(changed.get(c, F.col(c))) for c in LEAF_COLUMNS]), 256)


def ranked(df: DataFrame, groups: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rank`` of every row in its group, from 0, by a range partitioning: a group of any size is
    spread over partitions, and one number per partition and group gives the rows before it."""
    keys = [*groups, *order]
    place = F.monotonically_increasing_id()
    rows = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "*", F.shiftright(place, 33).alias("_part"), place.bitwiseAND((1 << 33) - 1).alias("_pos")), "ranked")
    parts = rows.groupBy("_part", *groups).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    named = parts.select(*[F.col(c).alias(f"{c}__p") for c in parts.columns])
    same = F.col("_part") == F.col("_part__p")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}__p"))
    return rows.join(named, same).select(*df.columns, (F.col("_pos") - F.col("_first__p") + F.col("_base__p")).alias("rank"))


@dataclass
class Forest:
    """``records (level, digest, children)`` and ``roots (tree, height, digest)``."""

    records: DataFrame
    roots: DataFrame
    height: int


def _parents(children: Column) -> Column:
    """Runs of ``WIDTH`` consecutive digests."""
    last = F.floor((F.size(children) - 1) / WIDTH).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(children, i * WIDTH + 1, WIDTH))


def _joined(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def grow(leaves: DataFrame) -> Forest:
    """The trees over ``leaves (tree, idx, digest)``.

    A pass shuffles the nodes of one level once and makes ``BUNDLE`` levels of records from them,
    so a pass handles an eighth of an eighth of an eighth of the rows of the pass before it.
    """
    spark = leaves.sparkSession
    sizes = leaves.groupBy("tree").agg(F.max("idx").alias("last"))
    height, bound = F.lit(0), 1
    for level in range(1, 21):
        height, bound = F.when(F.col("last") >= bound, level).otherwise(height), bound * WIDTH
    sizes = stored(sizes.select("tree", height.alias("height")), "tree-heights")
    top = sizes.agg(F.max("height")).first()[0] or 0
    nodes = leaves.select("tree", "idx", "digest")
    records, roots = [], [nodes.join(sizes.filter("height = 0"), "tree").select("tree", "height", "digest")]
    for level in range(0, top, BUNDLE):
        runs = nodes.groupBy("tree", F.shiftright("idx", BITS * BUNDLE).alias("idx")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"]).alias("c0"))
        runs = runs.join(sizes.filter(f"height > {level}"), "tree")
        for step in range(BUNDLE):
            # A tree that has reached its root has one node and no further records.
            more = F.col("height") > level + step
            runs = runs.withColumn(f"g{step}", F.when(more, _parents(F.col(f"c{step}"))))
            runs = runs.withColumn(f"c{step + 1}", F.coalesce(F.transform(f"g{step}", _joined), F.col(f"c{step}")))
        built = stored(runs.select("tree", "idx", "height", *[f"g{s}" for s in range(BUNDLE)],
                                   F.col(f"c{BUNDLE}")[0].alias("digest")), "merkle")
        for step in range(BUNDLE):
            each = built.select(F.explode(f"g{step}").alias("children"))
            records.append(each.select(F.lit(level + step + 1).alias("level"), _joined(F.col("children")).alias("digest"), "children"))
        roots.append(built.filter(f"height <= {level + BUNDLE}").select("tree", "height", "digest"))
        nodes = built.filter(f"height > {level + BUNDLE}").select("tree", "idx", "digest")
    none = spark.createDataFrame([], "level int, digest string, children array<string>")
    records, roots = [x if x else [none] for x in (records, roots)]
    union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].unionByName(parts[1]), *parts[2:]])
    return Forest(union(records), union(roots), top)


def _masks(asked: DataFrame, height: int) -> dict[int, DataFrame]:
    """For each level the nodes on the way to ``asked (tree, idx)`` and which children are asked for."""
    masks = {}
    for level in range(1, height + 1):
        asked = asked.groupBy("tree", F.shiftright("idx", BITS).alias("idx")).agg(
            F.bit_or(F.expr(f"shiftleft(1, int(idx & {WIDTH - 1}))")).alias("mask"))
        masks[level] = asked
        asked = asked.select("tree", "idx")
    return masks


def _segment(children: Column, digit: Column) -> Column:
    """The children that were not selected: those before and those after it, each joined."""
    return F.struct(F.array_join(F.slice(children, F.lit(1), digit), "").alias("before"),
                    F.array_join(F.slice(children, digit + 2, F.lit(WIDTH)), "").alias("after"))


def _at(forest: Forest, level: int) -> DataFrame:
    """The store's records of one level, each digest once."""
    return forest.records.filter(F.col("level") == level).select("digest", "children").dropDuplicates(["digest"])


def descend(forest: Forest, starts: DataFrame, asked: DataFrame, stop: int) -> DataFrame:
    """From the roots ``starts (tree, height, digest, path)`` towards the nodes ``asked (tree, idx)`` of
    level ``stop``: ``tree, idx, digest, path`` with the siblings met, the root's first."""
    masks = _masks(asked, forest.height - stop)
    front = None
    for level in range(forest.height, stop - 1, -1):
        entering = starts.filter(F.col("height") == level).select("tree", F.lit(0).cast("bigint").alias("idx"), "digest", "path")
        front = entering if front is None else front.unionByName(entering)
        if level == stop:
            break
        met = front.join(_at(forest, level), "digest").join(masks[level - stop], ["tree", "idx"])
        chosen = met.select("tree", "idx", "path", "children", "mask", F.posexplode("children").alias("digit", "child"))
        front = chosen.filter("(mask & shiftleft(1, digit)) <> 0").select(
            "tree", (F.col("idx") * WIDTH + F.col("digit")).alias("idx"), F.col("child").alias("digest"),
            F.concat("path", F.array(_segment(F.col("children"), F.col("digit")))).alias("path"))
    return front


def manifest_proofs(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row.

    ``tampered`` names the rows whose text is lower-cased (A-Z) before they are checked; by default those
    whose decimal id has a CRC-32 that 3 divides. The way from the leaf up folds the leaf found now with
    the siblings of the stored proof, which the descent collected from the root down and which are read in
    reverse.

    Nulls enter a leaf as ``-``; a null id stands first and is not tampered with, a null group is a group
    of its own and the first. Rows of equal id stand in the order of their digests, equal rows are equal
    leaves one after another. A group of one row has its leaf as root; an empty table gives an empty
    result. Other columns are ignored. Only digests and ids are shuffled, never texts.
    """
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0 if tampered is None else tampered
    lowered = leaf_digest(text=F.translate("text", UPPER, LOWER))
    rows = stored(docs.select("doc_id", "lang", leaf_digest().alias("leaf"), F.when(changed, lowered).alias("found")), "leaves")
    rows = ranked(rows, ["lang"], ["doc_id", "leaf"])
    groups = ranked(rows.select("lang").distinct(), [], ["lang"]).select(F.col("lang").alias("_lang"), F.col("rank").alias("tree"))
    rows = stored(rows.join(groups, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")
                  .withColumnRenamed("rank", "idx"), "leaves")

    below = grow(rows.select("tree", "idx", F.col("leaf").alias("digest")))
    subroots = stored(below.roots, "subroots")
    # Stored, so that the planner cannot fold the one tree's number and join without a key.
    asked_groups = stored(subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("idx"), "digest"), "top-leaves")
    above = grow(asked_groups)
    roots = above.roots.withColumn("path", F.expr(f"cast(array() as {PATH})"))
    top = above.roots.first()  # the top tree has one root, none if there are no rows
    root = F.lit(top["digest"] if top else None).cast("string")

    entry = descend(above, roots, asked_groups.select("tree", "idx"), 0).select(F.col("idx").alias("tree"), "digest", "path")
    starts = stored(entry.join(subroots.select("tree", "height"), "tree"), "entries")

    # The last step takes all asked leaves of a lowest node together, so a path travels once for them.
    asked = rows.groupBy("tree", F.shiftright("idx", BITS).alias("idx")).agg(
        F.collect_list(F.struct((F.col("idx") % WIDTH).cast("int").alias("digit"), "doc_id", "lang", "leaf", "found")).alias("asks"))
    if below.height:
        lowest = descend(below, starts, asked.select("tree", "idx"), 1).join(_at(below, 1), "digest")
    else:
        lowest = starts.limit(0).select("digest", "tree", F.lit(0).cast("bigint").alias("idx"), "path",
                                        F.expr("cast(array() as array<string>)").alias("children"))
    single = starts.filter("height = 0").select("digest", "tree", F.lit(0).cast("bigint").alias("idx"), "path",
                                                F.expr("cast(null as array<string>)").alias("children"))
    leaves = lowest.unionByName(single).join(asked, ["tree", "idx"]).select(
        "tree", "path", "children", F.explode("asks").alias("a")).select("tree", "a.*", F.reverse(F.when(
            F.col("children").isNull(), F.col("path")).otherwise(
            F.concat("path", F.array(_segment(F.col("children"), F.col("a.digit")))))).alias("way"))
    fold = F.aggregate("way", F.coalesce("found", "leaf"),
                       lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))
    proof = F.sha2(F.array_join(F.transform("way", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    done = leaves.select("tree", "doc_id", "lang", "leaf", proof.alias("proof_sha256"), fold.alias("folded_root"))
    named = subroots.select("tree", F.col("digest").alias("subroot"))
    return done.join(named, "tree").select(
        "doc_id", "lang", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
