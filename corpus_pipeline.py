"""The corpus pipeline: language, repeated lines, near duplicates, benchmark leaks, packing.

Every stage is written as Parquet in the shared folder and reread; all but the last keep the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.components import stored
from sluice.llm.decontaminate import contaminated
from sluice.llm.language import NO_LANGUAGE, fit, held_out, identify
from sluice.llm.line_dedup import dedup_lines
from sluice.llm.minhash_dedup import near_rows
from sluice.llm.packing import pack
from sluice.session import use_utc

LEADING_SHARE = 0.5


def _kept(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id stands in ``ids (doc_id)``, whatever other columns are called."""
    wanted = ids.select("doc_id").distinct().alias("w")
    return docs.alias("d").join(wanted, F.col("d.doc_id") == F.col("w.doc_id"), "left_semi")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letters), or whose leading language fills less than half
    of them, go. Null ids cannot be followed through the stages and go here."""
    found = identify(docs, fit(docs, ~held_out(4, 2)))
    return _kept(docs, found.filter((F.col("lang_pred") != NO_LANGUAGE) & (F.col("score") >= LEADING_SHARE)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document holds go; a document left without text goes, and
    one that came without text. ``n_chars`` follows the text where there is such a column."""
    freed = dedup_lines(docs).filter("trim(text) <> ''")
    if "n_chars" in docs.columns:
        freed = freed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return freed.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays. Of rows equal in id and text the one
    with the least other columns stays; different texts under one id are different documents."""
    chosen = near_rows(docs).filter("kept").select("doc_id", F.coalesce("text_md5", F.lit("")).alias("_md5")).distinct()
    return _least_rows(docs, chosen)


def _least_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Of the rows in ``chosen (doc_id, _md5)`` one for each id and text. The grouping keeps the join's dealing, so
    texts are dealt out once."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    marked = docs.select("doc_id", "text", F.struct(*rest).alias("_rest") if rest else F.lit(0).alias("_rest"),
                         F.coalesce(F.md5("text"), F.lit("")).alias("_md5"))
    kept = marked.join(chosen, ["doc_id", "_md5"], "left_semi")
    least = kept.groupBy("doc_id", "_md5", "text").agg(F.min("_rest").alias("_rest"))
    return least.select(*[F.col(c if c in ("doc_id", "text") else f"_rest.`{c}`") for c in docs.columns])


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _kept(docs, contaminated(docs, items).filter("not contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return pack(docs)


STAGES = [("language", language), ("line_dedup", lines), ("near_dedup", near_copies),
          ("decontamination", benchmark), ("packing", packing)]

#: The stages learn models and follow components; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = use_utc(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
