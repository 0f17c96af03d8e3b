"""Contiguous shards of equal byte size from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.components import stored

ROW_BYTES = 16


def _running(batches) -> Iterator[pa.RecordBatch]:
    """Bytes and rows before each row of its partition."""
    bytes_before = rows_before = 0
    for batch in batches:
        size = batch.column("size").to_numpy()
        ends = bytes_before + np.cumsum(size)
        place = rows_before + np.arange(len(size))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(ends - size), pa.array(place)], [*batch.schema.names, "bytes_before", "rows_before"])
        if len(size):
            bytes_before, rows_before = int(ends[-1]), rows_before + len(size)


def byte_shards(docs: DataFrame, shards: int = 40, order: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    Rows stand in the order of ``doc_id`` (then checksum and size). Per-partition totals give
    every row its global byte offset; a row goes to the shard whose equal share of all bytes
    holds the row's middle. So shards are contiguous, and their sizes differ by less than two
    of the largest rows. ``slot`` counts the rows of a shard from 0. Only the slim columns are
    shuffled; one number per partition is joined back.

    A null text has no bytes and the checksum of an empty text; equal and repeated rows are
    placed one after another; a null id comes first; other columns are ignored. An empty table
    gives an empty result; with fewer rows than shards some shards stay empty.
    """
    slim = docs.select(
        F.col(order).cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint") + ROW_BYTES).alias("size"),
        F.coalesce(F.crc32(F.col(text)), F.lit(0)).cast("bigint").alias("text_crc32"))
    keys = ["doc_id", "text_crc32", "size"]
    ranged = slim.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = ranged.withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33))
    rows = stored(ranged.mapInArrow(
        _running, "doc_id bigint, size bigint, text_crc32 bigint, part bigint, bytes_before bigint, rows_before bigint"), "sizes")
    parts = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    starts, all_bytes, all_rows = [], 0, 0
    for p in parts:
        starts.append((p["part"], all_bytes, all_rows))
        all_bytes, all_rows = all_bytes + p["bytes"], all_rows + p["n"]
    bases = docs.sparkSession.createDataFrame(starts, "part bigint, byte_base bigint, row_base bigint")
    middle = (F.col("byte_base") + F.col("bytes_before")) * 2 + F.col("size")
    placed = rows.join(F.broadcast(bases), "part").select(
        "doc_id", "size", "text_crc32", (F.col("row_base") + F.col("rows_before")).alias("at"),
        F.expr("bigint(0)").alias("zero") if not all_bytes else
        F.floor(middle.cast("decimal(38,0)") * shards / F.lit(2 * all_bytes).cast("decimal(38,0)")).cast("int").alias("shard"))
    if not all_bytes:
        placed = placed.withColumn("shard", F.lit(0)).drop("zero")
    firsts = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
