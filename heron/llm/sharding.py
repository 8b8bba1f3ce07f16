"""Contiguous shards of near-equal bytes from global prefix sums.

The documents are dealt to partitions by ranges of doc_id. Each partition's total of bytes and rows gives, summed over
the partitions before it, the place where it starts in the whole; inside a partition a running sum does the rest. A
document goes to the shard in whose equal share of all bytes its middle byte falls, so shards are contiguous in doc_id
and each is within one document's size of its share.

Only sizes, never texts, are shuffled (but for write_shards, which moves the rows to their shards). The totals, one row a partition, are the only thing summed in one place.

Cases: a null text has no bytes, size 1 and CRC 0; equal or null doc_ids (nulls first) keep a fixed order by CRC, size
and place in the input; an empty table gives an empty result; other columns are kept apart and never read; a document
larger than a share takes its shard for itself and leaves others empty; a text of any length is measured whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def _sized(docs: DataFrame, keep: bool) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if keep else []),
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_place"),
    )


def shard_documents(docs: DataFrame, shards: int = 8, keep: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (from 0 in each shard), grown_shard (null: cuts by bytes move when a
    shard is added), first_byte (the bytes of all documents before it). `keep` adds the whole row as a struct, doc."""
    order = [F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "_place"]
    # Written, so that every later step sees the same ranges.
    dealt = written(_sized(docs, keep).repartitionByRange("doc_id", "text_crc32", "size", "_place").withColumn("_part", F.spark_partition_id()), "sizes")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    starts = totals.select(
        "_part",
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("b").over(Window.partitionBy(F.lit(1))).alias("_all"),
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    placed = (
        dealt.withColumn("_end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_row", F.row_number().over(inside.rowsBetween(Window.unboundedPreceding, 0)) - 1)
        .join(F.broadcast(starts), "_part")  # a row for each partition
        .withColumn("first_byte", F.expr("_bytes_before + _end - size"))
        # 2 * middle / all, in decimals: 16 times the bytes of a large corpus would pass a long
        .withColumn("shard", F.least(F.floor((F.col("first_byte").cast("decimal(20,0)") * 2 + F.col("size")) * shards / (F.col("_all").cast("decimal(20,0)") * 2)), F.lit(shards - 1)).cast("int"))
        .withColumn("_at", F.expr("_rows_before + _row"))
    )
    # Where each shard begins: the rows of the shards before it, a row a shard.
    counts = placed.groupBy("shard").agg(F.min("_at").alias("_first"))
    return placed.join(F.broadcast(counts), "shard").select(
        "doc_id", "size", "text_crc32", *(["doc"] if keep else []), F.lit("bytes").alias("law"), "shard", (F.col("_at") - F.col("_first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("first_byte").cast("long")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """The documents as Parquet (slot, doc), one folder a shard, sorted by slot in each file."""
    placed = shard_documents(docs, shards, keep=True).select("shard", "slot", "doc")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
