"""Contiguous shards of near-equal size from global prefix sums of sizes (DataFrame functions only).

Rows are dealt into order buckets by id; the totals of the buckets (one row each, bounded by their number) give
every bucket its global offset, and a running sum inside each bucket gives every row its offset. A row goes to the
shard in which its first byte lies when the whole is cut at equal targets, so a shard is off its target by less
than one row at either end. The cut follows sizes alone, so equal texts may lie in different shards (law `bytes`).

Defined results: an empty table gives no rows; a text of any length is one row of its size; null ids come first; rows that share an id are ordered by size, checksum and hash of the text,
after which they are alike; a null text has size 1 (0 bytes plus 1) and checksum 0; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, n_buckets, order_bounds


def shard_by_bytes(documents: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, text_hash, start (bytes before the row), shard, slot (from 0 within the shard)."""
    spark = documents.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = documents.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("text_hash"),
    )
    bounds = order_bounds(documents.select(F.col(key).cast("long").alias("doc_id")), "doc_id", n_buckets(spark))
    rows = rows.withColumn("bucket", bucket_of(F.col("doc_id"), bounds))
    order = [F.col("doc_id").asc_nulls_first(), "size", "text_crc32", "text_hash"]
    totals = rows.groupBy("bucket").agg(F.sum("size").alias("bytes"))
    every = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each bucket
    bases = totals.select("bucket", F.coalesce(F.sum("bytes").over(every), F.lit(0)).alias("base"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("bucket").orderBy(*order)
    within = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = rows.select("*", within.alias("within"), F.row_number().over(inside).alias("rank")).join(F.broadcast(bases), "bucket")
    placed = placed.withColumn("start", F.col("base") + F.col("within")).withColumn("shard", F.expr(f"cast(least({shards - 1}, start * {shards} div total) as int)"))
    # slot: the rank within the bucket and shard, plus the rows of that shard in earlier buckets
    pieces = placed.groupBy("shard", "bucket").agg(F.count("*").alias("rows"), F.min("rank").alias("first"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("shard", "bucket", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("earlier"))
    out = placed.join(F.broadcast(pieces), ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", "text_hash", "start", "shard", (F.col("rank") - F.col("first") + F.col("earlier")).cast("long").alias("slot"))
