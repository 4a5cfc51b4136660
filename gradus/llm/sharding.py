"""Sharding by global prefix sums of byte sizes.

Rows are dealt into ranges of their order key and each range's totals are summed; the running sums
of the totals place every range on one line of bytes, a running sum inside the range places every
row, and cuts at equal targets give contiguous shards of near equal bytes. Only the totals, one row
per range, are ever ordered as a whole; ranges are written before they are read again, so a lost
executor cannot deal them differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, text_of

SHARDS = 16


def _placed(rows: DataFrame, n_ranges: int, scratch: Scratch) -> DataFrame:
    """rows (id columns, size) with ``start`` (bytes before it) and ``place`` (rows before it) in the order of doc_id."""
    # ids spread over many ranges even if a third of the rows shares one
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("row_id")]
    dealt = rows.repartitionByRange(n_ranges, *order).withColumn("range", F.spark_partition_id())
    dealt = scratch.stored(dealt, "ranges")
    totals = dealt.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "rows")))
    inside = W.partitionBy("range").orderBy(*order)
    here = inside.rowsBetween(W.unboundedPreceding, -1)
    # one row per range, as many as ``n_ranges``
    out = dealt.join(F.broadcast(totals), "range")
    out = out.withColumn("start", F.col("bytes_before") + F.coalesce(F.sum("size").over(here), F.lit(0)))
    return out.withColumn("place", F.col("rows_before") + F.row_number().over(inside) - 1)


def shards(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text) into one of ``n_shards`` contiguous shards of near equal bytes.

    A row's size is the UTF-8 bytes of its text plus one; null texts have none. Rows are ordered by
    doc_id (null last), then by the text's crc32, then as read; a row goes where the middle of its
    bytes lies, so a shard is off its target by less than one row at either end, and equal texts
    fall where their ids put them. Returns doc_id, size, text_crc32, law (``bytes``), shard, slot
    (position in the shard, gapless from 0), grown_shard (null under this law). Repeated rows are
    rows of their own. An empty table gives no rows. Runs its jobs when called; the result is a table in
    the shared folder.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
    )
    with Scratch(spark) as scratch:
        rows = scratch.kept(rows)
        n_ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
        placed = scratch.kept(_placed(rows, n_ranges, scratch).select("doc_id", "size", "text_crc32", "start", "place"))
        total = placed.agg((F.max(F.col("start") + F.col("size"))).alias("total"))
        # one row
        cut = placed.join(F.broadcast(total)).withColumn(
            "shard", F.least(F.lit(n_shards - 1), F.expr(f"cast((2 * start + size) * {n_shards} div (2 * total) as int)"))
        )
        # one row per shard
        firsts = cut.groupBy("shard").agg(F.min("place").alias("first"))
        out = cut.join(F.broadcast(firsts), "shard").select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
        )
        return scratch.stored(out, "shards", stays=True)
