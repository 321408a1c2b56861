"""Contiguous byte-balanced shards from global prefix sums (DataFrame functions only).

1. Rows are range partitioned by (id, position) and written once with the number
   of their block; only narrow columns travel, never the text.
2. Per-block totals (one row a block) are summed up over the blocks in order.
3. A running sum within each block plus the block's offset is the global prefix
   sum; the middle of a row's byte interval falls into one of the equal targets,
   which is its shard. A shard's bytes thus differ from the target by at most one
   row's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docprep.llm.common import materialise

SHARDS = 40
OVERHEAD = 16
BLOCK_ROWS = 500_000


def sized(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", overhead: int = OVERHEAD) -> DataFrame:
    """``(doc_id, size, text_crc32)``: UTF-8 bytes plus overhead, unsigned CRC-32 of the bytes (null text: none)."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary"))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(overhead)).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )


def assign_shards(rows: DataFrame, shards: int = SHARDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows(doc_id, size, ...)`` -> the same columns plus ``shard`` and ``slot``.

    Shards are contiguous in doc_id order (nulls first; rows of one doc_id in
    input order), their bytes near equal; slot counts from 0 in each shard
    without gaps. Sizes must not be negative. A row larger than a target takes
    its shard alone and may leave others empty. An empty table gives no rows.
    """
    kept = rows.columns
    spark = rows.sparkSession
    # the position in the input breaks ties, so a doc_id that holds many rows is cut as well
    placed = materialise(rows.withColumn("__pos", F.monotonically_increasing_id()), "rows")
    blocks = max(spark.sparkContext.defaultParallelism, -(-placed.count() // block_rows))
    ranged = placed.repartitionByRange(blocks, F.col("doc_id").asc_nulls_first(), "__pos")
    # the block number is written with the row: later steps do not depend on how Spark deals partitions out
    ranged = materialise(ranged.withColumn("__block", F.spark_partition_id()), "blocks")
    totals = ranged.groupBy("__block").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    every = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "__block",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("__bytes0"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n0"),
        F.sum("bytes").over(every).alias("__total"),
    )
    totals = materialise(totals, "totals")
    w = Window.partitionBy("__block").orderBy(F.col("doc_id").asc_nulls_first(), "__pos").rowsBetween(Window.unboundedPreceding, 0)
    prefix = ranged.select("*", F.sum("size").over(w).alias("__end"), F.count(F.lit(1)).over(w).alias("__rank"))
    prefix = prefix.join(F.broadcast(totals), "__block")  # one row a block of block_rows rows
    middle = F.expr(f"((2 * (__bytes0 + __end) - size) * {int(shards)}) div greatest(2 * __total, 1)")
    prefix = materialise(
        prefix.select(*kept, F.least(middle, F.lit(shards - 1)).cast("int").alias("shard"), (F.col("__n0") + F.col("__rank") - 1).alias("__row")),
        "prefix",
    )
    first = prefix.groupBy("shard").agg(F.min("__row").alias("__first"))
    out = prefix.join(F.broadcast(first), "shard")  # one row a shard
    return out.select(*kept, "shard", (F.col("__row") - F.col("__first")).alias("slot"))
