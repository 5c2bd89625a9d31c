"""Operator 2: contiguous balanced shards from global byte-size prefix sums.

Rows stand in the order of their identifier. They are dealt by range, each range is summed
on its own, the (few) totals of the ranges are summed up, and every row then knows the bytes
before it in the whole table. The line of all bytes is cut at equal targets.

Cases: a null text counts no bytes and has the checksum of the empty string; null identifiers
stand first; repeated rows keep a place each; an empty table gives no rows; one row larger
than a shard's target takes a shard and may leave neighbours without rows; only the named
columns are read, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import read
from shelfspark.session import cut_lineage

SHARDS = 40
#: Bytes of a record beside its text.
RECORD_BYTES = 16


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, record_bytes: int = RECORD_BYTES,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard (0 to ``shards`` - 1), slot (place
    in the shard, gapless from 0), start (bytes before it in the whole table). The middle byte
    of a document decides its shard, so a shard's size is off its target by at most one
    document at either end. DataFrame functions only; texts never leave the scan."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + record_bytes).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"))
    order = ["doc_id", "size", "text_crc32"]
    # both the totals and the rows below must see the same ranges: written once, narrow
    ranged = cut_lineage(rows.repartitionByRange(*order).withColumn("range_id", F.spark_partition_id()), "shard-ranges")
    before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = (ranged.groupBy("range_id").agg(F.sum("size").alias("range_bytes"), F.count(F.lit(1)).alias("range_rows"))
               .select("range_id",
                       F.coalesce(F.sum("range_bytes").over(before), F.lit(0)).alias("bytes_before"),
                       F.coalesce(F.sum("range_rows").over(before), F.lit(0)).alias("rows_before"),
                       F.sum("range_bytes").over(Window.orderBy("range_id").rowsBetween(
                           Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_bytes")))
    inside = Window.partitionBy("range_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = (ranged.join(F.broadcast(offsets), "range_id")  # as many rows as the exchange had partitions
              .withColumn("start", F.col("bytes_before") + F.sum("size").over(inside) - F.col("size"))
              .withColumn("place", F.col("rows_before") + F.row_number().over(
                  Window.partitionBy("range_id").orderBy(*order)) - 1)
              .withColumn("shard", F.expr(f"cast((2 * start + size) * {shards} div (2 * all_bytes) as int)")))
    first = placed.groupBy("shard").agg(F.min("place").alias("first_place"))  # at most ``shards`` rows
    return (placed.join(F.broadcast(first), "shard")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first_place")).alias("slot"),
                    "start"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
