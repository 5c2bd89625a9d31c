"""A keyed table in a folder that feeds change in place (SNK-1 as a stored table).

The table is partitioned by ``bucket``, a hash of the key. A feed reads the buckets that its keys fall into and
no others, merges there, writes the merged rows to the shared scratch folder and then replaces exactly these
partitions (dynamic partition overwrite). So a feed costs what it touches, files of other buckets stay as they are,
and a feed that is lost on the way is run again: merging the same changes twice gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.catalog import upsert
from shelfspark.session import cut_lineage

#: Buckets of a table; the same number for all its feeds. A bucket is what one task merges.
BUCKETS = 256


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int").alias("bucket")


def _write(rows: DataFrame, folder: str, mode: str) -> None:
    (rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", mode)
     .partitionBy("bucket").parquet(folder))


def write_table(rows: DataFrame, folder: str, key: str = "path", buckets: int = BUCKETS) -> None:
    """Rows with a key as a new table."""
    _write(rows.where(F.col(key).isNotNull()).select("*", _bucket(key, buckets)), folder, "static")


def read_table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).drop("bucket")


def merge_feed(spark: SparkSession, folder: str, feed: DataFrame, key: str = "path", buckets: int = BUCKETS,
               merge: Callable[[DataFrame, DataFrame], DataFrame] = upsert) -> int:
    """Apply a feed to the table: ``merge(rows, changes)`` gives the new rows of the touched buckets (by default
    an upsert by ``path``, in ``seq`` order). Changes without a key are left out. Returns the buckets rewritten."""
    changes = feed.where(F.col(key).isNotNull())
    touched = [r[0] for r in changes.select(_bucket(key, buckets)).distinct().collect()]  # at most ``buckets``
    if not touched:
        return 0
    table = spark.read.parquet(folder)
    merged = merge(table.where(F.col("bucket").isin(touched)).drop("bucket"), changes)
    merged = cut_lineage(merged.select(*[F.col(c) for c in table.columns if c != "bucket"], _bucket(key, buckets)), "merged-buckets")
    _write(merged, folder, "dynamic")
    return len(touched)
