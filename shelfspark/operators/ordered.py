"""Exact per-key ranks without a per-key window.

Ordered folds (learning, throttling) must process a key's events in order, and
one key may hold a third of all rows. ``ranked_within`` range-partitions by
(key, order) so a hot key spans many partitions, numbers rows inside each
(partition, key) group, and adds the counts of the key's earlier partitions — a
table of at most partitions x keys rows. Callers then fold bounded chunks of
ranks in rounds, carrying a small state between them. The partition ids are
materialised once (see ``prefix_sum_within``) so every branch reads the same ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import cut_lineage


def prefix_sum_within(df: DataFrame, key_cols: list[str], order_cols: list[str], value_col: str | None,
                      out_col: str, partitions: int = 0) -> DataFrame:
    """Adds ``out_col``: the running sum of ``value_col`` (or the running row count when
    it is None) within each key in ``order_cols`` order, current row included. Rows
    equal on (key, order) land in the same range partition, so ties stay consistent."""
    n = partitions or max(df.sparkSession.sparkContext.defaultParallelism * 4, 8)
    v = F.lit(1) if value_col is None else F.col(value_col)
    # the partition id is read by two branches below; it is only stable if both read
    # the same physical partitions (AQE may give one branch a local shuffle reader),
    # so the range-partitioned rows are written once with their id and read back
    r = cut_lineage(df.withColumn("_v", v).repartitionByRange(n, *key_cols, *order_cols)
                    .withColumn("_pid", F.spark_partition_id()), "prefix-sum")
    local = Window.partitionBy("_pid", *key_cols).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_local", F.sum("_v").over(local))
    sums = r.groupBy("_pid", *key_cols).agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*key_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_off", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    return (r.join(offsets, ["_pid", *key_cols])
            .withColumn(out_col, F.col("_off") + F.col("_local")).drop("_pid", "_local", "_off", "_v"))


def ranked_within(df: DataFrame, key_cols: list[str], order_cols: list[str], partitions: int = 0,
                  rank_col: str = "_rank") -> DataFrame:
    """Adds ``rank_col``: 1-based position of each row within its key in ``order_cols``
    order (``order_cols`` must be unique within a key)."""
    return prefix_sum_within(df, key_cols, order_cols, None, rank_col, partitions)
