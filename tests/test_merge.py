"""Feeds into a stored table."""

import os

from pyspark.sql import functions as F

from shelfspark.operators import merge as M
from shelfspark.operators.catalog import upsert

FILES = "path string, category string, importance double, starred boolean, view_count long"


def _files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    folder = str(tmp_path / "table")
    rows = spark.createDataFrame([(f"p{i}", "学习", i / 100, False, i) for i in range(400)], FILES)
    M.write_table(rows, folder, buckets=16)
    before = _files(folder)
    feed = spark.createDataFrame([("p3", 1, None, 0.9), ("p3", 2, "任务", None), ("new", 3, None, None), (None, 4, "x", None)],
                                 "path string, seq long, category string, importance double")
    n = M.merge_feed(spark, folder, feed, buckets=16)
    after = _files(folder)
    kept = before.keys() & after.keys()
    assert n in (1, 2) and len(kept) == len(before) - n == 16 - n
    assert all(before[f] == after[f] for f in kept)
    want = upsert(rows, feed.where("path is not null"))
    assert sorted(map(str, M.read_table(spark, folder).collect())) == sorted(map(str, want.collect()))
    # a feed that is run again, and one without changes
    M.merge_feed(spark, folder, feed, buckets=16)
    assert sorted(map(str, M.read_table(spark, folder).collect())) == sorted(map(str, want.collect()))
    now = _files(folder)
    assert M.merge_feed(spark, folder, feed.limit(0), buckets=16) == 0 and _files(folder) == now


def test_other_merges(spark, tmp_path):
    folder = str(tmp_path / "table")
    M.write_table(spark.createDataFrame([("a", 1), ("b", 2)], "path string, n long"), folder, buckets=4)
    add = lambda rows, changes: rows.unionByName(changes).groupBy("path").agg(F.sum("n").alias("n"))
    M.merge_feed(spark, folder, spark.createDataFrame([("b", 5), ("c", 1), ("c", 1)], "path string, n long"), buckets=4, merge=add)
    assert sorted(map(tuple, M.read_table(spark, folder).collect())) == [("a", 1), ("b", 7), ("c", 2)]
