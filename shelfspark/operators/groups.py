"""File grouping (GRP-1..5): stems -> greedy groups per directory.

The reference walks stems of one directory in order (file count desc, stem
length asc; ties by stem, V16) and gives each stem the files no earlier stem
took, if at least ``min_group_size`` remain. The parallel form used here is
exactly equal: per round, every stem whose remaining files all have it as their
best-ranked remaining stem wins them; stems with fewer than the minimum remaining
files are dropped (counts only shrink). The lowest-ranked stem always wins, so
every round makes progress. Each round is a few aggregates and joins (no window
over a directory, so a hot directory or stem is split across tasks), and its
remaining pairs are checkpointed to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark import constants as K
from shelfspark.functions.stems import (folder_name, group_confidence, has_version_word, stem_candidates,
                                        strategy_from_flags)
from shelfspark.functions.text import name_stem, name_suffix
from shelfspark.session import cut_lineage


def listing(files: DataFrame) -> DataFrame:
    """(directory, path, name) of non-hidden files."""
    return files.select("directory", "path", F.col("original_name").alias("name")).filter(~F.col("name").startswith("."))


def stem_index(files: DataFrame) -> DataFrame:
    """GRP-1: (directory, stem, path) for every candidate stem of every file."""
    return listing(files).select("directory", "path",
                                 F.explode(stem_candidates(name_stem(F.col("name")))).alias("stem"))


def ranked_pairs(files: DataFrame, min_group_size: int = K.MIN_GROUP_SIZE) -> DataFrame:
    """(directory, stem, n, rank, path): ``rank`` is the struct (-file count, stem length,
    stem), the per-directory processing order. Stems below the minimum never form a group."""
    idx = stem_index(files)
    counts = idx.groupBy("directory", "stem").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.filter(F.col("n") >= min_group_size)
    # the sort key itself is the rank: comparable with min(), no window over a directory
    ranks = counts.select("directory", "stem", "n",
                          F.struct((-F.col("n")).alias("neg_n"), F.length("stem").alias("len"),
                                   F.col("stem").alias("stem")).alias("rank"))
    return idx.join(ranks, ["directory", "stem"])


def greedy_assign(pairs: DataFrame, min_group_size: int = K.MIN_GROUP_SIZE,
                  checkpoint: bool = True) -> DataFrame:
    """GRP-2: (directory, stem, rank, path) of the files each group takes. Without ``checkpoint`` each round's
    rows are kept by the executors instead of written; the plan must not hold all rounds, which use one another
    several times, so it would grow with a power of their number."""
    def cut(df, name):
        return cut_lineage(df, name) if checkpoint else df.localCheckpoint()

    remaining = cut(pairs, "group-pairs")
    won = None
    while True:  # the lowest-ranked live stem always wins, so every round takes or drops pairs
        live = (remaining.groupBy("directory", "stem").agg(F.count(F.lit(1)).alias("n"))
                .filter(F.col("n") >= min_group_size).select("directory", "stem"))
        lp = remaining.join(live, ["directory", "stem"], "left_semi")
        best = lp.groupBy("directory", "path").agg(F.min("rank").alias("best"))
        flagged = lp.join(best, ["directory", "path"]).withColumn("is_best", F.col("rank") == F.col("best"))
        winners = (flagged.groupBy("directory", "stem").agg(F.min(F.col("is_best").cast("int")).alias("all_best"))
                   .filter(F.col("all_best") == 1).select("directory", "stem"))
        taken = flagged.join(winners, ["directory", "stem"], "left_semi").select("directory", "stem", "n", "rank",
                                                                                 "path")
        taken = cut(taken, "group-taken")
        won = taken if won is None else won.unionByName(taken)
        remaining = cut(lp.join(taken.select("directory", "path"), ["directory", "path"], "left_anti"), "group-remaining")
        if not remaining.head(1):
            break
    return won


def group_members(files: DataFrame, min_group_size: int = K.MIN_GROUP_SIZE, checkpoint: bool = True) -> DataFrame:
    """GRP-2: (directory, stem, stem_files, path) — which group each grouped file joins."""
    lst = listing(files)
    dirs = lst.groupBy("directory").agg(F.count(F.lit(1)).alias("total"))
    ok_dirs = dirs.filter(F.col("total") >= min_group_size).select("directory")
    pairs = ranked_pairs(files.join(ok_dirs, "directory", "left_semi"), min_group_size)
    taken = greedy_assign(pairs, min_group_size, checkpoint)
    return taken.select("directory", "stem", F.col("n").alias("stem_files"), "path")


def file_groups(files: DataFrame, min_group_size: int = K.MIN_GROUP_SIZE, checkpoint: bool = True,
                members: DataFrame | None = None) -> DataFrame:
    """GRP-2..4: one row per group: directory, stem, stem_files (files carrying the stem;
    groups were formed in order stem_files desc, stem length, stem), suggested_folder,
    strategy, file_count, confidence. Membership stays a table (``group_members``):
    every per-group value is an aggregate, so a group holding a third of all files
    is still reduced in parallel (partial aggregates) and never collected."""
    m = members if members is not None else group_members(files, min_group_size, checkpoint)
    named = m.join(listing(files).select("directory", "path", "name"), ["directory", "path"])
    low = F.lower(name_stem(F.col("name")))
    g = named.groupBy("directory", "stem", "stem_files").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.countDistinct(name_suffix(F.col("name"))).alias("_n_ext"),
        F.max(low.rlike(r"(?U)\d{2,}")).alias("_num"),
        F.max(has_version_word(low)).alias("_ver"))
    return g.select("directory", "stem", "stem_files", folder_name(F.col("stem")).alias("suggested_folder"),
                    strategy_from_flags("_n_ext", "_num", "_ver").alias("strategy"), "file_count",
                    group_confidence(F.col("file_count")).alias("confidence"))


def group_summary(files: DataFrame, members: DataFrame, min_group_size: int = K.MIN_GROUP_SIZE,
                  cap: int = K.UNGROUPED_LIST_CAP) -> DataFrame:
    """GRP-5: per directory total, grouped and ungrouped counts and the first ``cap``
    ungrouped files (by path). Directories below the minimum get status 'no_groups'."""
    lst = listing(files)
    grouped = members.select("directory", "path")
    ungrouped = lst.join(grouped, ["directory", "path"], "left_anti")
    w = Window.partitionBy("directory").orderBy("path")
    first = (ungrouped.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= cap)
             .groupBy("directory").agg(F.array_sort(F.collect_list("path")).alias("ungrouped_files")))
    tot = lst.groupBy("directory").agg(F.count(F.lit(1)).alias("total_files"))
    gc = grouped.groupBy("directory").agg(F.count(F.lit(1)).alias("grouped_count"))
    out = tot.join(gc, "directory", "left").join(first, "directory", "left")
    return out.select("directory", "total_files",
                      F.coalesce("grouped_count", F.lit(0).cast("bigint")).alias("grouped_count"),
                      (F.col("total_files") - F.coalesce("grouped_count", F.lit(0))).alias("ungrouped_count"),
                      F.coalesce("ungrouped_files", F.array().cast("array<string>")).alias("ungrouped_files"),
                      F.when(F.col("total_files") < min_group_size, F.lit("no_groups")).otherwise(F.lit("ok"))
                      .alias("status"))
