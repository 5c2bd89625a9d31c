"""Organise / archive / group manifests (ORG-1..3, GRP-6/7).

Moving files is replaced by manifests (src, dst) that a mover applies; the
catalogue update is a path rewrite on the same row (V2).

Collision naming (ORG-2) in bulk: the candidates of a file are ``name, stem_1.suffix,
stem_2.suffix, ...``. Files whose stems differ only in such numbers at the end (``a``, ``a_1``,
``a_1_2``) form a group of their directory; names of different groups never meet. Groups are
folded in order, each by one task, which also settles names that a move leaves and clashes
inside the group, in one pass over all of them. A group too large for that is assigned by
distributed ranks: the k-th incoming file of a family (directory, stem, suffix) takes the k-th
free candidate, and clashes between its families are settled by further passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfspark import constants as K
from shelfspark.functions.stems import safe_folder_name
from shelfspark.functions.text import name_stem, path_name, path_parent
from shelfspark.operators.ordered import prefix_sum_within, ranked_within
from shelfspark.session import cut_lineage

VAULT = "vault"


def _split(name_col: str, split_suffix: bool):
    n = F.col(name_col)
    if not split_suffix:
        return n, F.lit("")
    sfx = F.regexp_extract(n, r"(?s)^.+(\.[^.]+)$", 1)
    return name_stem(n), sfx


def _family_members(existing: DataFrame, split_suffix: bool) -> DataFrame:
    """Existing (dir, name, gone) -> (dir, stem, suffix, n, gone) for the families it blocks:
    itself as n=0 and, if it looks like ``stem_N.suffix``, index N of that family."""
    stem, sfx = _split("name", split_suffix)
    base = existing.select("dir", stem.alias("stem"), sfx.alias("suffix"), F.lit(0).cast("bigint").alias("n"), "gone")
    numbered = existing.select("dir", stem.alias("_s"), sfx.alias("suffix"), "gone").filter(
        F.col("_s").rlike(r"(?s)^.*_[1-9][0-9]{0,17}$")).select(
        "dir", F.regexp_extract("_s", r"(?s)^(.*)_[1-9][0-9]{0,17}$", 1).alias("stem"), "suffix",
        F.regexp_extract("_s", r"_([1-9][0-9]{0,17})$", 1).try_cast("bigint").alias("n"), "gone"
        ).filter(F.col("n").isNotNull())
    return base.unionByName(numbered).distinct()


FAMILY = ["dir", "stem", "suffix"]
GROUP = ["dir", "root", "suffix"]
#: Most names, present and incoming, of a group that one task folds.
FOLD_ROWS = 200_000


def _grouped(rows: DataFrame, split_suffix: bool) -> DataFrame:
    """Adds stem, suffix and the group's root: the stem without numbers at its end."""
    stem, sfx = _split("name", split_suffix)
    return rows.withColumns({"stem": stem, "suffix": sfx}).withColumn("root", F.regexp_replace("stem", r"(?s)(_[1-9][0-9]{0,17})+$", ""))


def collision_names(existing: DataFrame, incoming: DataFrame, split_suffix: bool = True) -> DataFrame:
    """ORG-2. ``existing``: (dir, name) and, if some of them move away, ``gone``: the order of
    that move (null: stays; the name is free for later orders); ``incoming``: (order, dir,
    name) with a unique, totally ordered ``order``. Returns incoming with ``final_name``:
    the first name of ``name, stem_1.suffix, stem_2.suffix, ...`` not taken at its turn by
    an existing file or by an earlier incoming one — exactly the sequential result.

    One pass folds all groups of at most ``FOLD_ROWS`` names, however many clashes there are. Larger
    groups go through ``_large_groups``."""
    order_type = incoming.schema["order"].dataType
    none = F.lit(None)
    inc = _grouped(incoming.select("order", "dir", "name"), split_suffix)
    held = existing.select("dir", "name", (F.col("gone") if "gone" in existing.columns else none).cast(order_type).alias("gone"))
    held = _grouped(held, split_suffix).join(inc.select(*GROUP).distinct(), GROUP, "left_semi")
    rows = cut_lineage(inc.select(*GROUP, "stem", "name", "order", F.lit(False).alias("held"), none.cast(order_type).alias("gone"))
                       .unionByName(held.select(*GROUP, "stem", "name", none.cast(order_type).alias("order"), F.lit(True).alias("held"), "gone")),
                       "collision-names")
    large = cut_lineage(rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FOLD_ROWS).select(*GROUP), "large-groups")
    if large.isEmpty():
        return _folded(rows, order_type)
    rest = rows.join(large, GROUP, "left_semi")
    settled = _large_groups(rest.filter("held").select("dir", "name", "gone"), rest.filter("not held").select("order", "dir", "name"),
                            split_suffix, order_type, "gone" in existing.columns)
    return _folded(rows.join(large, GROUP, "left_anti"), order_type).unionByName(settled)


def _folded(rows: DataFrame, order_type) -> DataFrame:
    """Groups in order, one sorted scan per task that keeps the taken names of the current group. A name is
    index 0 of its own family and, if it ends in a number, that index of the family before it. At the
    same order a file's own name is still taken."""
    held = rows.filter("held")
    none = F.lit(None)
    events = (held.select(*GROUP, "stem", "name", F.lit(0).alias("step"), none.cast(order_type).alias("order"))
              .unionByName(rows.filter("not held").select(*GROUP, "stem", "name", F.lit(1).alias("step"), "order"))
              .unionByName(held.filter(F.col("gone").isNotNull()).select(*GROUP, "stem", "name", F.lit(2).alias("step"), F.col("gone").alias("order"))))
    dealt = events.repartition(*GROUP).sortWithinPartitions(*GROUP, F.col("order").asc_nulls_first(), "step")

    def run(batches):
        import heapq
        import re

        import pyarrow as pa
        number = re.compile(r"(?s)^(.*)_([1-9][0-9]{0,17})$").match
        group, taken, free, top = None, set(), {}, {}
        for batch in batches:
            at, finals = [], []
            for i, (d, root, sfx, stem, name, step) in enumerate(zip(*(batch.column(c).to_pylist() for c in [*GROUP, "stem", "name", "step"]))):
                if (d, root, sfx) != group:
                    group, taken, free, top = (d, root, sfx), set(), {}, {}
                if step == 0:
                    taken.add(name)
                elif step == 2:
                    taken.discard(name)
                    heapq.heappush(free.setdefault(stem, []), 0)
                    before = number(stem)
                    if before:  # may lie above the family's ``top``; it is then met twice and skipped
                        heapq.heappush(free.setdefault(before[1], []), int(before[2]))
                else:
                    def spelt(n):
                        return f"{stem}_{n}{sfx}" if n else name  # noqa: B023
                    again = free.get(stem, [])
                    while again and spelt(again[0]) in taken:
                        heapq.heappop(again)
                    n = top.get(stem, 0)
                    while spelt(n) in taken:
                        n += 1
                    top[stem] = n
                    final = spelt(min(n, again[0]) if again else n)
                    taken.add(final)
                    at.append(i)
                    finals.append(final)
            chosen = batch.select(["order", "dir", "name"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(finals, pa.string())], names=[*chosen.schema.names, "final_name"])

    schema = StructType().add("order", order_type).add("dir", "string").add("name", "string").add("final_name", "string")
    return dealt.mapInArrow(run, schema)


def _large_groups(taken: DataFrame, pending: DataFrame, split_suffix: bool, order_type, leaves: bool) -> DataFrame:
    """Each pass assigns family by family. Names can only clash across families of a group
    (``a.txt`` twice and an incoming ``a_1.txt``): every pending file of a group ordered at or
    before its earliest clash is provably final, so it is fixed and the rest of that group is
    re-resolved against the grown set of taken names. Without clashes one pass settles everything."""
    done = None
    while True:
        # materialised once: the clash test and the consumers read the written table
        out = cut_lineage(_grouped(_one_pass(taken, pending, split_suffix, leaves), split_suffix), "collisions")
        twice = out.groupBy("dir", "final_name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        # of a name given twice every holder counts as clashing; the earliest of the group is final
        holders = out.join(twice.select("dir", "final_name"), ["dir", "final_name"], "left_semi")
        first = cut_lineage(holders.groupBy(*GROUP).agg(F.min("order").alias("first")), "collision-limits")
        columns = ["order", "dir", "name", "final_name"]
        if not first.head(1):
            return out.select(*columns) if done is None else done.unionByName(out.select(*columns))
        limited = out.join(first, GROUP, "left")
        settled = F.col("first").isNull() | (F.col("order") <= F.col("first"))
        fixed = limited.filter(settled).select(*columns)
        done = fixed if done is None else done.unionByName(fixed)
        taken = taken.unionByName(fixed.select("dir", F.col("final_name").alias("name"), F.lit(None).cast(order_type).alias("gone")))
        pending = limited.filter(~settled).select("order", "dir", "name")


def _one_pass(existing: DataFrame, incoming: DataFrame, split_suffix: bool, leaves: bool) -> DataFrame:
    """Family-local assignment. With the family's blocked indices b_1 < b_2 < ... and
    g_i = b_i - (i - 1) (free slots below b_i), the k-th free index (0-based) is
    k + #{i : g_i <= k}: a running count over the merged, sorted (g, k) keys. Ranks
    and running counts are distributed prefix sums (``operators.ordered``), so a
    family holding a third of all files is still spread over many tasks, and no
    candidate list is ever materialised. Families that lose a name to a move are folded
    in order instead (``_timed``)."""
    stem, sfx = _split("name", split_suffix)
    order_type = incoming.schema["order"].dataType
    inc = incoming.select("order", "dir", "name", stem.alias("stem"), sfx.alias("suffix"))
    blocked = _family_members(existing, split_suffix).join(inc.select(*FAMILY).distinct(), FAMILY, "left_semi")
    late = None
    if leaves:
        blocked = cut_lineage(blocked, "collision-blocked")
        timed = blocked.filter(F.col("gone").isNotNull()).select(*FAMILY).distinct()
        late = _timed(blocked.join(timed, FAMILY, "left_semi"), inc.join(timed, FAMILY, "left_semi"), order_type)
        blocked, inc = blocked.join(timed, FAMILY, "left_anti"), inc.join(timed, FAMILY, "left_anti")
    # both ranks in one pass: of the blocked indices, and of the incoming files, of a family
    none = F.lit(None)
    both = (blocked.select(*FAMILY, "n").distinct()
            .select(*FAMILY, F.lit(1).alias("blk"), "n", none.cast(order_type).alias("order"), none.cast("string").alias("name"))
            .unionByName(inc.select(*FAMILY, F.lit(0).alias("blk"), none.cast("bigint").alias("n"), "order", "name")))
    ranked = ranked_within(both, [*FAMILY, "blk"], ["n", "order"], rank_col="_r")
    merged = ranked.select(*FAMILY, F.when(F.col("blk") == 1, F.col("n") - (F.col("_r") - 1)).otherwise(F.col("_r") - 1).alias("key"),
                           "blk", "order", "name", (-F.col("blk")).alias("_desc_blk"))
    merged = prefix_sum_within(merged, FAMILY, ["key", "_desc_blk"], "blk", "j")
    out = merged.filter(F.col("blk") == 0).withColumn("n", F.col("key") + F.col("j")).select("order", *FAMILY, "name", "n")
    if late is not None:
        out = out.unionByName(late)
    final = F.when(F.col("n") == 0, F.col("name")).otherwise(
        F.concat(F.col("stem"), F.lit("_"), F.col("n").cast("string"), F.col("suffix")))
    return out.select("order", "dir", "name", final.alias("final_name"))


def _timed(blocked: DataFrame, inc: DataFrame, order_type) -> DataFrame:
    """Families in which names become free: their arrivals and departures in order, one
    sorted scan per task that keeps the taken indices of the current family. At the same
    order a file's own name is still taken."""
    start = blocked.filter(F.col("gone").isNull()).select(*FAMILY, "n", F.lit(0).alias("step"), F.lit(None).cast(order_type).alias("order"), F.lit(None).cast("string").alias("name"))
    held = blocked.filter(F.col("gone").isNotNull())
    events = (start.unionByName(held.select(*FAMILY, "n", F.lit(0).alias("step"), F.lit(None).cast(order_type).alias("order"), F.lit(None).cast("string").alias("name")))
              .unionByName(inc.select(*FAMILY, F.lit(None).cast("bigint").alias("n"), F.lit(1).alias("step"), "order", "name"))
              .unionByName(held.select(*FAMILY, "n", F.lit(2).alias("step"), F.col("gone").alias("order"), F.lit(None).cast("string").alias("name"))))
    dealt = events.repartition(*FAMILY).sortWithinPartitions(*FAMILY, F.col("order").asc_nulls_first(), "step")
    dealt = dealt.withColumn("order", F.col("order").cast("string"))  # not as a float where it is null

    def run(batches):
        import heapq

        import pandas as pd
        family, taken, free, top = None, set(), [], 0
        for pdf in batches:
            out = []
            for d, st, sf, n, step, order, name in zip(*(pdf[c] for c in [*FAMILY, "n", "step", "order", "name"])):
                if (d, st, sf) != family:
                    family, taken, free, top = (d, st, sf), set(), [], 0
                if step == 0:
                    taken.add(int(n))
                elif step == 2:
                    taken.discard(int(n))
                    heapq.heappush(free, int(n))  # may lie above ``top``; it is then met twice and skipped
                else:
                    while free and free[0] in taken:
                        heapq.heappop(free)
                    while top in taken:
                        top += 1
                    k = min(top, free[0]) if free else top
                    taken.add(k)
                    out.append((order, d, st, sf, name, k))
            yield pd.DataFrame(out, columns=["order", *FAMILY, "name", "n"])

    return (dealt.mapInPandas(run, "order string, dir string, stem string, suffix string, name string, n bigint")
            .withColumn("order", F.col("order").cast(order_type)))


def _existing_names(files: DataFrame, *more: str) -> DataFrame:
    return files.select(path_parent(F.col("path")).alias("dir"), path_name(F.col("path")).alias("name"), *more)


def known_directories(files: DataFrame, vault: str = VAULT) -> DataFrame:
    """(category, known) for every directory directly below the vault: the built-in ones and
    those that hold a file at any depth."""
    own = [K.INBOX, K.ARCHIVE, K.SENSITIVE] + K.CATEGORY_DIRS
    below = (files.filter(F.col("path").startswith(vault + "/"))
             .select(F.split(F.substring("path", len(vault) + 2, 1 << 30), "/").alias("p")).filter(F.size("p") > 1)
             .select(F.col("p")[0].alias("category")))
    built_in = files.sparkSession.createDataFrame([(c,) for c in own], "category string")
    return below.unionByName(built_in).distinct().withColumn("known", F.lit(True))


def organize_plan(files: DataFrame, moves: DataFrame, vault: str = VAULT) -> DataFrame:
    """ORG-1: moves (seq, path, category) -> manifest (seq, src, dst, category,
    target_dir, status, error), equal to applying the moves one by one in ``seq`` order:
    a category without a directory falls back to _inbox (the category is still recorded,
    V25); a name is free once its file has moved away and not before, so no ``dst`` names a
    file that is still there, and a file organised into its own directory gets a suffix;
    the first move of a source wins, later ones and unknown sources are error rows. (A move
    whose source is the target of an earlier move counts as unknown.)"""
    files = cut_lineage(files.select("path").distinct(), "organize-paths")
    moves = cut_lineage(moves.select("seq", "path", "category"), "organize-moves")
    first = moves.groupBy("path").agg(F.min("seq").alias("first"))
    known = known_directories(files, vault)
    m = (moves.join(files.withColumn("_e", F.lit(True)), "path", "left").join(first, "path").join(known, "category", "left")
         .select("seq", "path", "category", F.coalesce(F.col("_e") & (F.col("seq") == F.col("first")), F.lit(False)).alias("ok"),
                 F.concat(F.lit(vault + "/"), F.when(F.col("known"), F.col("category")).otherwise(F.lit(K.INBOX))).alias("target_dir")))
    m = cut_lineage(m, "organize-targets")
    good = m.filter("ok")
    inc = good.select(F.col("seq").alias("order"), F.col("target_dir").alias("dir"),
                      path_name(F.col("path")).alias("name"))
    leaving = files.join(good.select("path", F.col("seq").alias("gone")), "path", "left")
    existing = _existing_names(leaving, "gone")
    named = collision_names(existing, inc)
    ok = good.join(named.select(F.col("order").alias("seq"), "final_name"), "seq").select(
        "seq", F.col("path").alias("src"), F.concat_ws("/", "target_dir", "final_name").alias("dst"),
        "category", "target_dir", F.lit("moved").alias("status"), F.lit(None).cast("string").alias("error"))
    bad = m.filter("not ok").select(
        "seq", F.col("path").alias("src"), F.lit(None).cast("string").alias("dst"), "category", "target_dir",
        F.lit("error").alias("status"), F.concat(F.lit("Source not found: "), F.col("path")).alias("error"))
    return ok.unionByName(bad)


def archive_plan(files: DataFrame, as_of: str, days: int = K.ARCHIVE_DAYS, vault: str = VAULT) -> DataFrame:
    """ORG-3: stale (day-granular, V6), not archived, not starred files ->
    ``_archive/<old category>/<name>`` with collision suffixes."""
    cutoff = F.date_sub(F.to_date(F.lit(as_of)), days)
    # the plan reads the catalogue three times (candidates, names staying, result):
    # materialise the five columns it needs once
    files = cut_lineage(files.select("path", "category", "last_accessed", "starred", "file_size"), "archive-input")
    stale = files.filter((F.to_date("last_accessed") <= cutoff) & (F.col("category") != K.ARCHIVE)
                         & ~F.col("starred"))
    tdir = F.concat(F.lit(f"{vault}/{K.ARCHIVE}/"), F.col("category"))
    inc = stale.select(F.col("path").alias("order"), tdir.alias("dir"), path_name(F.col("path")).alias("name"))
    staying = files.join(stale.select("path"), "path", "left_anti")
    named = collision_names(_existing_names(staying), inc)
    return stale.join(named.select(F.col("order").alias("path"), "dir", "final_name"), "path").select(
        F.col("path").alias("src"), F.concat_ws("/", "dir", "final_name").alias("dst"),
        F.col("category").alias("from_category"), "file_size")


def archive_summary(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count(F.lit(1)).alias("archived_count"),
                    F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint").alias("total_freed_bytes"))


def group_order() -> F.Column:
    """Processing order of groups inside a directory as a sortable string:
    stem_files desc, stem length asc, stem asc."""
    return F.concat_ws("\u0000", F.lpad((F.lit(10 ** 12) - F.col("stem_files")).cast("string"), 13, "0"),
                       F.lpad(F.length("stem").cast("string"), 6, "0"), F.col("stem"))


def group_manifest(files: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """GRP-6: per grouped file (src, dst, folder). The folder is the sanitised
    suggested name inside the file's directory; an existing or earlier folder of the
    same name gets ``_n``."""
    folders = groups.select("directory", "stem", group_order().alias("order"),
                            safe_folder_name(F.col("suggested_folder")).alias("folder"))
    # existing entries of each directory: its files and sub-directories
    existing = (_existing_names(files)
                .unionByName(files.select(path_parent(path_parent(F.col("path"))).alias("dir"),
                                          path_name(path_parent(F.col("path"))).alias("name")))
                .distinct())
    inc = folders.select("order", F.col("directory").alias("dir"), F.col("folder").alias("name"))
    named = collision_names(existing, inc, split_suffix=False)
    g = folders.join(named.select(F.col("dir").alias("directory"), "order", "final_name"), ["directory", "order"])
    m = members.select("directory", "stem", F.col("path").alias("src"))
    return (g.join(m, ["directory", "stem"])
            .select("directory", "stem", F.concat_ws("/", "directory", "final_name").alias("folder"), "src")
            .select("directory", "stem", "folder", "src",
                    F.concat_ws("/", "folder", path_name(F.col("src"))).alias("dst")))


def group_files(files: DataFrame, requests: DataFrame) -> DataFrame:
    """GRP-6 for files that a caller names: ``requests`` (seq, folder_name, source_dir, paths
    array<string>) -> one row per listed path: seq, folder, src, dst, status, error. Without a
    source directory the folder lies beside the first path. The folder's name is made safe
    and gets ``_n`` when the directory has an entry of that name or an earlier request made
    one; names that meet in the folder get a suffix in list order; a path that does not
    exist, or that was moved by an earlier entry, is an error row. A request without paths
    is one error row."""
    entries = (_existing_names(files).unionByName(files.select(F.explode(_ancestors(path_parent(F.col("path")))).alias("d"))
               .unionByName(files.select(path_parent(F.col("path")).alias("d"))).distinct()
               .select(path_parent(F.col("d")).alias("dir"), path_name(F.col("d")).alias("name"))).distinct())
    req = cut_lineage(requests.select("seq", "folder_name", "source_dir", F.coalesce("paths", F.array().cast("array<string>")).alias("paths")), "group-requests")
    asked = req.filter(F.size("paths") > 0).select(
        "seq", "paths", F.coalesce("source_dir", path_parent(F.col("paths")[0])).alias("base"),
        safe_folder_name(F.col("folder_name")).alias("safe"))
    named = collision_names(entries, asked.select(F.col("seq").alias("order"), F.col("base").alias("dir"), F.col("safe").alias("name")), split_suffix=False)
    folder = asked.join(named.select(F.col("order").alias("seq"), "final_name"), "seq").select(
        "seq", F.concat_ws("/", "base", "final_name").alias("folder"), F.posexplode("paths").alias("pos", "src"))
    first = folder.groupBy("src").agg(F.min(F.struct("seq", "pos")).alias("first"))
    judged = cut_lineage(folder.join(first, "src").join(files.select(F.col("path").alias("src")).distinct().withColumn("_e", F.lit(True)), "src", "left")
                         .select("seq", "folder", "pos", "src", (F.coalesce("_e", F.lit(False)) & (F.struct("seq", "pos") == F.col("first"))).alias("ok")), "group-entries")
    good = judged.filter("ok")
    inside = collision_names(entries.limit(0), good.select(F.struct("seq", "pos").alias("order"), F.col("folder").alias("dir"), path_name(F.col("src")).alias("name")))
    none = F.lit(None).cast("string")
    moved = good.join(inside.select("order.seq", "order.pos", "final_name"), ["seq", "pos"]).select(
        "seq", "folder", "src", F.concat_ws("/", "folder", "final_name").alias("dst"), F.lit("moved").alias("status"), none.alias("error"))
    missing = judged.filter("not ok").select("seq", "folder", "src", none.alias("dst"), F.lit("error").alias("status"), F.lit("File not found").alias("error"))
    empty = req.filter(F.size("paths") == 0).select("seq", none.alias("folder"), none.alias("src"), none.alias("dst"), F.lit("error").alias("status"),
                                                    F.lit("No files provided").alias("error"))
    return moved.unionByName(missing).unionByName(empty)


def _ancestors(dir_col: F.Column) -> F.Column:
    """Proper ancestors of a directory path ('a/b/c' -> ['a', 'a/b'])."""
    parts = F.split(dir_col, "/")
    n = F.size(parts)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))) \
        .otherwise(F.array().cast("array<string>"))


def ungroup_manifest(files: DataFrame, folders: DataFrame) -> DataFrame:
    """GRP-7: move the direct children of each folder one level up (collision
    suffix against the parent); ``folder_deleted`` when no sub-directory remains."""
    f = folders.select(F.col("folder")).distinct()
    kids = files.select("path", path_parent(F.col("path")).alias("folder")).join(f, "folder")
    parent = path_parent(F.col("folder"))
    inc = kids.select(F.col("path").alias("order"), parent.alias("dir"), path_name(F.col("path")).alias("name"))
    staying = files.join(kids.select("path"), "path", "left_anti")
    named = collision_names(_existing_names(staying), inc)
    moved = kids.join(named.select(F.col("order").alias("path"), "dir", "final_name"), "path").select(
        "folder", F.col("path").alias("src"), F.concat_ws("/", "dir", "final_name").alias("dst"))
    # a folder keeps a sub-directory when it is a proper ancestor of some file's directory
    dirs = files.select(path_parent(F.col("path")).alias("d")).distinct()
    deeper = (dirs.select(F.explode(_ancestors(F.col("d"))).alias("folder")).distinct()
              .join(f, "folder", "left_semi").withColumn("_sub", F.lit(True)))
    return moved.join(deeper, "folder", "left").select(
        "folder", "src", "dst", F.col("_sub").isNull().alias("folder_deleted"))
