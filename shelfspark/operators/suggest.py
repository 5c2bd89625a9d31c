"""Category suggestion from keyword co-occurrence (SUG-1..5).

Data-sized work runs in Spark: keyword occurrence counts over the inbox, the
per-file keyword sets restricted to the (at most 30) frequent keywords, the pair
counts, and the per-cluster file counts / samples. Only the bounded graph (30
nodes, at most 435 pair counts) is folded greedily on the driver, because the
greedy pass is order dependent (not a transitive closure).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark import constants as K
from shelfspark.session import cut_lineage

RESULT_SCHEMA = T.StructType([
    T.StructField("rank", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("proposed_name", T.StringType()),
    T.StructField("top_keywords", T.ArrayType(T.StringType())),
    T.StructField("file_count", T.LongType()),
    T.StructField("sample_files", T.ArrayType(T.StringType())),
    T.StructField("message", T.StringType()),
])


def keyword_occurrences(inbox: DataFrame) -> DataFrame:
    """(file_id, path, pos, keyword) for every stored keyword of every inbox file."""
    return inbox.select("file_id", "path", F.posexplode(F.coalesce("keywords", F.array().cast("array<string>")))
                        .alias("pos", "keyword"))


def frequent_keywords(inbox: DataFrame) -> DataFrame:
    """SUG-2: the 30 most common keywords (occurrences; ties by first occurrence in
    file order), then only count >= 3, length >= 2 and not a stop word."""
    occ = keyword_occurrences(inbox)
    counts = occ.groupBy("keyword").agg(F.count(F.lit(1)).alias("cnt"),
                                        F.min(F.struct("file_id", "pos")).alias("first"))
    top = counts.orderBy(F.col("cnt").desc(), F.col("first")).limit(K.SUGGEST_MOST_COMMON)
    stop = F.array(*[F.lit(w) for w in K.STOP_WORDS])
    return (top.filter((F.col("cnt") >= K.SUGGEST_MIN_COUNT) & (F.length("keyword") >= K.SUGGEST_MIN_LEN)
                       & ~F.array_contains(stop, F.lower("keyword")))
            .select("keyword", "cnt", F.col("first.file_id").alias("first_file"), F.col("first.pos").alias("first_pos")))


def keyword_cooccurrence(inbox: DataFrame, frequent: DataFrame) -> DataFrame:
    """SUG-3: number of files holding both keywords, for pairs kw1 < kw2 of frequent
    keywords. ``frequent`` has at most 30 rows, so it is broadcast."""
    sets = (keyword_occurrences(inbox).join(F.broadcast(frequent.select("keyword")), "keyword")
            .select("file_id", "keyword").distinct())
    a = sets.select("file_id", F.col("keyword").alias("kw1"))
    b = sets.select("file_id", F.col("keyword").alias("kw2"))
    return (a.join(b, "file_id").filter(F.col("kw1") < F.col("kw2"))
            .groupBy("kw1", "kw2").agg(F.count(F.lit(1)).alias("files")))


def greedy_clusters(freq_rows: list, pair_rows: list) -> list[list[str]]:
    """SUG-4 on the bounded graph, keywords as bits in most-common order. ``linked[i]`` has
    the keywords that share enough files with keyword i. A cluster grows in one sweep over
    the free keywords: one joins when the links of the members so far reach it. Seeds are
    taken by count; clusters below the minimum size use their keywords up all the same."""
    names = [r["keyword"] for r in freq_rows]
    bit = {name: i for i, name in enumerate(names)}
    linked = [0] * len(names)
    for r in pair_rows:
        if r["files"] >= K.SUGGEST_PAIR_MIN and r["kw1"] in bit and r["kw2"] in bit:
            i, j = bit[r["kw1"]], bit[r["kw2"]]
            linked[i] |= 1 << j
            linked[j] |= 1 << i
    by_count = sorted(range(len(names)), key=lambda i: (-freq_rows[i]["cnt"], i))
    free = (1 << len(names)) - 1
    out = []
    while free:
        seed = next(i for i in by_count if free >> i & 1)
        free &= ~(1 << seed)
        cluster, reach, at = [names[seed]], linked[seed], 0
        while (ahead := (reach & free) >> at):  # the next reachable keyword at or behind ``at``
            at += (ahead & -ahead).bit_length() - 1
            cluster.append(names[at])
            free &= ~(1 << at)
            reach |= linked[at]
        if len(cluster) >= K.SUGGEST_CLUSTER_MIN:
            out.append(cluster)
    return out


def _status(spark: SparkSession, status: str, message: str) -> DataFrame:
    return spark.createDataFrame([(None, status, None, None, None, None, message)], RESULT_SCHEMA)


def suggest_categories(inbox: DataFrame, min_files: int = K.SUGGEST_MIN_FILES) -> DataFrame:
    """SUG-1..5: up to three proposed categories from the inbox files
    (file_id, path, keywords). Gate failures give one status row."""
    spark = inbox.sparkSession
    # several small driver decisions follow; compute the (narrow) inbox once
    inbox = cut_lineage(inbox.select("file_id", "path", "keywords"), "suggest-inbox")
    n = inbox.count()
    if n < min_files:
        return _status(spark, "insufficient_data",
                       f"Need at least {min_files} files in _inbox (currently {n})")
    occ = keyword_occurrences(inbox)
    if not occ.head(1):
        return _status(spark, "no_keywords", "No keywords extracted from inbox files yet. Run ingest first.")
    freq = frequent_keywords(inbox)
    freq_rows = sorted(freq.collect(), key=lambda r: (-r["cnt"], r["first_file"], r["first_pos"]))
    if not freq_rows:
        return _status(spark, "no_clusters", "No clear keyword clusters found in inbox files.")
    pair_rows = keyword_cooccurrence(inbox, freq).collect()  # at most 435 rows
    clusters = greedy_clusters(freq_rows, pair_rows)
    if not clusters:
        return _status(spark, "no_clusters", "No significant clusters found.")
    members = spark.createDataFrame(
        [(i, kw) for i, c in enumerate(clusters) for kw in c], "cluster int, keyword string")
    files = (keyword_occurrences(inbox).join(F.broadcast(members), "keyword")
             .select("cluster", "path").distinct())
    counts = files.groupBy("cluster").agg(F.count(F.lit(1)).alias("file_count"))
    # three smallest paths per cluster: a per-cluster top-k (partial top-k before the
    # shuffle), so a cluster holding most files is never collected
    w = Window.partitionBy("cluster").orderBy("path")
    samples = (files.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= K.SUGGEST_SAMPLES)
               .groupBy("cluster").agg(F.array_sort(F.collect_list("path")).alias("sample_files")))
    stats = counts.join(samples, "cluster")
    meta = spark.createDataFrame(
        [(i, " · ".join(c[:3]), c[:K.SUGGEST_KEYWORDS]) for i, c in enumerate(clusters)],
        "cluster int, proposed_name string, top_keywords array<string>")
    ranked = meta.join(stats, "cluster").orderBy(F.col("file_count").desc(), F.col("cluster")).limit(K.SUGGEST_TOP)
    rows = ranked.collect()  # at most three
    out = [(i + 1, "ok", r["proposed_name"], r["top_keywords"], r["file_count"], r["sample_files"], None)
           for i, r in enumerate(rows)]
    return spark.createDataFrame(out, RESULT_SCHEMA)
