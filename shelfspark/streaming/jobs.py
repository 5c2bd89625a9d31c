"""Structured Streaming jobs (STR-1..5).

Every job reads an append-only file source, keeps its state in a checkpoint folder and
writes to a sink folder. A caller that wants to go on after a restart passes both
(``checkpoint``, ``sink``): a later call, also from another driver, resumes where the
last one stopped and its result covers everything. Without them a call gets fresh
folders under the shared folder named by ``spark.checkpoint.dir``. Each micro-batch
writes a folder named by its batch id, so a replayed batch overwrites its own output.
``run`` drives a job with ``trigger(availableNow=True)``: process what is there, then
stop. Static sides are written once per call, not computed per micro-batch.
"""

from __future__ import annotations

import contextlib

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from shelfspark import constants as K
from shelfspark import fixtures as X
from shelfspark.functions.text import path_name
from shelfspark.functions.times import instant_to_ntz, ntz_micros, ntz_to_instant
from shelfspark.session import cut_lineage, shared_scratch
from shelfspark.sources.tree import hidden_from_spark, walk

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
DOCUMENTS_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS_SCHEMA = "doc_id bigint, quality int, toxic int"


def stream_table(spark: SparkSession, sf_dir: str, name: str, schema: str, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(f"{sf_dir.rstrip('/')}/{name}*.parquet")


def run(writer, checkpoint: str):
    """Process everything that is there and return when it is done, however long it takes."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q


# ----------------------------------------------------------------------------
# STR-1 access counters
# ----------------------------------------------------------------------------

def access_counts_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """Running view_count / last_accessed per path from the view events."""
    docs = X.table(spark, sf_dir, "documents")
    n = docs.select(F.count(F.lit(1))).scalar()
    files = cut_lineage(X.raw_files(spark, sf_dir).select(F.col("file_id").alias("_fid"), "path"), "stream-paths")
    ev = stream_table(spark, sf_dir, "events", EVENTS_SCHEMA, max_files).filter(F.col("event_type") == "view")
    views = ev.withColumn("_fid", F.pmod("event_id", n)).join(files, "_fid")
    return views.groupBy(F.col("path").alias("file_path")).agg(
        F.count(F.lit(1)).alias("views"), F.max("ts").alias("last_view"))


def stream_access_counts(spark: SparkSession, sf_dir: str, checkpoint: str | None = None, sink: str | None = None,
                         max_files: int | None = None) -> DataFrame:
    """Each batch writes the paths whose counters changed; the newest row of a path counts."""
    out = sink or shared_scratch(spark, "access-counts")

    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run(access_counts_stream(spark, sf_dir, max_files).writeStream.outputMode("update").foreachBatch(write),
        checkpoint or shared_scratch(spark, "access-counts-ckpt"))
    rows = spark.read.schema("file_path string, views bigint, last_view timestamp_ntz, batch bigint").parquet(out)
    return (rows.groupBy("file_path").agg(F.max_by(F.struct("views", "last_view"), "batch").alias("r"))
            .select("file_path", "r.views", "r.last_view"))


# ----------------------------------------------------------------------------
# STR-5 windowed activity with a watermark
# ----------------------------------------------------------------------------

WATERMARK = "1 hour"
WINDOW = "1 day"


def access_windows(spark: SparkSession, sf_dir: str, checkpoint: str | None = None, sink: str | None = None) -> DataFrame:
    """Views per (1-day window, file category); rows later than the 1-hour watermark
    are dropped; a window is emitted once the watermark passes its end (append)."""
    docs = X.table(spark, sf_dir, "documents")
    n = docs.select(F.count(F.lit(1))).scalar()
    cats = cut_lineage(X.classified_files(spark, sf_dir).select(F.col("file_id").alias("_fid"), "category"), "stream-categories")
    ev = stream_table(spark, sf_dir, "events", EVENTS_SCHEMA).filter(F.col("event_type") == "view")
    views = ev.withColumn("_fid", F.pmod("event_id", n)).join(cats, "_fid")
    # watermarks need a TIMESTAMP instant; the wall-clock NTZ value is read as UTC and
    # the window bounds are turned back into NTZ the same way (no session time zone)
    agg = (views.withColumn("event_time", ntz_to_instant("ts")).withWatermark("event_time", WATERMARK)
           .groupBy(F.window("event_time", WINDOW), "category").agg(F.count(F.lit(1)).alias("views"))
           .select(instant_to_ntz(F.col("window.start")).alias("window_start"),
                   instant_to_ntz(F.col("window.end")).alias("window_end"), "category", "views"))
    out = sink or shared_scratch(spark, "access-windows")
    run(agg.writeStream.outputMode("append").format("parquet").option("path", out),
        checkpoint or shared_scratch(spark, "access-windows-ckpt"))
    return spark.read.schema("window_start timestamp_ntz, window_end timestamp_ntz, category string, views bigint") \
        .parquet(out)


# ----------------------------------------------------------------------------
# STR-2 incremental inbox ingest
# ----------------------------------------------------------------------------

def stream_ingest(spark: SparkSession, sf_dir: str, max_files: int | None = None, checkpoint: str | None = None,
                  sink: str | None = None) -> DataFrame:
    """New documents -> files projection -> classify -> route, per micro-batch;
    each batch writes its own folder (rewritten on replay, so exactly once)."""
    from shelfspark.operators.classify import classify, route
    from shelfspark.operators.keywords import with_keywords
    cats, kws = X.dictionary(spark)
    out = sink or shared_scratch(spark, "ingest")

    def write(batch: DataFrame, batch_id: int):
        files = with_keywords(X.raw_files_from(batch), "extracted_text")
        routed = route(classify(files, cats, kws)).join(X.raw_files_from(batch).select("file_id", "path"), "file_id")
        (routed.select("file_id", "path", "category", "category_id", "confidence", "routed_to", "needs_review")
         .write.mode("overwrite").parquet(f"{out}/batch={batch_id}"))

    docs = stream_table(spark, sf_dir, "documents", DOCUMENTS_SCHEMA, max_files)
    run(docs.writeStream.foreachBatch(write), checkpoint or shared_scratch(spark, "ingest-ckpt"))
    return spark.read.parquet(out).drop("batch")


#: What opening a file costs, as bytes, and the bytes of files that a task takes: some thousands of small ones.
OPEN_COST_BYTES, TASK_BYTES = 16 << 10, 128 << 20
#: Files that a parquet file of a stream's listing names at most, where the caller gives no number.
LISTED_FILES = 100_000

#: What a stream's listing says of a file.
LISTING_SCHEMA = "path string, modified timestamp, size bigint"
#: What is known of a file that a stream has taken in.
LEDGER_SCHEMA = "path string, modified timestamp, size bigint, batch string"
INGESTED_SCHEMA = ("path string, file_type string, keywords array<string>, category string, category_id string, confidence double, "
                   "routed_to string, needs_review boolean, error string, batch string")


def _path(spark: SparkSession, name: str):
    """A path of any Hadoop-compatible store, and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def inbox_files(spark: SparkSession, inbox: str) -> DataFrame:
    """(path, modified, size) of the files below ``inbox`` that Spark's file sources would read, named as they name
    them, but listed by tasks: Spark's file stream keeps every file it lists, and has seen, in the driver's memory.
    ``inbox`` may be a file or a pattern, whose matches the driver sees."""
    path, fs = _path(spark, inbox)
    found = fs.globStatus(fs.makeQualified(path))
    if not found:
        raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {inbox}. SQLSTATE: 42K03")
    files = spark.createDataFrame([(st.getPath().toString(), st.getModificationTime(), st.getLen()) for st in found if st.isFile()],
                                  "path string, modified_ms bigint, size bigint")
    roots = [st.getPath().toString() for st in found if st.isDirectory()]
    if roots:
        scheme = "file:" if roots[0].startswith("file:") else ""  # walk() leaves it out
        files = files.unionByName(walk(spark, roots, hidden=hidden_from_spark)
                                  .select(F.concat(F.lit(scheme), "path").alias("path"), "modified_ms", "size"))
    if len(found) > 1:
        files = files.dropDuplicates(["path"])
    name = path_name(F.col("path"))
    unread = name.startswith(".") | (name.startswith("_") & ~name.contains("="))
    return files.where(~unread & (F.col("size") > 0)).select("path", F.timestamp_millis("modified_ms").alias("modified"), "size")


def announce(spark: SparkSession, inbox: str, folder: str, max_files: int | None = None) -> None:
    """Add the files of ``inbox`` that the listing in ``folder`` does not name yet to it, as parquet files that name
    ``max_files`` each at most, older files first. What a crash left of an earlier addition counts as it is."""
    path, fs = _path(spark, folder)
    fs.mkdirs(path)
    named = spark.read.schema(LISTING_SCHEMA).parquet(folder).select("path")
    new = inbox_files(spark, inbox).join(named.hint("merge"), "path", "left_anti").select("path", "modified", "size")  # names are never broadcast
    if not new.isEmpty():
        new = new.orderBy("modified", "path") if max_files else new
        new.write.mode("append").option("maxRecordsPerFile", max_files or LISTED_FILES).parquet(folder)


def _dealt(files: DataFrame) -> DataFrame:
    """Listed files dealt to tasks by their bytes, thousands of small ones to a task."""
    n, size = files.agg(F.count(F.lit(1)), F.sum("size")).first()
    slots = files.sparkSession.sparkContext.defaultParallelism
    tasks = min(n, max(slots, (n * OPEN_COST_BYTES + (size or 0)) // TASK_BYTES))
    return files.repartition(max(1, tasks), F.xxhash64("path"))


def stream_ingest_files(spark: SparkSession, inbox: str, categories: DataFrame, keywords: DataFrame, checkpoint: str | None = None,
                        sink: str | None = None, max_files: int | None = None, after_write=None) -> DataFrame:
    """SCN-9 / STR-2 over a directory: new files below ``inbox`` are extracted, get keywords, are classified and
    routed, micro-batch by micro-batch (of ``max_files`` files at most). Tasks list; what they find new is added to a
    listing in the checkpoint folder, and the stream's source is that listing, so the driver sees no file's
    name. Bodies are read by the tasks that extract.

    Every batch writes a folder of rows and then a folder of commit records, one for each file, both named by
    the query and the batch, so a batch that is run again overwrites itself. Only batches with commit
    records count, and files with one in another batch are left out: each file comes out once after a
    crash at any point, and also when the checkpoint folder is lost. ``after_write(batch_id)`` is called between
    the two writes (a test can fail there). As in Spark's file sources, names that begin with '_' or '.' below
    ``inbox`` are not seen, nor is a file without a byte, until it has one."""
    from shelfspark.operators.classify import classify, route
    from shelfspark.operators.keywords import with_keywords
    from shelfspark.sources.files import extract_listed
    out = (sink or shared_scratch(spark, "ingest-files")).rstrip("/")
    state = (checkpoint or shared_scratch(spark, "ingest-files-ckpt")).rstrip("/")

    def ledger() -> DataFrame:
        return spark.read.schema(LEDGER_SCHEMA).parquet(f"{out}/ledger")

    def write(batch: DataFrame, batch_id: int):
        key = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}"
        known = ledger().where(F.col("batch") != key).select("path", "modified").distinct()
        new = cut_lineage(batch.join(known.hint("merge"), ["path", "modified"], "left_anti"), "ingest-listing")
        read = cut_lineage(with_keywords(extract_listed(_dealt(new)), "text").withColumn("file_id", F.monotonically_increasing_id()), "ingest-texts")
        files = read.select("file_id", F.col("filename").alias("original_name"), F.col("text").alias("extracted_text"), "keywords")
        routed = route(classify(files, categories, keywords)).join(
            read.select("file_id", F.col("filepath").alias("path"), "file_type", "keywords", "error"), "file_id")
        (routed.select("path", "file_type", "keywords", "category", "category_id", "confidence", "routed_to", "needs_review", "error")
         .write.mode("overwrite").parquet(f"{out}/files/batch={key}"))
        if after_write:
            after_write(batch_id)
        new.select("path", "modified", "size").write.mode("overwrite").parquet(f"{out}/ledger/batch={key}")

    spark.createDataFrame([], LEDGER_SCHEMA).drop("batch").write.mode("ignore").parquet(f"{out}/ledger/batch=none")
    announce(spark, inbox, f"{state}/listing", max_files)
    listing = spark.readStream.schema(LISTING_SCHEMA)
    if max_files:
        listing = listing.option("maxFilesPerTrigger", 1)
    run(listing.parquet(f"{state}/listing").writeStream.foreachBatch(write), f"{state}/stream")
    spark.createDataFrame([], INGESTED_SCHEMA).drop("batch").write.mode("ignore").parquet(f"{out}/files/batch=none")
    committed = ledger().select("batch").distinct()  # a row for each batch
    return spark.read.schema(INGESTED_SCHEMA).parquet(f"{out}/files").join(committed, "batch", "left_semi").drop("batch")


# ----------------------------------------------------------------------------
# STR-3 online learner
# ----------------------------------------------------------------------------

def _snapshots(spark: SparkSession, folder: str) -> list[int]:
    """Batch ids of the snapshots in a folder, of any Hadoop-compatible store."""
    path, fs = _path(spark, folder)
    return sorted(int(st.getPath().getName()) for st in fs.listStatus(path)) if fs.exists(path) else []


def stream_corrections(spark: SparkSession, sf_dir: str, checkpoint: str | None = None, sink: str | None = None,
                       max_files: int | None = None) -> DataFrame:
    """Corrections (from labels) update the keyword weights batch by batch. The
    weights snapshot after batch b is written to ``sink/b`` and batch b starts from the
    newest snapshot before it on disk, so replays are idempotent and a restarted driver
    goes on from the last batch."""
    from shelfspark.operators.learn import apply_corrections
    from shelfspark.operators.keywords import keyword_arrays
    cats, kws0 = X.dictionary(spark)
    state = sink or shared_scratch(spark, "learner-state")
    raw = X.raw_files(spark, sf_dir)
    kw_arr = cut_lineage(keyword_arrays(raw.select(F.col("file_id").alias("doc_id"), F.col("extracted_text").alias("text"))),
                         "stream-keywords")
    raw = cut_lineage(raw.select("file_id", "path"), "stream-paths")
    ids = F.array(*[F.lit(c["id"]) for c in K.SEED_CATEGORIES])
    zh = F.array(*[F.lit(c["name_zh"]) for c in K.SEED_CATEGORIES])

    def learn(batch: DataFrame, batch_id: int):
        before = [b for b in _snapshots(spark, state) if b < batch_id]
        prev = spark.read.parquet(f"{state}/{before[-1]}") if before else kws0
        corr = (batch.join(raw.select(F.col("file_id").alias("doc_id"), "path"), "doc_id")
                .join(kw_arr, "doc_id", "left")
                .select(F.col("doc_id").alias("seq"), F.col("path").alias("filepath"),
                        F.element_at(zh, (F.pmod("doc_id", F.lit(7)) + 1).cast("int")).alias("from_category"),
                        F.element_at(ids, (F.pmod(F.col("doc_id") + 1 + F.col("toxic"), F.lit(7)) + 1).cast("int"))
                        .alias("to_category"),
                        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords")))
        apply_corrections(prev, cats, corr).write.mode("overwrite").parquet(f"{state}/{batch_id}")

    run(stream_table(spark, sf_dir, "labels", LABELS_SCHEMA, max_files).writeStream.foreachBatch(learn),
        checkpoint or shared_scratch(spark, "learner-ckpt"))
    done = _snapshots(spark, state)
    return spark.read.parquet(f"{state}/{done[-1]}") if done else kws0


# ----------------------------------------------------------------------------
# STR-4 attempt throttle
# ----------------------------------------------------------------------------

THROTTLE_OUT = "key string, event_id bigint, ts timestamp_ntz, allowed boolean, remaining int"

#: Most attempts of a burst that one task scans.
THROTTLE_SEGMENT = 1_000_000
#: Rounds in which all segments with a wrong state are scanned again; later ones take a burst's first.
THROTTLE_WIDE_ROUNDS = 4


class _Window:
    """The rule for one key: at most ``limit`` timestamps of allowed attempts."""

    def __init__(self, limit: int, window_s: int, kept=()):
        self.limit, self.width, self.kept = limit, window_s * 1_000_000, [int(x) for x in kept]

    def attempt(self, t: int) -> tuple[bool, int]:
        while self.kept and t - self.kept[0] >= self.width:
            del self.kept[0]
        left = self.limit - len(self.kept)
        if left > 0:
            self.kept.append(int(t))
        return left > 0, max(0, left)


def _throttle_scan(limit: int, window_s: int, group_cols: list[str], starts: str | None = None):
    """mapInPandas body over rows clustered by ``group_cols`` and sorted by them, then
    (t, event_id): one linear pass, the state is the group's last <= ``limit`` allowed
    timestamps and is carried across Arrow batches of the same task. ``starts``: a column with
    the state at the group's begin."""
    def run(batches):
        import pandas as pd
        cur, rule = None, None
        for pdf in batches:
            allowed, remaining = [], []
            groups = zip(*[pdf[c] for c in group_cols])
            begin = pdf[starts] if starts else [()] * len(pdf)
            for g, t, kept in zip(groups, pdf["t"], begin):
                if g != cur:
                    cur, rule = g, _Window(limit, window_s, () if kept is None else kept)
                ok, left = rule.attempt(t)
                allowed.append(ok)
                remaining.append(left)
            yield pd.DataFrame({"key": pdf["key"], "event_id": pdf["event_id"], "ts": pdf["ts"],
                                "allowed": allowed, "remaining": pd.Series(remaining, dtype="int32")})

    return run


_STATES = "key string, burst bigint, segment bigint, starts array<bigint>, ends array<bigint>"


def _throttle_states(limit: int, window_s: int):
    """mapInPandas body over clustered, sorted segments: only the state at each segment's begin and end."""
    def run(batches):
        import pandas as pd
        cur, rule, out = None, None, []
        for pdf in batches:
            for key, burst, segment, t, starts in zip(pdf["key"], pdf["burst"], pdf["segment"], pdf["t"], pdf["starts"]):
                if (key, burst, segment) != cur:
                    cur, rule = (key, burst, segment), _Window(limit, window_s, starts)
                    out.append((*cur, list(starts), rule))
                rule.attempt(t)
            if len(out) > 1:  # the last one may go on in the next batch
                yield pd.DataFrame([(*r[:4], list(r[4].kept)) for r in out[:-1]], columns=["key", "burst", "segment", "starts", "ends"])
                out = out[-1:]
        if out:
            yield pd.DataFrame([(*r[:4], list(r[4].kept)) for r in out], columns=["key", "burst", "segment", "starts", "ends"])

    return run


def throttle_batch(attempts: DataFrame, limit: int = K.MAX_ATTEMPTS,
                   window_s: int = K.ATTEMPT_WINDOW_SECONDS, partitions: int | None = None,
                   key_bound: int | None = None) -> DataFrame:
    """Sequential rule per key: an attempt is allowed iff fewer than ``limit`` allowed
    attempts lie in the preceding ``window_s`` seconds (strict); refused attempts are
    not recorded. The rule is a recurrence with one output per attempt, so it runs as
    a sorted scan: rows are hash-clustered and sorted inside each partition, and one
    pass carries at most ``limit`` timestamps of state (linear, bounded memory).

    When some key has more than ``key_bound`` attempts, keys are first cut into
    bursts: a gap of at least ``window_s`` after the previous attempt empties the
    state exactly, so bursts are independent. Burst ids come from distributed
    per-key ranks and prefix sums (``operators.ordered``), and the scan is clustered
    by (key, burst), spreading a hot key over many tasks. A burst of more than ``key_bound``
    attempts (a key without a pause) is cut into segments, see ``_segment_states``."""
    from shelfspark.operators.ordered import prefix_sum_within, ranked_within
    bound = THROTTLE_SEGMENT if key_bound is None else key_bound
    a = attempts.select("key", "event_id", "ts", ntz_micros("ts").alias("t"))
    n = partitions or max(attempts.sparkSession.sparkContext.defaultParallelism * 2, 8)
    biggest = a.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    if biggest <= bound:
        clustered = a.repartition(n, "key").sortWithinPartitions("key", "t", "event_id")
        return clustered.mapInPandas(_throttle_scan(limit, window_s, ["key"]), THROTTLE_OUT)
    w_us = window_s * 1_000_000
    r = ranked_within(a, ["key"], ["t", "event_id"], rank_col="_r")
    prev = r.select("key", (F.col("_r") + 1).alias("_r"), F.col("t").alias("_prev_t"))
    r = r.join(prev, ["key", "_r"], "left").withColumn(
        "_gap", F.when(F.col("_prev_t").isNull() | (F.col("t") - F.col("_prev_t") >= w_us), 1).otherwise(0))
    r = prefix_sum_within(r, ["key"], ["t", "event_id"], "_gap", "burst")
    first = r.where("_gap = 1").select("key", "burst", F.col("_r").alias("_first"))
    r = cut_lineage(r.join(first, ["key", "burst"]).select("key", "burst", "event_id", "ts", "t",
                           F.expr(f"(_r - _first) div {max(1, bound)}").alias("segment")), "throttle-segments")
    starts = _segment_states(r, limit, window_s, n)
    group = ["key", "burst", "segment"]
    clustered = r.join(starts, group, "left").repartition(n, *group).sortWithinPartitions(*group, "t", "event_id")
    return clustered.mapInPandas(_throttle_scan(limit, window_s, group, "starts"), THROTTLE_OUT)


def _segment_states(rows: DataFrame, limit: int, window_s: int, n: int) -> DataFrame:
    """(key, burst, segment, starts): the state, at most ``limit`` timestamps, at the begin of every segment
    but a burst's first.

    All segments are scanned at once from an empty state. A segment whose begin differs from the end of
    the one before is scanned again from that end, until none does; each round settles at least one more
    segment of each burst, and usually many, as the rule forgets: where fewer than ``limit`` attempts
    fall in a window once, both scans go on alike. After some rounds only the first wrong segment of a
    burst is scanned, so that a burst that never forgets costs one scan more and not one for each pair."""
    group = ["key", "burst", "segment"]
    several = rows.where("segment > 0").select("key", "burst").distinct()
    rows = rows.join(several, ["key", "burst"], "left_semi").select(*group, "t", "event_id")
    empty = F.array().cast("array<bigint>")

    def scan(chosen: DataFrame) -> DataFrame:
        clustered = chosen.repartition(n, *group).sortWithinPartitions(*group, "t", "event_id")
        return clustered.mapInPandas(_throttle_states(limit, window_s), _STATES)

    states = cut_lineage(scan(rows.withColumn("starts", empty)), "throttle-states")
    done = 0
    while True:
        before = states.select("key", "burst", (F.col("segment") + 1).alias("segment"), F.col("ends").alias("due"))
        wrong = cut_lineage(states.join(before, group).where("starts != due").select(*group, F.col("due").alias("starts")), "throttle-wrong")
        if wrong.isEmpty():
            return states.where("segment > 0").select(*group, "starts")
        if done >= THROTTLE_WIDE_ROUNDS:
            wrong = wrong.groupBy("key", "burst").agg(F.min(F.struct("segment", "starts")).alias("m")).select("key", "burst", "m.*")
        again = scan(rows.join(wrong, group))
        states = cut_lineage(states.join(wrong, group, "left_anti").unionByName(again), "throttle-states")
        done += 1


THROTTLE_LATENESS = "1 hour"


def _throttle_state_fn(limit: int, window_s: int):
    w_us = window_s * 1_000_000

    def fn(key, pdfs, state):
        if state.hasTimedOut:  # the watermark is a window past the last allowed attempt
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(pdfs)).sort_values(["t", "event_id"])
        allowed, remaining = [], []
        for t in pdf["t"]:
            kept = [x for x in kept if t - x < w_us]
            ok = len(kept) < limit
            allowed.append(ok)
            remaining.append(max(0, limit - len(kept)))
            if ok:
                kept.append(int(t))
        state.update((kept,))
        ends = (max(kept) + w_us) // 1000 + 1 if kept else 0
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "event_id": pdf["event_id"].astype("int64").values,
                            "ts": pdf["ts"].values, "allowed": allowed, "remaining": remaining})

    return fn


def _timestamp_of(micros) -> "pd.Timestamp":
    return pd.Timestamp(int(micros), unit="us")


def throttle_stream_ordered(attempts_stream: DataFrame, limit: int = K.MAX_ATTEMPTS, window_s: int = K.ATTEMPT_WINDOW_SECONDS,
                            lateness: str = THROTTLE_LATENESS) -> DataFrame:
    """Stream form that answers an attempt when the watermark has passed it, in (ts, event_id) order, so
    that files in any order within ``lateness`` give the batch rule's result. A key's state is its waiting
    attempts (a list of the state store, appended to) and at most ``limit`` timestamps; a timer at the
    earliest waiting attempt wakes the key. Needs the RocksDB state store (``ordered_store``)."""
    from pyspark.sql.streaming import StatefulProcessor

    class Rule(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.waiting = handle.getListState("waiting", "t bigint, event_id bigint")
            self.kept = handle.getValueState("kept", "times array<bigint>")
            self.due = handle.getValueState("due", "ms bigint")

        def handleInputRows(self, key, rows, timerValues):
            first = None
            for pdf in rows:
                if len(pdf):
                    self.waiting.appendList(list(zip(pdf["t"].astype("int64").tolist(), pdf["event_id"].astype("int64").tolist())))
                    least = int(pdf["t"].min())
                    first = least if first is None else min(first, least)
            if first is not None:
                self._wake(first // 1000 + 1)
            yield pd.DataFrame()

        def _wake(self, ms):
            due = self.due.get()
            if due is None or ms < due[0]:
                if due is not None:
                    self.handle.deleteTimer(due[0])
                self.handle.registerTimer(ms)
                self.due.update((ms,))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            rows = sorted((int(t), int(i)) for t, i in self.waiting.get())
            ready = [r for r in rows if r[0] <= passed]
            left = rows[len(ready):]
            kept = self.kept.get()
            rule = _Window(limit, window_s, kept[0] if kept else ())
            answers = [(key[0], i, _timestamp_of(t), *rule.attempt(t)) for t, i in ready]
            self.due.clear()
            if left:
                self.waiting.put(left)
                self._wake(left[0][0] // 1000 + 1)
            else:
                self.waiting.clear()
            if rule.kept and (left or passed - rule.kept[-1] < rule.width):
                self.kept.update((rule.kept,))
                if not left:  # wake once more to forget
                    self._wake((rule.kept[-1] + rule.width) // 1000 + 1)
            else:
                self.kept.clear()
            yield pd.DataFrame(answers, columns=["key", "event_id", "ts", "allowed", "remaining"])

        def close(self):
            pass

    a = (attempts_stream.select("key", "event_id", ntz_micros("ts").alias("t"), ntz_to_instant("ts").alias("event_time"))
         .withWatermark("event_time", lateness))
    return a.groupBy("key").transformWithStateInPandas(Rule(), THROTTLE_OUT, "append", "EventTime")


@contextlib.contextmanager
def ordered_store(spark: SparkSession):
    """The state store that timers and lists need, for the streams started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stream_throttle_ordered(spark: SparkSession, sf_dir: str, limit: int, window_s: int, checkpoint: str | None = None,
                            sink: str | None = None, max_files: int | None = None, lateness: str = THROTTLE_LATENESS) -> DataFrame:
    """The answers of all attempts that the watermark has passed."""
    ev = stream_table(spark, sf_dir, "events", EVENTS_SCHEMA, max_files)
    att = ev.select(F.col("user_id").cast("string").alias("key"), "event_id", "ts")
    out = sink or shared_scratch(spark, "throttle-ordered")
    with ordered_store(spark):
        run(throttle_stream_ordered(att, limit, window_s, lateness).writeStream.outputMode("append").format("parquet")
            .option("path", out), checkpoint or shared_scratch(spark, "throttle-ordered-ckpt"))
    return spark.read.schema(THROTTLE_OUT).parquet(out)


def throttle_stream(spark: SparkSession, attempts_stream: DataFrame, limit: int = K.MAX_ATTEMPTS,
                    window_s: int = K.ATTEMPT_WINDOW_SECONDS, lateness: str = THROTTLE_LATENESS) -> DataFrame:
    """Stream form: state per key is at most ``limit`` timestamps and goes once the watermark
    has passed them by a window. Attempts are answered as they come, in (ts, event_id) order
    within each micro-batch; files that arrive in time order give the batch rule's result.
    Attempts later than ``lateness`` are dropped."""
    a = (attempts_stream.select("key", "event_id", "ts", ntz_micros("ts").alias("t"))
         .withColumn("event_time", ntz_to_instant("ts")).withWatermark("event_time", lateness))
    return a.groupBy("key").applyInPandasWithState(
        _throttle_state_fn(limit, window_s), THROTTLE_OUT, "kept array<bigint>", "append",
        GroupStateTimeout.EventTimeTimeout)


def stream_throttle(spark: SparkSession, sf_dir: str, limit: int, window_s: int, checkpoint: str | None = None,
                    sink: str | None = None, max_files: int | None = None) -> DataFrame:
    ev = stream_table(spark, sf_dir, "events", EVENTS_SCHEMA, max_files)
    att = ev.select(F.col("user_id").cast("string").alias("key"), "event_id", "ts")
    out = sink or shared_scratch(spark, "throttle")
    run(throttle_stream(spark, att, limit, window_s).writeStream.outputMode("append").format("parquet")
        .option("path", out), checkpoint or shared_scratch(spark, "throttle-ckpt"))
    return spark.read.schema(THROTTLE_OUT).parquet(out)
