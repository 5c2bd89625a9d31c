"""Operator 3: exact deduplication by sorting the contents.

Texts are normalised (A-Z to a-z), range-partitioned over sampled splitters on their leading
bytes, and sorted within each partition by Spark's external sort, so equal texts are
neighbours. A scan compares each text in full with the one before it. A group of equal texts
may span several partitions (the splitters go on to digest and identifier, so a group that
holds a third of all rows is dealt to many tasks); only the first and last group of a
partition can, and those, two rows a partition, are stitched by their digest.

Cases: a null text counts as empty; null identifiers come last, so they stay only where a group
has no other; of rows that also share the identifier one stays; an empty table gives no rows;
only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import read, without
from shelfspark.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of the text that the splitters hold; digest and identifier follow.
SPLITTER_CHARS = 24

_OUT = pa.schema([("doc_id", pa.int64()), ("keep_id", pa.int64()), ("run_size", pa.int64()), ("head", pa.bool_()),
                  ("edge", pa.bool_()), ("part", pa.int32()), ("digest", pa.string())])


def normalise(column):
    return F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER)


def _runs(batches):
    """Neighbouring full comparisons over one sorted partition. A run is given out once its end
    is known; of the texts only the last one is kept between batches."""
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    last_text = None
    ids, digest, first = [], None, True  # the open run

    def emit(edge):
        every = pa.concat_arrays(ids)
        n = len(every)
        keep = every[0]
        return pa.RecordBatch.from_arrays([
            every, pa.repeat(keep, n), pa.repeat(pa.scalar(n, pa.int64()), n),
            pa.array(np.arange(n) == 0), pa.repeat(pa.scalar(edge), n),
            pa.repeat(pa.scalar(part, pa.int32()), n), pa.repeat(pa.scalar(digest, pa.string()), n)], schema=_OUT)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        texts = batch.column("norm").cast(pa.large_string())
        ident = batch.column("doc_id").cast(pa.int64())
        ident = pa.concat_arrays([ident]) if ident.offset else ident
        digests = batch.column("digest")
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = last_text is None or texts[0].as_py() != last_text
        starts = np.append(np.flatnonzero(new), n)
        if starts[0] > 0:  # the open run goes on
            ids.append(ident.slice(0, starts[0]))
        closed = len(starts) - 1  # runs that begin here; the last of them stays open
        if closed:
            if ids:
                yield emit(first)
                first = False
            inner = starts[:-1]
            if closed > 1:
                sizes = np.diff(inner)
                lo, hi = int(inner[0]), int(inner[-1])
                take = np.repeat(inner[:-1], sizes)
                edge = np.zeros(hi - lo, bool)
                if first:
                    edge[:sizes[0]] = True
                    first = False
                yield pa.RecordBatch.from_arrays([
                    ident.slice(lo, hi - lo), ident.take(pa.array(take)), pa.array(np.repeat(sizes, sizes).astype(np.int64)),
                    pa.array(new[lo:hi]), pa.array(edge), pa.repeat(pa.scalar(part, pa.int32()), hi - lo),
                    digests.slice(lo, hi - lo).cast(pa.string())], schema=_OUT)
            ids, digest = [ident.slice(int(inner[-1]))], digests[int(inner[-1])].as_py()
        last_text = texts[n - 1].as_py()
    if ids:
        yield emit(True)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id (largest identifier among the equal texts),
    group_size, kept (exactly one row of a group), text_sha256 (of the normalised text)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalise(F.col(text_col)).alias("norm"))
    rows = rows.select("doc_id", "norm", F.sha2(F.col("norm"), 256).alias("digest"),
                       F.substring("norm", 1, SPLITTER_CHARS).alias("lead"))
    latest = F.col("doc_id").desc_nulls_last()
    dealt = (rows.repartitionByRange("lead", "digest", latest)
             .sortWithinPartitions("lead", "digest", "norm", latest).select("doc_id", "norm", "digest"))
    runs = cut_lineage(dealt.mapInArrow(_runs, "doc_id long, keep_id long, run_size long, head boolean, edge boolean, "
                                               "part int, digest string"), "content-runs")
    # two groups a partition at most
    stitched = (runs.where("edge and head").groupBy("digest")
                .agg(F.max("keep_id").alias("all_keep"), F.sum("run_size").alias("all_size"),
                     F.max(F.struct(F.col("keep_id").isNotNull().alias("known"), "keep_id", (-F.col("part")).alias("minus")))["minus"].alias("minus"))
                .select("digest", "all_keep", "all_size", (-F.col("minus")).alias("head_part"))
                .withColumn("edge", F.lit(True)))
    return (runs.join(F.broadcast(stitched), ["digest", "edge"], "left")
            .select("doc_id", F.coalesce("all_keep", "keep_id").alias("keep_id"),
                    F.coalesce("all_size", "run_size").alias("group_size"),
                    (F.col("head") & F.coalesce(F.col("part") == F.col("head_part"), F.lit(True))).alias("kept"),
                    F.col("digest").alias("text_sha256")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one of each group of equal texts, all their columns unchanged."""
    verdicts = exact_groups(docs).select("doc_id", F.col("text_sha256").alias("key"), "kept")
    return without(docs, verdicts, F.sha2(normalise(F.col("text")), 256), "exact-verdicts")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


ORACLE = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256,
                  translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY norm)"""
