"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.session import cut_lineage

#: Bytes of text that one Python step of an operator holds at a time; its arrays over words
#: take some twenty times as much.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def _give_back() -> None:
    """Return freed memory to the system: workers are reused by later stages, and what their
    allocators keep would add up beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_KEPT: dict = {}


def kept(key, build):
    """A worker's state for later tasks of the same operator (``key``). Workers are reused by all stages, so
    only the latest operator's state is kept."""
    if key not in _KEPT:
        _KEPT.clear()
        _give_back()
        _KEPT[key] = build()
    return _KEPT[key]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Cut a batch into runs of rows whose texts hold at most ``limit`` bytes together
    (a single longer text is a run of its own), so memory follows the longest text and
    not the number of rows of a batch."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths.astype(np.int64))
    at = 0
    while at < n:
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end
    _give_back()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts as one large_string array, null as empty."""
    col = batch.column(column)
    return pc.fill_null(col.cast(pa.large_string()), "")


def words_of(texts: pa.Array, separator: str = " "):
    """(codes, offsets, words): every separator-delimited piece of the texts as a code into
    the distinct pieces; row i has the codes offsets[i]:offsets[i + 1]. C++ speed; Python then
    only handles distinct pieces."""
    parts = pc.split_pattern(texts, separator)
    offsets = parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    encoded = parts.flatten().dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets, encoded.dictionary


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate values[s:s + n] over all (s, n), in order."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    at = np.arange(total, dtype=np.int64)
    at += np.repeat(starts - (ends - lengths), lengths)
    return values[at]


#: Rows of a key list that may be broadcast (some tens of MB); a longer one is joined by shuffle.
BROADCAST_KEYS = 500_000


def without(docs: DataFrame, verdicts: DataFrame, key, name: str) -> DataFrame:
    """The rows of ``docs`` that a verdict keeps. ``verdicts`` has a row (doc_id, key, kept) for each
    row of docs; ``key`` is the same column's expression over docs. Rows equal in doc_id and key
    stay or go together, and if they stay, one of them does."""
    by = cut_lineage(verdicts.groupBy("doc_id", "key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
                     .where("not kept or n > 1"), name)
    gone = by.where("not kept").select(F.col("doc_id").alias("_gone_id"), F.col("key").alias("_gone_key"))
    if gone.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    keyed = docs.withColumn("_own_key", key)
    left = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (F.col("_own_key") == F.col("_gone_key")), "left_anti")
    if by.where("kept").limit(1).count():
        left = left.dropDuplicates(["doc_id", "_own_key"])
    return left.select(*docs.columns)
