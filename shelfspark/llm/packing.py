"""Operator 10: best-fit packing by the sum of squares.

Documents become token pieces of at most the capacity; the pieces, longest first, go one by
one where the sum over all residual gaps of (open bins with that gap) squared becomes smallest:
into an open bin, or a new one. The rule keeps the gaps varied, so later pieces find one that
fits. Pieces are dealt at random into groups of about ``GROUP_PIECES``, each packed by a task
of its own; a group's memory is bounded by that number and not by the table's size.

Cases: a null or empty text is the end token alone; a text longer than the capacity is cut into
full pieces and a rest; null identifiers and repeated rows are packed like any others; an empty
table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import read, slices, texts_of
from shelfspark.llm.word_bpe import encoder
from shelfspark.session import cut_lineage

CAPACITY = 4096
END_ID = 1
#: Pieces packed together. More pieces save part of a sequence per group, of some hundreds.
GROUP_PIECES = 4096


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each length, in the order given. ``open_bins[g]`` counts open bins
    with gap g. A length s put into a gap g takes one from open_bins[g] and adds one to
    open_bins[g - s] (a full bin, gap 0, is closed and not counted); a new bin only adds one to
    open_bins[capacity - s]. The smallest change of the sum of squares wins, of equal changes the
    tightest gap, and of equal gaps the bin opened or filled last."""
    open_bins = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened = 0
    for i, s in enumerate(lengths.tolist()):
        new = 2 * open_bins[capacity - s] + 1 if s < capacity else 0
        gaps = s + np.flatnonzero(open_bins[s:capacity])  # gaps with an open bin, tightest first
        best = -1
        if len(gaps):
            change = 1 - 2 * open_bins[gaps]
            left = gaps - s
            change += np.where(left > 0, 2 * open_bins[left] + 1, 0)
            k = int(np.argmin(change))
            if change[k] <= new:
                best = int(gaps[k])
        if best < 0:
            bins[i], offsets[i], gap = opened, 0, capacity - s
            opened += 1
        else:
            bins[i], offsets[i], gap = stacks[best].pop(), capacity - best, best - s
            open_bins[best] -= 1
        if gap:
            open_bins[gap] += 1
            stacks[gap].append(int(bins[i]))
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a vocabulary file
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def run(batches):
        encode = encoder(shared.value).encode
        for batch in batches:
            for part in slices(batch):
                ids, offsets = encode(texts_of(part))
                rows = []
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    n = b - a + 1
                    for k, start in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - start)
                        crc = zlib.crc32(ids[a + start:min(a + start + length, b)])
                        rows.append((doc_id, k, start, length, zlib.crc32(end, crc) if start + length == n else crc))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut_lineage(token_pieces(docs, tokenizer_json, capacity, end_id, id_col, text_col)
                         .withColumn("row_id", F.monotonically_increasing_id()), "token-pieces")
    groups = max(1, round(pieces.count() / GROUP_PIECES))

    def run(key, group):
        group = group.sort_values(["length", "row_id"], ascending=[False, True], ignore_index=True)
        bins, offsets = sum_of_squares(group["length"].to_numpy(), capacity)
        return group[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(
            sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    return (pieces.withColumn("group_id", F.pmod(F.xxhash64("row_id"), F.lit(groups)))
            .groupBy("group_id").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                                    "sequence_id long, offset long"))


def tokenizer_text() -> str:
    import public_tokenizers
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_text())
