"""Operator 11: harmonic packing.

A length belongs to class k when k of it fill a sequence and k + 1 do not (capacity / (k + 1) <
length <= capacity / k), and a sequence of class k takes k pieces, whichever they are. So a worker
needs no more than a counter for each class, and packs its own partition with no shuffle, no
sorting and nothing known about the others.

Left as they are, lengths just above capacity / (k + 1) would waste up to half of their sequences.
Documents are therefore cut at the classes' upper ends: full sequences first, then the largest
floor(capacity / k) with k at most ``classes`` that still fits, again and again, until a rest of at
most ``whole`` tokens is left, whose class is fine enough. Pieces of a class are then equally long,
and its sequences waste at most k - 1 tokens, most often none. What fills no sequence of its class
at the end of a partition is laid end to end and cut where a sequence is full; the very last
rest goes into sequences of lengths that are powers of two. Both need no padding.

Cases: a null or empty text is the end token alone; a very long text is held by itself, as ids;
null identifiers and repeated rows are packed like any others; an empty table gives no rows; only
the named columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import read, slices, texts_of
from shelfspark.llm.packing import tokenizer_text
from shelfspark.llm.word_bpe import encoder

CAPACITY = 2048
END_ID = 1
#: Reciprocals at which documents are cut, and the most tokens of a rest that is not cut.
CLASSES, WHOLE = 64, 32

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def cut_table(capacity: int = CAPACITY, classes: int = CLASSES, whole: int = WHOLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, starts, counts): the pieces of a rest of r tokens, r below the capacity, are
    sizes[starts[r]:starts[r] + counts[r]]."""
    ends = sorted({capacity // k for k in range(1, min(classes, capacity) + 1)})
    lists: list[list[int]] = [[]]
    for r in range(1, capacity):
        head = ends[int(np.searchsorted(ends, r, side="right")) - 1] if r > whole and r >= ends[0] else r
        lists.append([head, *lists[r - head]])
    counts = np.array([len(x) for x in lists], np.int64)
    return np.array([s for x in lists for s in x], np.int64), np.cumsum(counts) - counts, counts


def powers_of_two(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


class Packer:
    """The sequences of one partition. Pieces wait until their class fills a sequence, so what is
    held is less than one sequence for each class."""

    def __init__(self, capacity: int = CAPACITY, classes: int = CLASSES, whole: int = WHOLE, first_sequence: int = 0):
        self.capacity = capacity
        self.sizes, self.starts, self.counts = cut_table(capacity, classes, whole)
        self.next = first_sequence
        self.waiting: dict[int, list[tuple]] = {}  # length: (doc_id, start, doc_tokens, ids)

    def _sequences(self, n: int) -> int:
        self.next += n
        return self.next - n

    def add(self, doc_ids: list, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch | None:
        """The pieces whose sequences are now full. ``ids`` holds the documents' tokens one after
        another, ``ends`` where each document ends."""
        total = np.diff(ends, prepend=0)
        full, rest = np.divmod(total, self.capacity)
        pieces = full + self.counts[rest]
        doc = np.repeat(np.arange(len(total)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        cut = nth - full[doc]  # which piece of the rest
        length = np.where(cut < 0, self.capacity, self.sizes[np.minimum(self.starts[rest][doc] + np.maximum(cut, 0), len(self.sizes) - 1)])
        before = np.cumsum(length) - length
        start = before - np.repeat((np.cumsum(total) - total), pieces)
        order = np.argsort(length, kind="stable")
        bounds = np.flatnonzero(np.diff(length[order], prepend=-1))
        chosen, sequence, slot, old = [], [], [], []
        for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(order)]):
            size = int(length[order[a]])
            k = self.capacity // size
            held = self.waiting.get(size, [])
            n = (len(held) + b - a) // k * k  # pieces that fill sequences
            if n:
                first = self._sequences(n // k)
                taken = order[a:a + n - len(held)]
                place = np.arange(n)
                old += [(*h[:2], size, zlib.crc32(h[3]), h[2], first, i * size) for i, h in enumerate(held)]
                chosen.append(taken)
                sequence.append(first + place[len(held):] // k)
                slot.append(place[len(held):] % k * size)
                held, a = [], a + len(taken)
            self.waiting[size] = held + [(doc_ids[doc[i]], int(start[i]), int(total[doc[i]]), ids[before[i]:before[i] + size].tobytes())
                                         for i in order[a:b].tolist()]
        if not chosen:
            return None
        i = np.concatenate(chosen)
        crc = [zlib.crc32(ids[x:y]) for x, y in zip(before[i].tolist(), (before[i] + length[i]).tolist())]
        new = pa.record_batch([pa.array([doc_ids[d] for d in doc[i].tolist()], pa.int64()), pa.array(start[i]), pa.array(length[i]),
                               pa.array(crc, pa.int64()), pa.array(total[doc[i]]), pa.array(np.concatenate(sequence)),
                               pa.array(np.concatenate(slot))], schema=_SCHEMA)
        return pa.concat_batches([new, _batch(old)]) if old else new

    def finish(self) -> pa.RecordBatch | None:
        """The pieces that waited, end to end."""
        left = [(*h, size) for size in sorted(self.waiting, reverse=True) for h in self.waiting.pop(size)]
        tokens = sum(h[4] for h in left)
        room = [self.capacity] * (tokens // self.capacity) + powers_of_two(tokens % self.capacity)
        rows, sequence, offset, at = [], self._sequences(len(room)), 0, 0
        for doc_id, start, total, ids, size in left:
            done = 0
            while done < size:
                n = min(size - done, room[at] - offset)
                rows.append((doc_id, start + done, n, zlib.crc32(ids[4 * done:4 * (done + n)]), total, sequence + at, offset))
                done, offset = done + n, offset + n
                if offset == room[at]:
                    at, offset = at + 1, 0
        return _batch(rows) if rows else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids with the end token behind each document, where each document then ends)."""
    n = len(offsets) - 1
    ends = offsets[1:] + np.arange(1, n + 1)
    out = np.full(len(ids) + n, end_id, "<u4")
    mask = np.ones(len(out), bool)
    mask[ends - 1] = False
    out[mask] = ids
    return out, ends


def pack(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_id: int = END_ID, classes: int = CLASSES,
         whole: int = WHOLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a vocabulary file

    def run(batches):
        from pyspark import TaskContext
        encode = encoder(shared.value).encode
        packer = Packer(capacity, classes, whole, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for part in slices(batch):
                out = packer.add(part.column("doc_id").to_pylist(), *with_end(*encode(texts_of(part)), end_id))
                if out is not None:
                    yield out
        out = packer.finish()
        if out is not None:
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_text())
