"""Helpers for Arrow batches of text inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a step holds at a time, whatever the number of rows of a batch.
SLICE_BYTES = 1 << 20

#: Python's white space other than the blank, as RE2 text.
_COMMON_SPACE = "\t\n\v\f\r"
_RARE_SPACE = "[\\x1c-\\x1f\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Runs of rows whose texts hold at most ``limit`` bytes together; a longer text is one by itself."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        until = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, until - at)
        at = until


def pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, offsets, distinct pieces): the texts cut at every white space character. A run of them
    leaves empty pieces; row i has the codes offsets[i]:offsets[i + 1]."""
    texts = texts.cast(pa.large_string())
    for c in _COMMON_SPACE:
        texts = pc.replace_substring(texts, c, " ")
    rare = pc.match_substring_regex(texts, _RARE_SPACE)
    if pc.any(rare).as_py():
        texts = pc.replace_with_mask(texts, rare, pc.replace_substring_regex(texts.filter(rare), _RARE_SPACE, " "))
    lists = pc.split_pattern(texts, " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets - offsets[0], coded.dictionary


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, … of every range, in order."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
