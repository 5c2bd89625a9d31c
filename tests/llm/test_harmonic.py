import zlib

import numpy as np
import pytest

from shelfspark.llm.harmonic import Packer, cut_table, pack, powers_of_two
from shelfspark.llm.packing import tokenizer_text
from tests.conftest import SF_SMALL
from tests.llm.util import LONG, docs, rows


def padding(used, capacity):
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in used)


def check_rows(want, got, capacity):
    """``want``: (doc_id, its ids) in any order, repeated rows included. Every id lies in one piece,
    sequences are gapless and not too long; returns their lengths."""
    by_doc = {}
    for r in got:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    copies = {}
    for i, ids in want:
        copies.setdefault((i, len(ids)), []).append(ids)
    assert by_doc.keys() == copies.keys()
    for key, texts in copies.items():
        left = [(r["start"], r["length"], r["ids_crc32"]) for r in by_doc[key]]
        for ids in texts:  # a chain of pieces from 0 to the end for each copy
            at = 0
            while at < len(ids):
                fit = next(p for p in left if p[0] == at and p[2] == zlib.crc32(ids[at:at + p[1]].tobytes()))
                left.remove(fit)
                at += fit[1]
            assert at == len(ids)
        assert not left
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    used = []
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        used.append(at)
    return used


def token_ids(pairs):
    from tokenizers import Tokenizer
    tk = Tokenizer.from_str(tokenizer_text())
    return [(i, np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t in pairs]


@pytest.mark.parametrize(("capacity", "classes", "whole"), [(2048, 64, 32), (64, 8, 4), (64, 1, 0), (60, 60, 0), (7, 3, 2), (1, 1, 1)])
def test_pieces_of_a_rest(capacity, classes, whole):
    sizes, starts, counts = cut_table(capacity, classes, whole)
    ends = {capacity // k for k in range(1, classes + 1)}
    for r in range(capacity):
        pieces = sizes[starts[r]:starts[r] + counts[r]].tolist()
        assert sum(pieces) == r
        assert all(p in ends or p <= max(whole, min(ends)) for p in pieces)


def test_powers_of_two():
    assert [powers_of_two(n) for n in (0, 1, 6, 2047)] == [[], [1], [4, 2], [1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1]]


@pytest.mark.parametrize("seed", range(6))
def test_fixed_counts_by_class(seed):
    """Every sequence of a class holds as many pieces as fit, but for those that end the partition."""
    rng = np.random.default_rng(seed)
    capacity = [64, 100, 2048][seed % 3]
    packer, out, want = Packer(capacity, 8, 4), [], []
    for part in range(3):
        lengths = rng.integers(1, 3 * capacity, 80 if part else 0)
        ids = rng.integers(0, 50000, lengths.sum()).astype("<u4")
        ends = np.cumsum(lengths)
        names = [1000 * part + i for i in range(len(lengths))]
        want += [(n, ids[e - k:e]) for n, e, k in zip(names, ends.tolist(), lengths.tolist())]
        batch = packer.add(names, ids, ends)
        out += batch.to_pylist() if batch else []
    full = {}
    for r in out:
        full.setdefault(r["sequence_id"], set()).add((r["length"], r["offset"]))
    for pieces in full.values():
        size = {p[0] for p in pieces}
        assert len(size) == 1
        assert {p[1] for p in pieces} == {i * min(size) for i in range(capacity // min(size))}
    held = sum(size * len(p) for size, p in packer.waiting.items())
    assert held < capacity * len(packer.waiting) + 1
    tail = packer.finish().to_pylist()
    assert padding(check_rows([(n, x) for n, x in want], out + tail, capacity), capacity) <= sum(
        capacity % min(p)[0] for p in full.values())


def test_cases(spark):
    texts = [None, "", " ", "It's THE end... don't 123", "日本語 テキスト 🙂", LONG, "same", "same", "a\x1cb\x85c d", "w " * 333]
    ids = [*range(6), None, None, 8, 9]
    got = rows(pack(docs(spark, texts, ids), tokenizer_text(), capacity=64, classes=8, whole=4))
    check_rows(token_ids(zip(ids, texts)), got, 64)
    assert rows(pack(docs(spark, []), tokenizer_text())) == []


def test_whole_table_has_little_padding(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = rows(pack(df.repartition(5), tokenizer_text()))
    want = token_ids([(r["doc_id"], r["text"]) for r in df.collect()])
    used = check_rows(want, got, 2048)
    assert padding(used, 2048) <= 0.002 * sum(len(x) for _, x in want)
    assert len(got) <= 4 * len(want)
