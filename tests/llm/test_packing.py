import zlib

import numpy as np
import pytest

from shelfspark.llm.packing import pack, sum_of_squares, tokenizer_text
from tests.conftest import SF_SMALL
from tests.llm.util import LONG, docs, rows


def _brute_bins(lengths, capacity):
    """Every choice tried on the whole count table."""
    bins, out = [], []
    for s in lengths:
        def cost(k):
            gaps = [g - s if j == k else g for j, g in enumerate(bins)] + ([capacity - s] if k == len(bins) else [])
            n = np.bincount([g for g in gaps if g > 0] or [0], minlength=capacity + 1)
            n[0] = 0
            return int((n ** 2).sum())
        fits = [k for k, g in enumerate(bins) if g >= s] + [len(bins)]
        k = min(fits, key=lambda k: (cost(k), bins[k] if k < len(bins) else capacity + 1))
        if k == len(bins):
            bins.append(capacity)
        out.append(capacity - bins[k])
        bins[k] -= s
    return len(bins), sorted(bins)


@pytest.mark.parametrize("seed", range(5))
def test_rule_against_all_choices(seed):
    lengths = np.random.default_rng(seed).integers(1, 21, 60)
    bins, offsets = sum_of_squares(lengths, 20)
    gaps = [20 - int(lengths[bins == b].sum()) for b in range(bins.max() + 1)]
    assert (len(gaps), sorted(gaps)) == _brute_bins(lengths.tolist(), 20)


def _check(pairs, got, capacity):
    from tokenizers import Tokenizer
    tk = Tokenizer.from_str(tokenizer_text())
    want = []
    for i, t in pairs:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, s, len(ids[s:s + capacity]), zlib.crc32(ids[s:s + capacity].tobytes()))
                 for k, s in enumerate(range(0, len(ids), capacity))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(x[3] for x in want) / capacity


def test_cases(spark):
    texts = [None, "", " ", "\n\n", "It's THE end... don't <|endoftext|> 123 a_b \t x y", "Été ÜBER ét́ ΑΣ İstanbul ﬁ",
             "日本語 テキスト 🙂", LONG, "same", "same", "...!!", "a\x1cb\x85c d"]
    ids = [*range(len(texts) - 2), None, None]
    _check(list(zip(ids, texts)), rows(pack(docs(spark, texts, ids), tokenizer_text(), capacity=64)), 64)
    assert rows(pack(docs(spark, []), tokenizer_text())) == []


def test_whole_table_is_dense(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    pairs = [(r["doc_id"], r["text"]) for r in df.collect()]
    used, least = _check(pairs, rows(pack(df, tokenizer_text())), 4096)
    assert used <= 1.01 * least + 1
