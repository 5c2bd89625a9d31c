import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.llm.periodic_runs import find_runs, rewritten, runs_of
from tests.conftest import SF_SMALL
from tests.llm.util import LONG, docs, rows


def brute_runs(words):
    """Every start and period tried; a run is kept with the smallest period of its stretch."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1) if j > i else i + 1
    # a stretch has the smallest period that fits it, q apart throughout
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best and (*best, 1000 * best[1] // best[2]) or (None,) * 4),
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def tuples(df):
    return sorted((tuple(r.values()) for r in rows(df)), key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4))
def test_small_alphabets_against_brute_force(texts):
    offsets = np.cumsum([0, *map(len, texts)])
    found = runs_of(np.array([c for t in texts for c in t], np.int64), offsets)
    assert {i: brute_runs(t) for i, t in enumerate(texts) if brute_runs(t)} == found


@pytest.mark.parametrize("seed", range(8))
def test_nested_periods_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    words = []
    for _ in range(12):
        unit = rng.integers(0, 3, rng.integers(1, 9)).tolist()
        inner = unit * int(rng.integers(1, 9))
        words += (inner + rng.integers(0, 4, rng.integers(0, 4)).tolist()) * int(rng.integers(1, 6))
    assert runs_of(np.array(words, np.int64), np.array([0, len(words)])).get(0, []) == brute_runs(words)


def test_fibonacci_word():
    a, b = "0", "01"
    while len(b) < 300:
        a, b = b, b + a
    words = [int(c) for c in b * 5]
    assert runs_of(np.array(words, np.int64), np.array([0, len(words)])).get(0, []) == brute_runs(words)


def test_rewriting():
    assert rewritten(0, 7) is None and rewritten(5, None) is None
    chosen = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    assert [i for i in range(200) if rewritten(9, i) is not None] == chosen


def test_cases(spark):
    texts = [None, "", " \t\n\v\f\r ", "a", "x " * 50, "  la la\tla la\nla la la  end", "a b c d " * 4, "a b c d " * 3, LONG[:9000],
             "no\xa0break\x85here \x1c " * 6, "same same same same same same", "same same same same same same", "a b a b a b a",
             "Ä ä Ä ä Ä ä Ä ä", "x y " * 20 + "z " + "x y " * 20, "a a a a a", *["one two three four five six seven"] * 60]
    ids = [*range(len(texts) - 2), None, None]
    ids[11] = 10
    assert tuples(find_runs(docs(spark, texts, ids))) == sorted((brute(i, t) for i, t in zip(ids, texts)), key=str)
    assert rows(find_runs(docs(spark, []))) == []


def test_long_periodic_text(spark):
    got = rows(find_runs(docs(spark, [LONG, "a " * 200_000], [1, 2])))
    assert [(r["doc_id"], r["n_runs"], r["start"], r["length"], r["period"]) for r in sorted(got, key=lambda r: r["doc_id"])] == [
        (1, 1, 0, 36000, 9), (2, 1, 0, 200_000, 1)]


def test_whole_table_against_brute_force(spark):
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = sorted((brute(r["doc_id"], r["text"]) for r in table.collect()), key=str)
    assert tuples(find_runs(table)) == want
    assert any(r[1] for r in want)
