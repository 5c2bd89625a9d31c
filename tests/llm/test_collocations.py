import re
from collections import Counter

import numpy as np
import pytest

from shelfspark.llm.collocations import collocations, merged, stripes, tokens, totals
from tests.conftest import SF_SMALL
from tests.llm.util import LONG, docs, rows
import pyarrow as pa

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(pairs, least=10, most=2000):
    f, n, candidates = {}, Counter(), []
    for text, lang in pairs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    p = (lang, *w[i:i + k])
                    f[p] = f.get(p, 0) + 1
    by_lang = {}
    good = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    for p, a in good.items():
        if len(p) == 3 and any(len(q) == 4 and q[0] == p[0] and p[1:] in (q[1:3], q[2:4]) and 100 * b >= 50 * a for q, b in good.items()):
            continue
        cuts = [(1000000 * a * a // (f[p[:k + 1]] * f[(p[0], *p[k + 1:])]), k) for k in range(1, len(p) - 1)]
        s, k = min(cuts)
        by_lang.setdefault(p[0], []).append((-s, -a, " ".join(p[1:]).encode(), f[p[:k + 1]], f[(p[0], *p[k + 1:])]))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0])
                  for lang, found in by_lang.items() for i, x in enumerate(sorted(found)[:most]))


def tuples(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in rows(df))


def table(spark, pairs):
    return spark.createDataFrame([(i, t, g, i, "x") for i, (t, g) in enumerate(pairs)], "doc_id long, text string, lang string, id long, phrase string")


def test_tokens():
    numbers, words, langs = tokens(pa.array(["One two.THREE", "", " \t", "two", "one  two;; x"], pa.large_string()), pa.array(["en", None, "en", "de", None]))
    pairs = [None if i < 0 else (words[int(i)].as_py(), langs[int(i)].as_py()) for i in numbers]
    while pairs[-1] is None:
        pairs.pop()
    assert pairs == [("one", "en"), ("two", "en"), None, ("three", "en"), None, ("two", "de"), None, ("one", "und"), ("two", "und"), None, ("x", "und")]
    assert [len(x) for x in tokens(pa.array([], pa.large_string()), pa.array([], pa.string()))] == [0, 0, 0]


@pytest.mark.parametrize("seed", range(4))
def test_stripes(seed):
    rng = np.random.default_rng(seed)
    numbers = rng.integers(-1, 6, 300).astype(np.int32)
    ids = np.array([10, -1, 12, 13, -1, 15])
    want = Counter((a, b, c if c >= 0 and ids[c] >= 0 else -1) for a, b, c in zip(numbers.tolist(), numbers[1:].tolist(), [*numbers[2:].tolist(), -1])
                   if a >= 0 and b >= 0 and ids[a] >= 0 and ids[b] >= 0)
    got = stripes(numbers, ids)
    assert {(a, b, c): n for a, b, c, n in zip(*(x.tolist() for x in got))} == dict(want)
    twice = merged(*(np.concatenate([x, x[::-1]]) for x in got))
    assert [x.tolist() for x in twice[:3]] == [x.tolist() for x in got[:3]] and (twice[3] == 2 * got[3]).all()
    for a, b, total, longest in zip(*(x.tolist() for x in totals(*got, 3))):
        assert total == sum(n for p, n in want.items() if p[:2] == (a, b))
        assert longest == max([n for p, n in want.items() if p[:2] == (a, b) and p[2] >= 0 and n >= 3], default=0)


PAIRS = [("New York city is big. new york", "en")] * 12 + [("new york, new jersey; a\tb a b", "en"), ("a b c", None), (None, "en"), ("", None),
         ("ä b Ä b", "de"), ("x\x00y z", "de"), (LONG[:5000], "en"), (". , !", "fr"), ("und zwar", "und")] + [("a b c\nd e", "x")] * 11 + [("So So so so", None)] * 4


def test_cases(spark):
    for least in (1, 2, 10):
        assert tuples(collocations(table(spark, PAIRS), least=least)) == brute(PAIRS, least)
    assert tuples(collocations(table(spark, PAIRS), most=2)) == brute(PAIRS, most=2)
    assert rows(collocations(docs(spark, []))) == []
    assert rows(collocations(docs(spark, [None, "", "a b"]))) == []


def test_small_blocks_and_split_stripes(spark):
    want = brute(PAIRS, 2)
    got = collocations(table(spark, PAIRS).repartition(3), least=2, block_bytes=100, bucket_bytes=400, stripe_occurrences=3)
    assert tuples(got) == want


def test_shuffled_word_table(spark, monkeypatch):
    monkeypatch.setattr("shelfspark.llm.collocations.BROADCAST_WORDS", 0)
    assert tuples(collocations(table(spark, PAIRS), least=2)) == brute(PAIRS, 2)


def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert tuples(collocations(df)) == brute([(r["text"], r["lang"]) for r in df.collect()])
