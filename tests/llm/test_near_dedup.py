import random
import re

import numpy as np
import pyarrow as pa
import pytest

from shelfspark.llm import near_dedup as N
from shelfspark.llm.components import components
from tests.conftest import SF_SMALL
from tests.llm.util import LONG, docs, rows

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)])


def brute(pairs, share):
    sets = [brute_set(t) for _, t in pairs]
    group = list(range(len(pairs)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= share * (len(sets[i]) + len(sets[j]) - common):
                    group[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(pairs):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(pairs, sets))), key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(df)), key=str)


def variants(seed, n, length, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, length))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, int(len(copy) * edits)))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(rng.choice([" ", "\n", "  \t"]).join(copy).upper() if rng.random() < .3 else " ".join(copy))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("share,length", [(85, 12), (80, 60), (85, 400)])
def test_all_links_found(spark, share, length, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_SETS", 3)  # many blocks a cluster
    texts = variants(length, 60, length, 0.03)
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    df = N.near_groups(docs(spark, texts, ids), share=share)
    assert got(df) == brute(list(zip(ids, texts)), share)
    for r in rows(df):
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_cases(spark):
    texts = [None, "", " \n", "one", "ONE", "one two", "a b c d e", "a b c d e f g h i j", LONG, LONG + " end", "é É", "x", "x", "x y z", "x y z"]
    ids = [*range(11), 11, 11, None, None]
    df = N.near_groups(docs(spark, texts, ids), share=85)
    assert got(df) == brute(list(zip(ids, texts)), 85)
    assert rows(N.near_groups(docs(spark, []))) == []


def test_whole_table(spark):
    pairs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert got(N.query(spark, SF_SMALL)) == brute(pairs, 85)


def test_estimate_and_registers():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        h = rng.integers(0, 2 ** 64, 1200, dtype=np.uint64)
        a, b = np.sort(h[:1000]), np.sort(h[200:])
        regs, filled = N.hyper_registers(np.concatenate([a, b]), np.array([0, 1000, 2000]))
        errors.append(N.estimate(regs[0], filled[0], 1000, regs[1:], filled[1:], np.array([1000]))[0][0] - 800 / 1200)
    assert abs(np.mean(errors)) < 0.03
    smallest = min(int(x) for x in a if int(x) >> 57 == 5) & ((1 << 57) - 1)
    zeros = 57 - smallest.bit_length()
    regs, _ = N.hyper_registers(a, np.array([0, 1000]))
    assert int(regs[0, 5]) == zeros << 10 | (smallest << (zeros + 8)) % (1 << 64) >> 54


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(1, 90)] + [(i, i + 1) for i in range(2000, 2060)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    out = {r["vertex"]: r["component"] for r in rows(components(spark.createDataFrame(edges, "a long, b long")))}
    assert out == {x: find(x) for x in root}


def test_sets_do_not_collide():
    texts = variants(5, 40, 80, 0.1)
    hashes, offsets = N.shingle_sets(pa.array(texts, pa.large_string()))
    assert [b - a for a, b in zip(offsets[:-1], offsets[1:])] == [len(brute_set(t)) for t in texts]


def test_every_row_of_the_kept_identifier_is_kept(spark, tmp_path):
    """The query's ``kept`` is doc_id = component_id, also where an identifier is repeated with other texts."""
    from shelfspark.llm.near_dedup import query
    words = " ".join(f"w{i}" for i in range(60))
    docs(spark, [words, words + " end", "other text of some few words", words], [1, 2, 1, 3]).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in rows(query(spark, str(tmp_path))))
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]
