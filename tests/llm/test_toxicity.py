import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from shelfspark.llm.toxicity import FOLDS, HELD_OUT, LexiconAutomaton, Scorer, edits, fit, query, score
from tests.llm.util import LONG, docs, rows


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("budget", [edits, lambda t: 2, lambda t: len(t) % 2])
def test_automaton_against_distances(budget):
    rng = random.Random(0)
    terms = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 11))) for _ in range(8)} | {"tête", "abc", "abcd"})
    automaton = LexiconAutomaton(terms, budget)
    words = ["", "x", *terms]
    for _ in range(600):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            w[i:i + rng.randint(0, 1)] = rng.choice(["", "a", "z", "é", "bc"])
        words.append("".join(w))
    term, distance = automaton.match(words)
    for w, t, d in zip(words, term, distance):
        near = min(((_distance(w, x), k) for k, x in enumerate(terms) if _distance(w, x) <= budget(x)), default=None)
        assert (None if t < 0 else (d, t)) == near or (near and t >= 0 and d == near[0]), w


def test_spelling_and_quotation():
    s = Scorer(["nastyword", "vile"], [3.0, 3.0])
    texts = ["a nastyword here", "a nastywird here", "a n4styw0rd here", 'he said "nastyword" once', "a nasty word here", "Nastyword!", "", "vyle vile"]
    x = s.features(pa.array(texts, pa.large_string()))
    assert x[:, 0].tolist() == [3, 0, 0, 0, 0, 3, 0, 3]
    assert x[:, 1].tolist() == [0, 3, 3, 0, 0, 0, 0, 0]
    assert x[:, 2].tolist() == [0, 0, 0, 3, 0, 0, 0, 0]


SF = "/root/testdata/sf0.1"  # the smallest table with enough labels to hold some out


def test_held_out_accuracy(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = rows(query(spark, SF))
    assert len(got) == table.count()
    out = [(truth[r["doc_id"]], r["score"], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % FOLDS == HELD_OUT) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert np.mean([t == p for t, _, p in out]) > 0.97
    toxic, clean = [s for t, s, _ in out if t], [s for t, s, _ in out if not t]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.93


def test_cases(spark):
    texts = [None, "", LONG, "x" * 100000] + [f"calm words {i} here" for i in range(60)] + [f"you {w} badterm {w} now" for w in map(str, range(60))] + ["you badterrm now"] * 2
    ids = [*range(len(texts) - 1), None]
    df = docs(spark, texts, ids)
    labels = spark.createDataFrame([(i, int("badterm" in t)) for i, t in zip(ids, texts) if t and len(t) < 1000] + [(None, 1), (3, None)], "doc_id long, toxic int")
    scorer = fit(df, labels)
    assert scorer.automaton.terms == ["badterm"] or "badterm" in scorer.automaton.terms
    got = {r["doc_id"]: r for r in rows(score(df, scorer))}
    assert len(got) == len(texts) and got[70]["predicted"] == 1 and got[0]["predicted"] == got[1]["predicted"] == got[2]["predicted"] == got[10]["predicted"] == 0
    assert got[0]["score"] == got[1]["score"] and not got[None]["held_out"]
    assert rows(score(docs(spark, []), scorer)) == []
    assert {r["score"] for r in rows(score(df, fit(df, labels.limit(0))))} == {0.0}
