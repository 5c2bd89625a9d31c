"""Spark operators against the plain-Python oracles on seeded random inputs.
Many random cases go through one Spark job, keyed by a case id."""

import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import classify as CLS
from shelfspark.operators import keywords as KW
from shelfspark.operators import pii as PII
from shelfspark.operators.dictionary import keyword_frame, seed_categories
from shelfspark.operators.groups import greedy_assign
from shelfspark.operators.learn import apply_corrections
from shelfspark.plans.organize import collision_names
from shelfspark.streaming.jobs import throttle_batch
from tests import oracles as O

WORDS = ["plan", "report", "invoice", "学习", "发票", "exam", "note", "Tax", "the", "a", "周报", "home", "x", "work",
         "review", "deadline", "(memo)", "budget!", "项目", "travel", "plane", "airplane", "re", "c'est", "été"]


def _text(rng, n):
    seps = [" ", "  ", "\n", "　", "\t", " "]
    return "".join(rng.choice(WORDS) + rng.choice(seps) for _ in range(n))


@pytest.mark.parametrize("method", ["arrow", "shuffle"])
def test_keywords_vs_python(spark, method):
    rng = random.Random(1)
    docs = [(i, _text(rng, rng.randint(0, 40))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.keywords for r in KW.keyword_arrays(df, method=method).collect()}
    for i, t in docs:
        assert got.get(i, []) == O.py_keywords(t), (i, t)


@pytest.mark.parametrize("method,bound", [("arrow", 500_000), ("arrow", 0), ("shuffle", 0)])
def test_tfidf_vs_python(spark, method, bound):
    rng = random.Random(8)
    extra = ["项目plan进度", "(学)", "a学习b", "かな漢字", "ΑΣ", "“x”", "学习，复习", "[x]", "e.g."]
    docs = [(i, "".join(rng.choice(WORDS + extra) + rng.choice([" ", "\u3000", "\x1c", "\u2028", "\n"]) for _ in range(rng.randint(0, 30))))
            for i in range(150)] + [(150, None), (151, ""), (152, "[Image: x.png] word word")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {}
    for r in KW.tfidf_keywords(df, top_k=5, method=method, broadcast_terms=bound).orderBy("doc_id", "rank").collect():
        got.setdefault(r.doc_id, []).append((r.keyword, r.cnt, r.df))
    assert got == O.py_tfidf(docs, 5)


def test_keywords_beside_the_rows(spark):
    docs = [(1, "b a b", "x"), (2, None, None), (3, "[p]", "y"), (None, "Zwei zwei drei", "z"), (5, "", "w")]
    df = spark.createDataFrame(docs, "doc_id long, text string, other string").repartition(2)
    got = sorted(((r.doc_id, r.text, r.other, r.keywords) for r in KW.with_keywords(df, "text").collect()), key=str)
    assert got == sorted([(1, "b a b", "x", []), (2, None, None, []), (3, "[p]", "y", []), (None, "Zwei zwei drei", "z", ["zwei", "drei"]),
                          (5, "", "w", [])], key=str)
    assert KW.with_keywords(df.limit(0), "text").collect() == []


@pytest.mark.parametrize("matcher", ["join", "ac"])
def test_classify_vs_python(spark, matcher):
    rng = random.Random(2)
    cats = [{"id": c, "extensions": e, "active": a} for c, e, a in
            [("study", [".pdf"], True), ("memo", [], True), ("task", [], True), ("finance", [".csv", ".pdf"], True),
             ("off", [], False)]]
    kw_rows = [(rng.choice([c["id"] for c in cats]), rng.choice(WORDS).lower().strip("(!)"), rng.choice(["zh", "en"]),
                rng.choice([0.1, 0.3, 0.7, 1.0, 1.5, 2.15, 3.0])) for _ in range(40)]
    seen, rows = set(), []
    for r in kw_rows:
        if (r[0], r[1], r[2]) not in seen and r[1]:
            seen.add((r[0], r[1], r[2]))
            rows.append(r)
    cat_df = spark.createDataFrame([(c["id"], i, c["id"], c["id"], c["extensions"], 0, c["active"])
                                    for i, c in enumerate(cats)],
                                   "id string, ord int, name_zh string, name_en string, extensions array<string>, "
                                   "sample_count long, is_active boolean")
    kw_df = keyword_frame(spark, [(c, k, l, w, "user") for c, k, l, w in rows])
    files = []
    for i in range(300):
        name = rng.choice(WORDS).strip("(!)") + rng.choice(["", "_v1", " plan"]) + rng.choice([".pdf", ".csv", ".txt", ""])
        files.append((i, name, _text(rng, rng.randint(0, 8)), [rng.choice(WORDS) for _ in range(rng.randint(0, 3))]))
    fdf = spark.createDataFrame(files, "file_id long, original_name string, extracted_text string, "
                                       "keywords array<string>")
    got = {r.file_id: r for r in CLS.classify(fdf, cat_df, kw_df, locale="en", matcher=matcher).collect()}
    for i, name, text, kws in files:
        best, conf, sugg = O.py_classify(name, text, kws, cats, rows)
        r = got[i]
        assert r.category_id == best, (name, text, kws)
        assert abs(r.confidence - conf) < 1e-12
        assert r.suggestions == sugg


@pytest.mark.parametrize("max_events", [200_000, 3])
def test_learning_fold_vs_python(spark, max_events):
    rng = random.Random(3)
    cats = seed_categories(spark)
    names = {}
    from shelfspark import constants as K
    for c in K.SEED_CATEGORIES:
        for n in (c["name_zh"], c["name_en"], c["id"]):
            names.setdefault(n, c["id"])
    init_rows = [("study", "exam", "en", 1.0, "seed"), ("memo", "note", "zh", 2.0, "seed"),
                 ("task", "plan", "en", 2.9, "seed"), ("work", "report", "mixed", 0.2, "user")]
    kws = keyword_frame(spark, init_rows)
    vocab = ["exam", "note", "plan", "report", " Plan ", "学习", "", "发票 x"]
    cat_names = list(names) + ["nope"]
    corr = [(i, rng.choice(cat_names), rng.choice(cat_names),
             [rng.choice(vocab) for _ in range(rng.randint(0, 4))]) for i in range(150)]
    cdf = spark.createDataFrame([(s, "p", f, t, k) for s, f, t, k in corr],
                                "seq long, filepath string, from_category string, to_category string, "
                                "keywords array<string>")
    got = {(r.category_id, r.keyword, r.locale): (r.weight, r.source)
           for r in apply_corrections(kws, cats, cdf, max_events_per_key=max_events).collect()}
    want = O.py_learn({(c, k, l): (w, s) for c, k, l, w, s in init_rows}, names, corr)
    assert got == want


def test_pii_vs_python(spark):
    rng = random.Random(4)
    parts = ["姓名: 张琳坤", "身份证号: 41102220040318007X", "13812345678", "138-1234-5678", "abc@example.com",
             "邮箱abc@x.com", "C1234567", "CD1234567", "MC123456", "Mc123456", "dc12345", "D-C1-2345-6",
             "广东省深圳市南山区科技园路100号3楼", "北京市朝阳区建国路88号", "😀", "plain text", "é", " ", "\n"]
    docs = [(i, "".join(rng.choice(parts) + rng.choice([" ", "", ", "]) for _ in range(rng.randint(0, 8))))
            for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in PII.redact_documents(df).collect()}
    for i, t in docs:
        want = O.py_pii(t)
        r = got[i]
        assert [(f.type, f.start, f.end, f.redacted) for f in r.findings] == want, t
        assert r.redacted_text == O.py_redact(t)
    from shelfspark.functions import pii as P
    native = {r.doc_id: r for r in df.select("doc_id", P.findings(F.col("text")).alias("f")).collect()}
    assert all([(f.type, f.start, f.end, f.redacted) for f in native[i].f] == [(f.type, f.start, f.end, f.redacted) for f in got[i].findings] for i, _ in docs)
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [(r.redacted_text, r.findings, r.safe_description) for r in PII.redact_documents(empty).orderBy("doc_id").collect()] == [(None, [], ""), ("", [], "")]


def test_pii_cost_follows_the_matches():
    """Four times the matches take about four times as long, whether they overlap or not."""
    import time
    for unit in ("mail a.b@c.org and C1234567@x.org ", "13812345678 MC123456, "):
        def seconds(n):
            began = time.perf_counter()
            found = PII.find(unit * n)
            assert len(PII.hidden(unit * n, found)) > n
            return time.perf_counter() - began, len(found)
        seconds(100)
        (a, n), (b, m) = min(seconds(500) for _ in range(3)), min(seconds(2000) for _ in range(3))
        assert m == 4 * n and n >= 1000 and b < 9 * a


def test_greedy_rounds_vs_sequential(spark):
    rng = random.Random(5)
    pairs = set()
    for d in range(40):
        files = [f"f{j}" for j in range(rng.randint(1, 12))]
        stems = [f"s{j}" + "x" * rng.randint(0, 2) for j in range(rng.randint(1, 8))]
        for f in files:
            for s in rng.sample(stems, rng.randint(1, len(stems))):
                pairs.add((f"d{d}", s, f"d{d}/{f}"))
    pairs = sorted(pairs)
    df = spark.createDataFrame(pairs, "directory string, stem string, path string")
    counts = df.groupBy("directory", "stem").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    ranked = df.join(counts.select("directory", "stem", "n",
                                   F.struct((-F.col("n")).alias("neg_n"), F.length("stem").alias("len"),
                                            F.col("stem").alias("stem")).alias("rank")), ["directory", "stem"])
    taken = greedy_assign(ranked, 2, checkpoint=False)
    got = {}
    for r in taken.collect():
        got.setdefault((r.directory, r.stem), []).append(r.path)
    got = {k: sorted(v) for k, v in got.items()}
    assert got == O.py_greedy(pairs)


def test_greedy_rounds_without_folder_keep_no_plan(spark):
    pairs = [("d", s, f"d/{f}") for s, files in (("a", "123"), ("ab", "345"), ("abc", "567"), ("abcd", "78")) for f in files]
    ranked = spark.createDataFrame(pairs, "directory string, stem string, path string").withColumn("n", F.lit(2)).withColumn(
        "rank", F.struct((-F.col("n")).alias("neg_n"), F.length("stem").alias("len"), "stem"))
    taken = greedy_assign(ranked, 2, checkpoint=False)
    assert "Join" not in taken._jdf.queryExecution().analyzed().toString()
    assert sorted((r.stem, r.path[2:]) for r in taken.collect()) == [("a", "1"), ("a", "2"), ("a", "3"), ("ab", "4"), ("ab", "5"), ("abc", "6"), ("abc", "7")]


@pytest.mark.parametrize("partitions,bound", [(1, None), (5, None), (5, 0), (5, 7), (3, 100)])
def test_throttle_vs_python(spark, partitions, bound):
    rng = random.Random(6)
    from datetime import datetime, timedelta
    base = datetime(2024, 1, 1)
    ev = []
    for i in range(600):
        ev.append((rng.choice(["a", "b", "c"]), rng.randint(0, 400) + rng.choice([0, 0.5]), i))
    df = spark.createDataFrame([(k, i, base + timedelta(seconds=t)) for k, t, i in ev],
                               "key string, event_id long, ts timestamp_ntz")
    got = sorted((r.key, r.event_id, r.allowed, r.remaining)
                 for r in throttle_batch(df, 5, 60, partitions=partitions, key_bound=bound).collect())
    assert got == sorted(O.py_throttle(ev, 5, 60))


@pytest.mark.parametrize("wide", [4, 0])
def test_endless_burst_vs_python(spark, monkeypatch, wide):
    """One key without a pause, of steady attempts (which never forget) and of random ones, in segments."""
    from datetime import datetime, timedelta

    from shelfspark.streaming import jobs
    monkeypatch.setattr(jobs, "THROTTLE_WIDE_ROUNDS", wide)
    rng = random.Random(9)
    at, ev = {"steady": 0.0, "random": 0.0, "short": 0.0}, []
    for i in range(400):
        at["steady"] += 7
        at["random"] += rng.choice([0, 1, 3, 40])
        ev += [("steady", at["steady"], 2 * i), ("random", at["random"], 2 * i + 1)]
    ev += [("short", float(i), 5000 + i) for i in range(9)]
    rng.shuffle(ev)
    df = spark.createDataFrame([(k, i, datetime(2024, 1, 1) + timedelta(seconds=t)) for k, t, i in ev], "key string, event_id long, ts timestamp_ntz")
    got = sorted((r.key, r.event_id, r.allowed, r.remaining) for r in throttle_batch(df, 5, 60, partitions=4, key_bound=150).collect())
    assert got == sorted(O.py_throttle(ev, 5, 60))


@pytest.mark.parametrize("rows", [200_000, 0])
def test_collisions_vs_sequential(spark, monkeypatch, rows):
    from shelfspark.plans import organize
    monkeypatch.setattr(organize, "FOLD_ROWS", rows)
    rng = random.Random(7)
    names = ["a.txt", "a_1.txt", "a_2.txt", "b", "b_1", "c.tar.gz", "c.tar_1.gz", ".hidden", "d_01.txt"]
    existing = {(rng.choice(["x", "y"]), rng.choice(names)) for _ in range(8)}
    incoming = [(i, rng.choice(["x", "y"]), rng.choice(names)) for i in range(40)]
    e = spark.createDataFrame(sorted(existing), "dir string, name string")
    inc = spark.createDataFrame(incoming, "order int, dir string, name string")
    got = {r.order: r.final_name for r in collision_names(e, inc).collect()}
    assert got == O.py_collisions(existing, incoming)


def test_forced_distributed_paths_equal_default(spark):
    """The hot-key paths (bounded learning rounds, throttle bursts) give the default paths'
    results, keyword ids included, on real tables."""
    from shelfspark import fixtures as X
    from tests.conftest import SF_SMALL

    def same(a, b):
        assert a.count() == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0

    cats, kws = X.dictionary(spark)
    corr = X.corrections(spark, SF_SMALL)
    same(apply_corrections(kws, cats, corr), apply_corrections(kws, cats, corr, max_events_per_key=2))
    att = X.attempts(spark, SF_SMALL)
    same(throttle_batch(att, 5, 86400), throttle_batch(att, 5, 86400, key_bound=0))
