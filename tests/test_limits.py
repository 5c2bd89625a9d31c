"""Shrinking every chunk size changes nothing in a result."""

import pytest

from shelfspark import fixtures as X
from shelfspark.operators import catalog, classify
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("matcher", ["ac", "join"])
def test_dictionary_in_chunks(spark, monkeypatch, matcher):
    cats, kws = X.dictionary(spark)
    odd = spark.createDataFrame([(999999, "zzz", "qqq")], "file_id long, original_name string, extracted_text string")
    files = (X.raw_files(spark, SF_SMALL).filter("file_id < 60").select("file_id", "original_name", "extracted_text").unionByName(odd)
             .withColumn("keywords", X.F.when(X.F.col("file_id") < 30, X.F.array(X.F.lit("exam"))).otherwise(X.F.array().cast("array<string>"))))
    rows = lambda: sorted(str(r) for r in classify.classify(files, cats, kws, matcher=matcher).collect())
    whole = rows()
    monkeypatch.setattr(classify, "BROADCAST_KEYWORD_CHUNK", 40)
    assert rows() == whole
    found = classify.dictionary_matches(classify.prepare(files), cats, kws, keep_unmatched=True, matcher=matcher)
    assert found.filter("file_id = 999999").count() == 1 == found.filter("file_id = 999999 and category_id is null").count()


def test_query_batch_against_like(spark, monkeypatch):
    """Whatever is broadcast and however many queries a pass takes, hits are those of LIKE."""
    import re
    d = X.descriptions(spark, SF_SMALL)
    odd = [("p1", "100% SURE_thing of ab"), ("p2", None), ("p3", ""), ("p4", "ÄÖ äö Straße of")]
    d = d.select("path", "description", "updated_at").unionByName(
        spark.createDataFrame(odd, "path string, description string").withColumn("updated_at", X.F.lit(None).cast("timestamp_ntz")))
    terms = ["the", "and of", "zzzz", "ing", "th er", "a", "%", "_", "100%", "s_r", "sure%ing of", "__%", "ÄÖ", "äö", "", "  ", None, "Straße OF ab",
             "of the on in", "\u3000the\u3000"]
    q = spark.createDataFrame(list(enumerate(terms)), "query_id long, query string")
    fold = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    like = lambda t: re.compile("(?s).*" + "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in fold(t)) + ".*")
    rows = [(r.path, r.description) for r in d.collect()]
    want = {(i, p) for i, t in enumerate(terms) if t and t.split() for p, x in rows if x is not None and all(like(w).fullmatch(fold(x)) for w in t.split())}
    found = lambda: {(r.query_id, r.path) for r in catalog.search_batch(d, q, limit=10**6).collect()}
    assert found() == want
    plan = catalog.search_batch(d, q)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    monkeypatch.setattr(catalog, "BROADCAST_QUERIES", 0)
    monkeypatch.setattr(catalog, "SCAN_QUERIES", 2)
    assert found() == want
    assert catalog.search_batch(d, q.limit(0)).collect() == [] == catalog.search_batch(d.limit(0), q).collect()


def test_no_shared_folder_off_local_masters(spark, monkeypatch):
    from shelfspark import session

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

        class getConf:  # noqa: N801
            get = staticmethod(lambda *a: None)

    class Session:
        sparkContext = Context

        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session)
