import numpy as np
import pyarrow as pa

from shelfspark.llm.quality import fit, keep_good, query, score, text_features
from tests.conftest import SF_CHECK
from tests.llm.util import LONG, docs, rows


def test_held_out_accuracy(spark):
    """Fitted on two thirds of the labels, measured on the others."""
    table = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    model = fit(table, labels.where("doc_id % 3 != 0"))
    got = {r["doc_id"]: r for r in rows(score(table, model))}
    assert len(got) == table.count()
    truth = [(r["doc_id"], r["quality"]) for r in labels.where("doc_id % 3 = 0").collect()]
    right = [got[i]["kept"] == bool(q) for i, q in truth]
    assert np.mean(right) > 0.93
    good = [got[i]["kept"] for i, q in truth if q]
    assert np.mean(good) > 0.95
    assert all(0 <= r[c] <= 1 for r in got.values() for c in ("p_text", "p_meta", "score"))


def test_cases(spark):
    texts = [None, "", " \n ", LONG, "x" * 100000, "same text", "same text"] + [f"plain words number {i} stand here and there." for i in range(40)] + ["bad $$$ " * 30] * 40
    ids = [*range(len(texts))]
    ids[6], ids[8] = None, 7
    df = docs(spark, texts, ids)
    labels = spark.createDataFrame([(i, int(t.startswith("plain"))) for i, t in zip(ids, texts) if t and t[:3] in ("pla", "bad") and i is not None]
                                   + [(None, 1), (7, None), (99999, 0)], "doc_id long, quality int")
    got = rows(score(df, fit(df, labels)))
    assert len(got) == len(texts)
    by = {r["doc_id"]: r["kept"] for r in got}
    assert by[20] and not by[80]
    kept = keep_good(df, labels)
    assert kept.schema == df.schema and kept.count() == sum(r["kept"] for r in got)
    assert fit(df, labels.limit(0)) is None and all(r["kept"] for r in rows(score(df, None)))
    none = docs(spark, [])
    assert rows(score(none, fit(df, labels))) == [] and fit(none, labels) is None


def test_features_do_not_depend_on_neighbours():
    texts = ["One two. Three two two\nfour", "", "A b", LONG, "!!! ###"]
    together = text_features(pa.array(texts, pa.large_string()))
    alone = np.vstack([text_features(pa.array([t], pa.large_string())) for t in texts])
    keep = [i for i in range(together.shape[1]) if i not in (7, 8)]
    assert np.allclose(together[:, keep], alone[:, keep], atol=1e-5) and np.allclose(together, alone, atol=0.05)


def test_query_scores_every_document(spark):
    assert query(spark, SF_CHECK).count() == 1000
