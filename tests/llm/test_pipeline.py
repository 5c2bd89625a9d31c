import corpus_pipeline
from shelfspark.llm.common import without
from shelfspark.llm.crf import ChainField
from shelfspark.llm.exact_dedup import LOWER, UPPER
from shelfspark.llm.pii import redact
from shelfspark.llm.quality import fit, score
from tests.conftest import SF_SMALL
from tests.llm.test_near_dedup import brute_set
from tests.llm.test_packing import _check
from tests.llm.util import docs, rows
from pyspark.sql import functions as F

FOLD = str.maketrans(UPPER, LOWER)


def test_against_brute_force(spark):
    """Every stage's decision restated plainly on the rows that its predecessor kept; the
    classifier's and the field's own decisions are tested with those operators."""
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = {r["doc_id"] for r in rows(score(table, fit(table, spark.read.parquet(f"{SF_SMALL}/labels.parquet")))) if r["kept"]}
    texts = {r["doc_id"]: r["text"] for r in table.collect() if r["doc_id"] in kept}
    last = {}
    for i in sorted(texts):
        last[texts[i].translate(FOLD)] = i
    texts = {i: texts[i] for i in last.values()}
    sets = {i: brute_set(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    left = [i for i in ids if find(i) == i]
    hidden = {r["doc_id"]: r["text"] for r in rows(redact(docs(spark, [texts[i] for i in left], left), ChainField()))}
    used, least = _check([(i, hidden[i]) for i in left], rows(corpus_pipeline.run(spark, SF_SMALL)), 4096)
    assert used <= 1.02 * least + 1


def test_stages_keep_the_columns(spark):
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, SF_SMALL).columns == table.columns


def test_stages_on_odd_rows(spark):
    texts = [None, None, "", "same words", "SAME words", "same words", "x " * 50000, "a@b.cc is here"]
    df = docs(spark, texts, [0, 1, 2, None, 4, 4, 6, None])
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = rows(stage(spark, df, SF_SMALL))
        assert rows(stage(spark, docs(spark, []), SF_SMALL)) == []
        if name == "exact dedup":
            assert len({(r["text"] or "").translate(FOLD) for r in out}) == len(out) == 4
        if name == "near dedup":
            assert sum((r["text"] or "").lower() == "same words" for r in out) == 1


def test_without_keeps_one_of_repeated_rows(spark):
    df = docs(spark, ["a", "a", "b", "c"], [1, 1, 2, None])
    verdicts = spark.createDataFrame([(1, "a", True), (1, "a", False), (2, "b", False), (None, "c", True)], "doc_id long, key string, kept boolean")
    assert sorted(str(r["doc_id"]) for r in rows(without(df, verdicts, F.col("text"), "t"))) == ["1", "None"]
