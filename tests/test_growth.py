"""What grew faster than the input: the same results from work that does not."""

import pytest

from shelfspark import fixtures as X
from shelfspark.operators import classify as CLS
from shelfspark.plans.pipelines import reclassify
from tests.conftest import SF_SMALL

F = X.F


def _odd_files(spark):
    rows = [(1, "notes final.md", "the end of the　thing and a token", ["token", "end"]), (2, "zzz", "qqq", []), (3, None, None, None),
            (4, "contract1.pdf", "für und avec\nmit", ["avec"]), (4, "s_token.pdf", "项目进度报告 project plan", ["plan"]), (5, "b", "big big", ["big"]),
            (None, "misc1.bin", "with from", ["with"])]
    return spark.createDataFrame(rows, "file_id long, original_name string, extracted_text string, keywords array<string>")


@pytest.mark.parametrize("weight", [0.7, 9_000_000_000.0])
def test_two_tables_in_one_scan(spark, monkeypatch, weight):
    """Both classifications are those of classify(), whatever a scan takes, and no hit leaves the scan."""
    cats, old = X.dictionary(spark)
    odd = [(900, "study", "the end", "en", 1.3, "user"), (901, "life", "big", "en", weight, "user"), (902, "work", "", "zh", 0.1, "user"),
           (903, "task", "a　b", "en", 5.0, "user"), (904, "memo", "thing", None, 0.25, "user"), (905, "memo", "thing", "en", 0.25, "user")]
    odd = spark.createDataFrame(odd, "kw_id long, category_id string, keyword string, locale string, weight double, source string")
    new = old.where("keyword <> 'und'").withColumn("weight", F.col("weight") * 1.1).select(*odd.columns).unionByName(odd)
    files = X.keyword_files(spark, SF_SMALL).select("file_id", "original_name", "extracted_text", "keywords").where("abs(file_id) < 60").unionByName(_odd_files(spark))
    rows = lambda df: sorted(map(str, df.collect()))
    want = [rows(CLS.classify(files, cats, t).drop("reason")) for t in (old, new)]
    assert want[0] != want[1]
    for most in (250_000, 40):
        monkeypatch.setattr(CLS, "SCORED_KEYWORDS", most)
        assert [rows(df) for df in reclassify(files, cats, old, new)] == want
    scores = CLS.score_tables(CLS.prepare(files), cats, [old, new])
    assert scores.groupBy("table", "file_id").count().where(F.col("count") > cats.count()).count() == 0


def test_ingest_takes_many_small_files_a_task(spark, tmp_path, monkeypatch):
    from shelfspark.streaming import jobs as J
    inbox = tmp_path / "in"
    inbox.mkdir()
    for i in range(1200):
        (inbox / f"n{i}.txt").write_text(f"exam note {i}")
    seen, cut = {}, J.cut_lineage

    def spy(df, name="stage"):
        seen.setdefault(name, df.rdd.getNumPartitions())
        return cut(df, name)

    monkeypatch.setattr(J, "cut_lineage", spy)
    names = ["spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]
    cats, kws = X.dictionary(spark)
    rows = J.stream_ingest_files(spark, str(inbox), cats, kws)
    assert rows.select("path").distinct().count() == 1200 == rows.count()
    assert seen["ingest-listing"] <= 2 * spark.sparkContext.defaultParallelism < 1200 // 32
    assert [spark.conf.get(n) for n in names] == before


def test_tfidf_moves_contenders_only(spark, monkeypatch):
    from shelfspark.operators import keywords as KW
    docs = X.raw_files(spark, SF_SMALL).select(F.col("file_id").alias("doc_id"), F.col("extracted_text").alias("text"))
    # as many words of one document and of two, ties, fewer than top_k words, none, a null
    docs = docs.unionByName(spark.createDataFrame([(9001, "uno dos tres uno"), (9002, "dos cuatro " + " ".join(f"w{i}" for i in range(40))), (9003, ""), (9004, None), (None, "uno w7")],
                                                  "doc_id long, text string"))
    rows = lambda **more: sorted(map(str, KW.tfidf_keywords(docs, 20, **more).drop("score").collect()))
    want, moved, cut = rows(), {}, KW.cut_lineage

    def spy(df, name="stage"):
        out = cut(df, name)
        moved[name] = out.count()
        return out

    monkeypatch.setattr(KW, "cut_lineage", spy)
    for bound in (0, 5, 300):
        assert rows(broadcast_terms=bound) == want
        assert moved["tfidf-contenders"] >= len(want)
    assert moved["tfidf-contenders"] < KW.word_counts(docs, by_script=True).count() / 2


def test_workers_get_small_batches(spark):
    import __spark_entry__ as entry
    from shelfspark.session import BATCH_BYTES, BATCH_SETTING, small_batches
    before = spark.conf.get(BATCH_SETTING, None)
    try:
        spark.conf.unset(BATCH_SETTING)
        entry.queries()["keywords_freq"](spark, SF_SMALL)
        texts = spark.range(300, numPartitions=1).select(F.repeat(F.lit("exam "), 20_000).alias("text"))

        def sizes(batches):
            import pyarrow as pa
            for b in batches:
                yield pa.record_batch({"n": [b.num_rows], "bytes": [b.nbytes]})

        seen = texts.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r.n for r in seen) == 300 and max(r.bytes for r in seen) < 2 * BATCH_BYTES
        small_batches(spark, False)
        assert spark.conf.get(BATCH_SETTING, None) is None
        spark.conf.set(BATCH_SETTING, "12345678")
        small_batches(spark)
        small_batches(spark, False)
        assert spark.conf.get(BATCH_SETTING) == "12345678"
    finally:
        spark.conf.unset(BATCH_SETTING) if before is None else spark.conf.set(BATCH_SETTING, before)


def test_a_vault_is_written_from_some_text_at_a_time(spark, tmp_path, monkeypatch):
    """Files and their bytes are those of the rows, also where a batch holds several slices, and directories change."""
    from shelfspark.sources.tree import write_files
    rows = [(f"{tmp_path}/v/{'ab'[i % 2]}/{i}.txt", bytes([i]) * i if i else None) for i in range(40)]
    assert write_files(spark.createDataFrame(rows, "path string, content binary").coalesce(1)) == 40
    assert all(open(p, "rb").read() == (c or b"") for p, c in rows)
