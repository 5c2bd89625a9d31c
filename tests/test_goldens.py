"""Hand-evaluated goldens as tiny DataFrames."""

from datetime import datetime

from pyspark.sql import functions as F

from shelfspark import fixtures as X
from shelfspark.functions.stems import stem_candidates
from shelfspark.functions.text import detect_language, name_stem
from shelfspark.operators import classify as CLS
from shelfspark.operators import pii as PII
from shelfspark.operators.dictionary import keyword_frame, seed_categories, seed_keyword_rows
from shelfspark.operators.learn import apply_corrections
from shelfspark.plans.organize import archive_plan
from shelfspark.streaming.jobs import throttle_batch


def test_language(spark):
    df = spark.createDataFrame([("",), ("12345",), ("abc",), ("学a",), ("学习",)], "t string")
    got = [r[0] for r in df.select(detect_language(F.col("t"))).collect()]
    assert got == ["zh", "mixed", "en", "mixed", "zh"]


def test_invoice_golden(spark):
    cats = seed_categories(spark)
    kws = keyword_frame(spark, seed_keyword_rows())
    files = spark.createDataFrame(
        [(1, "2024年度发票汇总.pdf", "发票号码 INV-2024-0881 金额 ¥128,800", ["2024", "发票", "INV", "报销", "金额"])],
        "file_id long, original_name string, extracted_text string, keywords array<string>")
    r = CLS.classify(files, cats, kws).collect()[0]
    assert r.locale_detected == "zh"
    assert r.category_id == "finance"
    assert abs(r.score - 6.0) < 1e-12
    assert abs(r.confidence - 6.0 / 70.0) < 1e-12
    assert r.suggestions == ["学习"]
    assert r.reason.startswith("filename '发票' (w=1.0)")


def test_substring_match_and_inbox(spark):
    cats = seed_categories(spark)
    kws = keyword_frame(spark, seed_keyword_rows())
    files = spark.createDataFrame([(1, "airplane.bin", "", []), (2, "zzz.bin", "zzz 123", [])],
                                  "file_id long, original_name string, extracted_text string, keywords array<string>")
    rows = {r.file_id: r for r in CLS.classify(files, cats, kws).collect()}
    assert rows[1].category_id == "task"  # 'plan' inside 'airplane'
    assert rows[2].category == "_inbox" and rows[2].confidence == 0.0
    assert rows[2].reason == "No keyword matches — needs manual classification"


def test_fixture_golden_counts(spark):
    cats, kws = X.dictionary(spark)
    files = X.raw_files(spark, "/root/testdata/sf0.001").withColumn("keywords", F.array().cast("array<string>"))
    c = CLS.classify(files, cats, kws)
    got = {r[0]: r[1] for r in c.groupBy("category_id").count().collect()}
    assert got == {"finance": 47, "life": 46, "memo": 24, "reminder": 49, "study": 26, "task": 55, "work": 9,
                   None: 4}


def test_redaction_golden(spark):
    df = spark.createDataFrame([(1, "姓名: 张琳坤 身份证号: 41102220040318007X 澳门大学"),
                                (2, "13812345678 abc@example.com"), (3, "邮箱abc@x.com")], "doc_id long, text string")
    rows = {r.doc_id: r for r in PII.redact_documents(df).collect()}
    assert rows[1].redacted_text == "姓名: 张** 身份证号: 411022**********X 澳门大学"
    assert rows[1].safe_description == "姓名、身份证号、个人证件 - 含澳大相关内容"
    assert rows[2].redacted_text == "138****5678 a***@example.com"
    assert rows[3].pii_count == 0


def test_weight_chain(spark):
    cats = seed_categories(spark)
    kws = keyword_frame(spark, [("study", "exam", "en", 1.0, "seed"), ("memo", "note", "zh", 1.0, "seed")])
    corr = spark.createDataFrame(
        [(1, "f", "study", "memo", ["exam"]),        # exam down in study (0.7), up in memo (new 1.5)
         (2, "f", "memo", "study", ["note"])],       # note(en) down in memo: only zh row exists -> nothing
        "seq long, filepath string, from_category string, to_category string, keywords array<string>")
    out = {(r.category_id, r.keyword, r.locale): (r.weight, r.source)
           for r in apply_corrections(kws, cats, corr).collect()}
    assert out[("study", "exam", "en")] == (0.7, "learned")
    assert out[("memo", "exam", "en")] == (1.5, "learned")
    assert out[("memo", "note", "zh")] == (1.0, "seed")
    assert ("memo", "note", "en") not in out
    assert out[("study", "note", "en")] == (1.5, "learned")


def test_weight_cap_and_floor(spark):
    cats = seed_categories(spark)
    kws = keyword_frame(spark, [("study", "exam", "en", 1.0, "seed"), ("memo", "exam", "en", 1.0, "seed")])
    rows = [(i, "f", "memo", "study", ["exam"]) for i in range(12)]
    corr = spark.createDataFrame(rows, "seq long, filepath string, from_category string, to_category string, "
                                       "keywords array<string>")
    out = {(r.category_id, r.keyword): r.weight for r in apply_corrections(kws, cats, corr).collect()}
    assert out[("study", "exam")] == 3.0
    assert out[("memo", "exam")] == 0.1


def test_stems_golden(spark):
    df = spark.createDataFrame([("report_v1.pdf",)], "n string")
    got = df.select(stem_candidates(name_stem(F.col("n")))).collect()[0][0]
    assert sorted(got) == sorted(["report_v1", "report", "report_v"])


def test_group_golden(spark):
    from shelfspark.operators.groups import file_groups, group_members
    files = spark.createDataFrame([("d", "d/report_v1.pdf", "report_v1.pdf"), ("d", "d/report_v2.pdf", "report_v2.pdf")],
                                  "directory string, path string, original_name string")
    assert sorted(r.path for r in group_members(files).collect()) == ["d/report_v1.pdf", "d/report_v2.pdf"]
    g = file_groups(files).collect()
    assert len(g) == 1
    r = g[0]
    assert r.stem == "report" and r.file_count == 2 and abs(r.confidence - 0.8) < 1e-12
    assert r.strategy == "version_variants" and r.suggested_folder == "Report"


def test_archive_cutoff_day_granular(spark):
    files = spark.createDataFrame(
        [("vault/_inbox/a.txt", "学习", datetime(2024, 1, 22, 23, 59), False, 5),
         ("vault/_inbox/b.txt", "学习", datetime(2024, 1, 23, 0, 0), False, 5),
         ("vault/_inbox/c.txt", "学习", datetime(2024, 1, 1), True, 5)],
        "path string, category string, last_accessed timestamp_ntz, starred boolean, file_size long")
    got = [r.src for r in archive_plan(files, "2024-02-01", 10).collect()]
    assert got == ["vault/_inbox/a.txt"]


def test_throttle_golden(spark):
    base = datetime(2024, 1, 1, 0, 0, 0)
    from datetime import timedelta
    ts = [base + timedelta(seconds=2 * i) for i in range(6)] + [base + timedelta(seconds=60), base + timedelta(seconds=61)]
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate(ts)], "key string, event_id long, ts timestamp_ntz")
    got = [(r.event_id, r.allowed) for r in throttle_batch(df, 5, 60).orderBy("event_id").collect()]
    assert [a for _, a in got[:6]] == [True] * 5 + [False]
    assert got[6] == (6, True)      # the oldest (t=0) is exactly 60 s old
    assert got[7] == (7, False)     # at t=61 the allowed t=2,4,6,8,60 are all < 60 s old


def test_path_audit_golden(spark):
    from shelfspark.functions.paths import path_audit
    df = spark.createDataFrame([("../../../etc/passwd",), ("%2e%2e%2fetc%2fpasswd",), ("/etc/passwd%00.jpg",),
                                ("a/./b//c",), ("~root/x",), ("a+b.txt",)], "p string")
    safe, norm = path_audit(F.col("p"))
    got = [(r[0], r[1]) for r in df.select(safe, norm).collect()]
    assert got == [(False, None), (False, None), (True, "etc/passwd.jpg"), (True, "a/b/c"), (False, None),
                   (True, "a+b.txt")]


def test_bootstrap_seeds_only_when_empty(spark):
    from shelfspark.operators.dictionary import bootstrap
    cats, kws = bootstrap(None, spark)
    assert cats.count() == 7 and kws.count() == 175
    assert kws.filter("source = 'seed' AND weight = 1.0").count() == 175
    again, same = bootstrap(cats, spark, kws.limit(3))
    assert same.count() == 3 and again.count() == 7
    assert bootstrap(cats, spark)[1].count() == 0


def test_json_lines_keep_utf8(spark):
    from shelfspark.operators.catalog import json_lines
    df = spark.createDataFrame([("学习", 2)], "category string, file_count int")
    assert json_lines(df).collect()[0][0] == '{"category":"学习","file_count":2}'
