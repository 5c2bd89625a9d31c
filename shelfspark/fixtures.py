"""Catalogue tables projected from the driver's tables (FIXTURES.md §2).

The driver ships TPC-H-ish tables plus documents / events / labels / pages /
conversations. The catalogue operators need files, an access log, descriptions,
corrections, attempts, paths to audit, PII text and PDF pages; each is a pure
projection of a driver table so that its size grows with the data. The same
expressions are written in DuckDB SQL in ``shelfspark.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark import constants as K
from shelfspark.functions.text import keyword_tokens, name_suffix

AS_OF = "2024-02-01"
EPOCH_SQL = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"

# Fixture dictionary rows added to the seeds: (category_id, keyword, locale, weight).
FIXTURE_KEYWORDS = [
    ("study", "tion", "en", 1.0),
    ("memo", "license", "en", 2.0),
    ("memo", "licensed", "en", 1.0),
    ("reminder", "für", "zh", 1.5),
    ("reminder", "und", "en", 1.0),
    ("life", "haha", "en", 1.5),
    ("life", "avec", "zh", 1.5),
    ("task", "token", "en", 3.0),
    ("task", "that", "en", 0.7),
    ("finance", "ción", "en", 1.5),
    ("finance", "para", "zh", 1.0),
    ("finance", "|", "en", 2.0),
    ("work", "with", "en", 0.5),
    ("work", "from", "en", 0.5),
    ("work", "worthless", "en", 2.0),
]

TEXT_ZH = "学习笔记 课程 论文 复习 考试 发票"
TEXT_MIXED = "项目进度报告 project plan"
TEXT_JUNK = "zzz 123"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dictionary(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Seed categories and seed + fixture keywords."""
    from shelfspark.operators.dictionary import keyword_frame, seed_categories, seed_keyword_rows
    rows = seed_keyword_rows() + [(c, k, l, w, "user") for c, k, l, w in FIXTURE_KEYWORDS]
    return seed_categories(spark), keyword_frame(spark, rows)


def file_name_expr() -> F.Column:
    """original_name by ``k % 6`` with ``k = doc_id div 20``."""
    k = F.expr("doc_id div 20")
    kind = F.pmod(k, F.lit(6))
    ext3 = F.element_at(F.array(F.lit("pdf"), F.lit("docx"), F.lit("xlsx")),
                        (F.pmod(F.expr("doc_id div 20 div 6"), F.lit(3)) + 1).cast("int"))
    fd = F.when(F.pmod(F.expr("doc_id div 20 div 6"), F.lit(2)) == 0, F.lit("final")).otherwise(F.lit("draft"))
    return (F.when(kind == 0, F.concat(F.lit("report_v"), k.cast("string"), F.lit(".pdf")))
            .when(kind == 1, F.format_string("photo_%03d.jpg", k))
            .when(kind == 2, F.format_string("%d-%02d-%02d-meeting.txt",
                                             F.lit(2024) + F.expr("doc_id div 20 div 336"),
                                             F.pmod(F.expr("doc_id div 20 div 28"), F.lit(12)) + 1,
                                             F.pmod(k, F.lit(28)) + 1))
            .when(kind == 3, F.concat(F.lit("contract"), F.expr("doc_id div 20 div 18").cast("string"),
                                      F.lit("."), ext3))
            .when(kind == 4, F.concat(F.lit("notes "), k.cast("string"), F.lit(" "), fd, F.lit(".md")))
            .otherwise(F.concat(F.lit("misc"), F.col("doc_id").cast("string"), F.lit(".bin"))))


def synthetic_text_expr() -> F.Column:
    """Chinese, mixed and empty-handed text for three of every ten documents."""
    r = F.pmod(F.col("doc_id"), F.lit(10))
    return F.when(r == 7, F.lit(TEXT_ZH)).when(r == 8, F.lit(TEXT_MIXED)).when(r == 9, F.lit(TEXT_JUNK))


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files before classification: one row per document with its whole text, and beside
    every document with ``doc_id % 10`` in 7, 8, 9 a synthetic file (id -1 - doc_id)."""
    return raw_files_from(table(spark, sf_dir, "documents"))


def raw_files_from(docs: DataFrame) -> DataFrame:
    """The raw-files projection of a documents DataFrame (batch or streaming)."""
    own = docs.select("doc_id", "source", "n_chars", "text", F.lit(False).alias("extra"))
    extra = (docs.select("doc_id", "source", synthetic_text_expr().alias("text")).filter(F.col("text").isNotNull())
             .select("doc_id", "source", F.length("text").cast("bigint").alias("n_chars"), "text", F.lit(True).alias("extra")))
    directory = F.concat(F.lit("vault/_inbox/"), F.col("source"))
    return own.unionByName(extra).select(
        F.when(F.col("extra"), -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("file_id"),
        directory.alias("directory"),
        F.when(F.col("extra"), F.concat(F.lit("s_"), file_name_expr())).otherwise(file_name_expr()).alias("original_name"),
        F.col("text").alias("extracted_text"),
        F.col("n_chars").alias("file_size"),
        (F.pmod(F.col("doc_id"), F.lit(11)) / F.lit(10.0)).alias("importance"),
        (F.pmod(F.col("doc_id"), F.lit(17)) == 0).alias("starred"),
        F.expr(EPOCH_SQL).alias("created_at"),
    ).select("*", F.concat_ws("/", "directory", "original_name").alias("path"),
             name_suffix("original_name").alias("file_type"))


def docx_bytes(text: str) -> bytes:
    """A word document with a paragraph for each line."""
    import io
    import zipfile
    from xml.sax.saxutils import escape
    paragraphs = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
                                        f"{paragraphs}</w:body></w:document>")
    return out.getvalue()


def written_vault(spark: SparkSession, sf_dir: str) -> str:
    """The raw files as files with their texts, in a fresh shared folder; docx files are word documents."""
    from shelfspark.session import shared_scratch
    from shelfspark.sources.tree import plain_path, write_files
    root = plain_path(shared_scratch(spark, "vault"))
    raw = raw_files(spark, sf_dir).select("path", "file_type", "extracted_text")

    def contents(batches):
        import pyarrow as pa

        from shelfspark.functions.batches import slices
        for batch in batches:
            for some in slices(batch, "extracted_text"):
                part = some.to_pylist()
                yield pa.record_batch({"path": pa.array([f"{root}/{r['path']}" for r in part], pa.string()), "content": pa.array(
                    [docx_bytes(r["extracted_text"] or "") if r["file_type"] == ".docx" else (r["extracted_text"] or "").encode() for r in part], pa.binary())})

    write_files(raw.mapInArrow(contents, "path string, content binary"))
    return root


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View events mapped to files (file = documents row ``event_id % N``)."""
    docs = table(spark, sf_dir, "documents")
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "view")
    files = raw_files(spark, sf_dir).select("file_id", "path")
    return (ev.select("event_id", F.pmod(F.col("event_id"), n_docs).alias("file_id"),
                      F.col("ts").alias("accessed_at"))
            .join(files, "file_id")
            .select("event_id", F.col("path").alias("file_path"), "accessed_at"))


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last turn per conversation; updated_at is the ts of the event with id conv_id."""
    conv = table(spark, sf_dir, "conversations")
    last = conv.groupBy("conv_id").agg(F.max_by("text", "turn").alias("description"))
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("conv_id"), F.col("ts").alias("updated_at"))
    return (last.join(ev, "conv_id", "left")
            .select(F.concat(F.lit("vault/conv/"), F.col("conv_id").cast("string")).alias("path"),
                    "description", F.expr(EPOCH_SQL).alias("created_at"), "updated_at"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").cast("string").alias("key"), "ts", "event_id")


def audit_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path part of page URLs with traversal / encoding / NUL variants by page_id % 5."""
    pages = table(spark, sf_dir, "pages")
    p = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1)
    v = F.pmod(F.col("page_id"), F.lit(5))
    raw = (F.when(v == 0, p)
           .when(v == 1, F.concat(F.lit("../.."), p))
           .when(v == 2, F.concat(F.lit("%2e%2e"), p))
           .when(v == 3, F.concat(F.lit("/~x"), p))
           .otherwise(F.concat(p, F.lit("%00.jpg"))))
    return pages.select("page_id", raw.alias("raw_path"))


def pii_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASCII PII text per customer; every 4th customer has none, another 4th matches that overlap."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    mm = F.lpad((F.pmod(key, F.lit(12)) + 1).cast("string"), 2, "0")
    dd = F.lpad((F.pmod(key, F.lit(28)) + 1).cast("string"), 2, "0")
    ddd = F.lpad(F.pmod(key, F.lit(1000)).cast("string"), 3, "0")
    name = F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit(".")))
    text = F.concat(F.lit("ID 4110221990"), mm, dd, ddd, F.lit("X tel 138"), F.lpad(key.cast("string"), 8, "0"),
                    F.lit(" mail "), name, F.lit("@example.com permit C"), F.lpad(key.cast("string"), 8, "0"),
                    F.lit(" sid dc"), F.lpad(key.cast("string"), 6, "0"))
    # a phone number in a mail address, one number of two kinds, a permit number in a mail address
    overlaps = F.concat(F.lit(" alt 138"), F.lpad(key.cast("string"), 8, "0"), F.lit("@mail.com MC"), F.lpad(key.cast("string"), 6, "0"),
                        F.lit(" x.C"), F.lpad(key.cast("string"), 8, "0"), F.lit("@y.org end"))
    text = F.when(F.pmod(key, F.lit(4)) == 1, F.concat(text, overlaps)).otherwise(text)
    plain = F.concat(F.lit("customer "), F.col("c_name"), F.lit(" segment "), F.col("c_mktsegment"))
    return c.select(F.col("c_custkey").alias("doc_id"),
                    F.when(F.pmod(key, F.lit(4)) == 0, plain).otherwise(text).alias("text"),
                    F.concat(F.lit("vault/_sensitive/scan_"), key.cast("string"),
                             F.when(F.pmod(key, F.lit(3)) == 0, F.lit("_passport.jpg"))
                             .when(F.pmod(key, F.lit(3)) == 1, F.lit("_NDA_agreement.pdf"))
                             .otherwise(F.lit(".png"))).alias("filepath"))


def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    return conv.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")


def category_ids() -> list[str]:
    return [c["id"] for c in K.SEED_CATEGORIES]


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as corrections: from category doc_id % 7 (by Chinese name), to category
    (doc_id + 1 + toxic) % 7 (by id); keywords are all extracted keywords."""
    from shelfspark.operators.keywords import keyword_lists
    labels = table(spark, sf_dir, "labels")
    files = raw_files(spark, sf_dir)
    kw_arr = keyword_lists(files.select(F.col("file_id").alias("doc_id"), F.col("extracted_text").alias("text")))
    zh = F.array(*[F.lit(c["name_zh"]) for c in K.SEED_CATEGORIES])
    ids = F.array(*[F.lit(c["id"]) for c in K.SEED_CATEGORIES])
    return (labels.join(files.select(F.col("file_id").alias("doc_id"), "path"), "doc_id")
            .join(kw_arr, "doc_id", "left")
            .select(F.col("doc_id").alias("seq"), F.col("path").alias("filepath"),
                    F.element_at(zh, (F.pmod("doc_id", F.lit(7)) + 1).cast("int")).alias("from_category"),
                    F.element_at(ids, (F.pmod(F.col("doc_id") + 1 + F.col("toxic"), F.lit(7)) + 1).cast("int"))
                    .alias("to_category"),
                    F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords")))


__all__ = ["AS_OF", "FIXTURE_KEYWORDS", "table", "dictionary", "raw_files", "access_log", "descriptions",
           "attempts", "audit_paths", "pii_text", "pdf_pages", "corrections", "keyword_tokens"]


ARCHIVED_EVERY = 23  # files with file_id % 23 = 0 start in _archive (so archive filters matter)


def classified_files(spark: SparkSession, sf_dir: str, locale: str = "zh") -> DataFrame:
    """Classification of the raw files with the seed + fixture dictionary and the
    extracted keywords."""
    from shelfspark.operators.classify import classify
    cats, kws = dictionary(spark)
    return classify(keyword_files(spark, sf_dir), cats, kws, locale=locale)


def keyword_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw files with their extracted keywords, in one pass over the texts."""
    from shelfspark.operators.classify import spread
    from shelfspark.operators.keywords import with_keywords
    return with_keywords(spread(raw_files(spark, sf_dir)), "extracted_text")


CATALOG_COLUMNS = ("path", "directory", "original_name", "file_type", "keywords", "file_size", "importance", "starred", "created_at")


def catalog_files(spark: SparkSession, sf_dir: str, with_access: bool = True, **marks) -> DataFrame:
    """The ``files`` catalogue table: raw files + category + extracted keywords, then
    the access log rolled up into view_count / last_accessed.

    The texts are read in one pass that extracts keywords, finds dictionary rows and computes ``marks`` (named
    expressions over the raw files and their keywords); its rows, without the texts, are written once."""
    from shelfspark.operators.catalog import apply_access_log
    from shelfspark.operators.classify import annotate, classify_annotated, prepare
    from shelfspark.session import cut_lineage
    cats, kws = dictionary(spark)
    carry = (*CATALOG_COLUMNS, *marks)
    files = keyword_files(spark, sf_dir).withColumns(marks) if marks else keyword_files(spark, sf_dir)
    rows, indexed = annotate(prepare(files, carry), cats, kws, carry)
    rows = cut_lineage(rows, "catalog-scan")
    cls = classify_annotated(rows, indexed, cats, kws).select("file_id", "category", "confidence")
    files = (rows.select("file_id", *carry).join(cls, "file_id")
             .select("file_id", "path", "directory", "original_name",
                     F.when(F.pmod("file_id", F.lit(ARCHIVED_EVERY)) == 0, F.lit(K.ARCHIVE))
                     .otherwise(F.col("category")).alias("category"),
                     "file_type", "keywords",
                     "file_size", "confidence", "importance", "starred",
                     F.lit(0).cast("bigint").alias("view_count"), "created_at",
                     F.col("created_at").alias("last_accessed"), F.col("created_at").alias("last_modified"), *marks))
    if with_access:
        files = apply_access_log(files, access_log(spark, sf_dir))
    return files


def review_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review queue: catalogue files left in _inbox or routed there by low
    confidence (CLS-11), excluding archived ones."""
    files = catalog_files(spark, sf_dir)
    return files.filter((F.col("category") != K.ARCHIVE)
                        & ((F.col("category") == K.INBOX) | (F.col("confidence") < K.LOW_CONFIDENCE)))


def vault_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path table of the whole vault: catalogue files plus the sensitive scans
    (path, size, modified)."""
    files = raw_files(spark, sf_dir).select("path", F.col("file_size").alias("size"),
                                            F.lit(1704067200.0).alias("modified"))
    sens = pii_text(spark, sf_dir).select(F.col("filepath").alias("path"), F.length("text").cast("bigint")
                                          .alias("size"), F.lit(1704067200.0).alias("modified"))
    return files.unionByName(sens)
