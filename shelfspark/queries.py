"""Registered queries: one per operator of SURVEY §2, each ``(spark, sf_dir) -> DataFrame``
over the driver's tables, with the matching DuckDB oracle SQL where one exists.

Every computed column is aliased identically on both sides. Values that would
depend on evaluation order are avoided (decimal sums, unique tie-breaks).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark import constants as K
from shelfspark import fixtures as X
from shelfspark import oracle as O
from shelfspark.functions.text import detect_language
from shelfspark.operators import catalog as CAT
from shelfspark.operators import classify as CLS
from shelfspark.operators import keywords as KW
from shelfspark.session import cut_lineage, shared_scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# Classification (CLS)
# ---------------------------------------------------------------------------

@register("classify", O.build(["classified"], """
SELECT file_id, category, category_id, confidence, score, locale_detected FROM classified"""))
def q_classify(spark, sf):
    return X.classified_files(spark, sf).select("file_id", "category", "category_id", "confidence", "score",
                                                 "locale_detected")


@register("classify_suggestions", O.build(["cls_suggest"], "SELECT file_id, suggestions FROM cls_suggest"))
def q_classify_suggestions(spark, sf):
    return X.classified_files(spark, sf).select("file_id", F.array_join("suggestions", "|").alias("suggestions"))


@register("classify_reasons", O.build(["classified"], "SELECT file_id, reason FROM classified"))
def q_classify_reasons(spark, sf):
    return X.classified_files(spark, sf).select("file_id", "reason")


@register("route_files", O.build(["classified"], """
SELECT file_id, CASE WHEN confidence < 0.3 THEN '_inbox' ELSE category END AS routed_to,
       confidence < 0.3 AS needs_review FROM classified"""))
def q_route_files(spark, sf):
    return CLS.route(X.classified_files(spark, sf)).select("file_id", "routed_to", "needs_review")


@register("dictionary_matches", O.build(["cls_matches"], """
SELECT file_id, category_id, keyword, keyword_locale, tier, CAST(locale_bonus AS DOUBLE) AS locale_bonus
FROM cls_matches"""))
def q_dictionary_matches(spark, sf):
    cats, kws = X.dictionary(spark)
    files = X.keyword_files(spark, sf)
    m = CLS.dictionary_matches(CLS.prepare(files), cats, kws)
    return m.filter(F.col("_kind") == "kw").select("file_id", "category_id", "keyword", "keyword_locale", "tier",
                                                   "locale_bonus")


@register("category_scores", O.build(["cls_scores"], """
SELECT file_id, category_id, CAST(score_dec AS DOUBLE) AS score FROM cls_scores"""))
def q_category_scores(spark, sf):
    cats, kws = X.dictionary(spark)
    files = X.keyword_files(spark, sf)
    s = CLS.category_scores(CLS.prepare(files), cats, kws)
    return s.select("file_id", "category_id", F.col("score_dec").cast("double").alias("score"))


# ---------------------------------------------------------------------------
# Text functions (TXT)
# ---------------------------------------------------------------------------

@register("detect_language", f"""
SELECT doc_id, {O.lang('text')} AS lang_detected, length(text) AS text_length FROM documents""")
def q_detect_language(spark, sf):
    d = X.table(spark, sf, "documents")
    return d.select("doc_id", detect_language(F.col("text")).alias("lang_detected"),
                    F.length("text").cast("bigint").alias("text_length"))


@register("keywords_freq", O.build(["file_keywords"], """
SELECT doc_id, rank, keyword, cnt FROM file_keywords"""))
def q_keywords_freq(spark, sf):
    files = X.raw_files(spark, sf).select(F.col("file_id").alias("doc_id"), F.col("extracted_text").alias("text"))
    return KW.top_keywords(files).select("doc_id", F.col("rank").cast("bigint").alias("rank"), "keyword", "cnt")


@register("keywords_tfidf", O.build(["file_term_counts", "raw_files"], """
SELECT doc_id, rank, keyword, cnt, df FROM (
  SELECT w.doc_id, w.keyword, w.cnt, d.df,
         row_number() OVER (PARTITION BY w.doc_id ORDER BY
           w.cnt * ln(CAST((SELECT count(*) FROM raw_files) + 1 AS DOUBLE) / CAST(d.df + 1 AS DOUBLE)) DESC, w.first_pos) AS rank
  FROM file_term_counts w JOIN (SELECT keyword, count(*) AS df FROM file_term_counts GROUP BY keyword) d
    ON d.keyword = w.keyword)
WHERE rank <= 20"""))
def q_keywords_tfidf(spark, sf):
    files = X.raw_files(spark, sf).select(F.col("file_id").alias("doc_id"), F.col("extracted_text").alias("text"))
    return KW.tfidf_keywords(files).select("doc_id", F.col("rank").cast("bigint").alias("rank"), "keyword",
                                           "cnt", "df")


# ---------------------------------------------------------------------------
# Catalogue statistics and recommendations (AGG)
# ---------------------------------------------------------------------------

@register("stats_by_category", O.build(["catalog_files"], """
SELECT category, count(*) AS file_count, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_size
FROM catalog_files WHERE category IS NOT NULL GROUP BY category"""))
def q_stats_by_category(spark, sf):
    return CAT.stats_by_category(X.catalog_files(spark, sf))


@register("stats_totals", O.build(["catalog_files"], """
SELECT count(*) AS total_files, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_size_bytes,
       count(*) FILTER (WHERE category = '_inbox') AS inbox_count FROM catalog_files"""))
def q_stats_totals(spark, sf):
    return CAT.stats_totals(X.catalog_files(spark, sf))


@register("top_viewed", O.build(["catalog_files"], """
SELECT path, view_count FROM catalog_files ORDER BY view_count DESC, path LIMIT 10"""))
def q_top_viewed(spark, sf):
    return CAT.top_viewed(X.catalog_files(spark, sf))


@register("category_share", O.build(["catalog_files"], """
SELECT category, file_count, CAST(file_count AS DOUBLE) / CAST(greatest(1, max(file_count) OVER ()) AS DOUBLE) * 100.0
       AS share_pct
FROM (SELECT category, count(*) AS file_count FROM catalog_files
      WHERE category IS NOT NULL AND category NOT IN ('_inbox', '_archive') GROUP BY category)"""))
def q_category_share(spark, sf):
    return CAT.category_share(X.catalog_files(spark, sf))


@register("sidebar_counts", O.build(["catalog_files", "categories"], """
SELECT row_number() OVER (ORDER BY grp, sort) AS position, n.category, coalesce(c.file_count, 0) AS file_count
FROM (SELECT name_zh AS category, id AS sort, 1 AS grp FROM categories WHERE is_active
      UNION ALL SELECT '_inbox', '', 0 UNION ALL SELECT '_archive', '', 2) n
LEFT JOIN (SELECT category, count(*) AS file_count FROM catalog_files GROUP BY category) c
  ON c.category = n.category"""))
def q_sidebar_counts(spark, sf):
    cats, _ = X.dictionary(spark)
    return CAT.sidebar_counts(X.catalog_files(spark, sf), cats).withColumn("position", F.col("position").cast("bigint"))


@register("rec_important", O.build(["catalog_files"], """
SELECT path, category, coalesce(nullif(original_name, ''), regexp_extract(path, '[^/]*$', 0)) AS name,
       importance, last_accessed
FROM catalog_files WHERE importance > 0 AND category <> '_archive'
ORDER BY importance DESC, last_accessed ASC NULLS FIRST, path LIMIT 5"""))
def q_rec_important(spark, sf):
    return CAT.rec_important(X.catalog_files(spark, sf))


@register("rec_overdue", O.build(["catalog_files"], """
SELECT path, coalesce(nullif(original_name, ''), regexp_extract(path, '[^/]*$', 0)) AS name, last_accessed
FROM catalog_files WHERE category = '提醒' ORDER BY last_accessed ASC NULLS FIRST, path LIMIT 5"""))
def q_rec_overdue(spark, sf):
    return CAT.rec_overdue(X.catalog_files(spark, sf))


@register("rec_by_category", O.build(["catalog_files"], """
SELECT category, path, importance, last_accessed, rank FROM (
  SELECT category, path, importance, last_accessed,
         row_number() OVER (PARTITION BY category ORDER BY importance DESC, last_accessed ASC NULLS FIRST, path) AS rank
  FROM catalog_files WHERE importance > 0 AND category <> '_archive') WHERE rank <= 5"""))
def q_rec_by_category(spark, sf):
    return CAT.rec_by_category(X.catalog_files(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


@register("rec_discovery", O.build(["catalog_files"], """
SELECT path, category, coalesce(nullif(original_name, ''), regexp_extract(path, '[^/]*$', 0)) AS name, view_count
FROM catalog_files WHERE view_count = 0 AND category <> '_archive'
ORDER BY md5(path || ':42'), path LIMIT 5"""))
def q_rec_discovery(spark, sf):
    return CAT.rec_discovery(X.catalog_files(spark, sf))


@register("apply_access_log", O.build(["catalog_files"], """
SELECT path, view_count, last_accessed FROM catalog_files"""))
def q_apply_access_log(spark, sf):
    return X.catalog_files(spark, sf).select("path", "view_count", "last_accessed")


# ---------------------------------------------------------------------------
# Searches (FLT)
# ---------------------------------------------------------------------------

SEARCH_TERM = "tion"


@register("search_files", O.build(["catalog_files"], f"""
SELECT path, category, file_type, original_name, view_count, importance, confidence, last_accessed
FROM catalog_files
WHERE {O.like('original_name', SEARCH_TERM)} OR list_bool_or(list_transform(keywords, lambda k: {O.like('k', SEARCH_TERM)}))
   OR {O.like('extracted_text', SEARCH_TERM)}
ORDER BY importance DESC, view_count DESC, path LIMIT 50"""))
def q_search_files(spark, sf):
    return CAT.search_files(X.catalog_files(spark, sf, hit=CAT.search_hit(SEARCH_TERM)))


DESC_QUERY = "le la"


@register("search_descriptions", O.build(["descriptions"], f"""
SELECT path, description, updated_at, count(*) OVER () AS total_hits FROM descriptions
WHERE {' AND '.join(O.like('description', t) for t in DESC_QUERY.split())}
ORDER BY updated_at DESC, path LIMIT 50"""))
def q_search_descriptions(spark, sf):
    return CAT.search_descriptions(X.descriptions(spark, sf), DESC_QUERY)


@register("list_descriptions", O.build(["descriptions"], """
SELECT path, description, updated_at, count(*) OVER () AS total FROM descriptions
WHERE path = 'vault/conv' OR starts_with(path, 'vault/conv/')"""))
def q_list_descriptions(spark, sf):
    return CAT.list_descriptions(X.descriptions(spark, sf), "vault/conv")


@register("get_descriptions", O.build(["descriptions"], """
SELECT p.path, d.description, d.created_at, d.updated_at,
       CASE WHEN d.description IS NULL THEN 'No description set for this path' END AS message
FROM (SELECT 'vault/conv/' || CAST(page_id AS VARCHAR) AS path FROM pages) p
LEFT JOIN descriptions d ON d.path = p.path"""))
def q_get_descriptions(spark, sf):
    paths = X.table(spark, sf, "pages").select(
        F.concat(F.lit("vault/conv/"), F.col("page_id").cast("string")).alias("path"))
    return CAT.get_descriptions(X.descriptions(spark, sf), paths)


@register("lookup_files", O.build(["catalog_files", "raw_files"], """
SELECT p.path, f.category, coalesce(array_to_string(f.keywords, '|'), '') AS keywords
FROM (SELECT r.path || v.suffix AS path FROM labels l JOIN raw_files r ON r.file_id = l.doc_id,
      (VALUES (''), ('.bak')) v(suffix)) p
LEFT JOIN catalog_files f ON f.path = p.path"""))
def q_lookup_files(spark, sf):
    raw = X.raw_files(spark, sf).select(F.col("file_id").alias("doc_id"), "path")
    known = X.table(spark, sf, "labels").join(raw, "doc_id").select("path")
    paths = known.unionByName(known.select(F.concat("path", F.lit(".bak")).alias("path")))
    r = CAT.lookup_files(X.catalog_files(spark, sf), paths)
    return r.select("path", "category", F.array_join("keywords", "|").alias("keywords"))


@register("lookup_stored", O.build(["catalog_files"], """
SELECT path, category, CASE WHEN file_id % 7 = 1 OR file_id % 5 = 0 OR file_id % 11 = 3 THEN '' ELSE array_to_string(keywords, '|') END AS keywords
FROM catalog_files"""))
def q_lookup_stored(spark, sf):
    """Keywords stored as JSON text, some of it missing, cut off or no array."""
    files = X.catalog_files(spark, sf)
    text, i = F.to_json("keywords"), F.col("file_id")
    stored = files.select("path", "category", F.when(i % 7 == 1, F.lit(None)).when(i % 5 == 0, F.expr("substring(to_json(keywords), 1, length(to_json(keywords)) - 1)"))
                          .when(i % 11 == 3, F.concat(F.lit('{"k": '), text, F.lit("}"))).otherwise(text).alias("keywords"))
    return CAT.lookup_files(stored, files.select("path")).select("path", "category", F.array_join("keywords", "|").alias("keywords"))


@register("classify_locales", O.build(["classified", "categories"], """
SELECT c.file_id, coalesce(k.name_en, '_inbox') AS category_en,
       coalesce(CASE WHEN c.locale_detected = 'zh' THEN k.name_zh ELSE k.name_en END, '_inbox') AS category_auto
FROM classified c LEFT JOIN categories k ON k.id = c.category_id"""))
def q_classify_locales(spark, sf):
    """Display names in English and in each file's own language, from one pass over the texts."""
    cats, kws = X.dictionary(spark)
    rows, indexed = CLS.annotate(CLS.prepare(X.keyword_files(spark, sf)), cats, kws)
    rows = cut_lineage(rows, "locales")
    one = lambda loc, name: CLS.classify_annotated(rows, indexed, cats, kws, locale=loc).select("file_id", F.col("category").alias(name))
    return one("en", "category_en").join(one("auto", "category_auto"), "file_id")


@register("translate_names", O.build(["catalog_files"], f"""
SELECT category, CASE category {' '.join(f"WHEN {O.q(a)} THEN {O.q(b)}" for a, b in K.NAME_TRANSLATION.items())} ELSE category END AS name_en,
       count(*) AS files FROM catalog_files GROUP BY category"""))
def q_translate_names(spark, sf):
    named = X.catalog_files(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("files"))
    return named.select("category", DIC.translate_name("category").alias("name_en"), "files")


@register("seed_dictionary", O.build(["categories", "keywords"], """
SELECT 'empty' AS table_was, c.id, c.name_zh, count(*) AS keywords
FROM categories c JOIN keywords k ON k.category_id = c.id WHERE k.source = 'seed' GROUP BY c.id, c.name_zh
UNION ALL SELECT DISTINCT 'filled', lang, source, 0 FROM documents WHERE source = 'src0'"""))
def q_seed_dictionary(spark, sf):
    """A vault whose category table is empty gets the seeds; one with own categories (here the languages of a
    source) keeps them."""
    own = X.table(spark, sf, "documents").where("source = 'src0'").select(F.col("lang").alias("id"), F.col("source").alias("name_zh")).distinct()
    out = None
    for was, have in (("empty", own.where("id is null")), ("filled", own)):
        cats, kws = DIC.bootstrap(have, spark)
        n = kws.groupBy(F.col("category_id").alias("id")).agg(F.count(F.lit(1)).alias("keywords"))
        part = cats.join(n, "id", "left").select(F.lit(was).alias("table_was"), "id", "name_zh", F.coalesce("keywords", F.lit(0)).alias("keywords"))
        out = part if out is None else out.unionByName(part)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# ---------------------------------------------------------------------------
# Learning engine (LRN) and dictionary maintenance (CAT)
# ---------------------------------------------------------------------------

from shelfspark.operators import dictionary as DIC  # noqa: E402
from shelfspark.operators import learn as LRN  # noqa: E402

CORRECTIONS_SQL_CTE = None  # corrections need keyword extraction; see oracle cte "corrections"


@register("apply_corrections", O.build(["learned_keywords"], """
SELECT category_id, keyword, locale, weight, source FROM learned_keywords"""))
def q_apply_corrections(spark, sf):
    cats, kws = X.dictionary(spark)
    return LRN.apply_corrections(kws, cats, X.corrections(spark, sf)).select(
        "category_id", "keyword", "locale", "weight", "source")


@register("sample_counts", O.build(["categories", "labels_corr"], """
SELECT c.id, c.sample_count + coalesce(n.cnt, 0) AS sample_count
FROM categories c LEFT JOIN (SELECT to_category, count(*) AS cnt FROM labels_corr GROUP BY to_category) n
  ON n.to_category = c.id"""))
def q_sample_counts(spark, sf):
    cats, _ = X.dictionary(spark)
    return LRN.sample_counts(cats, X.corrections(spark, sf)).select("id", "sample_count")


@register("top_corrected", O.build(["labels_corr"], """
SELECT to_category AS category, count(*) AS corrections FROM labels_corr GROUP BY to_category
ORDER BY corrections DESC, category LIMIT 10"""))
def q_top_corrected(spark, sf):
    log = LRN.log_corrections(None, X.corrections(spark, sf))
    return LRN.top_corrected(log)


@register("learning_stats", O.build(["learned_keywords", "labels_corr"], """
SELECT (SELECT count(*) FROM labels_corr) AS total_corrections,
       (SELECT count(*) FROM learned_keywords WHERE source = 'learned') AS learned_keywords"""))
def q_learning_stats(spark, sf):
    cats, kws = X.dictionary(spark)
    corr = X.corrections(spark, sf)
    new_kws = LRN.apply_corrections(kws, cats, corr)
    return LRN.learning_stats(LRN.log_corrections(None, corr), new_kws)


def _moves(spark, sf):
    """Moves derived from labels: quality-1 documents move to category (doc_id + 3) % 7."""
    labels = X.table(spark, sf, "labels").filter(F.col("quality") == 1)
    raw = X.raw_files(spark, sf).select(F.col("file_id").alias("doc_id"), "path")
    dirs = F.array(*[F.lit(c) for c in K.CATEGORY_DIRS])
    return labels.join(raw, "doc_id").select(
        F.col("doc_id").alias("seq"), "path",
        F.element_at(dirs, (F.pmod(F.col("doc_id") + 3, F.lit(7)) + 1).cast("int")).alias("category"))


MOVES_SQL = "(SELECT l.doc_id AS seq, r.path, ([" + ", ".join(O.q(c) for c in K.CATEGORY_DIRS) + \
    "])[(l.doc_id + 3) % 7 + 1] AS category FROM labels l JOIN raw_files r ON r.file_id = l.doc_id " \
    "WHERE l.quality = 1)"


@register("moves_to_corrections", O.build(["catalog_files", "raw_files"], f"""
SELECT m.seq, m.path AS filepath, f.category AS from_category, m.category AS to_category,
       array_to_string(f.keywords, '|') AS keywords
FROM {MOVES_SQL} m JOIN catalog_files f ON f.path = m.path
WHERE f.category IS NOT NULL AND f.category <> m.category"""))
def q_moves_to_corrections(spark, sf):
    c = LRN.moves_to_corrections(X.catalog_files(spark, sf), _moves(spark, sf))
    return c.select("seq", "filepath", "from_category", "to_category", F.array_join("keywords", "|").alias("keywords"))


@register("list_categories", O.build(["categories", "keywords", "labels_corr"], """
SELECT c.id, c.name_zh AS display_name, c.name_zh, c.name_en, array_to_string(c.extensions, ',') AS extensions,
       c.sample_count + coalesce(n.cnt, 0) AS sample_count, coalesce(k.keyword_count, 0) AS keyword_count
FROM categories c
LEFT JOIN (SELECT to_category, count(*) AS cnt FROM labels_corr GROUP BY to_category) n ON n.to_category = c.id
LEFT JOIN (SELECT category_id, count(*) AS keyword_count FROM keywords GROUP BY category_id) k ON k.category_id = c.id
WHERE c.is_active"""))
def q_list_categories(spark, sf):
    cats, kws = X.dictionary(spark)
    cats = LRN.sample_counts(cats, X.corrections(spark, sf))
    return DIC.list_categories(cats, kws)


@register("category_map", O.build(["categories", "labels_corr"], """
SELECT c.name_zh AS display_name, c.id, c.name_zh, c.name_en, array_to_string(c.extensions, ',') AS extensions,
       c.sample_count + coalesce(n.cnt, 0) AS sample_count
FROM categories c
LEFT JOIN (SELECT to_category, count(*) AS cnt FROM labels_corr GROUP BY to_category) n ON n.to_category = c.id
WHERE c.is_active"""))
def q_category_map(spark, sf):
    cats, _ = X.dictionary(spark)
    return DIC.category_map(LRN.sample_counts(cats, X.corrections(spark, sf)))


@register("export_stats_json", O.build(["catalog_files"], """
SELECT CAST(to_json(struct_pack(category := category, file_count := file_count, total_size := total_size)) AS VARCHAR)
       AS json
FROM (SELECT category, count(*) AS file_count, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_size
      FROM catalog_files WHERE category IS NOT NULL GROUP BY category)"""))
def q_export_stats_json(spark, sf):
    """SNK-3: per-category statistics as JSON documents (UTF-8 kept)."""
    return CAT.json_lines(CAT.stats_by_category(X.catalog_files(spark, sf)))


def _category_requests(spark, sf):
    """Category additions derived from the benchmark items: name = first word, keywords =
    all further words."""
    b = X.table(spark, sf, "benchmark")
    words = F.split(F.trim(F.col("text")), r"\s+")
    return b.select(F.col("item_id").alias("seq"), F.element_at(words, 1).alias("name"),
                    F.slice(words, 2, F.size(words)).alias("keywords"), F.array().cast("array<string>").alias("extensions"),
                    F.lit("en").alias("locale"))


_SLUG_SQL = """CASE WHEN slug = '' OR starts_with(slug, '_')
     THEN 'cat_' || CAST(('0x' || substr(md5(name), 1, 8))::BIGINT % 10000 AS VARCHAR) ELSE slug END"""


@register("add_categories", O.build(["categories"], f"""
SELECT seq, id, name,
       CASE WHEN id NOT IN (SELECT id FROM categories)
             AND row_number() OVER (PARTITION BY id ORDER BY seq) = 1 THEN 'added' ELSE 'duplicate' END AS status,
       keywords_count
FROM (SELECT seq, name, keywords_count, {_SLUG_SQL} AS id FROM (
  SELECT seq, name, keywords_count,
         regexp_replace(replace(lower(name), ' ', '_'), '[^a-z0-9_]', '_', 'g')[1:32] AS slug
  FROM (SELECT item_id AS seq, parts[1] AS name, len(parts) - 1 AS keywords_count
        FROM (SELECT item_id, string_split_regex(trim(text), '\\s+') AS parts FROM benchmark))))"""))
def q_add_categories(spark, sf):
    cats, kws = X.dictionary(spark)
    new_cats, new_kws, result = DIC.add_categories(cats, kws, _category_requests(spark, sf))
    return result.withColumn("keywords_count", F.col("keywords_count").cast("bigint"))


@register("add_keywords", O.build(["keywords", "file_keywords"], """
SELECT category_id, count(*) AS keywords_added FROM (
  SELECT DISTINCT (['study','memo','reminder','life','task','finance','work'])[abs(doc_id) % 7 + 1] AS category_id,
         lower(trim(keyword)) AS keyword, 'en' AS locale
  FROM file_keywords WHERE lower(trim(keyword)) <> '') a
WHERE NOT EXISTS (SELECT 1 FROM keywords k WHERE k.category_id = a.category_id AND k.keyword = a.keyword
                  AND k.locale = a.locale)
GROUP BY category_id"""))
def q_add_keywords(spark, sf):
    cats, kws = X.dictionary(spark)
    files = X.raw_files(spark, sf).select(F.col("file_id").alias("doc_id"), F.col("extracted_text").alias("text"))
    top = KW.top_keywords(files)
    ids = F.array(*[F.lit(c["id"]) for c in K.SEED_CATEGORIES])
    adds = top.select((F.col("doc_id") * 100 + F.col("rank")).alias("seq"),
                      F.element_at(ids, (F.pmod(F.abs("doc_id"), F.lit(7)) + 1).cast("int")).alias("category_id"),
                      "keyword", F.lit("en").alias("locale"))
    _, counts = DIC.add_keywords(kws, adds)
    return counts


@register("get_keywords", O.build(["learned_keywords"], """
SELECT category_id, keyword, locale, weight, source FROM learned_keywords"""))
def q_get_keywords(spark, sf):
    cats, kws = X.dictionary(spark)
    new_kws = LRN.apply_corrections(kws, cats, X.corrections(spark, sf))
    return DIC.get_keywords(new_kws)


@register("remove_keywords", O.build(["keywords", "file_keywords"], """
SELECT category_id, keyword, locale, weight, source FROM keywords k
WHERE NOT EXISTS (SELECT 1 FROM file_keywords f WHERE f.keyword = k.keyword)"""))
def q_remove_keywords(spark, sf):
    """Remove, from every category, each keyword that occurs among the documents' top words."""
    cats, kws = X.dictionary(spark)
    files = X.raw_files(spark, sf).select(F.col("file_id").alias("doc_id"), F.col("extracted_text").alias("text"))
    words = KW.top_keywords(files).select("keyword").distinct()
    removals = words.join(F.broadcast(kws.select("category_id", "keyword")), "keyword")
    return DIC.remove_keywords(kws, removals).select("category_id", "keyword", "locale", "weight", "source")


@register("update_categories", O.build(["categories", "labels_corr"], """
SELECT c.id, coalesce(u.name_en, c.name_en) AS name_en, c.is_active
FROM categories c LEFT JOIN (
  SELECT to_category AS id, arg_max('Renamed ' || CAST(seq AS VARCHAR), seq) AS name_en FROM labels_corr
  GROUP BY to_category) u ON u.id = c.id"""))
def q_update_categories(spark, sf):
    cats, _ = X.dictionary(spark)
    corr = X.corrections(spark, sf)
    upd = corr.select("seq", F.col("to_category").alias("id"), F.lit(None).cast("string").alias("name_zh"),
                      F.concat(F.lit("Renamed "), F.col("seq").cast("string")).alias("name_en"),
                      F.lit(None).cast("boolean").alias("is_active"),
                      F.lit(None).cast("array<string>").alias("extensions"),
                      F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    return DIC.update_categories(cats, upd).select("id", "name_en", "is_active")


@register("delete_categories", O.build(["categories", "labels_corr"], """
SELECT c.id, c.is_active AND c.id NOT IN (SELECT to_category FROM labels_corr WHERE toxic = 1) AS is_active
FROM categories c"""))
def q_delete_categories(spark, sf):
    cats, _ = X.dictionary(spark)
    corr = X.corrections(spark, sf).join(X.table(spark, sf, "labels").select(F.col("doc_id").alias("seq"), "toxic"),
                                         "seq").filter(F.col("toxic") == 1)
    dels = corr.select(F.col("to_category").alias("id"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    return DIC.delete_categories(cats, dels).select("id", "is_active")


# ---------------------------------------------------------------------------
# Personal data (PII)
# ---------------------------------------------------------------------------

from shelfspark.functions import pii as PF  # noqa: E402
from shelfspark.operators import pii as PII  # noqa: E402


@register("pii_findings", O.build(["pii_found"], """
SELECT doc_id, idx, type, start, "end", redacted FROM pii_found"""))
def q_pii_findings(spark, sf):
    s = PII.scan(X.pii_text(spark, sf)).select("doc_id", F.posexplode("findings").alias("i", "f"))
    return s.select("doc_id", (F.col("i") + 1).cast("bigint").alias("idx"), F.col("f.type").alias("type"),
                    F.col("f.start").alias("start"), F.col("f.end").alias("end"), F.col("f.redacted").alias("redacted"))


@register("redact_text", O.build(["pii_desc"], """
SELECT doc_id, redacted_text, pii_count, pii_count > 0 AS has_pii, safe_description FROM pii_desc"""))
def q_redact_text(spark, sf):
    r = PII.redact_documents(X.pii_text(spark, sf))
    return r.select("doc_id", "redacted_text", F.col("pii_count").cast("bigint").alias("pii_count"), "has_pii",
                    "safe_description")


@register("pii_profile", O.build(["pii_found"], """
SELECT type, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM pii_found GROUP BY type"""))
def q_pii_profile(spark, sf):
    return PII.pii_profile(X.pii_text(spark, sf))


@register("filename_hints", O.build(["pii_docs"], f"""
SELECT filepath, {O._hint_sql('filepath')} AS hint FROM pii_docs"""))
def q_filename_hints(spark, sf):
    return X.pii_text(spark, sf).select("filepath", PF.filename_hint(F.col("filepath")).alias("hint"))


@register("sensitive_descriptions", O.build(["pii_desc"], f"""
SELECT filepath AS path,
       CASE WHEN coalesce(filepath, '') = '' THEN
              CASE WHEN safe_description <> '' THEN safe_description ELSE '敏感文件（未识别到具体类型）' END
            WHEN {O._hint_sql('filepath')} <> '' AND safe_description <> ''
              THEN {O._hint_sql('filepath')} || '：' || safe_description
            WHEN {O._hint_sql('filepath')} <> '' THEN {O._hint_sql('filepath')}
            ELSE safe_description END AS description
FROM pii_desc"""))
def q_sensitive_descriptions(spark, sf):
    _, d, _ = PII.ingest_sensitive(X.pii_text(spark, sf))
    return d


@register("ingest_sensitive", O.build(["pii_desc"], """
SELECT filepath AS path, '_sensitive' AS category, redacted_text[1:500] AS extracted_text,
       coalesce(array_to_string(list_filter(types, lambda x: x IS NOT NULL), '|'), '') AS keywords FROM pii_desc"""))
def q_ingest_sensitive(spark, sf):
    files, _, _ = PII.ingest_sensitive(X.pii_text(spark, sf))
    return files.select("path", "category", "extracted_text", F.array_join("keywords", "|").alias("keywords"))


@register("pii_documents", O.build(["doc_pii_desc"], """
SELECT doc_id, pii_count, safe_description, sha256(redacted_text) AS redacted_sha256 FROM doc_pii_desc"""))
def q_pii_documents(spark, sf):
    """PII scan of the whole document corpus (non-ASCII text: Python-oracle tested)."""
    d = X.table(spark, sf, "documents").select("doc_id", "text")
    r = PII.redact_documents(d)
    return r.select("doc_id", F.col("pii_count").cast("bigint").alias("pii_count"), "safe_description",
                    F.sha2(F.col("redacted_text"), 256).alias("redacted_sha256"))


# ---------------------------------------------------------------------------
# File grouping (GRP) and organise / archive plans (ORG)
# ---------------------------------------------------------------------------

from shelfspark.functions.stems import stem_candidates  # noqa: E402
from shelfspark.functions.text import name_stem  # noqa: E402
from shelfspark.operators import groups as GRP  # noqa: E402
from shelfspark.plans import organize as ORG  # noqa: E402


ARCHIVE_DAYS = 10


@register("file_stems", O.build(["file_stems"], """
SELECT path, array_to_string(list_sort(stems), '|') AS stems FROM file_stems"""))
def q_file_stems(spark, sf):
    f = GRP.listing(X.raw_files(spark, sf))
    return f.select("path", F.array_join(F.array_sort(stem_candidates(name_stem(F.col("name")))), "|").alias("stems"))


@register("stem_index", O.build(["file_stems"], """
SELECT directory, stem, count(*) AS files FROM (SELECT directory, unnest(stems) AS stem FROM file_stems)
GROUP BY directory, stem HAVING count(*) >= 2"""))
def q_stem_index(spark, sf):
    idx = GRP.stem_index(X.raw_files(spark, sf))
    return idx.groupBy("directory", "stem").agg(F.count(F.lit(1)).alias("files")).filter(F.col("files") >= 2)


@register("file_groups", O.build(["file_groups_sql"], """
SELECT directory, stem, stem_files, suggested_folder, strategy, file_count, confidence FROM file_groups_sql"""))
def q_file_groups(spark, sf):
    return GRP.file_groups(X.raw_files(spark, sf))


@register("group_members", O.build(["group_members"], """
SELECT directory, stem, stem_files, path FROM group_members"""))
def q_group_members(spark, sf):
    return GRP.group_members(X.raw_files(spark, sf))


@register("group_summary", O.build(["group_members", "raw_files"], """
SELECT t.directory, t.total_files, coalesce(g.grouped, 0) AS grouped_count,
       t.total_files - coalesce(g.grouped, 0) AS ungrouped_count, coalesce(u.files, '') AS ungrouped_files,
       CASE WHEN t.total_files < 2 THEN 'no_groups' ELSE 'ok' END AS status
FROM (SELECT directory, count(*) AS total_files FROM raw_files WHERE NOT starts_with(original_name, '.')
      GROUP BY directory) t
LEFT JOIN (SELECT directory, count(*) AS grouped FROM group_members GROUP BY directory) g ON g.directory = t.directory
LEFT JOIN (SELECT directory, array_to_string(list(path ORDER BY path), '|') AS files FROM (
             SELECT directory, path, row_number() OVER (PARTITION BY directory ORDER BY path) AS rn FROM raw_files r
             WHERE NOT starts_with(original_name, '.')
               AND NOT EXISTS (SELECT 1 FROM group_members m WHERE m.path = r.path)) WHERE rn <= 20
           GROUP BY directory) u ON u.directory = t.directory"""))
def q_group_summary(spark, sf):
    files = X.raw_files(spark, sf)
    s = GRP.group_summary(files, GRP.group_members(files))
    return s.select("directory", "total_files", "grouped_count", "ungrouped_count",
                    F.array_join("ungrouped_files", "|").alias("ungrouped_files"), "status")


@register("group_manifest", O.build(["file_groups_sql", "group_members"], """
SELECT m.directory, m.stem, g.directory || '/' || g.suggested_folder AS folder, m.path AS src,
       g.directory || '/' || g.suggested_folder || '/' || regexp_extract(m.path, '[^/]*$', 0) AS dst
FROM group_members m JOIN file_groups_sql g ON g.directory = m.directory AND g.stem = m.stem"""))
def q_group_manifest(spark, sf):
    files = X.raw_files(spark, sf)
    members = cut_lineage(GRP.group_members(files), "group-members")
    return ORG.group_manifest(files, GRP.file_groups(files, members=members), members)


@register("ungroup_manifest", O.build(["raw_files"], """
SELECT directory AS folder, path AS src,
       'vault/_inbox/' || CASE WHEN k = 0 THEN name ELSE stem || '_' || CAST(k AS VARCHAR) || sfx END AS dst,
       TRUE AS folder_deleted
FROM (SELECT directory, path, original_name AS name,
             regexp_extract(original_name, '^.+([.][^.]+)$', 1) AS sfx,
             CASE WHEN regexp_matches(original_name, '^.+[.][^.]+$')
                  THEN regexp_extract(original_name, '^(.+)[.][^.]+$', 1) ELSE original_name END AS stem,
             row_number() OVER (PARTITION BY original_name ORDER BY path) - 1 AS k
      FROM raw_files)"""))
def q_ungroup_manifest(spark, sf):
    """Ungroup every source folder of the inbox: all files move up into vault/_inbox."""
    files = X.raw_files(spark, sf)
    folders = files.select(F.col("directory").alias("folder")).distinct()
    return ORG.ungroup_manifest(files, folders)


ORG_MOVES_SQL = """(SELECT l.doc_id AS seq, CASE WHEN l.quality = 1 THEN r.path ELSE r.path || '.missing' END AS path,
       CASE WHEN l.toxic = 1 THEN 'Unknown' || CAST(l.doc_id % 3 AS VARCHAR)
            ELSE (['学习','备忘','提醒','生活','任务','财务','职务'])[l.doc_id % 7 + 1] END AS category
FROM labels l JOIN raw_files r ON r.file_id = l.doc_id)"""


def _org_moves(spark, sf):
    labels = X.table(spark, sf, "labels")
    raw = X.raw_files(spark, sf).select(F.col("file_id").alias("doc_id"), "path")
    dirs = F.array(*[F.lit(c) for c in K.CATEGORY_DIRS])
    return labels.join(raw, "doc_id").select(
        F.col("doc_id").alias("seq"),
        F.when(F.col("quality") == 1, F.col("path")).otherwise(F.concat("path", F.lit(".missing"))).alias("path"),
        F.when(F.col("toxic") == 1, F.concat(F.lit("Unknown"), F.pmod("doc_id", F.lit(3)).cast("string")))
        .otherwise(F.element_at(dirs, (F.pmod("doc_id", F.lit(7)) + 1).cast("int"))).alias("category"))


@register("organize_plan", O.build(["raw_files"], f"""
SELECT seq, src, CASE WHEN ok THEN target_dir || '/' || CASE WHEN k = 0 THEN name
                      ELSE stem || '_' || CAST(k AS VARCHAR) || sfx END END AS dst,
       category, target_dir, CASE WHEN ok THEN 'moved' ELSE 'error' END AS status,
       CASE WHEN NOT ok THEN 'Source not found: ' || src END AS error
FROM (SELECT m.seq, m.path AS src, m.category, r.file_id IS NOT NULL AS ok,
             'vault/' || CASE WHEN m.category IN ('_inbox', '_archive', '_sensitive', '学习', '备忘', '提醒', '生活',
                                                  '任务', '财务', '职务') THEN m.category ELSE '_inbox' END AS target_dir,
             regexp_extract(m.path, '[^/]*$', 0) AS name,
             regexp_extract(regexp_extract(m.path, '[^/]*$', 0), '^.+([.][^.]+)$', 1) AS sfx,
             regexp_extract(regexp_extract(m.path, '[^/]*$', 0), '^(.+)[.][^.]+$', 1) AS stem,
             row_number() OVER (PARTITION BY r.file_id IS NOT NULL,
               CASE WHEN m.category IN ('_inbox', '_archive', '_sensitive', '学习', '备忘', '提醒', '生活', '任务',
                                        '财务', '职务') THEN m.category ELSE '_inbox' END,
               regexp_extract(m.path, '[^/]*$', 0) ORDER BY m.seq) - 1 AS k
      FROM {ORG_MOVES_SQL} m LEFT JOIN raw_files r ON r.path = m.path)"""))
def q_organize_plan(spark, sf):
    return ORG.organize_plan(X.raw_files(spark, sf), _org_moves(spark, sf))


ARCHIVE_SQL = f"""
SELECT path AS src, 'vault/_archive/' || category || '/' || CASE WHEN k = 0 THEN name
       ELSE stem || '_' || CAST(k AS VARCHAR) || sfx END AS dst, category AS from_category, file_size
FROM (SELECT path, category, file_size, regexp_extract(path, '[^/]*$', 0) AS name,
             regexp_extract(regexp_extract(path, '[^/]*$', 0), '^.+([.][^.]+)$', 1) AS sfx,
             regexp_extract(regexp_extract(path, '[^/]*$', 0), '^(.+)[.][^.]+$', 1) AS stem,
             row_number() OVER (PARTITION BY category, regexp_extract(path, '[^/]*$', 0) ORDER BY path) - 1 AS k
      FROM catalog_files
      WHERE CAST(last_accessed AS DATE) <= DATE '2024-02-01' - INTERVAL {ARCHIVE_DAYS} DAY
        AND category <> '_archive' AND NOT starred)"""


@register("archive_plan", O.build(["catalog_files"], ARCHIVE_SQL))
def q_archive_plan(spark, sf):
    return ORG.archive_plan(X.catalog_files(spark, sf), X.AS_OF, ARCHIVE_DAYS)


@register("archive_summary", O.build(["catalog_files"], f"""
SELECT count(*) AS archived_count, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_freed_bytes
FROM ({ARCHIVE_SQL})"""))
def q_archive_summary(spark, sf):
    return ORG.archive_summary(ORG.archive_plan(X.catalog_files(spark, sf), X.AS_OF, ARCHIVE_DAYS))


# ---------------------------------------------------------------------------
# Category suggestion (SUG)
# ---------------------------------------------------------------------------

from shelfspark.operators import suggest as SUG  # noqa: E402


@register("frequent_keywords", O.build(["frequent_kw"], "SELECT keyword, cnt FROM frequent_kw"))
def q_frequent_keywords(spark, sf):
    return SUG.frequent_keywords(X.review_inbox(spark, sf)).select("keyword", "cnt")


@register("keyword_cooccurrence", O.build(["inbox_occ", "frequent_kw"], """
SELECT a.keyword AS kw1, b.keyword AS kw2, count(*) AS files
FROM (SELECT DISTINCT file_id, keyword FROM inbox_occ WHERE keyword IN (SELECT keyword FROM frequent_kw)) a
JOIN (SELECT DISTINCT file_id, keyword FROM inbox_occ WHERE keyword IN (SELECT keyword FROM frequent_kw)) b
  ON a.file_id = b.file_id AND a.keyword < b.keyword
GROUP BY a.keyword, b.keyword"""))
def q_keyword_cooccurrence(spark, sf):
    inbox = X.review_inbox(spark, sf)
    return SUG.keyword_cooccurrence(inbox, SUG.frequent_keywords(inbox))


@register("suggest_categories", O.build(["suggest_clusters", "frequent_ord", "inbox_occ"], """
SELECT CAST(row_number() OVER (ORDER BY file_count DESC, ci) AS INTEGER) AS rank, 'ok' AS status,
       proposed_name, top_keywords, file_count, sample_files, CAST(NULL AS VARCHAR) AS message
FROM (
  SELECT c.ci, array_to_string(list_transform(c.members[1:3], lambda x: k.kwl[x]), ' · ') AS proposed_name,
         array_to_string(list_transform(c.members[1:10], lambda x: k.kwl[x]), '|') AS top_keywords,
         (SELECT count(DISTINCT o.path) FROM inbox_occ o WHERE list_contains(list_transform(c.members,
            lambda x: k.kwl[x]), o.keyword)) AS file_count,
         (SELECT array_to_string(list(path ORDER BY path), '|') FROM (
            SELECT DISTINCT o.path FROM inbox_occ o
            WHERE list_contains(list_transform(c.members, lambda x: k.kwl[x]), o.keyword) ORDER BY o.path LIMIT 3))
           AS sample_files
  FROM (SELECT unnest(clusters) AS members, generate_subscripts(clusters, 1) AS ci FROM suggest_clusters) c,
       (SELECT list(keyword ORDER BY ord) AS kwl FROM frequent_ord) k)
QUALIFY rank <= 3"""))
def q_suggest_categories(spark, sf):
    s = SUG.suggest_categories(X.review_inbox(spark, sf))
    return s.select("rank", "status", "proposed_name", F.array_join("top_keywords", "|").alias("top_keywords"),
                    "file_count", F.array_join("sample_files", "|").alias("sample_files"), "message")


@register("suggest_gates", O.build(["review_inbox"], """
SELECT 1 AS gate, 'insufficient_data' AS status, 'Need at least ' || CAST(count(*) + 1 AS VARCHAR) || ' files in _inbox (currently '
       || CAST(count(*) AS VARCHAR) || ')' AS message FROM review_inbox
UNION ALL SELECT 2, 'no_keywords', 'No keywords extracted from inbox files yet. Run ingest first.'
UNION ALL SELECT 3, 'no_clusters', 'No clear keyword clusters found in inbox files.'
UNION ALL SELECT 4, 'no_clusters', 'No significant clusters found.'"""))
def q_suggest_gates(spark, sf):
    """The four reasons to suggest nothing: too few files, no keywords, none that is frequent, none that meet."""
    inbox = cut_lineage(X.review_inbox(spark, sf).select("file_id", "path", "keywords"), "gates-inbox")
    n = inbox.count()
    words = lambda *cols: inbox.withColumn("keywords", F.array(*cols).cast("array<string>"))
    cases = [(inbox, n + 1), (words(), 1), (words(F.concat(F.lit("k"), F.abs("file_id").cast("string"), F.when(F.col("file_id") < 0, F.lit("s")).otherwise(F.lit("")))), 1),
             (words(F.concat(F.lit("group"), F.pmod("file_id", F.lit(3)).cast("string"))), 1)]
    out = None
    for gate, (rows, least) in enumerate(cases, 1):
        part = SUG.suggest_categories(rows, min_files=least).select(F.lit(gate).alias("gate"), "status", "message")
        out = part if out is None else out.unionByName(part)
    return out


@register("group_files", O.build(["pick_listed", "pick_req"], """
SELECT seq, path AS src, directory || '/Picked ' || c || '/' || original_name AS dst, 'moved' AS status FROM pick_listed WHERE kind = 0
UNION ALL
SELECT l.seq + 1, l.path, CASE WHEN kind = 1 THEN l.directory || '/Picked ' || l.c || '_1/' || l.original_name END,
       CASE WHEN kind = 1 THEN 'moved' ELSE 'error' END
FROM pick_listed l JOIN pick_req r USING (directory, c)
UNION ALL SELECT seq + 1, directory || '/none.txt', NULL, 'error' FROM pick_req"""))
def q_group_files(spark, sf):
    """In every directory, and for every 9000 identifiers, a request for every ninth file, then one for the same
    folder name that names those again, their neighbours and a file that is not there."""
    raw = X.raw_files(spark, sf).select("file_id", "path", "directory").where("file_id >= 0")
    kind, c = F.pmod("file_id", F.lit(9)), F.expr("file_id div 9000").alias("c")  # a request names 1000 files at most

    def listed(i):
        return raw.where(kind == i).groupBy("directory", c).agg(F.sort_array(F.collect_list("path")).alias(f"paths{i}"))
    req = listed(0).join(listed(1), ["directory", "c"], "left").withColumn(
        "seq", 2 * (1000 * F.col("c") + F.regexp_extract("directory", "[0-9]+$", 0).cast("bigint")))
    missing = F.array(F.concat("directory", F.lit("/none.txt")))
    second = F.concat("paths0", F.coalesce("paths1", F.array().cast("array<string>")), missing)
    asked = [(F.col("seq"), F.col("paths0")), (F.col("seq") + 1, second)]
    asked = [req.select(seq.alias("seq"), F.concat(F.lit("Picked "), F.col("c").cast("string")).alias("folder_name"),
                        F.col("directory").alias("source_dir"), paths.alias("paths")) for seq, paths in asked]
    return ORG.group_files(raw, asked[0].unionByName(asked[1])).select("seq", "src", "dst", "status")


# ---------------------------------------------------------------------------
# Scans and sources (SCN), path / name checks (FLT-7..9), slugs (TXT-4)
# ---------------------------------------------------------------------------

from shelfspark.functions import paths as PTH  # noqa: E402
from shelfspark.sources import files as SRC  # noqa: E402

VAULT_ROOT = "vault"
_FLAG_SQL = ", ".join([
    f"extension IN ({', '.join(O.q(e) for e in K.FLAG_IMAGE)}) AS is_image",
    f"extension IN ({', '.join(O.q(e) for e in K.FLAG_VIDEO)}) AS is_video",
    f"extension IN ({', '.join(O.q(e) for e in K.FLAG_AUDIO)}) AS is_audio",
    f"extension IN ({', '.join(O.q(e) for e in K.FLAG_TEXT)}) AS is_text",
    "extension = '.pdf' AS is_pdf"])


def _vault_listing(spark, sf):
    return SRC.listing_from_paths(X.vault_paths(spark, sf), VAULT_ROOT)


@register("scan_files", O.build(["vault_listing"], """
SELECT path, name, size, extension, relative_path FROM vault_listing"""))
def q_scan_files(spark, sf):
    return _vault_listing(spark, sf).select("path", "name", "size", "extension", "relative_path")


@register("list_files", O.build(["raw_files", "vault_files"], """
SELECT r.path AS relative_path, r.original_name AS name, r.file_type AS extension,
       CASE WHEN r.file_type = '.docx' THEN -1 ELSE strlen(r.extracted_text) END AS size FROM raw_files r"""))
def q_list_files(spark, sf):
    """The raw files written as a tree, and listed; a packed file's size is not stated."""
    ls = SRC.list_files(spark, X.written_vault(spark, sf))
    return ls.select("relative_path", "name", "extension", F.when(F.col("extension") == ".docx", F.lit(-1)).otherwise(F.col("size")).alias("size"))


_RELATIVE = r"^.*/vault-[0-9a-f]+/"


@register("extract_files", O.build(["vault_files"], """
SELECT path AS relative_path, original_name AS filename, file_type, text, error FROM vault_files"""))
def q_extract_files(spark, sf):
    rows = SRC.extract_files(spark, X.written_vault(spark, sf), recursive=True)
    return rows.select(F.regexp_replace("filepath", _RELATIVE, "").alias("relative_path"), "filename", "file_type", "text", "error")


@register("stream_ingest_files", O.build(["vault_files", "vault_keywords", "vcls_classified"], """
SELECT f.path AS relative_path, f.file_type, coalesce(array_to_string(k.keywords, '|'), '') AS keywords, c.category, c.category_id,
       c.confidence, CASE WHEN c.confidence < 0.3 THEN '_inbox' ELSE c.category END AS routed_to,
       c.confidence < 0.3 AS needs_review, f.error
FROM vault_files f JOIN vcls_classified c ON c.file_id = f.file_id LEFT JOIN vault_keywords k ON k.file_id = f.file_id"""))
def q_stream_ingest_files(spark, sf):
    from shelfspark.streaming import jobs
    cats, kws = X.dictionary(spark)
    rows = jobs.stream_ingest_files(spark, X.written_vault(spark, sf) + "/vault/_inbox", cats, kws)
    return rows.select(F.regexp_replace("path", _RELATIVE, "").alias("relative_path"), "file_type", F.array_join("keywords", "|").alias("keywords"),
                       "category", "category_id", "confidence", "routed_to", "needs_review", "error")


@register("file_type_flags", O.build(["vault_listing"], f"SELECT path, {_FLAG_SQL} FROM vault_listing"))
def q_file_type_flags(spark, sf):
    return _vault_listing(spark, sf).select("path", *PTH.type_flags(F.col("extension")))


@register("exclude_sensitive", O.build(["vault_listing"], """
SELECT path, relative_path FROM vault_listing WHERE NOT starts_with(relative_path, '_sensitive/')"""))
def q_exclude_sensitive(spark, sf):
    return SRC.exclude_sensitive(_vault_listing(spark, sf)).select("path", "relative_path")


def _mime_sql(e: str) -> str:
    return "CASE " + " ".join(f"WHEN {e} = {O.q(k)} THEN {O.q(v)}" for k, v in K.MIME_MAP.items()) + \
        f" ELSE {O.q(K.DEFAULT_MIME)} END"


@register("servable_files", O.build(["vault_listing"], f"""
SELECT path, extension IN ({', '.join(O.q(e) for e in K.ALLOWED_EXTENSIONS)}) AND size <= {K.MAX_FILE_BYTES}
       AS servable, {_mime_sql('extension')} AS mime_type FROM vault_listing"""))
def q_servable_files(spark, sf):
    v = _vault_listing(spark, sf)
    return v.select("path", PTH.servable(F.col("extension"), F.col("size")).alias("servable"),
                    PTH.mime_type(F.col("extension")).alias("mime_type"))


def _kind_sql(e: str) -> str:
    sets = [("text", K.TEXT_EXTENSIONS), ("ipynb", K.IPYNB_EXTENSIONS), ("pdf", K.PDF_EXTENSIONS),
            ("docx", K.DOCX_EXTENSIONS), ("pptx", K.PPTX_EXTENSIONS), ("image", K.IMAGE_EXTENSIONS),
            ("audio", K.AUDIO_EXTENSIONS), ("video", K.VIDEO_EXTENSIONS)]
    return "CASE " + " ".join(f"WHEN {e} IN ({', '.join(O.q(x) for x in xs)}) THEN {O.q(k)}" for k, xs in sets) + \
        " ELSE 'unknown' END"


@register("extract_dispatch", O.build(["vault_listing"], f"""
SELECT path, kind, CASE kind WHEN 'image' THEN '[Image: ' || name || ']' WHEN 'audio' THEN '[Audio: ' || name || ']'
                    WHEN 'video' THEN '[Video: ' || name || ']' WHEN 'unknown' THEN '[Unknown type: ' || name || ']'
                    END AS placeholder
FROM (SELECT path, name, {_kind_sql('extension')} AS kind FROM vault_listing)"""))
def q_extract_dispatch(spark, sf):
    v = _vault_listing(spark, sf).withColumn("kind", SRC.extraction_kind(F.col("extension")))
    return v.select("path", "kind", SRC.placeholder("kind", "name").alias("placeholder"))


_AUDIT_SQL = """(SELECT page_id, CASE page_id % 5 WHEN 0 THEN p WHEN 1 THEN '../..' || p WHEN 2 THEN '%2e%2e' || p
                                  WHEN 3 THEN '/~x' || p ELSE p || '%00.jpg' END AS raw_path
  FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS p FROM pages))"""


@register("path_audit", f"""
SELECT page_id, safe, CASE WHEN safe THEN array_to_string(kept, '/') END AS normalized FROM (
  SELECT page_id, NOT list_bool_or(list_transform(parts, lambda x: x = '..' OR starts_with(x, '~')))
                  AND len(kept) > 0 AS safe, kept
  FROM (SELECT page_id, parts, list_filter(parts, lambda x: x <> '' AND x <> '.') AS kept
        FROM (SELECT page_id, string_split(regexp_replace(replace(url_decode(raw_path), chr(0), ''), '^/+', ''), '/')
                     AS parts FROM {_AUDIT_SQL})))""")
def q_path_audit(spark, sf):
    a = X.audit_paths(spark, sf)
    safe, norm = PTH.path_audit(F.col("raw_path"))
    return a.select("page_id", safe.alias("safe"), norm.alias("normalized"))


@register("sanitize_names", f"""
SELECT a.page_id,
       coalesce(name <> '' AND NOT contains(name, chr(0)) AND NOT contains(name, chr(10))
         AND NOT contains(name, chr(13)) AND NOT contains(name, '/') AND NOT contains(name, '\\')
         AND NOT contains(name, '..'), FALSE) AS name_safe,
       regexp_replace(host, '[^\\w\\x{{4e00}}-\\x{{9fff}}\\-_]', '', 'g')[1:64] AS category_clean
FROM (SELECT page_id, regexp_extract(raw_path, '[^/]*$', 0) AS name FROM {_AUDIT_SQL}) a
JOIN (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages) h ON h.page_id = a.page_id""")
def q_sanitize_names(spark, sf):
    a = X.audit_paths(spark, sf).select("page_id", F.element_at(F.split("raw_path", "/"), -1).alias("name"))
    h = X.table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"))
    return a.join(h, "page_id").select("page_id", F.coalesce(PTH.is_safe_filename(F.col("name")), F.lit(False))
                                       .alias("name_safe"),
                                       PTH.validate_category(F.col("host")).alias("category_clean"))


@register("category_slug", """
SELECT item_id, pos, name, CASE WHEN slug = '' OR starts_with(slug, '_')
                                THEN 'cat_' || CAST(('0x' || substr(md5(name), 1, 8))::BIGINT % 10000 AS VARCHAR)
                                ELSE slug END AS slug
FROM (SELECT item_id, pos, name, regexp_replace(replace(lower(name), ' ', '_'), '[^a-z0-9_]', '_', 'g')[1:32] AS slug
      FROM (SELECT item_id, unnest(w) AS name, unnest(range(len(w))) AS pos
            FROM (SELECT item_id, list_concat(string_split(text, ' '), [text]) AS w FROM benchmark)))""")
def q_category_slug(spark, sf):
    """Slugs of every word of every text, and of the text itself."""
    names = F.concat(F.split("text", " "), F.array("text"))
    b = X.table(spark, sf, "benchmark").select("item_id", F.posexplode(names).alias("pos", "name"))
    return b.select("item_id", F.col("pos").cast("bigint").alias("pos"), "name", DIC.category_slug(F.col("name")).alias("slug"))


@register("assemble_pages", """
SELECT doc_id, fulltext AS text,
       CASE WHEN scanned THEN 'scanned_pdf' ELSE 'pdf' END AS file_type,
       CASE WHEN scanned THEN 'Low text content — may be scanned PDF. Install marker-pdf for OCR.' END AS error
FROM (SELECT doc_id, fulltext, length(regexp_replace(fulltext, '^\\s+|\\s+$', '', 'g')) < 50 AS scanned FROM (
  SELECT conv_id AS doc_id, coalesce(string_agg(text, chr(10) ORDER BY turn)
           FILTER (WHERE NOT regexp_matches(text, '^\\s*$')), '') AS fulltext
  FROM conversations GROUP BY conv_id))""")
def q_assemble_pages(spark, sf):
    return SRC.assemble_pages(X.pdf_pages(spark, sf))


def notebooks_from_conversations(spark, sf):
    """One notebook JSON per conversation: user turns are markdown cells, assistant
    turns code cells, others raw; even turns store ``source`` as a list of lines."""
    conv = X.table(spark, sf, "conversations")
    ctype = (F.when(F.col("role") == "user", F.lit("markdown")).when(F.col("role") == "assistant", F.lit("code"))
             .otherwise(F.lit("raw")))
    lines = F.split(F.col("text"), "\n", -1)
    as_list = F.to_json(F.transform(lines, lambda l, i: F.when(i < F.size(lines) - 1, F.concat(l, F.lit("\n")))
                                    .otherwise(l)))
    as_str = F.regexp_replace(F.to_json(F.array(F.col("text"))), r"^\[|\]$", "")
    cell = F.concat(F.lit('{"cell_type":'), F.regexp_replace(F.to_json(F.array(ctype)), r"^\[|\]$", ""),
                    F.lit(',"source":'), F.when(F.pmod("turn", F.lit(2)) == 0, as_list).otherwise(as_str), F.lit("}"))
    cells = conv.select("conv_id", "turn", cell.alias("cell")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "cell"))).alias("c"))
    return cells.select("conv_id", F.concat(F.lit('{"cells":['), F.array_join(F.transform("c", lambda x: x["cell"]), ","),
                                            F.lit('],"metadata":{}}')).alias("json"))


@register("read_notebook", """
SELECT conv_id, CASE WHEN body = '' THEN '[Jupyter Notebook: 0 code cells, 0 markdown cells]' ELSE body END
       AS text
FROM (SELECT conv_id, coalesce(string_agg(
        CASE WHEN role = 'assistant' THEN '# --- Code Cell ' ELSE '# --- Markdown Cell ' END || CAST(n AS VARCHAR)
        || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE keep), '') AS body
      FROM (SELECT conv_id, turn, role, text,
                   role IN ('user', 'assistant') AND NOT regexp_matches(text, '^\\s*$') AS keep,
                   sum(CASE WHEN role IN ('user', 'assistant') AND NOT regexp_matches(text, '^\\s*$') THEN 1 ELSE 0 END)
                     OVER (PARTITION BY conv_id, role ORDER BY turn) AS n
            FROM conversations)
      GROUP BY conv_id)""")
def q_read_notebook(spark, sf):
    nb = notebooks_from_conversations(spark, sf)
    text, err = SRC.notebook_text(F.col("json"))
    return nb.select("conv_id", text.alias("text"))


# ---------------------------------------------------------------------------
# State merges: SNK-1 upsert, AGG-11..13 feeds, FLT-3 batch search
# ---------------------------------------------------------------------------

def _upsert_changes(spark, sf):
    labels = X.table(spark, sf, "labels")
    raw = X.raw_files(spark, sf).select(F.col("file_id").alias("doc_id"), "path")
    base = labels.join(raw, "doc_id").select(
        F.col("doc_id").alias("seq"), "path",
        F.when(F.col("quality") == 1, F.lit("学习")).alias("category"),
        F.when(F.col("toxic") == 1, F.lit(0.9)).alias("importance"))
    new = labels.filter(F.col("toxic") == 1).select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("vault/_inbox/new/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.lit(None).cast("string").alias("category"), F.lit(0.5).alias("importance"))
    return base.unionByName(new)


_UPSERT_SQL = """
SELECT coalesce(f.path, c.path) AS path,
       CASE WHEN f.path IS NULL THEN coalesce(c.category, '_inbox') ELSE coalesce(c.category, f.category) END
         AS category,
       CASE WHEN f.path IS NULL THEN coalesce(c.importance, 0.0) ELSE coalesce(c.importance, f.importance) END
         AS importance,
       coalesce(f.starred, FALSE) AS starred, coalesce(f.view_count, 0) AS view_count
FROM catalog_files f FULL OUTER JOIN (
  SELECT r.path, CASE WHEN l.quality = 1 THEN '学习' END AS category, CASE WHEN l.toxic = 1 THEN 0.9 END AS importance
  FROM labels l JOIN raw_files r ON r.file_id = l.doc_id
  UNION ALL SELECT 'vault/_inbox/new/' || CAST(doc_id AS VARCHAR) || '.txt', NULL, 0.5 FROM labels WHERE toxic = 1) c
  ON c.path = f.path"""


@register("upsert_files", O.build(["catalog_files"], _UPSERT_SQL))
def q_upsert_files(spark, sf):
    out = CAT.upsert(X.catalog_files(spark, sf), _upsert_changes(spark, sf))
    return out.select("path", "category", "importance", "starred", "view_count")


@register("merge_feed", O.build(["catalog_files"], _UPSERT_SQL))
def q_merge_feed(spark, sf):
    """The same changes as two feeds into a stored table."""
    from shelfspark.operators import merge
    folder = shared_scratch(spark, "files-table")
    merge.write_table(X.catalog_files(spark, sf).select("path", "category", "importance", "starred", "view_count"), folder, buckets=32)
    changes = _upsert_changes(spark, sf)
    half = changes.agg(F.max("seq")).first()[0] // 2
    for part in (F.col("seq") <= half, F.col("seq") > half):
        merge.merge_feed(spark, folder, changes.where(part), buckets=32)
    return merge.read_table(spark, folder).select("path", "category", "importance", "starred", "view_count")


_EVENT_FILE_SQL = "(SELECT e.*, r.path FROM events e JOIN raw_files r ON r.file_id = e.event_id % (SELECT n FROM n_docs))"


def _event_files(spark, sf):
    docs = X.table(spark, sf, "documents")
    n = docs.select(F.count(F.lit(1))).scalar()
    raw = X.raw_files(spark, sf).select(F.col("file_id").alias("_fid"), "path")
    ev = X.table(spark, sf, "events")
    return ev.withColumn("_fid", F.pmod("event_id", n)).join(raw, "_fid").drop("_fid")


@register("apply_importance", O.build(["catalog_files", "raw_files", "n_docs"], f"""
SELECT coalesce(f.path, c.path) AS path, coalesce(c.importance, f.importance) AS importance,
       coalesce(f.category, '_inbox') AS category, coalesce(f.view_count, 0) AS view_count
FROM catalog_files f FULL OUTER JOIN (
  SELECT path, arg_max(importance, seq) AS importance FROM (
    SELECT event_id AS seq, path, value / 100.0 AS importance FROM {_EVENT_FILE_SQL} WHERE event_type = 'purchase'
    UNION ALL SELECT event_id, 'vault/_inbox/ghost/' || CAST(event_id AS VARCHAR) || '.txt', value / 100.0
    FROM events WHERE event_type = 'error') GROUP BY path) c ON c.path = f.path"""))
def q_apply_importance(spark, sf):
    ev = _event_files(spark, sf)
    known = ev.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("seq"), "path", (F.col("value") / 100.0).alias("importance"))
    ghost = X.table(spark, sf, "events").filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("vault/_inbox/ghost/"), F.col("event_id").cast("string"), F.lit(".txt")).alias("path"),
        (F.col("value") / 100.0).alias("importance"))
    out = CAT.apply_importance(X.catalog_files(spark, sf), known.unionByName(ghost))
    return out.select("path", "importance", "category", "view_count")


@register("apply_star_toggles", O.build(["catalog_files", "raw_files", "n_docs"], f"""
SELECT f.path, CASE WHEN coalesce(t.n, 0) % 2 = 1 THEN NOT f.starred ELSE f.starred END AS starred
FROM catalog_files f LEFT JOIN (SELECT path, count(*) AS n FROM {_EVENT_FILE_SQL} WHERE event_type = 'click'
                                GROUP BY path) t ON t.path = f.path"""))
def q_apply_star_toggles(spark, sf):
    toggles = _event_files(spark, sf).filter(F.col("event_type") == "click").select(F.col("event_id").alias("seq"),
                                                                                    "path")
    new, _ = CAT.apply_star_toggles(X.catalog_files(spark, sf), toggles)
    return new.select("path", "starred")


@register("star_toggle_errors", O.build(["catalog_files"], """
SELECT DISTINCT 'vault/ghost/' || CAST(user_id AS VARCHAR) AS path, 'File not found in metadata' AS error
FROM events WHERE event_type = 'signup'"""))
def q_star_toggle_errors(spark, sf):
    toggles = X.table(spark, sf, "events").filter(F.col("event_type") == "signup").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("vault/ghost/"), F.col("user_id").cast("string")).alias("path"))
    _, errors = CAT.apply_star_toggles(X.catalog_files(spark, sf), toggles)
    return errors


def _description_feed(spark, sf):
    conv = X.table(spark, sf, "conversations")
    base = F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'")
    a = conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
                    F.concat(F.lit("vault/conv/"), F.col("conv_id").cast("string")).alias("path"),
                    F.col("text").alias("description"))
    b = X.table(spark, sf, "pages").select(
        (F.lit(10 ** 9) + F.col("page_id")).alias("seq"),
        F.concat(F.lit("vault/page/"), F.col("page_id").cast("string")).alias("path"), F.col("url").alias("description"))
    feed = a.unionByName(b)
    return feed.withColumn("at", F.timestamp_add("SECOND", F.col("seq"), base))


@register("apply_descriptions", O.build(["descriptions"], """
SELECT coalesce(d.path, c.path) AS path, coalesce(c.description, d.description) AS description,
       CASE WHEN d.path IS NULL THEN c.first_at ELSE d.created_at END AS created_at,
       coalesce(c.at_ts, d.updated_at) AS updated_at
FROM descriptions d FULL OUTER JOIN (
  SELECT path, arg_max(description, seq) AS description, arg_max(at_ts, seq) AS at_ts, min(at_ts) AS first_at FROM (
    SELECT seq, path, description, TIMESTAMP '2024-02-01 00:00:00' + to_seconds(seq) AS at_ts FROM (
      SELECT conv_id * 1000 + turn AS seq, 'vault/conv/' || CAST(conv_id AS VARCHAR) AS path, text AS description
      FROM conversations
      UNION ALL SELECT 1000000000 + page_id, 'vault/page/' || CAST(page_id AS VARCHAR), url FROM pages)
    WHERE description IS NOT NULL AND description <> '') GROUP BY path) c ON c.path = d.path"""))
def q_apply_descriptions(spark, sf):
    return CAT.apply_descriptions(X.descriptions(spark, sf), _description_feed(spark, sf))


@register("delete_descriptions", O.build(["descriptions"], """
SELECT p.path, d.path IS NOT NULL AS deleted
FROM (SELECT DISTINCT 'vault/conv/' || CAST(page_id AS VARCHAR) AS path FROM pages) p
LEFT JOIN descriptions d ON d.path = p.path"""))
def q_delete_descriptions(spark, sf):
    dels = X.table(spark, sf, "pages").select(F.concat(F.lit("vault/conv/"), F.col("page_id").cast("string"))
                                              .alias("path"))
    _, report = CAT.delete_descriptions(X.descriptions(spark, sf), dels)
    return report


def _batch_queries(spark, sf):
    """Every two neighbouring words of every benchmark text; some cut short, some with wildcards."""
    b = X.table(spark, sf, "benchmark")
    words = b.select("item_id", F.split(F.trim("text"), r"\s+").alias("w")).select("item_id", "w", F.posexplode("w").alias("i", "x"))
    x, y, i = F.col("x"), F.try_element_at("w", F.col("i") + 2), F.col("i")
    y = (F.when(i % 11 == 3, F.substring(y, 1, 2)).when(i % 13 == 5, F.concat(F.substring(y, 1, 1), F.lit("_"), F.substring(y, 3, 1000)))
         .when(i % 17 == 6, F.concat(F.substring(y, 1, 2), F.lit("%"), F.substring(y, 4, 1000))).otherwise(y))
    x = F.when(i % 11 == 3, F.substring(x, 1, 2)).otherwise(x)
    return words.select((F.col("item_id") * 1000 + i).alias("query_id"), F.concat_ws(" ", x, y).alias("query"))


@register("search_batch", O.build(["descriptions"], f"""
SELECT query_id, path, updated_at, rank, total_hits FROM (
  SELECT q.query_id, d.path, d.updated_at,
         row_number() OVER (PARTITION BY q.query_id ORDER BY d.updated_at DESC, d.path) AS rank,
         count(*) OVER (PARTITION BY q.query_id) AS total_hits
  FROM (
    SELECT item_id * 1000 + i AS query_id, list_filter([CASE WHEN i % 11 = 3 THEN substring(x, 1, 2) ELSE x END,
           CASE WHEN i % 11 = 3 THEN substring(y, 1, 2) WHEN i % 13 = 5 THEN substring(y, 1, 1) || '_' || substring(y, 3, 1000)
                WHEN i % 17 = 6 THEN substring(y, 1, 2) || '%' || substring(y, 4, 1000) ELSE y END], lambda t: t IS NOT NULL) AS terms
    FROM (SELECT item_id, unnest(range(len(w))) AS i, unnest(w) AS x, unnest(list_concat(w[2:], [NULL::VARCHAR])) AS y
          FROM (SELECT item_id, string_split_regex(trim(text), '\\s+') AS w FROM benchmark))) q
  JOIN descriptions d ON len(list_filter(q.terms, lambda t: {O.fold('d.description')} LIKE '%' || {O.fold('t')} || '%')) = len(q.terms))
WHERE rank <= 50"""))
def q_search_batch(spark, sf):
    r = CAT.search_batch(X.descriptions(spark, sf), _batch_queries(spark, sf))
    return r.withColumn("rank", F.col("rank").cast("bigint"))


# ---------------------------------------------------------------------------
# Streaming (STR)
# ---------------------------------------------------------------------------

from shelfspark.streaming import jobs as STR  # noqa: E402

THROTTLE_LIMIT = K.MAX_ATTEMPTS
THROTTLE_WINDOW_S = 86_400  # FIXTURES: 5 per day (60 s never triggers on this data)


@register("stream_access_counts", O.build(["access_log"], """
SELECT file_path, count(*) AS views, max(accessed_at) AS last_view FROM access_log GROUP BY file_path"""))
def q_stream_access_counts(spark, sf):
    return STR.stream_access_counts(spark, sf).select("file_path", "views", "last_view")


@register("access_windows", O.build(["access_log", "classified", "raw_files"], """
SELECT window_start, window_end, category, views FROM (
  SELECT date_trunc('day', e.accessed_at) AS window_start, date_trunc('day', e.accessed_at) + INTERVAL 1 DAY AS window_end,
         c.category, count(*) AS views
  FROM access_log e JOIN raw_files r ON r.path = e.file_path JOIN classified c ON c.file_id = r.file_id
  GROUP BY 1, 2, 3)
WHERE window_end <= (SELECT max(accessed_at) FROM access_log) - INTERVAL 1 HOUR"""))
def q_access_windows(spark, sf):
    return STR.access_windows(spark, sf)


@register("stream_ingest", O.build(["classified", "raw_files"], """
SELECT c.file_id, r.path, c.category, c.category_id, c.confidence,
       CASE WHEN c.confidence < 0.3 THEN '_inbox' ELSE c.category END AS routed_to,
       c.confidence < 0.3 AS needs_review
FROM classified c JOIN raw_files r ON r.file_id = c.file_id"""))
def q_stream_ingest(spark, sf):
    return STR.stream_ingest(spark, sf)


@register("stream_corrections", O.build(["learned_keywords"], """
SELECT category_id, keyword, locale, weight, source FROM learned_keywords"""))
def q_stream_corrections(spark, sf):
    return STR.stream_corrections(spark, sf).select("category_id", "keyword", "locale", "weight", "source")


_THROTTLE_SQL = f"""
WITH RECURSIVE ev AS (
  SELECT CAST(user_id AS VARCHAR) AS key, event_id, ts, epoch_us(ts) AS t,
         row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS i
  FROM events),
fold(key, i, event_id, ts, allowed, remaining, kept) AS (
  SELECT key, 0::BIGINT, NULL::BIGINT, NULL::TIMESTAMP, NULL::BOOLEAN, NULL::INTEGER, []::BIGINT[]
  FROM (SELECT DISTINCT key FROM ev)
  UNION ALL
  SELECT f.key, f.i + 1, e.event_id, e.ts,
         len(list_filter(f.kept, lambda x: e.t - x < {THROTTLE_WINDOW_S * 1_000_000})) < {THROTTLE_LIMIT},
         CAST(greatest({THROTTLE_LIMIT} - len(list_filter(f.kept, lambda x: e.t - x < {THROTTLE_WINDOW_S * 1_000_000})), 0)
              AS INTEGER),
         CASE WHEN len(list_filter(f.kept, lambda x: e.t - x < {THROTTLE_WINDOW_S * 1_000_000})) < {THROTTLE_LIMIT}
              THEN list_append(list_filter(f.kept, lambda x: e.t - x < {THROTTLE_WINDOW_S * 1_000_000}), e.t)
              ELSE list_filter(f.kept, lambda x: e.t - x < {THROTTLE_WINDOW_S * 1_000_000}) END
  FROM fold f JOIN ev e ON e.key = f.key AND e.i = f.i + 1)
SELECT key, event_id, ts, allowed, remaining FROM fold WHERE i > 0"""


@register("throttle_audit", _THROTTLE_SQL)
def q_throttle_audit(spark, sf):
    return STR.throttle_batch(X.attempts(spark, sf), THROTTLE_LIMIT, THROTTLE_WINDOW_S)


@register("stream_throttle_ordered", f"""
SELECT key, event_id, ts, allowed, remaining FROM ({_THROTTLE_SQL})
WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def q_stream_throttle_ordered(spark, sf):
    return STR.stream_throttle_ordered(spark, sf, THROTTLE_LIMIT, THROTTLE_WINDOW_S)


@register("stream_throttle", _THROTTLE_SQL)
def q_stream_throttle(spark, sf):
    return STR.stream_throttle(spark, sf, THROTTLE_LIMIT, THROTTLE_WINDOW_S)


@register("attempt_rate", f"""
SELECT CAST(user_id AS VARCHAR) AS key, event_id,
       count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
                      RANGE BETWEEN {THROTTLE_WINDOW_S * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS attempts_in_window
FROM events""")
def q_attempt_rate(spark, sf):
    from pyspark.sql import Window
    from shelfspark.functions.times import ntz_micros
    a = X.attempts(spark, sf).withColumn("t", ntz_micros("ts"))
    w = Window.partitionBy("key").orderBy("t").rangeBetween(-(THROTTLE_WINDOW_S * 1_000_000 - 1), 0)
    return a.select("key", "event_id", F.count(F.lit(1)).over(w).alias("attempts_in_window"))


# ---------------------------------------------------------------------------
# End-to-end compositions (E2E)
# ---------------------------------------------------------------------------

from shelfspark.plans import pipelines as E2E  # noqa: E402


@register("ingest_pipeline", O.build(["kcls_classified", "raw_files", "kwarr"], """
SELECT file_id, path, keywords, category, confidence, routed_to,
       'vault/' || routed_to || '/' || CASE WHEN k = 0 THEN original_name
         ELSE stem || '_' || CAST(k AS VARCHAR) || sfx END AS dst,
       extracted_text[1:120] || '。' || routed_to AS description
FROM (SELECT c.file_id, r.path, r.original_name, r.extracted_text,
             coalesce(array_to_string(k.keywords, '|'), '') AS keywords, c.category, c.confidence,
             CASE WHEN c.confidence < 0.3 THEN '_inbox' ELSE c.category END AS routed_to,
             regexp_extract(r.original_name, '^.+([.][^.]+)$', 1) AS sfx,
             CASE WHEN regexp_matches(r.original_name, '^.+[.][^.]+$')
                  THEN regexp_extract(r.original_name, '^(.+)[.][^.]+$', 1) ELSE r.original_name END AS stem,
             row_number() OVER (PARTITION BY CASE WHEN c.confidence < 0.3 THEN '_inbox' ELSE c.category END,
                                r.original_name ORDER BY c.file_id) - 1 AS k
      FROM kcls_classified c JOIN raw_files r ON r.file_id = c.file_id
      LEFT JOIN kwarr k ON k.doc_id = c.file_id)"""))
def q_ingest_pipeline(spark, sf):
    return E2E.ingest_pipeline(spark, sf, description_chars=E2E.DESCRIPTION_PREFIX)


@register("reclassify_shift", O.build(["classified", "lcls_classified"], """
SELECT b.category AS before, a.category AS after, count(*) AS files
FROM classified b JOIN lcls_classified a ON a.file_id = b.file_id GROUP BY b.category, a.category"""))
def q_reclassify_shift(spark, sf):
    return E2E.reclassify_shift(spark, sf)
