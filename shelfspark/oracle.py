"""DuckDB oracle SQL for the registered queries.

Independent re-statements of each operator in plain SQL over the driver's
tables (views ``documents``, ``events``, ... are pre-registered by the checker).
Fixture projections are written once as named CTEs; ``build`` assembles the
ones a query needs in dependency order.
"""

from __future__ import annotations

from shelfspark import constants as K
from shelfspark.fixtures import ARCHIVED_EVERY, FIXTURE_KEYWORDS, TEXT_JUNK, TEXT_MIXED, TEXT_ZH
from shelfspark.operators.dictionary import seed_category_rows, seed_keyword_rows


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _lang(expr: str) -> str:
    cjk = rf"length(regexp_replace({expr}, '[^\x{{4e00}}-\x{{9fff}}\x{{3040}}-\x{{30ff}}]', '', 'g'))"
    asc = rf"length(regexp_replace({expr}, '[^A-Za-z]', '', 'g'))"
    return (f"(CASE WHEN {expr} IS NULL OR {expr} = '' THEN 'zh' WHEN {cjk} > {asc} THEN 'zh' "
            f"WHEN {asc} > {cjk} * 2 THEN 'en' ELSE 'mixed' END)")


def lang(expr: str) -> str:
    return _lang(expr)


WS = K.WHITESPACE_RUN
STRIP = q(K.KEYWORD_STRIP_CHARS)


def _categories_values() -> str:
    rows = []
    for cid, ord_, zh, en, exts, sc, active in seed_category_rows():
        ext = "[" + ", ".join(q(e) for e in exts) + "]::VARCHAR[]"
        rows.append(f"({q(cid)}, {ord_}, {q(zh)}, {q(en)}, {ext}, {sc}::BIGINT, {str(active).upper()})")
    return ("SELECT * FROM (VALUES " + ", ".join(rows) +
            ") t(id, ord, name_zh, name_en, extensions, sample_count, is_active)")


def _keywords_values() -> str:
    rows = seed_keyword_rows() + [(c, k, l, w, "user") for c, k, l, w in FIXTURE_KEYWORDS]
    vals = ", ".join(f"({i}::BIGINT, {q(c)}, {q(k)}, {q(l)}, {float(w)!r}::DOUBLE, {q(s)})"
                     for i, (c, k, l, w, s) in enumerate(rows))
    return "SELECT * FROM (VALUES " + vals + ") t(kw_id, category_id, keyword, locale, weight, source)"


def _file_name() -> str:
    k = "(doc_id // 20)"
    return (f"CASE {k} % 6 "
            f"WHEN 0 THEN 'report_v' || CAST({k} AS VARCHAR) || '.pdf' "
            f"WHEN 1 THEN printf('photo_%03d.jpg', {k}) "
            f"WHEN 2 THEN printf('%d-%02d-%02d-meeting.txt', 2024 + {k} // 336, ({k} // 28) % 12 + 1, {k} % 28 + 1) "
            f"WHEN 3 THEN 'contract' || CAST({k} // 18 AS VARCHAR) || '.' || (['pdf','docx','xlsx'])[({k} // 6) % 3 + 1] "
            f"WHEN 4 THEN 'notes ' || CAST({k} AS VARCHAR) || ' ' || "
            f"CASE WHEN ({k} // 6) % 2 = 0 THEN 'final' ELSE 'draft' END || '.md' "
            f"ELSE 'misc' || CAST(doc_id AS VARCHAR) || '.bin' END")


SUFFIX = r"lower(regexp_extract({x}, '(?s)^.+(\.[^.]+)$', 1))"

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    CTES[name] = (deps, body)


cte("categories", [], _categories_values())
cte("keywords", [], _keywords_values())
cte("n_docs", [], "SELECT count(*) AS n FROM documents")
_NAME = f"CASE WHEN extra THEN 's_' ELSE '' END || {_file_name()}"
cte("raw_files", [], f"""
SELECT CASE WHEN extra THEN -1 - doc_id ELSE doc_id END AS file_id, 'vault/_inbox/' || source AS directory,
       {_NAME} AS original_name, text AS extracted_text,
       n_chars AS file_size, CAST(doc_id % 11 AS DOUBLE) / 10.0 AS importance, doc_id % 17 = 0 AS starred,
       TIMESTAMP '2024-01-01 00:00:00' AS created_at,
       'vault/_inbox/' || source || '/' || {_NAME} AS path,
       {SUFFIX.format(x="(" + _NAME + ")")} AS file_type
FROM (SELECT doc_id, source, n_chars, text, FALSE AS extra FROM documents
      UNION ALL SELECT doc_id, source, length(s) AS n_chars, s AS text, TRUE AS extra
      FROM (SELECT doc_id, source, CASE doc_id % 10 WHEN 7 THEN {q(TEXT_ZH)} WHEN 8 THEN {q(TEXT_MIXED)}
                                   WHEN 9 THEN {q(TEXT_JUNK)} END AS s FROM documents) WHERE s IS NOT NULL)""")
cte("access_log", ["raw_files", "n_docs"], """
SELECT e.event_id, f.path AS file_path, e.ts AS accessed_at
FROM events e JOIN raw_files f ON f.file_id = e.event_id % (SELECT n FROM n_docs)
WHERE e.event_type = 'view'""")
# classification (CLS-1..8) with the extracted keywords
cte("cls_prepped", ["raw_files", "kwarr"], f"""
SELECT file_id, lower(original_name) AS _name, lower(coalesce(array_to_string(k.keywords, ' '), '')) AS _kwj,
       lower(original_name) || ' ' || lower(coalesce(extracted_text, '')) || ' ' || lower(coalesce(array_to_string(k.keywords, ' '), '')) AS _hay,
       file_type AS _ext,
       {lang("(CASE WHEN coalesce(extracted_text, '') <> '' THEN extracted_text ELSE lower(original_name) END)")}
         AS locale_detected
FROM raw_files LEFT JOIN kwarr k ON k.doc_id = file_id""")
cte("cls_dict", ["categories", "keywords"], """
SELECT k.kw_id, k.category_id, c.ord, k.keyword, k.locale, k.weight
FROM keywords k JOIN categories c ON c.id = k.category_id WHERE c.is_active""")
cte("cls_matches", ["cls_prepped", "cls_dict"], """
SELECT p.file_id, d.category_id, d.ord, d.kw_id, d.keyword, d.locale AS keyword_locale, d.weight,
       CASE WHEN contains(p._name, d.keyword) THEN 3 WHEN contains(p._kwj, d.keyword) THEN 2 ELSE 1 END AS tier,
       CASE WHEN d.locale = p.locale_detected THEN 1.2 ELSE 1.0 END AS locale_bonus
FROM cls_prepped p JOIN cls_dict d ON contains(p._hay, d.keyword)""")
cte("cls_contrib", ["cls_matches", "cls_prepped", "categories"], """
SELECT file_id, category_id, ord,
       CAST(CAST(weight AS DECIMAL(18,8)) * (CAST(tier AS DECIMAL(2,0)) * CAST(locale_bonus AS DECIMAL(2,1)))
            AS DECIMAL(22,9)) AS contrib,
       kw_id AS seq,
       CASE WHEN tier = 3 THEN printf('filename ''%s'' (w=%.1f)', keyword, weight)
            WHEN tier = 2 THEN printf('keyword ''%s'' (w=%.1f)', keyword, weight) END AS label
FROM cls_matches
UNION ALL
SELECT p.file_id, c.id, c.ord, CAST(2.0 AS DECIMAL(22,9)), -1, 'extension ' || p._ext
FROM cls_prepped p JOIN (SELECT id, ord, unnest(extensions) AS ext FROM categories WHERE is_active) c
  ON c.ext = p._ext""")
cte("cls_scores", ["cls_contrib"], """
SELECT file_id, category_id, ord, sum(contrib) AS score_dec,
       list(label ORDER BY seq) FILTER (WHERE label IS NOT NULL) AS labels
FROM cls_contrib GROUP BY file_id, category_id, ord""")
cte("cls_ranked", ["cls_scores"], """
SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score_dec DESC, ord) AS rank FROM cls_scores""")
cte("kw_count", ["keywords"], "SELECT category_id, count(*) AS n_kw FROM keywords GROUP BY category_id")
cte("classified", ["cls_prepped", "cls_ranked", "categories", "kw_count"], """
SELECT p.file_id,
       coalesce(c.name_zh, '_inbox') AS category, b.category_id,
       CASE WHEN b.file_id IS NULL THEN 0.0
            ELSE least(CAST(b.score_dec AS DOUBLE) / greatest(CAST(n.n_kw AS DOUBLE) * 2.5, 5.0), 1.0) END
         AS confidence,
       coalesce(CAST(b.score_dec AS DOUBLE), 0.0) AS score,
       p.locale_detected,
       CASE WHEN b.file_id IS NULL THEN 'No keyword matches — needs manual classification'
            ELSE coalesce(array_to_string(b.labels[1:5], '; '), '') END AS reason
FROM cls_prepped p
LEFT JOIN (SELECT * FROM cls_ranked WHERE rank = 1) b ON b.file_id = p.file_id
LEFT JOIN categories c ON c.id = b.category_id
LEFT JOIN kw_count n ON n.category_id = b.category_id""")
cte("cls_suggest", ["cls_ranked", "classified", "categories"], """
SELECT x.file_id,
       coalesce(array_to_string(list(c.name_zh ORDER BY r.rank) FILTER (WHERE r.rank > 1 AND x.confidence < 0.3), '|'), '')
         AS suggestions
FROM classified x LEFT JOIN cls_ranked r ON r.file_id = x.file_id AND r.rank <= 3
LEFT JOIN categories c ON c.id = r.category_id
GROUP BY x.file_id""")
# keyword extraction (TXT-2)
cte("file_words", ["raw_files"], f"""
SELECT doc_id, pos, trim(w, {STRIP}) AS keyword FROM (
  SELECT file_id AS doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS pos
  FROM (SELECT file_id, string_split_regex(lower(extracted_text), '{WS}') AS l FROM raw_files
        WHERE extracted_text <> '' AND NOT starts_with(extracted_text, '[')))
WHERE length(trim(w, {STRIP})) >= 2""")
cte("file_word_counts", ["file_words"], """
SELECT doc_id, keyword, count(*) AS cnt, min(pos) AS first_pos FROM file_words GROUP BY doc_id, keyword""")
# terms (TXT-3): words cut into script runs, bigrams of CJK runs
_CJK = r"\x{4e00}-\x{9fff}\x{3040}-\x{30ff}"
cte("file_term_counts", ["file_words"], f"""
SELECT doc_id, keyword, count(*) AS cnt, min(pos * 1000000000 + nth) AS first_pos FROM (
  SELECT doc_id, pos, unnest(terms) AS keyword, generate_subscripts(terms, 1) AS nth FROM (
    SELECT doc_id, pos, CASE WHEN regexp_matches(keyword, '[{_CJK}]') THEN
      flatten(list_transform(regexp_extract_all(keyword, '[{_CJK}]+|[^{_CJK}]+'), lambda r:
        CASE WHEN regexp_matches(r, '[{_CJK}]') THEN list_transform(range(1, length(r)), lambda i: substr(r, i, 2))
             ELSE list_filter([trim(r, {STRIP})], lambda x: length(x) >= 2) END))
      ELSE [keyword] END AS terms FROM file_words))
GROUP BY doc_id, keyword""")
cte("file_keywords", ["file_word_counts"], """
SELECT * FROM (SELECT doc_id, keyword, cnt, first_pos,
  row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, first_pos) AS rank FROM file_word_counts)
WHERE rank <= 20""")
cte("kwarr", ["file_keywords"], "SELECT doc_id, list(keyword ORDER BY rank) AS keywords FROM file_keywords GROUP BY doc_id")
cte("catalog_files", ["raw_files", "classified", "kwarr", "access_log"], f"""
SELECT r.file_id, r.path, r.directory, r.original_name,
       CASE WHEN r.file_id % {ARCHIVED_EVERY} = 0 THEN '_archive' ELSE c.category END AS category,
       r.file_type, r.extracted_text, coalesce(k.keywords, []::VARCHAR[]) AS keywords, r.file_size,
       c.confidence, r.importance, r.starred, coalesce(a.views, 0) AS view_count, r.created_at,
       coalesce(a.last_view, r.created_at) AS last_accessed, r.created_at AS last_modified
FROM raw_files r JOIN classified c ON c.file_id = r.file_id
LEFT JOIN kwarr k ON k.doc_id = r.file_id
LEFT JOIN (SELECT file_path, count(*) AS views, max(accessed_at) AS last_view FROM access_log GROUP BY file_path) a
  ON a.file_path = r.path""")
cte("descriptions", [], """
SELECT 'vault/conv/' || CAST(l.conv_id AS VARCHAR) AS path, l.description,
       TIMESTAMP '2024-01-01 00:00:00' AS created_at, e.ts AS updated_at
FROM (SELECT conv_id, arg_max(text, turn) AS description FROM conversations GROUP BY conv_id) l
LEFT JOIN events e ON e.event_id = l.conv_id""")


cte("labels_corr", ["raw_files"], """
SELECT l.doc_id AS seq, r.path AS filepath, l.toxic,
       (['学习','备忘','提醒','生活','任务','财务','职务'])[l.doc_id % 7 + 1] AS from_category,
       (['study','memo','reminder','life','task','finance','work'])[(l.doc_id + 1 + l.toxic) % 7 + 1] AS to_category
FROM labels l JOIN raw_files r ON r.file_id = l.doc_id""")


cte("pii_docs", [], """
SELECT c_custkey AS doc_id,
       CASE WHEN c_custkey % 4 = 0 THEN 'customer ' || c_name || ' segment ' || c_mktsegment
            ELSE 'ID 4110221990' || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0')
                 || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')
                 || 'X tel 138' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || ' mail '
                 || lower(replace(c_name, '#', '.')) || '@example.com permit C' || lpad(CAST(c_custkey AS VARCHAR), 8, '0')
                 || ' sid dc' || lpad(CAST(c_custkey AS VARCHAR), 6, '0')
                 || CASE WHEN c_custkey % 4 = 1 THEN ' alt 138' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '@mail.com MC'
                    || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || ' x.C' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '@y.org end'
                    ELSE '' END END AS text,
       'vault/_sensitive/scan_' || CAST(c_custkey AS VARCHAR)
         || CASE c_custkey % 3 WHEN 0 THEN '_passport.jpg' WHEN 1 THEN '_NDA_agreement.pdf' ELSE '.png' END
         AS filepath
FROM customer""")


def _re2(p: str) -> str:
    """A fixed pattern in RE2 syntax (DuckDB): code points as \\x{...}."""
    import re as _re
    return _re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: "\\x{" + m.group(1) + "}", p)


def _pii_lists() -> str:
    cols, lists = [], []
    for i, (name, pat) in enumerate(K.PII_PATTERNS):
        rp = q(_re2(pat))
        cols.append(f"regexp_extract_all(text, {rp}) AS m{i}, string_split_regex(text, {rp}) AS p{i}")
        lists.append(
            f"list_transform(range(1, len(m{i}) + 1), lambda k: {{'prio': {i}, 'type': {q(name)}, 'original': m{i}[k], "
            f"'start': CAST(coalesce(list_sum(list_transform(p{i}[1:k], lambda x: length(x))), 0) "
            f"+ coalesce(list_sum(list_transform(m{i}[1:k-1], lambda x: length(x))), 0) AS INTEGER)}})")
    # by priority, then position: a match that overlaps an accepted one is dropped
    rule = ("list_reduce(list_transform(every, lambda x: [x]), lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: "
            "k.start < x[1].start + length(x[1].original) AND x[1].start < k.start + length(k.original))) > 0 "
            "THEN kept ELSE list_concat(kept, x) END)")
    return (f"SELECT doc_id, text, filepath, unnest({rule}) AS f FROM (SELECT doc_id, text, filepath, "
            "list_concat(" + ", ".join(lists) + ") AS every FROM (SELECT doc_id, text, filepath, " + ", ".join(cols) + " FROM pii_docs)) "
            "WHERE len(every) > 0")


cte("pii_raw", ["pii_docs"], _pii_lists())
cte("doc_pii_docs", [], "SELECT doc_id, text, CAST(NULL AS VARCHAR) AS filepath FROM documents")
cte("doc_pii_raw", ["doc_pii_docs"], _pii_lists().replace("FROM pii_docs", "FROM doc_pii_docs"))
cte("pii_found", ["pii_raw"], """
SELECT doc_id, text, filepath, f.type AS type, f.start AS start, CAST(f.start + length(f.original) AS INTEGER) AS "end",
       CASE f.type
         WHEN '身份证号' THEN f.original[1:6] || '**********' || f.original[-1:]
         WHEN '手机号' THEN f.original[1:3] || '****' || f.original[-4:]
         WHEN '邮箱' THEN split_part(f.original, '@', 1)[1:1] || '***@' || split_part(f.original, '@', 2)
         WHEN '地址' THEN CASE WHEN length(f.original) > 8 THEN f.original[1:8] || '***' ELSE '***地址***' END
         ELSE CASE WHEN length(f.original) > 3 THEN f.original[1:2] || repeat('*', length(f.original) - 3)
                   || f.original[-1:] ELSE '***' END END AS redacted,
       row_number() OVER (PARTITION BY doc_id ORDER BY f.start) AS idx
FROM pii_raw""")
cte("pii_redacted", ["pii_docs", "pii_found"], """
SELECT d.doc_id, d.text, d.filepath,
       CASE WHEN max(f.doc_id) IS NULL THEN d.text
            ELSE string_agg(f.seg, '' ORDER BY f.start) || max(f.tail) END AS redacted_text,
       count(f.doc_id) AS pii_count,
       list(DISTINCT f.type) AS types_unordered,
       list(f.type ORDER BY f.start) AS types
FROM pii_docs d LEFT JOIN (
  SELECT doc_id, start, type,
         substring(text, coalesce(lag("end") OVER w, 0) + 1, start - coalesce(lag("end") OVER w, 0)) || redacted AS seg,
         CASE WHEN idx = count(*) OVER (PARTITION BY doc_id) THEN substring(text, "end" + 1) END AS tail
  FROM pii_found WINDOW w AS (PARTITION BY doc_id ORDER BY start)) f ON f.doc_id = d.doc_id
GROUP BY d.doc_id, d.text, d.filepath""")


cte("doc_pii_found", ["doc_pii_raw"], """
SELECT doc_id, text, filepath, f.type AS type, f.start AS start, CAST(f.start + length(f.original) AS INTEGER) AS "end",
       CASE f.type
         WHEN '身份证号' THEN f.original[1:6] || '**********' || f.original[-1:]
         WHEN '手机号' THEN f.original[1:3] || '****' || f.original[-4:]
         WHEN '邮箱' THEN split_part(f.original, '@', 1)[1:1] || '***@' || split_part(f.original, '@', 2)
         WHEN '地址' THEN CASE WHEN length(f.original) > 8 THEN f.original[1:8] || '***' ELSE '***地址***' END
         ELSE CASE WHEN length(f.original) > 3 THEN f.original[1:2] || repeat('*', length(f.original) - 3)
                   || f.original[-1:] ELSE '***' END END AS redacted,
       row_number() OVER (PARTITION BY doc_id ORDER BY f.start) AS idx
FROM doc_pii_raw""")
cte("doc_pii_redacted", ["doc_pii_docs", "doc_pii_found"], """
SELECT d.doc_id, d.text, d.filepath,
       CASE WHEN max(f.doc_id) IS NULL THEN d.text
            ELSE string_agg(f.seg, '' ORDER BY f.start) || max(f.tail) END AS redacted_text,
       count(f.doc_id) AS pii_count,
       list(DISTINCT f.type) AS types_unordered,
       list(f.type ORDER BY f.start) AS types
FROM doc_pii_docs d LEFT JOIN (
  SELECT doc_id, start, type,
         substring(text, coalesce(lag("end") OVER w, 0) + 1, start - coalesce(lag("end") OVER w, 0)) || redacted AS seg,
         CASE WHEN idx = count(*) OVER (PARTITION BY doc_id) THEN substring(text, "end" + 1) END AS tail
  FROM doc_pii_found WINDOW w AS (PARTITION BY doc_id ORDER BY start)) f ON f.doc_id = d.doc_id
GROUP BY d.doc_id, d.text, d.filepath""")


def _safe_desc_sql() -> str:
    ctx = " ".join(
        f"|| CASE WHEN {' OR '.join(f'contains(text, {q(w)})' for w in words)} THEN {q('、' + label)} ELSE '' END"
        for label, words in K.PII_CONTEXT_TESTS)
    return f"""
SELECT doc_id, text, filepath, redacted_text, pii_count, types,
  CASE WHEN pii_count = 0 THEN '' ELSE
    array_to_string(list_concat(list_distinct_ordered,
      CASE WHEN has_name AND has_student THEN ['学生证件'] WHEN has_name THEN ['个人证件'] ELSE [] END,
      CASE WHEN has_permit THEN ['通行证件'] ELSE [] END), '、')
    || CASE WHEN ctx <> '' THEN ' - 含' || ctx[2:] || '相关内容' ELSE '' END END AS safe_description
FROM (SELECT *, list_has_any(types, ['学号','学号2','澳大学号']) AS has_student,
             list_contains(types, '姓名') AS has_name, list_has_any(types, ['证件号','通行证号']) AS has_permit,
             list_filter(types, lambda x, i: list_position(types, x) = i) AS list_distinct_ordered,
             '' {ctx} AS ctx
      FROM pii_redacted)"""


cte("pii_desc", ["pii_redacted"], _safe_desc_sql())
cte("doc_pii_desc", ["doc_pii_redacted"], _safe_desc_sql().replace("FROM pii_redacted", "FROM doc_pii_redacted"))


def _hint_sql(col: str) -> str:
    base = f"regexp_extract(coalesce({col}, ''), '[^/]*$', 0)"
    words = ", ".join(q(w) for w in K.PII_FILENAME_HINT_WORDS)
    return f"array_to_string(list_filter([{words}], lambda w: contains({base}, w)), '、')"


def _stem_sql(stem: str) -> str:
    """TXT-6 candidates of a file stem as a DuckDB list (ASCII names)."""
    low = f"lower({stem})"
    strip = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    def keep(expr: str) -> str:
        st = strip.format(x=expr)
        return f"CASE WHEN {st} <> '' AND {st} <> {low} THEN {st} END"
    cands = [stem]
    for pat in K.STEM_SUFFIX_PATTERNS:
        cands.append(keep(f"regexp_replace({low}, {q(_re2(pat))}, '', 'i')"))
    cands.append(keep(f"regexp_replace({low}, {q(K.STEM_TRAILING_DIGITS)}, '')"))
    cands.append(keep(f"regexp_replace({low}, {q(K.STEM_DATE_PREFIX)}, '')"))
    cands.append(keep(f"regexp_replace({low}, {q(K.STEM_CHAPTER)}, '', 'g')"))
    prefixes = []
    for sep in K.STEM_SEPARATORS:
        parts = f"string_split({low}, {q(sep)})"
        prefixes.append(f"CASE WHEN len({parts}) >= 2 THEN list_transform(range(1, len({parts})), "
                        f"lambda i: array_to_string(({parts})[1:i], {q(sep)})) ELSE []::VARCHAR[] END")
    allc = "list_concat([" + ", ".join(cands) + "], " + ", ".join(prefixes) + ")"
    return f"list_distinct(list_filter({allc}, lambda s: s IS NOT NULL AND length(s) >= 2))"


cte("file_stems", ["raw_files"], f"""
SELECT directory, path, original_name,
       {_stem_sql("(CASE WHEN regexp_matches(original_name, '^.+[.][^.]+$') "
                  "THEN regexp_extract(original_name, '^(.+)[.][^.]+$', 1) ELSE original_name END)")} AS stems
FROM raw_files WHERE NOT starts_with(original_name, '.')""")


cte("review_inbox", ["catalog_files"], """
SELECT * FROM catalog_files WHERE category <> '_archive' AND (category = '_inbox' OR confidence < 0.3)""")
cte("inbox_occ", ["review_inbox"], """
SELECT file_id, path, unnest(keywords) AS keyword, generate_subscripts(keywords, 1) AS pos FROM review_inbox""")
cte("frequent_kw", ["inbox_occ"], """
SELECT keyword, cnt FROM (
  SELECT keyword, count(*) AS cnt, min(file_id * 1000 + pos) AS first FROM inbox_occ GROUP BY keyword
  ORDER BY cnt DESC, first LIMIT 30)
WHERE cnt >= 3 AND length(keyword) >= 2
  AND lower(keyword) NOT IN ('the', 'a', 'an', 'is', 'of', 'to', 'in', 'and', '的', '了', '是', '在', '和',
                             '2024', '2025', '2026')""")


cte("vault_paths", ["raw_files", "pii_docs"], """
SELECT path, file_size AS size, 1704067200.0::DOUBLE AS modified FROM raw_files
UNION ALL SELECT filepath, CAST(length(text) AS BIGINT), 1704067200.0::DOUBLE FROM pii_docs""")
cte("vault_listing", ["vault_paths"], """
SELECT path, regexp_extract(path, '[^/]*$', 0) AS name, size, modified,
       lower(regexp_extract(regexp_extract(path, '[^/]*$', 0), '(?s)^.+([.][^.]+)$', 1)) AS extension,
       regexp_replace(path, '^vault/', '') AS relative_path
FROM vault_paths WHERE NOT starts_with(regexp_extract(path, '[^/]*$', 0), '.')""")


def _classification_chain(prefix: str, files_sql: str, deps: list[str], dict_cte: str = "cls_dict",
                          count_cte: str = "kw_count") -> None:
    """CLS-1..8 as CTEs over ``files_sql`` (file_id, original_name, extracted_text,
    file_type, kwj = lower-cased joined keywords)."""
    cte(prefix + "prepped", deps, f"""
SELECT file_id, lower(original_name) AS _name, kwj AS _kwj,
       lower(original_name) || ' ' || lower(coalesce(extracted_text, '')) || ' ' || kwj AS _hay,
       file_type AS _ext,
       {lang("(CASE WHEN coalesce(extracted_text, '') <> '' THEN extracted_text ELSE lower(original_name) END)")}
         AS locale_detected
FROM ({files_sql})""")
    cte(prefix + "contrib", [prefix + "prepped", dict_cte, "categories"], f"""
SELECT p.file_id, d.category_id, d.ord,
       CAST(CAST(d.weight AS DECIMAL(18,8)) * (CAST(CASE WHEN contains(p._name, d.keyword) THEN 3
            WHEN contains(p._kwj, d.keyword) THEN 2 ELSE 1 END AS DECIMAL(2,0))
            * CAST(CASE WHEN d.locale = p.locale_detected THEN 1.2 ELSE 1.0 END AS DECIMAL(2,1))) AS DECIMAL(22,9))
         AS contrib
FROM {prefix}prepped p JOIN {dict_cte} d ON contains(p._hay, d.keyword)
UNION ALL
SELECT p.file_id, c.id, c.ord, CAST(2.0 AS DECIMAL(22,9))
FROM {prefix}prepped p JOIN (SELECT id, ord, unnest(extensions) AS ext FROM categories WHERE is_active) c
  ON c.ext = p._ext""")
    cte(prefix + "ranked", [prefix + "contrib"], f"""
SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score_dec DESC, ord) AS rank FROM (
  SELECT file_id, category_id, ord, sum(contrib) AS score_dec FROM {prefix}contrib GROUP BY file_id, category_id, ord)""")
    cte(prefix + "classified", [prefix + "prepped", prefix + "ranked", "categories", count_cte], f"""
SELECT p.file_id, coalesce(c.name_zh, '_inbox') AS category, b.category_id,
       CASE WHEN b.file_id IS NULL THEN 0.0
            ELSE least(CAST(b.score_dec AS DOUBLE) / greatest(CAST(n.n_kw AS DOUBLE) * 2.5, 5.0), 1.0) END
         AS confidence
FROM {prefix}prepped p
LEFT JOIN (SELECT * FROM {prefix}ranked WHERE rank = 1) b ON b.file_id = p.file_id
LEFT JOIN categories c ON c.id = b.category_id
LEFT JOIN {count_cte} n ON n.category_id = b.category_id""")


_classification_chain("kcls_", """
SELECT r.file_id, r.original_name, r.extracted_text, r.file_type,
       lower(coalesce(array_to_string(k.keywords, ' '), '')) AS kwj
FROM raw_files r LEFT JOIN kwarr k ON k.doc_id = r.file_id""", ["raw_files", "kwarr"])


cte("corr_events", ["labels_corr", "file_keywords", "categories"], f"""
SELECT category_id, keyword, seq, phase, pos, op, locale,
       row_number() OVER (PARTITION BY category_id, keyword ORDER BY seq, phase, pos) AS i
FROM (
  SELECT CASE WHEN p.phase = 0 THEN fc.id ELSE tc.id END AS category_id, lower(trim(k.keyword)) AS keyword,
         c.seq, p.phase, k.rank AS pos, CASE WHEN p.phase = 0 THEN 'down' ELSE 'up' END AS op, c.kw_locale AS locale
  FROM (SELECT l.*, coalesce(kk.kws, []::VARCHAR[]) AS kws,
               CASE WHEN len(coalesce(kk.kws, []::VARCHAR[])) > 0 THEN {lang("array_to_string(kk.kws, ' ')")}
                    ELSE 'zh' END AS kw_locale
        FROM labels_corr l LEFT JOIN (SELECT doc_id, list(keyword ORDER BY rank) AS kws FROM file_keywords
                                      GROUP BY doc_id) kk ON kk.doc_id = l.seq) c
  JOIN file_keywords k ON k.doc_id = c.seq
  CROSS JOIN (VALUES (0), (1)) p(phase)
  LEFT JOIN categories fc ON fc.name_zh = c.from_category
  LEFT JOIN categories tc ON tc.id = c.to_category)
WHERE category_id IS NOT NULL AND keyword <> ''""")
cte("corr_fold", ["corr_events", "keywords"], """
SELECT * FROM (
  WITH RECURSIVE fold(category_id, keyword, i, zh, en, mixed, src_zh, src_en, src_mixed, other) AS (
    SELECT k.category_id, k.keyword, 0::BIGINT, s.zh, s.en, s.mixed, s.src_zh, s.src_en, s.src_mixed,
           coalesce(s.other, FALSE)
    FROM (SELECT DISTINCT category_id, keyword FROM corr_events) k
    LEFT JOIN (SELECT category_id, keyword,
                      max(CASE WHEN locale = 'zh' THEN weight END) AS zh, max(CASE WHEN locale = 'en' THEN weight END) AS en,
                      max(CASE WHEN locale = 'mixed' THEN weight END) AS mixed,
                      max(CASE WHEN locale = 'zh' THEN source END) AS src_zh,
                      max(CASE WHEN locale = 'en' THEN source END) AS src_en,
                      max(CASE WHEN locale = 'mixed' THEN source END) AS src_mixed,
                      bool_or(locale NOT IN ('zh', 'en', 'mixed')) AS other
               FROM keywords GROUP BY category_id, keyword) s
      ON s.category_id = k.category_id AND s.keyword = k.keyword
    UNION ALL
    SELECT f.category_id, f.keyword, f.i + 1,
""" + ",\n".join(
    f"""      CASE WHEN e.locale <> '{l}' THEN f.{l}
           WHEN e.op = 'up' THEN CASE WHEN f.{l} IS NOT NULL THEN least(f.{l} * 1.3 + 0.2, 3.0) ELSE 1.5 END
           WHEN f.{l} IS NOT NULL THEN greatest(f.{l} * 0.7, 0.1)
           WHEN NOT (f.zh IS NOT NULL OR f.en IS NOT NULL OR f.mixed IS NOT NULL OR f.other) THEN 0.3 END"""
    for l in ("zh", "en", "mixed")) + ",\n" + ",\n".join(
    f"""      CASE WHEN e.locale <> '{l}' THEN f.src_{l}
           WHEN e.op = 'up' THEN 'learned'
           WHEN f.{l} IS NOT NULL THEN 'learned'
           WHEN NOT (f.zh IS NOT NULL OR f.en IS NOT NULL OR f.mixed IS NOT NULL OR f.other) THEN 'corrected_down'
           ELSE f.src_{l} END"""
    for l in ("zh", "en", "mixed")) + """,
      f.other
    FROM fold f JOIN corr_events e ON e.category_id = f.category_id AND e.keyword = f.keyword AND e.i = f.i + 1)
  SELECT * FROM fold QUALIFY i = max(i) OVER (PARTITION BY category_id, keyword))""")
cte("learned_keywords", ["corr_fold", "keywords"], """
SELECT k.category_id, k.keyword, k.locale, k.weight, k.source FROM keywords k
WHERE NOT EXISTS (SELECT 1 FROM corr_fold f WHERE f.category_id = k.category_id AND f.keyword = k.keyword)
   OR k.locale NOT IN ('zh', 'en', 'mixed')
UNION ALL SELECT category_id, keyword, 'zh', zh, src_zh FROM corr_fold WHERE zh IS NOT NULL
UNION ALL SELECT category_id, keyword, 'en', en, src_en FROM corr_fold WHERE en IS NOT NULL
UNION ALL SELECT category_id, keyword, 'mixed', mixed, src_mixed FROM corr_fold WHERE mixed IS NOT NULL""")


cte("group_members", ["file_stems"], """
SELECT directory, stem, n AS stem_files, path FROM (
  WITH RECURSIVE
  pairs AS (SELECT DISTINCT directory, unnest(stems) AS stem, path FROM file_stems),
  counts AS (SELECT directory, stem, count(*) AS n FROM pairs GROUP BY directory, stem HAVING count(*) >= 2),
  ranked AS (SELECT p.directory, p.stem, p.path, c.n FROM pairs p JOIN counts c
             ON c.directory = p.directory AND c.stem = p.stem),
  r(directory, stem, path, n, status) AS (
    SELECT directory, stem, path, n, 'pending' FROM ranked
    UNION ALL
    SELECT directory, stem, path, n, CASE WHEN all_best THEN 'taken' ELSE 'pending' END FROM (
      SELECT *, bool_or(all_best) OVER (PARTITION BY directory, path) AS path_taken FROM (
        SELECT *, bool_and(is_best) OVER (PARTITION BY directory, stem) AS all_best FROM (
          SELECT *, struct_pack(a := -n, b := length(stem), c := stem)
                    = min(struct_pack(a := -n, b := length(stem), c := stem)) OVER (PARTITION BY directory, path)
                    AS is_best
          FROM (SELECT directory, stem, path, n FROM r WHERE status = 'pending'
                QUALIFY count(*) OVER (PARTITION BY directory, stem) >= 2))))
    WHERE all_best OR NOT path_taken)
  SELECT * FROM r WHERE status = 'taken')""")


def _title_sql(x: str) -> str:
    """Python str.title() for ASCII text (a letter is upper-cased after a non-letter)."""
    return (f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN i = 1 "
            f"OR NOT regexp_matches(substring({x}, i - 1, 1), '[A-Za-z]') THEN upper(substring({x}, i, 1)) "
            f"ELSE lower(substring({x}, i, 1)) END), '')")


def folder_name_sql(stem: str) -> str:
    t = _title_sql(f"replace(replace(regexp_replace({stem}, '^[_ -]+|[_ -]+$', '', 'g'), '_', ' '), '-', ' ')")
    return (f"CASE WHEN {t} = '' THEN 'Grouped Files' WHEN length({t}) > 50 THEN substring({t}, 1, 47) || '...' "
            f"ELSE {t} END")


cte("file_groups_sql", ["group_members", "raw_files"], f"""
SELECT directory, stem, stem_files, {folder_name_sql('stem')} AS suggested_folder,
       CASE WHEN n_ext > 1 AND num THEN 'sequential_different_formats'
            WHEN n_ext > 1 THEN 'same_stem_different_formats'
            WHEN num THEN 'sequential_numbering' WHEN ver THEN 'version_variants' ELSE 'common_prefix' END AS strategy,
       file_count, least(0.5 + CAST(file_count AS DOUBLE) * 0.15, 1.0) AS confidence
FROM (SELECT m.directory, m.stem, m.stem_files, count(*) AS file_count, count(DISTINCT r.file_type) AS n_ext,
             bool_or(regexp_matches(lower(f.st), '[0-9]{{2,}}')) AS num,
             bool_or({' OR '.join(f"contains(lower(f.st), {q(w)})" for w in K.VERSION_WORDS)}) AS ver
      FROM group_members m JOIN raw_files r ON r.path = m.path
      JOIN (SELECT path, CASE WHEN regexp_matches(original_name, '^.+[.][^.]+$')
                 THEN regexp_extract(original_name, '^(.+)[.][^.]+$', 1) ELSE original_name END AS st
            FROM raw_files) f ON f.path = m.path
      GROUP BY m.directory, m.stem, m.stem_files)""")


cte("learned_dict", ["learned_keywords", "categories"], """
SELECT k.category_id, c.ord, k.keyword, k.locale, k.weight
FROM learned_keywords k JOIN categories c ON c.id = k.category_id WHERE c.is_active""")
cte("learned_count", ["learned_keywords"],
    "SELECT category_id, count(*) AS n_kw FROM learned_keywords GROUP BY category_id")
_classification_chain("lcls_", """
SELECT r.file_id, r.original_name, r.extracted_text, r.file_type,
       lower(coalesce(array_to_string(k.keywords, ' '), '')) AS kwj
FROM raw_files r LEFT JOIN kwarr k ON k.doc_id = r.file_id""", ["raw_files", "kwarr"],
                      dict_cte="learned_dict", count_cte="learned_count")


cte("frequent_ord", ["inbox_occ"], """
SELECT keyword, cnt, row_number() OVER (ORDER BY cnt DESC, first) AS ord FROM (
  SELECT keyword, count(*) AS cnt, min(file_id * 1000 + pos) AS first FROM inbox_occ GROUP BY keyword
  ORDER BY cnt DESC, first LIMIT 30)
WHERE cnt >= 3 AND length(keyword) >= 2
  AND lower(keyword) NOT IN ('the', 'a', 'an', 'is', 'of', 'to', 'in', 'and', '的', '了', '是', '在', '和',
                             '2024', '2025', '2026')""")
cte("suggest_clusters", ["frequent_ord", "inbox_occ"], """
SELECT clusters FROM (
  WITH RECURSIVE
  fs AS (SELECT DISTINCT o.file_id, f.ord FROM inbox_occ o JOIN frequent_ord f ON f.keyword = o.keyword),
  pc AS (SELECT a.ord AS x, b.ord AS y, count(*) AS n FROM fs a JOIN fs b ON a.file_id = b.file_id AND a.ord <> b.ord
         GROUP BY a.ord, b.ord HAVING count(*) >= 2),
  strong2 AS (SELECT coalesce(list(x * 1000 + y), []::BIGINT[]) AS s FROM pc),
  nf AS (SELECT count(*) AS f FROM frequent_ord),
  st(step, visited, members, clusters) AS (
    SELECT 0, []::BIGINT[], []::BIGINT[], []::BIGINT[][]
    UNION ALL
    SELECT step + 1, v2, m2,
           CASE WHEN oi = f AND len(m2) >= 3 THEN list_append(clusters, m2) ELSE clusters END
    FROM (
      SELECT step, clusters, oi, f,
             CASE WHEN oi = 0 THEN (CASE WHEN list_contains(visited, si) THEN visited ELSE list_append(visited, si) END)
                  WHEN add_it THEN list_append(visited, oi) ELSE visited END AS v2,
             CASE WHEN oi = 0 THEN (CASE WHEN list_contains(visited, si) THEN []::BIGINT[] ELSE [si] END)
                  WHEN add_it THEN list_append(members, oi) ELSE members END AS m2
      FROM (
        SELECT st.*, nf.f, (st.step // (nf.f + 1)) + 1 AS si, st.step % (nf.f + 1) AS oi, strong2.s AS s
        FROM st, nf, strong2 WHERE st.step < nf.f * (nf.f + 1)) q,
      LATERAL (SELECT q.oi > 0 AND len(q.members) > 0 AND NOT list_contains(q.visited, q.oi)
                      AND list_bool_or(list_transform(q.members, lambda m: list_contains(q.s, m * 1000 + q.oi)))
                      AS add_it)))
  SELECT clusters FROM st ORDER BY step DESC LIMIT 1)""")


# the raw files written as files, and what extraction gives (SCN-4..9)
cte("vault_files", ["raw_files"], """
SELECT file_id, path, original_name, file_type AS ext,
       CASE WHEN file_type IN ('.txt', '.md') THEN replace(replace(extracted_text, chr(13) || chr(10), chr(10)), chr(13), chr(10))
            WHEN file_type = '.docx' THEN array_to_string(list_filter(string_split(extracted_text, chr(10)), lambda x: trim(x) <> ''), chr(10))
            WHEN file_type = '.jpg' THEN '[Image: ' || original_name || ']' WHEN file_type = '.pdf' THEN ''
            ELSE '[Unknown type: ' || original_name || ']' END AS text,
       CASE WHEN file_type = '.pdf' THEN 'PDF parsing is not built in; supply page text to assemble_pages' END AS error,
       CASE WHEN file_type IN ('.txt', '.md') THEN 'text' WHEN file_type = '.docx' THEN 'docx' WHEN file_type = '.jpg' THEN 'image'
            WHEN file_type = '.pdf' THEN '.pdf' ELSE 'unknown' END AS file_type
FROM raw_files""")
cte("vault_keywords", ["vault_files"], f"""
SELECT file_id, list(keyword ORDER BY rank) AS keywords FROM (
  SELECT file_id, keyword, row_number() OVER (PARTITION BY file_id ORDER BY count(*) DESC, min(pos)) AS rank FROM (
    SELECT file_id, trim(w, {STRIP}) AS keyword, pos FROM (
      SELECT file_id, unnest(l) AS w, generate_subscripts(l, 1) AS pos
      FROM (SELECT file_id, string_split_regex(lower(text), '{WS}') AS l FROM vault_files
            WHERE text <> '' AND NOT starts_with(text, '[')))
    WHERE length(trim(w, {STRIP})) >= 2)
  GROUP BY file_id, keyword)
WHERE rank <= 20 GROUP BY file_id""")
_classification_chain("vcls_", """
SELECT r.file_id, r.original_name, r.text AS extracted_text, r.ext AS file_type,
       lower(coalesce(array_to_string(k.keywords, ' '), '')) AS kwj
FROM vault_files r LEFT JOIN vault_keywords k ON k.file_id = r.file_id""", ["vault_files", "vault_keywords"])


# requests to group files (GRP-6)
cte("pick_listed", ["raw_files"], """
SELECT file_id % 9 AS kind, path, original_name, directory, file_id // 9000 AS c,
       2 * (1000 * (file_id // 9000) + CAST(regexp_extract(directory, '[0-9]+$', 0) AS BIGINT)) AS seq
FROM raw_files WHERE file_id >= 0 AND file_id % 9 IN (0, 1)""")
cte("pick_req", ["pick_listed"], "SELECT DISTINCT directory, c, seq FROM pick_listed WHERE kind = 0")


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in CTES[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def build(needed: list[str], body: str) -> str:
    names = _order(needed)
    if not names:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in names) + "\n" + body


def fold(expr: str) -> str:
    """ASCII-only lower-casing (SQLite LIKE rules)."""
    return f"translate({expr}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like(expr: str, needle: str) -> str:
    return f"{fold(expr)} LIKE {q('%' + needle.translate(_ASCII_LOWER) + '%')}"
