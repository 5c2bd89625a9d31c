"""Keyword extraction (TXT-2 frequency form, TXT-3 corpus TF-IDF form).

A word is what white space separates, in lower case, without the punctuation set at both ends, of two
characters or more. A text that starts with '[' is a placeholder and has no keywords (V22).

Terms of the TF-IDF form are these words cut into script runs: a run of Chinese or Japanese characters
gives its bigrams (a single character none), another run is stripped of punctuation again and
kept from two characters on. Words without such characters are terms as they are.

Extraction is document-local. The default (``method="arrow"``) counts the words of some MB of text at a
time with arrays: Python sees a distinct piece once per slice and never a place in a text.
``method="shuffle"`` states the same with built-ins only (explode, aggregate by document and word,
window); it moves every distinct pair of document and word. The tests hold both against each other.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark import constants as K
from shelfspark.functions.batches import expand, pieces, slices
from shelfspark.functions.text import CJK_CLASS
from shelfspark.session import cut_lineage

DEFAULT_METHOD = "arrow"
#: Terms of two documents or more whose frequencies may go to all tasks (some tens of MB); more are joined by shuffle.
BROADCAST_TERMS = 500_000

_CJK = "一-鿿぀-ヿ"
_RUN = re.compile(f"[{_CJK}]+|[^{_CJK}]+")


def script_terms(word: str) -> list[str]:
    """The terms of a cleaned word, by script runs."""
    out = []
    for run in _RUN.findall(word):
        if "一" <= run[0] <= "鿿" or "぀" <= run[0] <= "ヿ":
            out += [run[i:i + 2] for i in range(len(run) - 1)]
        else:
            rest = run.strip(K.KEYWORD_STRIP_CHARS)
            out += [rest] if len(rest) > 1 else []
    return out


def _cleaned(parts: pa.Array) -> pa.Array:
    """Distinct pieces in lower case and stripped. Latin ones in C++, as their case has no surprises."""
    latin = pc.match_substring_regex(parts, "^[\\x00-\\xff]*$")
    usual = pc.utf8_lower(parts.filter(latin))
    if latin.false_count:
        rest = pa.array([p.lower() for p in parts.filter(pc.invert(latin)).to_pylist()], parts.type)
        usual = pc.replace_with_mask(pc.replace_with_mask(parts, latin, usual), pc.invert(latin), rest)
    return pc.utf8_trim(usual, characters=K.KEYWORD_STRIP_CHARS)


class Counts:
    """Distinct words of each text of a slice: rows (``row``, ``word``, ``count``, ``first``), by row and word.
    ``words``: the distinct words of the slice; ``first``: the word's first place in its text."""

    def __init__(self, texts: pa.Array, by_script: bool = False):
        usable = pc.fill_null(pc.and_(pc.not_equal(texts, ""), pc.invert(pc.starts_with(texts, "["))), False)
        codes, offsets, parts = pieces(pc.if_else(usable, texts, ""))
        words = _cleaned(parts).dictionary_encode()
        of = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = words.dictionary
        keep = pc.greater(pc.utf8_length(self.words), 1).to_numpy(zero_copy_only=False)
        number, row = of[codes], np.repeat(np.arange(len(texts)), np.diff(offsets))
        real = keep[number]
        number, row = number[real], row[real]
        if by_script:
            number, row = self._terms(number, row)
        key, first, count = np.unique(row * max(len(self.words), 1) + number, return_index=True, return_counts=True)
        self.row, self.word, self.count, self.first = key // max(len(self.words), 1), key % max(len(self.words), 1), count, first

    def _terms(self, number: np.ndarray, row: np.ndarray):
        cjk = np.flatnonzero(pc.match_substring_regex(self.words, f"[{CJK_CLASS}]").to_numpy(zero_copy_only=False))
        if not len(cjk):
            return number, row
        lists = [script_terms(w) for w in self.words.take(pa.array(cjk)).to_pylist()]
        words = pa.concat_arrays([self.words, pa.array([t for x in lists for t in x], self.words.type)]).dictionary_encode()
        of = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.ones(len(self.words), np.int64)
        starts = np.arange(len(self.words))
        sizes[cjk] = [len(x) for x in lists]
        starts[cjk] = len(self.words) + np.cumsum(sizes[cjk]) - sizes[cjk]
        self.words = words.dictionary
        return of[expand(starts[number], sizes[number])], np.repeat(row, sizes[number])

    def top(self, score: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of the first ``top_k`` words of each text by score, then first place; their rank from 1)."""
        order = np.lexsort((self.first, -score, self.row))
        row = self.row[order]
        new = np.flatnonzero(np.diff(row, prepend=-1))
        rank = np.arange(len(row)) - np.repeat(new, np.diff(np.append(new, len(row))))
        near = rank < top_k
        return order[near], rank[near] + 1

    def lists(self, at: np.ndarray, n_rows: int) -> pa.Array:
        """The words at these places, a list for each text."""
        sizes = np.bincount(self.row[at], minlength=n_rows)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                                        self.words.take(pa.array(self.word[at])).cast(pa.string()))


def _per_slice(fn, by_script: bool = False):
    """mapInArrow over (doc_id, text): ``fn(ids, counts)`` for each slice of some MB."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield fn(part.column("doc_id"), Counts(part.column("text"), by_script))
    return run


def _src(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))


def terms_of(word) -> Column:
    """``script_terms`` of a cleaned word as an expression."""
    runs = F.regexp_extract_all(word, F.lit(f"([{CJK_CLASS}]+|[^{CJK_CLASS}]+)"), F.lit(1))
    bigrams = lambda r: F.when(F.length(r) < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))
    rest = lambda r: F.filter(F.array(F.btrim(r, F.lit(K.KEYWORD_STRIP_CHARS))), lambda x: F.length(x) >= 2)
    cjk = lambda x: x.rlike(f"[{CJK_CLASS}]")
    return F.when(cjk(word), F.flatten(F.transform(runs, lambda r: F.when(cjk(r), bigrams(r)).otherwise(rest(r))))).otherwise(F.array(word))


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_script: bool = False) -> DataFrame:
    """(doc_id, pos, keyword) for every word or term. The split is exploded first so stripping and the
    length test run in whole-stage codegen rather than in interpreted lambdas."""
    raw = docs.select(F.col(id_col).alias("doc_id"),
                      F.posexplode(F.split(F.lower(F.col(text_col)), K.WHITESPACE_RUN)).alias("pos", "w"))
    found = (raw.select("doc_id", "pos", F.btrim(F.col("w"), F.lit(K.KEYWORD_STRIP_CHARS)).alias("keyword"))
             .filter(F.length("keyword") >= 2))
    if by_script:
        found = (found.select("doc_id", "pos", F.posexplode(terms_of(F.col("keyword"))).alias("at", "keyword"))
                 .select("doc_id", F.struct("pos", "at").alias("pos"), "keyword"))
    return found


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                method: str = DEFAULT_METHOD, by_script: bool = False) -> DataFrame:
    """(doc_id, keyword, cnt, first_pos) for every word (or term) of every usable document."""
    if method == "arrow":
        def rows(ids, c):
            return pa.record_batch({"doc_id": ids.take(pa.array(c.row)), "keyword": c.words.take(pa.array(c.word)).cast(pa.string()),
                                    "cnt": pa.array(c.count, pa.int64()), "first_pos": pa.array(c.first, pa.int64())})
        return _src(docs, id_col, text_col).mapInArrow(
            _per_slice(rows, by_script), "doc_id bigint, keyword string, cnt bigint, first_pos bigint")
    src = docs.filter(~F.col(text_col).startswith("[") & (F.col(text_col) != ""))
    return words(src, id_col, text_col, by_script).groupBy("doc_id", "keyword").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("pos").alias("first_pos"))


def top_keywords(docs: DataFrame, top_k: int = K.KEYWORDS_TOP_K, id_col: str = "doc_id",
                 text_col: str = "text", method: str = DEFAULT_METHOD) -> DataFrame:
    """TXT-2: (doc_id, rank, keyword, cnt), top-k words per document by count desc, ties
    by first occurrence."""
    if method == "arrow":
        def rows(ids, c):
            at, rank = c.top(c.count, top_k)
            return pa.record_batch({"doc_id": ids.take(pa.array(c.row[at])), "rank": pa.array(rank, pa.int32()),
                                    "keyword": c.words.take(pa.array(c.word[at])).cast(pa.string()), "cnt": pa.array(c.count[at], pa.int64())})
        return _src(docs, id_col, text_col).mapInArrow(_per_slice(rows), "doc_id bigint, rank int, keyword string, cnt bigint")
    wc = word_counts(docs, id_col, text_col, method="shuffle")
    w = Window.partitionBy("doc_id").orderBy(F.col("cnt").desc(), F.col("first_pos"))
    return (wc.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= top_k)
            .select("doc_id", "rank", "keyword", "cnt"))


def keyword_arrays(docs: DataFrame, top_k: int = K.KEYWORDS_TOP_K, id_col: str = "doc_id",
                   text_col: str = "text", method: str = DEFAULT_METHOD) -> DataFrame:
    """(doc_id, keywords array<string>) in rank order for documents with keywords;
    callers left-join it and default to [] (see ``keyword_lists``)."""
    return keyword_lists(docs, top_k, id_col, text_col, method)


def keyword_lists(docs: DataFrame, top_k: int = K.KEYWORDS_TOP_K, id_col: str = "doc_id",
                  text_col: str = "text", method: str = DEFAULT_METHOD) -> DataFrame:
    """(doc_id, keywords) for documents with at least one keyword."""
    if method == "arrow":
        def rows(ids, c):
            out = pa.record_batch({"doc_id": ids, "keywords": c.lists(c.top(c.count, top_k)[0], len(ids))})
            return out.filter(pc.greater(pc.list_value_length(out.column("keywords")), 0))
        return _src(docs, id_col, text_col).mapInArrow(_per_slice(rows), "doc_id bigint, keywords array<string>")
    tk = top_keywords(docs, top_k, id_col, text_col, method="shuffle")
    return tk.groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda s: s["keyword"])
        .alias("keywords"))


def with_keywords(docs: DataFrame, text_col: str, top_k: int = K.KEYWORDS_TOP_K, name: str = "keywords") -> DataFrame:
    """The rows with their keyword list as a further column, in the pass over the text (no join, no shuffle);
    an empty list without keywords."""
    schema = docs.withColumn(name, F.array().cast("array<string>")).schema

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                c = Counts(part.column(text_col))
                yield pa.RecordBatch.from_arrays([*part.columns, c.lists(c.top(c.count, top_k)[0], part.num_rows)],
                                                 names=[*part.schema.names, name])
    return docs.mapInArrow(run, schema)


def tfidf_keywords(docs: DataFrame, top_k: int = K.KEYWORDS_TOP_K, id_col: str = "doc_id", text_col: str = "text",
                   method: str = DEFAULT_METHOD, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """TXT-3 (re-aimed): tf = count in the document, idf = ln((N + 1) / (df + 1)) over the corpus; top-k terms by
    tf * idf desc, then first occurrence: (doc_id, rank, keyword, cnt, df, score).

    One pass over the texts tells, per slice, in how many of its documents each term occurs; these are added up
    by term and only terms of two documents or more are written (a term that is not found has one). While
    these are at most ``broadcast_terms`` they go to all tasks and a second pass ranks within each document;
    nothing is moved by document. Beyond that, the most frequent ones go to all tasks. A rarer term's df, and so its
    score, then lies between known bounds, and a document hands on only the terms that can be among its first
    ``top_k`` by them; the rare ones of these are joined by shuffle (none of them is hot), then ranked."""
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    result = ["doc_id", "rank", "keyword", "cnt", "df", "score"]
    if method == "arrow":
        src = _src(docs, id_col, text_col)

        def frequencies(ids, c):
            return pa.record_batch({"keyword": c.words.cast(pa.string()),
                                    "df": pa.array(np.bincount(c.word, minlength=len(c.words)), pa.int64())}).filter(pc.greater(pc.field("df"), 0))
        df_ = cut_lineage(src.mapInArrow(_per_slice(frequencies, True), "keyword string, df bigint").groupBy("keyword")
                          .agg(F.sum("df").alias("df")).where("df > 1"), "document-frequencies")
        total = docs.count()
        if df_.count() <= broadcast_terms:
            shared = docs.sparkSession.sparkContext.broadcast(df_.toArrow())
            return src.mapInArrow(_per_slice(_ranked(shared, total, top_k), True),
                                  "doc_id bigint, rank int, keyword string, cnt bigint, df bigint, score double")
        rare = _rarest(df_, broadcast_terms)
        shared = docs.sparkSession.sparkContext.broadcast(df_.where(F.col("df") > rare).toArrow())
        near = cut_lineage(src.mapInArrow(_per_slice(_contenders(shared, total, rare, top_k), True),
                                          "doc_id bigint, keyword string, cnt bigint, first_pos bigint, df bigint"), "tfidf-contenders")
        open_ = near.where("df is null").drop("df").join(df_.where(F.col("df") <= rare), "keyword", "left")
        found = near.where("df is not null").unionByName(open_.withColumn("df", F.coalesce("df", F.lit(1))))
    else:
        wc = word_counts(docs, id_col, text_col, method, by_script=True)
        found = wc.join(wc.groupBy("keyword").agg(F.count(F.lit(1)).alias("df")), "keyword")
    idf = F.log((n_docs + F.lit(1)).cast("double") / (F.col("df") + 1).cast("double"))
    w = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), F.col("first_pos"))
    return (found.withColumn("score", F.col("cnt") * idf).withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= top_k).select(*result))


def _rarest(frequencies: DataFrame, most: int) -> int:
    """The smallest df above which there are at most ``most`` terms."""
    above = 0
    for df_, n in frequencies.groupBy("df").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("df").desc()).toLocalIterator():
        above += n
        if above > most:
            return df_
    return 0


def _shared_df(words: pa.Array, shared) -> pa.ChunkedArray:
    """The df of each word by a broadcast table, null where it is not there."""
    terms = shared.value
    return terms.column("df").take(pc.index_in(words.cast(pa.string()), value_set=terms.column("keyword").combine_chunks()))


def _idf(df_: np.ndarray, n_docs: int) -> np.ndarray:
    seen, back = np.unique(df_, return_inverse=True)
    return np.array([math.log((n_docs + 1) / (n + 1)) for n in seen.tolist()])[back] if len(seen) else np.zeros(0)


def _contenders(shared, n_docs: int, rare: int, top_k: int):
    """The terms of each text that may be among its first ``top_k``: a term that is not shared has a df of 1 to ``rare``."""
    def rows(ids, c):
        df_ = _shared_df(c.words, shared)
        known = df_.is_valid().to_numpy().astype(bool)[c.word]
        low, high = (c.count * _idf(pc.fill_null(df_, n).to_numpy().astype(np.int64), n_docs)[c.word] for n in (rare, 1))
        kth = np.full(len(ids), -np.inf)  # of each text, its top_k-th largest lower bound
        at, rank = c.top(low, top_k)
        kth[c.row[at[rank == top_k]]] = low[at[rank == top_k]]
        near = high >= kth[c.row] - 1e-9 * np.abs(kth[c.row])
        first = np.zeros(len(near), bool)  # more shared terms than top_k need not go, also where they are equal
        shown = np.where(known, low, -np.inf)
        first[c.top(shown, top_k)[0]] = True
        at = pa.array(np.flatnonzero(near & (first | ~known)))
        words = pa.array(c.word).take(at)
        return pa.record_batch({"doc_id": ids.take(pa.array(c.row).take(at)), "keyword": c.words.take(words).cast(pa.string()),
                                "cnt": pa.array(c.count, pa.int64()).take(at), "first_pos": pa.array(c.first, pa.int64()).take(at),
                                "df": df_.combine_chunks().cast(pa.int64()).take(words)})
    return rows


def _ranked(shared, n_docs: int, top_k: int):
    def rows(ids, c):
        df_ = pc.fill_null(_shared_df(c.words, shared), 1).to_numpy().astype(np.int64)
        idf = _idf(df_, n_docs)
        score = c.count * idf[c.word]
        at, rank = c.top(score, top_k)
        return pa.record_batch({"doc_id": ids.take(pa.array(c.row[at])), "rank": pa.array(rank, pa.int32()),
                                "keyword": c.words.take(pa.array(c.word[at])).cast(pa.string()), "cnt": pa.array(c.count[at], pa.int64()),
                                "df": pa.array(df_[c.word[at]]), "score": pa.array(score[at])})
    return rows
