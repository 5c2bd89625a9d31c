"""Operator 1: a quality classifier by co-training.

Two logistic classifiers see different views of a document: its text (repetition, symbols,
line structure, word shapes) and its page's metadata (language, source, stated length). In each
round both are fitted and calibrated; each gives its confident answers on unlabelled documents
to the other as pseudo-labels. At the end both views are calibrated on held-back labels and
combined by a small logistic model on their calibrated log-odds, which also learns how much
each view is worth. Every document is scored.

The models are fitted on a bounded sample (``LABELLED`` labelled and ``POOL`` unlabelled
documents, the smallest by a hash of the identifier); all else covers all rows.

Cases: a null text counts as empty, null metadata as a value of its own; documents with a null
identifier have no label and are scored; of rows repeating an identifier one is sampled and all
are scored; where the labels hold fewer than ten documents of either class nothing can be
learned, every score is 1 and all documents are kept; an empty table gives no rows; only the
named columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import read, slices, texts_of, words_of
from shelfspark.llm.logistic import Logistic, logit, sigmoid

#: Bounds of the sample that the models are fitted on.
LABELLED, POOL = 6000, 6000
ROUNDS = 3
#: A pseudo-label needs this calibrated probability, and a round takes this share of the pool at most.
CONFIDENT, SHARE = 0.97, 0.1
#: Documents below this score are rejected.
THRESHOLD = 0.5
SHAPES, SOURCES, LANGS, LENGTHS = 192, 32, 8, 12

META = "lang string, source string, n_chars long"


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(rows: np.ndarray, codes: np.ndarray, n: int):
    """Of (row, code) pairs: distinct codes of each row, and the count of the most frequent."""
    if not len(rows):
        return np.zeros(n), np.zeros(n)
    key = rows * (int(codes.max()) + 1) + codes
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    row = key[first] // (int(codes.max()) + 1)
    most = np.zeros(n)
    np.maximum.at(most, row, np.diff(np.append(first, len(key))))
    return np.bincount(row, minlength=n).astype(float), most


def text_features(texts: pa.Array) -> np.ndarray:
    """The text view: a row for each text."""
    n = len(texts)
    lines, line_at, line_text = words_of(texts, "\n")
    line_row = np.repeat(np.arange(n), np.diff(line_at))
    codes, offsets, words = words_of(pc.replace_substring(texts, "\n", " "))
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(float)
    real = length[codes] > 0
    row = np.repeat(np.arange(n), np.diff(offsets))[real]
    codes = codes[real]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    shapes = pc.replace_substring_regex(words, r"\p{Ll}+", "a")
    shapes = pc.replace_substring_regex(pc.replace_substring_regex(shapes, r"\p{Lu}+", "A"), r"\p{N}+", "0")
    shapes = shapes.dictionary_encode()
    of_word, shape = shapes.indices.to_numpy(zero_copy_only=False), shapes.dictionary.to_pylist()
    upper = np.array([s.startswith("AA") or s.rstrip(".,!?;:") == "A" for s in shape], float)
    symbol = np.array([any(not c.isalnum() and c not in ".,;:!?'\"()-" for c in s) for s in shape], float)
    loud = np.array(["!" in s for s in shape], float)
    digit = np.array(["0" in s for s in shape], float)
    bare = np.array([not any(c.isalpha() for c in s) for s in shape], float)
    ending = np.array([s[-1:] in ".!?" for s in shape], float)
    comma = np.array([s[-1:] in ",;:" for s in shape], float)
    hashed = np.array([zlib.crc32(s[:12].encode()) % SHAPES for s in shape], np.int64)
    n_words = np.bincount(row, minlength=n).astype(float)
    one = np.maximum(n_words, 1)
    share = lambda flags: _per_row(flags[of_word[codes]], offsets) / one
    kinds, most = _distinct(row, codes, n)
    same_row = row[1:] == row[:-1]
    again = np.bincount(row[1:][same_row & (codes[1:] == codes[:-1])], minlength=n)
    pairs, most_pairs = _distinct(row[1:][same_row], (codes[:-1] * len(words) + codes[1:])[same_row] % (1 << 31), n)
    n_lines = np.diff(line_at).astype(float)
    line_kinds, most_lines = _distinct(line_row, lines, n)
    line_length = pc.utf8_length(line_text).to_numpy(zero_copy_only=False).astype(float)[lines]
    chars = _per_row(length[codes], offsets)
    dense = np.column_stack([
        np.log1p(n_words), np.log1p(chars), chars / one, np.sqrt(_per_row(length[codes] ** 2, offsets) / one),
        kinds / one, most / one, again / one, pairs / one, most_pairs / one, np.log1p(n_lines), line_kinds / n_lines,
        most_lines / n_lines, _per_row(line_length, line_at) / n_lines, n_words < 5, (n_words < 20),
        *(share(x) for x in (upper, symbol, loud, digit, bare, ending, comma))])
    bag = np.bincount(row * SHAPES + hashed[of_word[codes]], minlength=n * SHAPES).reshape(n, SHAPES) / one[:, None]
    return np.hstack([dense, np.sqrt(bag)]).astype(np.float32)


def meta_features(batch) -> np.ndarray:
    """The metadata view: hashed source and language, length in powers of two."""
    n = batch.num_rows

    def hashed(name, size):
        out = np.zeros((n, size), np.float32)
        for i, v in enumerate(batch.column(name).to_pylist()):
            out[i, 0 if v is None else 1 + zlib.crc32(v.encode()) % (size - 1)] = 1
        return out

    size = pc.fill_null(batch.column("n_chars"), -1).to_numpy(zero_copy_only=False).astype(float)
    log = np.log2(np.maximum(size, 0) + 1)
    lengths = np.zeros((n, LENGTHS), np.float32)
    lengths[np.arange(n), np.where(size < 0, 0, 1 + np.clip(log - 4, 0, LENGTHS - 2)).astype(int)] = 1
    return np.hstack([hashed("source", SOURCES), hashed("lang", LANGS), lengths, log[:, None].astype(np.float32)])


class CoTrained:
    """Two views' classifiers, their calibrations and the combination."""

    def __init__(self, views, labels, held, pool):
        """views: the labelled documents' features by view; labels: 0/1; held: rows that only
        calibrate; pool: the unlabelled documents' features by view."""
        own = [(x[~held], labels[~held]) for x in views]
        free = np.ones(len(pool[0]), bool)
        for _ in range(ROUNDS):
            self._fit(own, views, labels, held)
            given = []
            for v in (0, 1):
                p = self._view(v, pool[v])
                sure = np.maximum(p, 1 - p)
                order = np.argsort(-sure, kind="stable")
                order = order[free[order] & (sure[order] >= CONFIDENT)][:int(SHARE * len(free))]
                given.append((order, (p[order] >= 0.5).astype(float)))
            for v, (rows, answers) in enumerate(given):
                other = 1 - v
                own[other] = (np.vstack([own[other][0], pool[other][rows]]), np.concatenate([own[other][1], answers]))
                free[rows] = False
        self._fit(own, views, labels, held)
        margins = np.column_stack([logit(self._view(v, views[v][held])) for v in (0, 1)])
        self.both = Logistic(margins, labels[held])

    def _fit(self, own, views, labels, held):
        self.models = [Logistic(x, y, l2=3.0) for x, y in own]
        self.calibrations = [Logistic(m.margin(x[held])[:, None], labels[held]) for m, x in zip(self.models, views)]

    def _view(self, v, x):
        return self.calibrations[v].probability(self.models[v].margin(x)[:, None])

    def score(self, text_view, meta_view):
        """(probability by text, by metadata, combined)."""
        p = [self._view(0, text_view), self._view(1, meta_view)]
        return p[0], p[1], sigmoid(self.both.margin(np.column_stack([logit(p[0]), logit(p[1])])))


def _view_rows(batches):
    for batch in batches:
        for part in slices(batch):
            text, meta = text_features(texts_of(part)), meta_features(part)
            yield pa.record_batch({"doc_id": part.column("doc_id"), "quality": part.column("quality"),
                                   "text_view": pa.array(list(text), pa.list_(pa.float32())),
                                   "meta_view": pa.array(list(meta), pa.list_(pa.float32()))})


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), "lang", "source",
                       F.col("n_chars").cast("long").alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> CoTrained | None:
    """The co-trained classifier, or None if the labels can't tell two classes apart."""
    rows = _columns(docs, id_col, text_col)
    known = (labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.min("quality").cast("int").alias("quality")))
    ids = rows.select("doc_id").where("doc_id is not null").distinct().join(known, "doc_id", "left")
    order = F.xxhash64("doc_id", F.lit(1))
    sample = (ids.where("quality is not null").orderBy(order).limit(LABELLED)
              .unionAll(ids.where("quality is null").orderBy(order).limit(POOL)))
    got = (rows.join(F.broadcast(sample), "doc_id")  # LABELLED + POOL identifiers at most
           .dropDuplicates(["doc_id"]).select("doc_id", "quality", "text", "lang", "source", "n_chars")
           .mapInArrow(_view_rows, "doc_id long, quality int, text_view array<float>, meta_view array<float>").toArrow())
    got = got.sort_by("doc_id")
    text, meta = (np.stack([np.zeros(0)] if not got.num_rows else c.combine_chunks().values.to_numpy().reshape(got.num_rows, -1))
                  for c in (got.column("text_view"), got.column("meta_view")))
    quality = pc.fill_null(got.column("quality"), -1).to_numpy()
    has = quality >= 0
    y = quality[has].astype(float)
    if min((y == 0).sum(), (y == 1).sum()) < 10:
        return None
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[::3]] = True  # every third of a class only calibrates
    return CoTrained((text[has], meta[has]), y, held, (text[~has], meta[~has]))


def score(docs: DataFrame, model: CoTrained | None, keep: str = "", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_text, p_meta, score, kept for every document."""
    rows = _columns(docs, id_col, text_col)
    if model is None:
        one = F.lit(1.0)
        return rows.select("doc_id", one.alias("p_text"), one.alias("p_meta"), one.alias("score"), F.lit(True).alias("kept"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred weights

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                a, b, s = shared.value.score(text_features(texts_of(part)), meta_features(part))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "p_text": a, "p_meta": b, "score": s, "kept": s >= THRESHOLD})

    return rows.mapInArrow(run, "doc_id long, p_text double, p_meta double, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, all their columns unchanged."""
    model = fit(docs, labels)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                s = shared.value.score(text_features(texts_of(part)), meta_features(part))[2]
                yield part.filter(pa.array(s >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
