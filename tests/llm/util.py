"""Small fixtures for the corpus operators."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, part int, start long"

LONG = ("The quick brown fox jumps over the lazy dog. " * 4000).strip()


def docs(spark, texts, ids=None):
    """A documents table with every other column null and further columns whose names the
    operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None, "x", 1, 2) for i, t in zip(ids, texts)], DOCS)


def rows(df):
    return [r.asDict() for r in df.collect()]
