"""Scalar text functions as Catalyst column expressions (no UDFs)."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark import constants as K

CJK_CLASS = r"\x{4e00}-\x{9fff}\x{3040}-\x{30ff}"
_UPPER = string.ascii_uppercase
_LOWER = string.ascii_lowercase


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cjk_count(text) -> Column:
    """Number of characters in U+4E00..U+9FFF or U+3040..U+30FF."""
    t = _c(text)
    return F.length(F.regexp_replace(t, f"[^{CJK_CLASS}]", ""))


def ascii_letter_count(text) -> Column:
    t = _c(text)
    return F.length(F.regexp_replace(t, "[^A-Za-z]", ""))


def detect_language(text) -> Column:
    """TXT-1: 'zh' / 'en' / 'mixed'. Empty or NULL text is 'zh'."""
    t = _c(text)
    cjk = cjk_count(t)
    asc = ascii_letter_count(t)
    return (F.when(t.isNull() | (t == ""), F.lit("zh"))
            .when(cjk > asc, F.lit("zh"))
            .when(asc > cjk * 2, F.lit("en"))
            .otherwise(F.lit("mixed")))


def ascii_fold(c) -> Column:
    """Lower-case ASCII letters only (SQLite LIKE folds ASCII only)."""
    return F.translate(_c(c), _UPPER, _LOWER)


def sqlite_like(value, needle: str) -> Column:
    """SQLite ``value LIKE '%needle%'``: ASCII-case-insensitive, ``%``/``_`` in the
    needle stay wildcards, no escape character."""
    pattern = "%" + needle.translate(str.maketrans(_UPPER, _LOWER)) + "%"
    return F.like(ascii_fold(value), F.lit(pattern), F.lit("\u0001"))


def sqlite_like_col(value, pattern_col) -> Column:
    """Same as ``sqlite_like`` with a per-row (already folded) pattern column."""
    return F.like(ascii_fold(value), _c(pattern_col), F.lit("\u0001"))


def path_name(path) -> Column:
    """Last path segment."""
    return F.element_at(F.split(_c(path), "/"), -1)


def path_parent(path) -> Column:
    p = _c(path)
    return F.regexp_extract(p, r"^(.*)/[^/]*$", 1)


def name_suffix(name) -> Column:
    """Python ``Path.suffix`` lower-cased: from the last dot, unless that dot is
    the first or the last character of the name."""
    return F.lower(F.regexp_extract(_c(name), r"(?s)^.+(\.[^.]+)$", 1))


def name_stem(name) -> Column:
    """Python ``Path.stem``: the name without its suffix."""
    n = _c(name)
    stem = F.regexp_extract(n, r"(?s)^(.+)\.[^.]+$", 1)
    return F.when(stem == "", n).otherwise(stem)


def keyword_tokens(text) -> Column:
    """Words of TXT-2: lower-case, Unicode-whitespace split, punctuation stripped
    from both ends, length >= 2 (array in text order)."""
    words = F.split(F.lower(_c(text)), K.WHITESPACE_RUN)
    stripped = F.transform(words, lambda w: F.btrim(w, F.lit(K.KEYWORD_STRIP_CHARS)))
    return F.filter(stripped, lambda w: F.length(w) >= 2)


def python_title(s) -> Column:
    """Python ``str.title()``: a character is lower-cased when the previous one is a
    cased letter, otherwise upper-cased (``3d`` -> ``3D``, ``it's`` -> ``It'S``)."""
    chars = F.split(_c(s), "")

    def one(ch, i):
        prev = F.get(chars, i - 1)
        prev_cased = prev.isNotNull() & prev.rlike(r"^[\p{Lu}\p{Ll}\p{Lt}]$")
        return F.when(prev_cased, F.lower(ch)).otherwise(F.upper(ch))

    return F.array_join(F.transform(chars, one), "")


def json_array(text) -> Column:
    """TXT-9: a JSON array as text, as an array of strings; [] for null, for text that is no JSON and for JSON that
    is no array."""
    t = _c(text)
    return F.coalesce(F.when(t.rlike(r"^\s*\["), F.from_json(t, "array<string>")), F.array().cast("array<string>"))
