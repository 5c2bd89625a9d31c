"""File-name stem candidates, folder names and strategy labels (TXT-6..8, GRP-3/4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark import constants as K
from shelfspark.functions.text import python_title

_WS = K.WHITESPACE_RUN


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()`` (Unicode whitespace)."""
    return F.regexp_replace(_c(c), f"^{_WS}|{_WS}$", "")


def _keep(stripped: Column, lower: Column) -> Column:
    return F.when((stripped != "") & (stripped != lower), stripped)


def stem_candidates(stem) -> Column:
    """TXT-6: distinct candidates of length >= 2 for a file stem (name without suffix).
    The first candidate keeps its case; all others are lower-cased."""
    name = _c(stem)
    low = F.lower(name)
    cands = [name]
    for pat in K.STEM_SUFFIX_PATTERNS:
        cands.append(_keep(py_strip(F.regexp_replace(low, "(?iU)" + pat, "")), low))
    cands.append(_keep(py_strip(F.regexp_replace(low, "(?U)" + K.STEM_TRAILING_DIGITS, "")), low))
    cands.append(_keep(py_strip(F.regexp_replace(low, "(?U)" + K.STEM_DATE_PREFIX, "")), low))
    cands.append(_keep(py_strip(F.regexp_replace(low, "(?U)" + K.STEM_CHAPTER, "")), low))
    prefixes = []
    for sep in K.STEM_SEPARATORS:
        parts = F.split(low, "\\" + sep if sep == "-" else sep, -1)
        n = F.size(parts)
        prefixes.append(F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1),
                                                  lambda i: F.array_join(F.slice(parts, 1, i), sep)))
                        .otherwise(F.array().cast("array<string>")))
    allc = F.concat(F.array(*cands), *prefixes)
    return F.array_distinct(F.filter(allc, lambda s: s.isNotNull() & (F.length(s) >= 2)))


def folder_name(stem) -> Column:
    """TXT-7: strip ``_- ``, separators to spaces, Python ``title()``, cut to 47 + '...'
    when longer than 50, default ``Grouped Files``."""
    s = F.regexp_replace(_c(stem), r"^[_\- ]+|[_\- ]+$", "")
    s = F.translate(s, "_-", "  ")
    t = python_title(s)
    t = F.when(F.length(t) > K.FOLDER_NAME_CAP, F.concat(F.substring(t, 1, 47), F.lit("..."))).otherwise(t)
    return F.when(t == "", F.lit(K.DEFAULT_FOLDER_NAME)).otherwise(t)


def safe_folder_name(name) -> Column:
    """TXT-8: ``/`` and ``\\`` become ``_``, NUL is dropped, blank -> GroupedFiles."""
    s = py_strip(F.regexp_replace(F.translate(_c(name), "/\\", "__"), "\u0000", ""))
    return F.when(s == "", F.lit(K.DEFAULT_SAFE_FOLDER)).otherwise(s)


def strategy_from_flags(n_ext, has_numbers, has_version) -> Column:
    """GRP-3 from per-group aggregates: distinct suffixes, any stem with two digits in
    a row, any stem containing a version word (words hold no space, so testing each
    name equals testing the space-joined names)."""
    return (F.when((_c(n_ext) > 1) & _c(has_numbers), F.lit("sequential_different_formats"))
            .when(_c(n_ext) > 1, F.lit("same_stem_different_formats"))
            .when(_c(has_numbers), F.lit("sequential_numbering"))
            .when(_c(has_version), F.lit("version_variants"))
            .otherwise(F.lit("common_prefix")))


def has_version_word(stem_lower) -> Column:
    s = _c(stem_lower)
    return F.greatest(*[s.contains(w) for w in K.VERSION_WORDS])


def group_confidence(n) -> Column:
    """GRP-4: min(0.5 + 0.15 n, 1)."""
    return F.least(F.lit(0.5) + _c(n).cast("double") * F.lit(0.15), F.lit(1.0))
