"""Path and name checks, type flags, MIME lookup (FLT-7..9, SCN-2/3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark import constants as K


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _isin(col: Column, values: list[str]) -> Column:
    return col.isin(*values)


def type_flags(ext) -> list[Column]:
    """SCN-2: is_image / is_video / is_audio / is_text / is_pdf by (narrow) suffix sets."""
    e = _c(ext)
    return [_isin(e, K.FLAG_IMAGE).alias("is_image"), _isin(e, K.FLAG_VIDEO).alias("is_video"),
            _isin(e, K.FLAG_AUDIO).alias("is_audio"), _isin(e, K.FLAG_TEXT).alias("is_text"),
            _isin(e, K.FLAG_PDF).alias("is_pdf")]


def python_unquote(s) -> Column:
    """URL-decoding like Python's ``unquote``: '+' stays, a '%' without two hex digits
    stays as it is (the valid escapes around it are decoded all the same), and bytes
    that are not UTF-8 become the replacement character."""
    raw = _c(s)
    # every byte that is no valid escape is escaped itself, so the text is all hex pairs
    stray = F.regexp_replace(raw, "%(?![0-9A-Fa-f]{2})", "%25")
    pieces = F.regexp_extract_all(stray, F.lit("((?:%[0-9A-Fa-f]{2})+|[^%]+)"), F.lit(1))
    decoded = F.transform(pieces, lambda p: F.when(
        p.startswith("%"), F.make_valid_utf8(F.unhex(F.replace(p, F.lit("%"), F.lit(""))).cast("string"))).otherwise(p))
    return F.array_join(decoded, "")


def path_audit(raw) -> tuple[Column, Column]:
    """FLT-7: (safe, normalised). Decode, drop NUL, strip leading '/', reject any '..'
    part or a part starting with '~', drop empty and '.' parts; nothing left -> unsafe.
    (Containment after symlink resolution needs a file system and is not checked.)"""
    dec = F.replace(python_unquote(raw), F.lit("\u0000"), F.lit(""))
    cleaned = F.regexp_replace(dec, "^/+", "")
    parts = F.split(cleaned, "/", -1)
    bad = F.exists(parts, lambda p: (p == "..") | p.startswith("~"))
    kept = F.filter(parts, lambda p: (p != "") & (p != "."))
    safe = ~bad & (F.size(kept) > 0)
    return safe, F.when(safe, F.array_join(kept, "/"))


def is_safe_filename(name) -> Column:
    """FLT-8: non-empty, no NUL / CR / LF, no '/', '\\' or '..'."""
    n = _c(name)
    return (n.isNotNull() & (n != "") & ~n.contains("\u0000") & ~n.contains("\n") & ~n.contains("\r")
            & ~n.contains("/") & ~n.contains("\\") & ~n.contains(".."))


def validate_category(name) -> Column:
    """FLT-8: keep word characters (Unicode), CJK, '-' and '_'; cut to 64."""
    n = F.coalesce(_c(name), F.lit(""))
    return F.substring(F.regexp_replace(n, r"(?U)[^\w\x{4e00}-\x{9fff}\-_]", ""), 1, K.CATEGORY_NAME_CAP)


def mime_type(ext) -> Column:
    """FLT-9: MIME type by suffix, default application/octet-stream."""
    m = F.create_map(*[x for kv in K.MIME_MAP.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.element_at(m, _c(ext)), F.lit(K.DEFAULT_MIME))


def servable(ext, size) -> Column:
    """FLT-9: suffix on the allow-list and size within the cap."""
    return _isin(_c(ext), K.ALLOWED_EXTENSIONS) & (_c(size) <= K.MAX_FILE_BYTES)
