"""Personal-data detection and redaction as column expressions (PII-1..7).

Spans come from native regex functions: for a pattern P over text t,
``regexp_extract_all(t, P, 0)`` gives the matches m_1..m_n and ``split(t, P, -1)``
the pieces between them p_0..p_n, so match i starts at
``len(p_0..p_{i-1}) + len(m_1..m_{i-1})`` (code points, as in Python). The
overlap rule, masks, rebuild and description are higher-order functions over the
per-row finding array; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark import constants as K

FINDING_T = "struct<prio:int,start:int,end:int,type:string,original:string,grp:string>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java_pattern(p: str) -> str:
    """Python-compatible Unicode classes (\\d \\w \\b \\s) in Java regex."""
    return "(?U)" + p


def pattern_spans(text, prio: int, ptype: str, pattern: str) -> Column:
    """All non-overlapping matches of one pattern with their code-point spans.

    One left-to-right fold over (match, piece-before-it) pairs carries the running
    position, so each regex runs once per row and the work is linear in the matches."""
    t = _c(text)
    jp = java_pattern(pattern)
    matches = F.regexp_extract_all(t, F.lit(jp), 0)
    groups = F.regexp_extract_all(t, F.lit(jp), 1) if ptype == "姓名" else matches
    pieces = F.split(t, jp, -1)
    pairs = F.arrays_zip(matches.alias("m"), groups.alias("g"), pieces.alias("p"))
    init = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{FINDING_T}>").alias("out"))

    def step(acc, x):
        start = acc["pos"] + F.length(x["p"])
        end = start + F.length(x["m"])
        item = F.struct(F.lit(prio).alias("prio"), start.cast("int").alias("start"), end.cast("int").alias("end"),
                        F.lit(ptype).alias("type"), x["m"].alias("original"), x["g"].alias("grp"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(item)).alias("out"))

    # the zip runs one past the last match (the tail piece); drop that element
    spans = F.aggregate(F.filter(pairs, lambda x: x["m"].isNotNull()), init, step)["out"]
    return F.when(t.isNull(), F.array().cast(f"array<{FINDING_T}>")).otherwise(spans)


def _gates(text) -> dict[str, Column]:
    """Cheap necessary conditions per pattern, so most texts skip most regex work:
    every digit-based pattern contains a run of four digits, an e-mail an '@', an
    address CJK characters, a name its label."""
    t = _c(text)
    digits = t.rlike(r"(?U)\d{4}")
    return {"身份证号": digits, "手机号": digits, "邮箱": t.contains("@"), "证件号": digits, "通行证号": digits,
            "学号": digits, "学号2": digits, "地址": t.rlike(r"[\x{4e00}-\x{9fff}]"),
            "澳大学号": digits, "姓名": t.contains("姓名") | t.contains("Name")}


def raw_findings(text) -> Column:
    """Matches of all patterns in priority order (pattern, then position)."""
    gates = _gates(text)
    empty = F.array().cast(f"array<{FINDING_T}>")
    parts = [F.when(gates[name], pattern_spans(text, i, name, pat)).otherwise(empty)
             for i, (name, pat) in enumerate(K.PII_PATTERNS)]
    return F.concat(*parts)


def resolve_overlaps(findings) -> Column:
    """PII-2: scan in (priority, position) order and keep a match only if it does not
    overlap an already kept one (any overlap, V20); result sorted by start."""
    empty = F.array().cast(f"array<{FINDING_T}>")
    kept = F.aggregate(
        findings, empty,
        lambda acc, f: F.when(
            F.exists(acc, lambda a: (f["start"] < a["end"]) & (a["start"] < f["end"])), acc
        ).otherwise(F.concat(acc, F.array(f))))
    return F.array_sort(kept, lambda a, b: F.when(a["start"] < b["start"], -1)
                        .when(a["start"] > b["start"], 1).otherwise(0))


def mask(f) -> Column:
    """PII-3: masked value of one finding."""
    o = f["original"]
    n = F.length(o)
    short = F.when(n > 3, F.concat(F.substring(o, 1, 2), F.repeat(F.lit("*"), n - 3), F.substring(o, -1, 1))) \
        .otherwise(F.lit("***"))
    mail_local = F.substring_index(o, "@", 1)
    mail_domain = F.substring_index(o, "@", -1)
    g = f["grp"]
    name_mask = F.when(F.length(g) >= 2, F.concat(F.lit("姓名: "), F.substring(g, 1, 1),
                                                  F.repeat(F.lit("*"), F.length(g) - 1))) \
        .otherwise(F.lit(K.PII_NAME_EMPTY_MASK))
    t = f["type"]
    return (F.when(t == "身份证号", F.concat(F.substring(o, 1, 6), F.lit("*" * 10), F.substring(o, -1, 1)))
            .when(t == "手机号", F.concat(F.substring(o, 1, 3), F.lit("****"), F.substring(o, -4, 4)))
            .when(t == "邮箱", F.when(F.size(F.split(o, "@")) == 2,
                                      F.concat(F.substring(mail_local, 1, 1), F.lit("***@"), mail_domain))
                  .otherwise(F.lit("***@***")))
            .when(t.isin(*K.PII_SHORT_MASK_TYPES), short)
            .when(t == "地址", F.when(n > 8, F.concat(F.substring(o, 1, 8), F.lit("***")))
                  .otherwise(F.lit(K.PII_ADDRESS_SHORT_MASK)))
            .when(t == "姓名", name_mask)
            .otherwise(F.lit(K.PII_OTHER_MASK)))


def any_pii(text) -> Column:
    """Could any pattern match? (OR of the per-pattern gates.)"""
    g = list(_gates(text).values())
    out = g[0]
    for x in g[1:]:
        out = out | x
    return out


FOUND_T = "array<struct<type:string,start:int,end:int,redacted:string>>"


def findings(text) -> Column:
    """Accepted findings sorted by position: type, start, end, redacted (never the original)."""
    acc = resolve_overlaps(raw_findings(text))
    full = F.transform(acc, lambda f: F.struct(f["type"].alias("type"), f["start"].alias("start"),
                                               f["end"].alias("end"), mask(f).alias("redacted")))
    return F.when(F.coalesce(any_pii(text), F.lit(False)), full).otherwise(F.array().cast(FOUND_T))


def redact(text, found) -> Column:
    """PII-4: the text with every finding replaced by its mask."""
    t = _c(text)
    init = F.struct(F.lit("").alias("out"), F.lit(0).alias("cur"))
    st = F.aggregate(
        found, init,
        lambda s, f: F.struct(
            F.concat(s["out"], F.substring(t, s["cur"] + 1, f["start"] - s["cur"]), f["redacted"]).alias("out"),
            f["end"].alias("cur")))
    tail = F.when(F.length(t) > st["cur"], F.substring(t, st["cur"] + 1, F.length(t) - st["cur"])) \
        .otherwise(F.lit(""))
    return F.when(t.isNull(), F.lit(None)).otherwise(F.concat(st["out"], tail))


def safe_description(text, found) -> Column:
    """PII-5: distinct types in position order, plus document-kind labels and the
    context labels, e.g. ``姓名、身份证号、个人证件 - 含澳大相关内容``; '' without findings."""
    t = _c(text)
    types = F.array_distinct(F.transform(found, lambda f: f["type"]))
    has_name = F.array_contains(types, "姓名")
    has_student = F.arrays_overlap(types, F.array(*[F.lit(x) for x in K.PII_STUDENT_TYPES]))
    has_permit = F.arrays_overlap(types, F.array(*[F.lit(x) for x in K.PII_PERMIT_TYPES]))
    kinds = F.array(
        F.when(has_name & has_student, F.lit(K.PII_DESC_STUDENT)),
        F.when(has_name & ~F.coalesce(has_student, F.lit(False)), F.lit(K.PII_DESC_PERSONAL)),
        F.when(has_permit, F.lit(K.PII_DESC_PERMIT)))
    parts = F.concat(types, F.array_compact(kinds))
    ctx = F.array_compact(F.array(*[
        F.when(F.greatest(*[t.contains(w) for w in words]), F.lit(label)) if len(words) > 1 else
        F.when(t.contains(words[0]), F.lit(label))
        for label, words in K.PII_CONTEXT_TESTS]))
    desc = F.concat(F.array_join(parts, K.PII_TYPE_SEPARATOR),
                    F.when(F.size(ctx) > 0, F.concat(F.lit(" - 含"), F.array_join(ctx, K.PII_TYPE_SEPARATOR),
                                                     F.lit("相关内容"))).otherwise(F.lit("")))
    return F.when(F.size(found) == 0, F.lit("")).otherwise(desc)


def filename_hint(filename) -> Column:
    """PII-6: which fixed hint words occur in the base name, in list order."""
    base = F.element_at(F.split(F.coalesce(_c(filename), F.lit("")), "/"), -1)
    words = F.array(*[F.lit(w) for w in K.PII_FILENAME_HINT_WORDS])
    return F.array_join(F.filter(words, lambda w: base.contains(w)), K.PII_TYPE_SEPARATOR)


def sensitive_description(desc, filename) -> Column:
    """PII-7: ``hint：desc`` / whichever exists; without a file name and without
    findings a fixed fallback."""
    d = _c(desc)
    fn = _c(filename)
    has_fn = fn.isNotNull() & (fn != "")
    hint = filename_hint(fn)
    with_fn = (F.when((hint != "") & (d != ""), F.concat(hint, F.lit("："), d))
               .when(hint != "", hint).otherwise(d))
    combined = F.when(has_fn, with_fn).otherwise(d)
    return F.when(combined != "", combined).when(has_fn, hint).otherwise(F.lit(K.PII_UNKNOWN_SENSITIVE))
