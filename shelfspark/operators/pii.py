"""Sensitive-file pipeline (PII-8) and corpus roll-up (PII-9).

Texts are scanned some MB at a time (``mapInArrow``): four cheap tests in C++ tell which patterns can match
at all, and only those run, each once, over the texts that pass. The matches go through a sweep in
priority order over accepted intervals kept by position, so a text's cost grows with its length and its
matches, not with their square. Masks and the redacted text are made in the same pass; the raw text never
reaches an output column. ``functions.pii`` states the same as column expressions, which the tests compare.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfspark import constants as K
from shelfspark.functions import pii as P
from shelfspark.functions.batches import slices

#: What a text must hold for a pattern to match, as RE2 text.
_GATE = {name: r"\p{Nd}{4}" for name, _ in K.PII_PATTERNS} | {"邮箱": "@", "地址": r"[\x{4e00}-\x{9fff}]", "姓名": "姓名|Name"}
_PATTERNS = [(name, re.compile(pattern)) for name, pattern in K.PII_PATTERNS]


def masked(kind: str, m: re.Match) -> str:
    """PII-3: what stands for a match."""
    o = m[0]
    if kind == "身份证号":
        return o[:6] + "*" * 10 + o[-1]
    if kind == "手机号":
        return o[:3] + "****" + o[-4:]
    if kind == "邮箱":
        local, _, domain = o.partition("@")
        return f"{local[:1]}***@{domain}" if "@" not in domain else "***@***"
    if kind in K.PII_SHORT_MASK_TYPES:
        return o[:2] + "*" * (len(o) - 3) + o[-1] if len(o) > 3 else "***"
    if kind == "地址":
        return o[:8] + "***" if len(o) > 8 else K.PII_ADDRESS_SHORT_MASK
    if kind == "姓名":
        return f"姓名: {m[1][0]}{'*' * (len(m[1]) - 1)}" if len(m[1] or "") >= 2 else K.PII_NAME_EMPTY_MASK
    return K.PII_OTHER_MASK


def find(text: str, kinds=None) -> list[tuple[str, int, int, str]]:
    """PII-1..3: (type, start, end, redacted) of the accepted matches, by position. Patterns come in priority
    order and their matches by position; one that touches an accepted interval is dropped."""
    starts: list[int] = []
    kept: list[tuple[str, int, int, str]] = []
    for kind, pattern in _PATTERNS:
        if kinds is not None and kind not in kinds:
            continue
        for m in pattern.finditer(text):
            at = bisect_right(starts, m.start())
            if (at == 0 or kept[at - 1][2] <= m.start()) and (at == len(starts) or m.end() <= starts[at]):
                starts.insert(at, m.start())
                kept.insert(at, (kind, m.start(), m.end(), masked(kind, m)))
    return kept


def hidden(text: str, found: list[tuple[str, int, int, str]]) -> str:
    """PII-4: the text with every finding replaced by its mask."""
    out, at = [], 0
    for _, start, end, mask in found:
        out += [text[at:start], mask]
        at = end
    return "".join([*out, text[at:]])


def _scanned(docs: DataFrame, text_col: str, redacted_col: str | None = None) -> DataFrame:
    """The rows with ``findings`` and, where named, the redacted text (null for a null text)."""
    schema = StructType(list(docs.schema.fields)).add("findings", docs.sparkSession.createDataFrame([], f"x {P.FOUND_T}").schema["x"].dataType)
    if redacted_col:
        schema = schema.add(redacted_col, "string")
    struct = pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("redacted", pa.string())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part.column(text_col)
                passed = {g: pc.fill_null(pc.match_substring_regex(texts, g), False).to_numpy(zero_copy_only=False) for g in set(_GATE.values())}
                found: list[list] = [[] for _ in range(part.num_rows)]
                for i in np.flatnonzero(np.logical_or.reduce(list(passed.values()))).tolist():
                    found[i] = find(texts[i].as_py(), {kind for kind, g in _GATE.items() if passed[g][i]})
                sizes = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32())
                flat = list(zip(*(x for f in found for x in f))) or [[], [], [], []]
                values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, struct)], fields=list(struct))
                columns = [*part.columns, pa.ListArray.from_arrays(sizes, values)]
                if redacted_col:
                    changed = [i for i, f in enumerate(found) if f]
                    mask = np.zeros(part.num_rows, bool)
                    mask[changed] = True
                    columns.append(pc.replace_with_mask(texts, pa.array(mask), pa.array([hidden(texts[i].as_py(), found[i]) for i in changed], texts.type)))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``findings`` (type, start, end, redacted) to every row."""
    return _scanned(docs, text_col)


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PII-1..5 per document: redacted_text, findings, pii_count, has_pii, safe_description."""
    s = _scanned(docs.select(id_col, text_col), text_col, "redacted_text")
    return s.select(
        id_col,
        "redacted_text",
        "findings",
        F.size("findings").alias("pii_count"),
        (F.size("findings") > 0).alias("has_pii"),
        P.safe_description(F.col(text_col), F.col("findings")).alias("safe_description"))


def ingest_sensitive(docs: DataFrame, id_col: str = "doc_id", path_col: str = "filepath",
                     text_col: str = "text", max_text: int | None = None, max_report: int | None = None
                     ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """PII-8. Returns three feeds:

    * files: path, category ``_sensitive``, extracted_text = redacted text,
      keywords = finding types (with repeats);
    * descriptions: path, description (PII-7);
    * report: redacted text, findings without originals, counts.

    ``max_text`` and ``max_report`` cut the texts to previews (``SENSITIVE_TEXT_CAP`` and
    ``SENSITIVE_REPORT_CAP`` are the usual ones); without them the whole text is kept.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    s = _scanned(docs.select(id_col, path_col, text.alias("_t")), "_t", "_red")
    s = s.withColumn("_desc", P.sensitive_description(P.safe_description(F.col("_t"), F.col("findings")),
                                                      F.col(path_col)))
    files = s.select(F.col(path_col).alias("path"), F.lit(K.SENSITIVE).alias("category"),
                     (F.col("_red") if max_text is None else F.substring("_red", 1, max_text)).alias("extracted_text"),
                     F.transform("findings", lambda f: f["type"]).alias("keywords"))
    descriptions = s.select(F.col(path_col).alias("path"), F.col("_desc").alias("description"))
    report = s.select(id_col, F.col(path_col).alias("filepath"),
                      (F.col("_red") if max_report is None else F.substring("_red", 1, max_report)).alias("redacted_text"),
                      F.transform("findings", lambda f: F.struct(f["type"].alias("type"),
                                                                 f["redacted"].alias("redacted")))
                      .alias("pii_findings"),
                      F.size("findings").alias("pii_count"),
                      F.col("_desc").alias("safe_description"),
                      (F.size("findings") > 0).alias("has_pii"))
    return files, descriptions, report


def pii_profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PII-9: per finding type, number of findings and of documents holding one."""
    s = scan(docs, text_col).select(id_col, F.explode("findings").alias("f"))
    return s.groupBy(F.col("f.type").alias("type")).agg(
        F.count(F.lit(1)).alias("findings"), F.countDistinct(id_col).alias("documents"))
