"""File sources: catalogue listing and text extraction (SCN-1..9).

* listing: tasks expand a frontier of directories (``sources.tree``), paths are parsed
  with built-ins;
* plain text and notebooks: bytes read by tasks, decoded and parsed in the JVM
  (``make_valid_utf8``, ``try_parse_json`` / VARIANT);
* docx / pptx: turned into text in the task that reads them, with the standard
  library (zip + XML), one bad file -> one error row;
* PDF text comes from a page table (``assemble_pages``), the parser itself is
  not part of this engine.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark import constants as K
from shelfspark.functions.stems import py_strip
from shelfspark.functions.text import name_suffix, path_name
from shelfspark.sources.tree import is_directory, plain_path, walk, with_content

EXTRACT_SCHEMA = "filepath string, filename string, file_type string, text string, error string"


def _strip_scheme(p) -> F.Column:
    return F.regexp_replace(p, r"^file:", "")


def listing_from_paths(paths: DataFrame, root: str) -> DataFrame:
    """SCN-1 projection over a path table (path, size, modified): name, extension,
    relative_path; hidden names (leading '.') are skipped."""
    base = root.rstrip("/")
    name = path_name(F.col("path"))
    return (paths.select("path", name.alias("name"), "size", "modified", name_suffix(name).alias("extension"))
            .filter(~F.col("name").startswith("."))
            .withColumn("relative_path", F.regexp_replace("path", "^" + re.escape(base) + "/", "")))


def list_files(spark: SparkSession, root: str, subdir: str | None = None, recursive: bool = True) -> DataFrame:
    """SCN-1: every non-hidden file under ``root`` (or ``root/subdir``): path, name,
    size, modified (epoch seconds), extension, relative_path. Tasks list the directories
    (``tree.walk``); no file body is read."""
    base = plain_path(root).rstrip("/")
    return listing_from_paths(walk(spark, f"{base}/{subdir}" if subdir else base, recursive), base)


def exclude_sensitive(listing: DataFrame) -> DataFrame:
    """SCN-3: drop everything under ``_sensitive/``."""
    return listing.filter(~F.col("relative_path").startswith(K.SENSITIVE + "/"))


def extraction_kind(ext) -> F.Column:
    """SCN-4: extractor chosen by suffix."""
    e = F.col(ext) if isinstance(ext, str) else ext
    return (F.when(e.isin(*K.TEXT_EXTENSIONS), F.lit("text"))
            .when(e.isin(*K.IPYNB_EXTENSIONS), F.lit("ipynb"))
            .when(e.isin(*K.PDF_EXTENSIONS), F.lit("pdf"))
            .when(e.isin(*K.DOCX_EXTENSIONS), F.lit("docx"))
            .when(e.isin(*K.PPTX_EXTENSIONS), F.lit("pptx"))
            .when(e.isin(*K.IMAGE_EXTENSIONS), F.lit("image"))
            .when(e.isin(*K.AUDIO_EXTENSIONS), F.lit("audio"))
            .when(e.isin(*K.VIDEO_EXTENSIONS), F.lit("video"))
            .otherwise(F.lit("unknown")))


def placeholder(kind, name) -> F.Column:
    """SCN-4: text of media / unknown files."""
    k = F.col(kind) if isinstance(kind, str) else kind
    n = F.col(name) if isinstance(name, str) else name
    return (F.when(k == "image", F.concat(F.lit("[Image: "), n, F.lit("]")))
            .when(k == "audio", F.concat(F.lit("[Audio: "), n, F.lit("]")))
            .when(k == "video", F.concat(F.lit("[Video: "), n, F.lit("]")))
            .when(k == "unknown", F.concat(F.lit("[Unknown type: "), n, F.lit("]"))))


def _cut(text: F.Column, max_chars: int | None) -> F.Column:
    """The whole text, or its first ``max_chars`` characters where a caller wants a preview
    (``constants.TEXT_CAP`` is the usual one)."""
    return text if max_chars is None else F.substring(text, 1, max_chars)


def decode_text(content, max_chars: int | None = None) -> F.Column:
    """SCN-5: UTF-8 with replacement, universal newlines."""
    c = F.col(content) if isinstance(content, str) else content
    t = F.make_valid_utf8(c.cast("string"))
    t = F.regexp_replace(t, "\r\n?", "\n")
    return _cut(t, max_chars)


def notebook_text(raw, max_chars: int | None = None) -> tuple[F.Column, F.Column]:
    """SCN-6: (text, error) of a notebook JSON document. Code and markdown cells with
    non-blank source get ``# --- Code Cell n ---`` / ``# --- Markdown Cell n ---``
    headers (separate counters), joined by a blank line."""
    r = F.col(raw) if isinstance(raw, str) else raw
    v = F.try_parse_json(r)
    cells = F.coalesce(F.try_variant_get(v, "$.cells", "array<variant>"), F.array().cast("array<variant>"))

    def src_of(c):
        s = F.try_variant_get(c, "$.source", "variant")
        is_arr = F.schema_of_variant(s).startswith("ARRAY")
        return F.when(is_arr, F.array_join(F.try_variant_get(s, "$", "array<string>"), "")) \
            .otherwise(F.coalesce(F.try_variant_get(s, "$", "string"), F.lit("")))

    items = F.transform(cells, lambda c: F.struct(
        F.coalesce(F.try_variant_get(c, "$.cell_type", "string"), F.lit("")).alias("t"), src_of(c).alias("s")))
    items = F.filter(items, lambda x: (py_strip(x["s"]) != "") & x["t"].isin("code", "markdown"))
    init = F.struct(F.lit(0).alias("nc"), F.lit(0).alias("nm"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        is_code = x["t"] == "code"
        nc = acc["nc"] + F.when(is_code, 1).otherwise(0)
        nm = acc["nm"] + F.when(is_code, 0).otherwise(1)
        head = F.when(is_code, F.concat(F.lit("# --- Code Cell "), nc.cast("string"))) \
            .otherwise(F.concat(F.lit("# --- Markdown Cell "), nm.cast("string")))
        part = F.concat(head, F.lit(" ---\n"), x["s"])
        return F.struct(nc.alias("nc"), nm.alias("nm"), F.concat(acc["out"], F.array(part)).alias("out"))

    st = F.aggregate(items, init, step)
    text = _cut(F.array_join(st["out"], "\n\n"), max_chars)
    text = F.when(text == "", F.lit("[Jupyter Notebook: 0 code cells, 0 markdown cells]")).otherwise(text)
    ok = v.isNotNull()
    return F.when(ok, text), F.when(~ok, F.lit("Failed to parse notebook: invalid JSON"))


# ----------------------------------------------------------------------------
# SCN-7 office documents (standard library only)
# ----------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PR = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _docx_paragraph(p) -> str:
    out = []
    for el in p.iter():
        if el.tag == _W + "t" and el.text:
            out.append(el.text)
        elif el.tag == _W + "tab":
            out.append("\t")
        elif el.tag in (_W + "br", _W + "cr"):
            out.append("\n")
    return "".join(out)


def docx_text(data: bytes, max_chars: int | None = None) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    body = root.find(_W + "body")
    paras = [] if body is None else [_docx_paragraph(p) for p in body.findall(_W + "p")]
    return "\n".join(p for p in paras if p.strip())[:max_chars]


def _pptx_paragraph(p) -> str:
    out = []
    for el in p.iter():
        if el.tag == _A + "t" and el.text:
            out.append(el.text)
        elif el.tag == _A + "br":
            out.append("\v")
    return "".join(out)


def pptx_text(data: bytes, max_chars: int | None = None) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        pres = ET.fromstring(z.read("ppt/presentation.xml"))
        rels = ET.fromstring(z.read("ppt/_rels/presentation.xml.rels"))
        target = {r.get("Id"): r.get("Target") for r in rels.findall(_PR + "Relationship")}
        ids = pres.find(_P + "sldIdLst")
        slide_files = [] if ids is None else [target[s.get(_R + "id")] for s in ids.findall(_P + "sldId")]
        parts = []
        for num, f in enumerate(slide_files, 1):
            slide = ET.fromstring(z.read("ppt/" + f.lstrip("/").replace("ppt/", "", 1)))
            tree = slide.find(f"{_P}cSld/{_P}spTree")
            texts = []
            for sp in ([] if tree is None else tree.findall(_P + "sp")):
                body = sp.find(_P + "txBody")
                if body is None:
                    continue
                for p in body.findall(_A + "p"):
                    t = _pptx_paragraph(p).strip()
                    if t:
                        texts.append(t)
            if texts:
                parts.append(f"--- Slide {num} ---\n" + "\n".join(texts))
    return "\n\n".join(parts)[:max_chars]


def assemble_pages(pages: DataFrame, id_col: str = "doc_id", max_chars: int | None = None) -> DataFrame:
    """SCN-8: non-blank pages joined by newlines in page order; under 50 stripped
    characters -> scanned_pdf with an error, else pdf.

    The stripped length comes from aggregates (every kept page is non-blank, so it is the
    total length minus the first page's leading and the last page's trailing whitespace);
    with ``max_chars`` only pages starting before that cut are collected."""
    from pyspark.sql import Window
    ws = K.WHITESPACE_RUN
    kept = pages.filter(py_strip(F.col("text")) != "").select(
        id_col, "page_no", "text", F.length("text").alias("_len"),
        F.length(F.regexp_extract("text", f"^{ws}", 0)).alias("_lead"),
        F.length(F.regexp_extract("text", f"{ws}$", 0)).alias("_trail"))
    stats = kept.groupBy(id_col).agg(
        (F.sum("_len") + F.count(F.lit(1)) - 1 - F.min_by("_lead", "page_no") - F.max_by("_trail", "page_no"))
        .alias("_stripped"))
    w = Window.partitionBy(id_col).orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.withColumn("_before", F.coalesce(F.sum(F.col("_len") + 1).over(w), F.lit(0)))
    g = (kept.join(stats, id_col)
         .filter(F.lit(True) if max_chars is None else
                 (F.col("_before") < max_chars) | (F.col("_stripped") < K.SCANNED_MIN_CHARS))
         .groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("pg"),
                              F.first("_stripped").alias("_stripped")))
    ids = pages.select(id_col).distinct()
    joined = ids.join(g.select(id_col, "_stripped",
                               F.array_join(F.transform("pg", lambda p: p["text"]), "\n").alias("full")),
                      id_col, "left")
    full = F.coalesce(F.col("full"), F.lit(""))
    scanned = F.coalesce(F.col("_stripped"), F.lit(0)) < K.SCANNED_MIN_CHARS
    return joined.select(
        id_col,
        F.when(scanned, full).otherwise(_cut(full, max_chars)).alias("text"),
        F.when(scanned, F.lit("scanned_pdf")).otherwise(F.lit("pdf")).alias("file_type"),
        F.when(scanned, F.lit("Low text content — may be scanned PDF. Install marker-pdf for OCR.")).alias("error"))


#: Largest file whose bytes are read into a row.
MAX_CONTENT_BYTES = 1 << 30


def _office(max_chars: int | None):
    """(text, error) of the bytes of a docx or pptx file; other rows keep their bytes."""
    def convert(row, data):
        read = {"docx": docx_text, "pptx": pptx_text}.get(row["kind"])
        if read is None:
            return None
        try:
            return read(data, max_chars), None
        except Exception as e:  # noqa: BLE001 - one bad file becomes one error row
            return "", f"{row['kind'].upper()} extraction failed: {e}"
    return convert


def extract_listed(files: DataFrame, max_chars: int | None = None, max_bytes: int = MAX_CONTENT_BYTES) -> DataFrame:
    """SCN-4..8 over listed files (path, size): filepath, filename, file_type, text, error; hidden names are left out.

    One pass without a shuffle: tasks read the bytes of text, notebook and office files and of no others, office
    files become text there, the rest is decoded and parsed in the JVM. A file above ``max_bytes`` is an error row."""
    path = _strip_scheme(F.col("path"))
    listed = (files.select(path.alias("path"), path_name(path).alias("name"), F.col("size").cast("bigint").alias("size"))
              .filter(~F.col("name").startswith("."))
              .withColumn("ext", name_suffix(F.col("name")))
              .withColumn("kind", extraction_kind(F.col("ext"))))
    has_text = F.col("kind").isin("text", "ipynb", "docx", "pptx")
    read = with_content(listed, has_text & (F.col("size") <= max_bytes), _office(max_chars))
    kind, failed = F.col("kind"), F.col("error").isNotNull()
    nb_text, nb_err = notebook_text(decode_text(F.col("content")), max_chars)
    large = has_text & (F.col("size") > max_bytes)
    notebook = (kind == "ipynb") & ~failed & ~large
    error = (F.when(large, F.concat(F.lit("File of "), F.col("size").cast("string"), F.lit(f" bytes exceeds {max_bytes}")))
             .when(failed, F.col("error"))
             .when(kind == "ipynb", nb_err)
             .when(kind == "pdf", F.lit("PDF parsing is not built in; supply page text to assemble_pages")))
    text = (F.when(large | failed | (kind == "pdf"), F.lit(""))
            .when(kind == "text", decode_text(F.col("content"), max_chars))
            .when(notebook, F.coalesce(nb_text, F.lit("")))
            .when(kind.isin("docx", "pptx"), F.col("text"))
            .otherwise(placeholder("kind", "name")))
    return read.select(F.col("path").alias("filepath"), F.col("name").alias("filename"),
                       F.when(error.isNotNull(), F.col("ext")).otherwise(kind).alias("file_type"),
                       text.alias("text"), error.alias("error"))


def extract_files(spark: SparkSession, root: str, recursive: bool = False, max_chars: int | None = None,
                  max_bytes: int = MAX_CONTENT_BYTES) -> DataFrame:
    """SCN-9: one extraction row per non-hidden file of a directory (non-recursive by default, as the
    batch tool); a directory that is not there gives one error row."""
    base = plain_path(root).rstrip("/")
    if not is_directory(spark, base):
        return spark.createDataFrame([(base, path_tail(base), "", "", f"Directory not found: {base}")], EXTRACT_SCHEMA)
    return extract_listed(walk(spark, base, recursive), max_chars, max_bytes)


def path_tail(path: str) -> str:
    return path.rpartition("/")[2]
