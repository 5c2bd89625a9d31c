"""binaryFile sources on generated files (bad UTF-8, notebooks, docx, pptx)."""

import json
import os
import tempfile
import zipfile

from shelfspark.sources import files as S

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
P = ('xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" '
     'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" '
     'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"')


def _slide(texts):
    sps = "".join(f"<p:sp><p:txBody>{''.join(f'<a:p><a:r><a:t>{t}</a:t></a:r></a:p>' for t in ts)}</p:txBody></p:sp>"
                  for ts in texts)
    return f"<p:sld {P}><p:cSld><p:spTree>{sps}</p:spTree></p:cSld></p:sld>"


def _make(d):
    with open(f"{d}/a.txt", "wb") as f:
        f.write(b"line1\r\nline2\rline3 \xff end")
    with open(f"{d}/.hidden.md", "w") as f:
        f.write("x")
    json.dump({"cells": [{"cell_type": "markdown", "source": ["# T\n", "body"]}, {"cell_type": "code", "source": "x=1"},
                         {"cell_type": "code", "source": ""}, {"cell_type": "code", "source": "y=2"}]},
              open(f"{d}/n.ipynb", "w"))
    with open(f"{d}/bad.ipynb", "w") as f:
        f.write("{")
    with zipfile.ZipFile(f"{d}/w.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/>"
                                        f"<w:p><w:r><w:t>Two</w:t></w:r><w:r><w:tab/><w:t>x</w:t></w:r></w:p>"
                                        f"</w:body></w:document>")
    with zipfile.ZipFile(f"{d}/s.pptx", "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation {P}><p:sldIdLst><p:sldId id="256" r:id="rId2"/>'
                                           f'<p:sldId id="257" r:id="rId3"/><p:sldId id="258" r:id="rId4"/>'
                                           f'</p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId2" Target="slides/slide1.xml"/><Relationship Id="rId3" Target="slides/slide2.xml"/>'
                   '<Relationship Id="rId4" Target="slides/slide3.xml"/></Relationships>')
        z.writestr("ppt/slides/slide1.xml", _slide([["Title", " "], ["Body"]]))
        z.writestr("ppt/slides/slide2.xml", _slide([[" "]]))
        z.writestr("ppt/slides/slide3.xml", _slide([["Last"]]))
    with open(f"{d}/broken.pptx", "wb") as f:
        f.write(b"nope")
    with open(f"{d}/pic.png", "wb") as f:
        f.write(b"\x89PNG")


def test_extract(spark):
    d = tempfile.mkdtemp(prefix="shelfspark-src-")
    _make(d)
    rows = {r.filename: r for r in S.extract_files(spark, d).collect()}
    assert ".hidden.md" not in rows
    assert rows["a.txt"].text == "line1\nline2\nline3 � end" and rows["a.txt"].file_type == "text"
    assert rows["n.ipynb"].text == "# --- Markdown Cell 1 ---\n# T\nbody\n\n# --- Code Cell 1 ---\nx=1\n\n" \
                                   "# --- Code Cell 2 ---\ny=2"
    assert rows["bad.ipynb"].error.startswith("Failed to parse notebook") and rows["bad.ipynb"].file_type == ".ipynb"
    assert rows["w.docx"].text == "One\nTwo\tx" and rows["w.docx"].file_type == "docx"
    assert rows["s.pptx"].text == "--- Slide 1 ---\nTitle\nBody\n\n--- Slide 3 ---\nLast"
    assert rows["broken.pptx"].error.startswith("PPTX extraction failed")
    assert rows["pic.png"].text == "[Image: pic.png]"
    # a file above the limit is an error row, and no media file's bytes are read
    small = {r.filename: r for r in S.extract_files(spark, d, max_bytes=3).collect()}
    assert small.keys() == rows.keys()
    assert small["a.txt"].error.startswith("File of") and small["pic.png"].text == "[Image: pic.png]"


def test_listing(spark):
    d = tempfile.mkdtemp(prefix="shelfspark-ls-")
    os.makedirs(f"{d}/_sensitive")
    os.makedirs(f"{d}/学习")
    for p in ["_sensitive/id.jpg", "学习/a.pdf", ".dot", "b.MP4"]:
        with open(f"{d}/{p}", "w") as f:
            f.write("x")
    ls = S.list_files(spark, d)
    rel = sorted(r.relative_path for r in ls.collect())
    assert rel == ["_sensitive/id.jpg", "b.MP4", "学习/a.pdf"]
    assert sorted(r.relative_path for r in S.exclude_sensitive(ls).collect()) == ["b.MP4", "学习/a.pdf"]
    assert {r.name: r.extension for r in ls.collect()}["b.MP4"] == ".mp4"


def test_assemble_pages_edges(spark):
    pages = spark.createDataFrame(
        [(1, 1, "  short  "), (1, 2, "   "), (1, 3, "text"),               # scanned: 'short  \n text' < 50
         (2, 1, "a" + " " * 60000), (2, 2, "b" * 100),                      # not scanned, cut to 50 000
         (3, 1, "x" * 49990), (3, 2, "y" * 30), (3, 3, "z" * 10)],           # third page starts after the cut
        "doc_id long, page_no int, text string")
    whole = {r.doc_id: r for r in S.assemble_pages(pages).collect()}
    assert whole[2].text == "a" + " " * 60000 + "\n" + "b" * 100
    assert whole[3].text == "x" * 49990 + "\n" + "y" * 30 + "\n" + "z" * 10
    rows = {r.doc_id: r for r in S.assemble_pages(pages, max_chars=50000).collect()}
    assert rows[1].file_type == "scanned_pdf" and rows[1].text == "  short  \ntext"
    assert rows[2].file_type == "pdf" and rows[2].text == ("a" + " " * 60000 + "\n" + "b" * 100)[:50000]
    assert rows[3].text == ("x" * 49990 + "\n" + "y" * 30 + "\n" + "z" * 10)[:50000]


def test_large_tree_in_rounds(spark, tmp_path):
    """Ten thousand directories; the driver sees counts only, and small budgets give more rounds."""
    from shelfspark.sources import tree as T
    want = set()
    for i in range(10_000):
        d = tmp_path / f"a{i % 20}" / f"_b{i % 400}" / f"c{i}"
        os.makedirs(d)
        if i % 7 == 0:
            (d / f"f{i}.txt").write_text("x" * (i % 5))
            want.add((f"a{i % 20}/_b{i % 400}/c{i}/f{i}.txt", i % 5))
    os.makedirs(tmp_path / ".git" / "deep")
    (tmp_path / ".git" / "deep" / "no.txt").write_text("x")
    for budget in (2000, 150):
        got = {(r.path[len(str(tmp_path)) + 1:], r.size) for r in T.walk(spark, f"file:{tmp_path}", budget=budget).collect()}
        assert got == want
    assert {r.relative_path for r in S.list_files(spark, str(tmp_path), "a3/_b3").collect()} == {p for p, _ in want if p.startswith("a3/_b3/")}
    assert T.walk(spark, str(tmp_path), recursive=False).collect() == []


def test_missing_and_unreadable(spark, tmp_path):
    row, = S.extract_files(spark, str(tmp_path / "gone")).collect()
    assert row.error == f"Directory not found: {tmp_path}/gone" and row.filename == "gone"
    (tmp_path / "dir.txt").mkdir()
    files = spark.createDataFrame([(str(tmp_path / "no.txt"), 3), (None, 1), (str(tmp_path / "x.png"), None)], "path string, size long")
    rows = {r.filename: r for r in S.extract_listed(files).collect()}
    assert rows["no.txt"].error.startswith("Cannot read file") and rows["no.txt"].file_type == ".txt"
    assert rows["x.png"].text == "[Image: x.png]"
    assert S.extract_files(spark, str(tmp_path)).collect() == []


def test_written_files_read_again(spark, tmp_path):
    from shelfspark.sources import tree as T
    rows = [(f"{tmp_path}/d{i % 3}/f{i}.txt", f"text {i}".encode()) for i in range(50)] + [(f"{tmp_path}/empty.md", None)]
    assert T.write_files(spark.createDataFrame(rows, "path string, content binary")) == 51
    got = {r.filepath: r.text for r in S.extract_files(spark, str(tmp_path), recursive=True).collect()}
    assert got == {p: (c or b"").decode() for p, c in rows}
