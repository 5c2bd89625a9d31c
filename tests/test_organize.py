"""Organising and grouping against plain sequential Python, on random moves."""

import random

import pytest
from pyspark.sql import functions as F

from shelfspark import constants as K
from shelfspark.functions.paths import path_audit
from shelfspark.plans.organize import collision_names, group_files, organize_plan


def _free(live, folder, name, split=True):
    stem, dot, end = name.rpartition(".") if split and "." in name.strip(".") and name.rpartition(".")[0] and name.rpartition(".")[2] else (name, "", "")
    out, n = name, 0
    while f"{folder}/{out}" in live:
        n += 1
        out = f"{stem}_{n}{dot}{end}"
    return out


def sequential(paths, moves):
    live, origin = set(paths), set(paths)
    known = {K.INBOX, K.ARCHIVE, K.SENSITIVE, *K.CATEGORY_DIRS} | {p.split("/")[1] for p in paths if p.count("/") > 1}
    rows = []
    for seq, path, category in sorted(moves):
        folder = "vault/" + (category if category in known else K.INBOX)
        if path not in origin:
            rows.append((seq, path, None, folder, "error"))
            continue
        dst = f"{folder}/{_free(live, folder, path.rpartition('/')[2])}"
        origin.discard(path)
        live.discard(path)
        live.add(dst)
        rows.append((seq, path, dst, folder, "moved"))
    return rows


@pytest.mark.parametrize("seed,rows", [*((s, 200_000) for s in range(6)), (0, 0), (1, 0), (2, 6)])
def test_organize_equals_sequential_moves(spark, monkeypatch, seed, rows):
    from shelfspark.plans import organize
    monkeypatch.setattr(organize, "FOLD_ROWS", rows)
    rng = random.Random(seed)
    folders = ["_inbox", "学习", "备忘", "Trips", "_inbox/src1"]
    names = ["a.txt", "a_1.txt", "a_2.txt", "a_1_1.txt", "b.md", "b", ".hidden", "c.tar.gz"]
    paths = sorted({f"vault/{rng.choice(folders)}/{rng.choice(names)}" for _ in range(25)})
    moves = [(i * 3, rng.choice(paths + ["vault/_inbox/none.txt"]), rng.choice(["学习", "备忘", "Trips", "Nowhere", "_inbox"])) for i in range(40)]
    df = organize_plan(spark.createDataFrame([(p,) for p in paths], "path string"),
                       spark.createDataFrame(moves, "seq long, path string, category string"))
    got = sorted((r.seq, r.src, r.dst, r.target_dir, r.status) for r in df.collect())
    assert got == sequential(paths, moves)


def test_a_thousand_clashes_in_one_directory(spark, monkeypatch):
    """Clashes between families are settled in the one pass over all groups."""
    from shelfspark.plans import organize
    monkeypatch.setattr(organize, "_one_pass", None)
    names = [n for i in range(1000) for n in (f"f{i}x.txt", f"f{i}x.txt", f"f{i}x_1.txt")]
    rows = [(i, "d", n) for i, n in enumerate(names)]
    out = collision_names(spark.createDataFrame([], "dir string, name string"), spark.createDataFrame(rows, "order long, dir string, name string"))
    got = {r.order: r.final_name for r in out.collect()}
    assert got == {3 * i + k: n for i in range(1000) for k, n in enumerate((f"f{i}x.txt", f"f{i}x_1.txt", f"f{i}x_1_1.txt"))}


def test_passes_of_large_groups_do_not_grow_with_their_number(spark, monkeypatch):
    """Six groups, of one directory or of six, with the same clash settle in as many passes as one."""
    from shelfspark.plans import organize
    calls = []
    inner = organize._one_pass
    monkeypatch.setattr(organize, "_one_pass", lambda *a: calls.append(1) or inner(*a))
    monkeypatch.setattr(organize, "FOLD_ROWS", 0)
    counts = []
    for folders, stems in ((1, 1), (3, 2)):
        calls.clear()
        rows = [(f"d{d}", f"{s}{n}") for d in range(folders) for s in "ab"[:stems] for n in (".txt", ".txt", "_1.txt")]
        out = collision_names(spark.createDataFrame([], "dir string, name string"),
                              spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "order long, dir string, name string"))
        assert sorted((r.dir, r.final_name) for r in out.collect()) == sorted(
            (f"d{d}", f"{s}{n}") for d in range(folders) for s in "ab"[:stems] for n in (".txt", "_1.txt", "_1_1.txt"))
        counts.append(len(calls))
    assert counts[0] == counts[1] and counts[0] > 0


def test_group_files_equals_sequential(spark):
    files = ["v/in/a.txt", "v/in/b.txt", "v/in/sub/a.txt", "v/in/Trip/x", "v/in/c.md"]
    requests = [(1, "Trip", "v/in", ["v/in/a.txt", "v/in/none", "v/in/sub/a.txt"]), (2, "Trip", None, ["v/in/b.txt", "v/in/a.txt"]),
                (3, " a/b ", "v/out", ["v/in/c.md", "v/in/c.md"]), (4, "x", None, [])]
    df = group_files(spark.createDataFrame([(p,) for p in files], "path string"),
                     spark.createDataFrame(requests, "seq long, folder_name string, source_dir string, paths array<string>"))
    got = sorted(((r.seq, r.src, r.dst, r.status) for r in df.collect()), key=str)
    assert got == sorted([
        (1, "v/in/a.txt", "v/in/Trip_1/a.txt", "moved"), (1, "v/in/none", None, "error"), (1, "v/in/sub/a.txt", "v/in/Trip_1/a_1.txt", "moved"),
        (2, "v/in/b.txt", "v/in/Trip_2/b.txt", "moved"), (2, "v/in/a.txt", None, "error"),
        (3, "v/in/c.md", "v/out/a_b/c.md", "moved"), (3, "v/in/c.md", None, "error"), (4, None, None, "error")], key=str)


def test_path_audit_decodes_around_malformed_escapes(spark):
    from urllib.parse import unquote
    raw = ["%2e%2e/%zz", "a/%2e%2e/b%", "a/%", "%e4%b8%ad/x", "a%ffb", "a%2", "100%/x", "%2e%2e%2f%%", "x%25y", "a+b%20c", ""]
    df = spark.createDataFrame([(r,) for r in raw], "p string")
    safe, norm = path_audit(F.col("p"))
    for r in df.select("p", safe.alias("s"), norm.alias("n")).collect():
        parts = unquote(r.p).replace("\x00", "").lstrip("/").split("/")
        kept = [p for p in parts if p not in ("", ".")]
        want = not any(p == ".." or p.startswith("~") for p in parts) and bool(kept)
        assert (r.s, r.n) == (want, "/".join(kept) if want else None), r.p


def test_new_keyword_ids_are_unique(spark):
    from shelfspark.operators.dictionary import keyword_frame, seed_categories
    from shelfspark.operators.learn import apply_corrections
    cats = seed_categories(spark)
    kws = keyword_frame(spark, [("study", "exam", "en", 1.0, "seed")])
    corr = spark.createDataFrame([(i, "f", "memo", "study", [f"word{i}", "exam", f"other{i % 3}", "hot"]) for i in range(20)],
                                 "seq long, filepath string, from_category string, to_category string, keywords array<string>")
    for bound in (200_000, 4):
        out = apply_corrections(kws, cats, corr, max_events_per_key=bound).orderBy("kw_id").collect()
        ids = [r.kw_id for r in out]
        assert ids == list(range(len(ids))) and out[0].keyword == "exam"
        order = [r.keyword for r in out if r.category_id == "study" and r.keyword.startswith("word")]
        assert order == [f"word{i}" for i in range(20)]
