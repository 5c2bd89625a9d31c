"""Batch / stream equivalence."""

from pyspark.sql import functions as F

from shelfspark import fixtures as X
from shelfspark.operators.learn import apply_corrections
from shelfspark.streaming import jobs as J
from tests.conftest import SF_SMALL


def _same(a, b):
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_stream_ingest_equals_batch(spark):
    from shelfspark.operators.classify import route
    s = J.stream_ingest(spark, SF_SMALL).select("file_id", "category", "confidence", "routed_to")
    b = route(X.classified_files(spark, SF_SMALL)).select("file_id", "category", "confidence", "routed_to")
    _same(s, b)


def test_stream_corrections_equals_batch(spark):
    cats, kws = X.dictionary(spark)
    b = apply_corrections(kws, cats, X.corrections(spark, SF_SMALL)).select("category_id", "keyword", "locale",
                                                                            "weight", "source")
    s = J.stream_corrections(spark, SF_SMALL).select("category_id", "keyword", "locale", "weight", "source")
    _same(s, b)


def test_stream_throttle_equals_batch(spark):
    b = J.throttle_batch(X.attempts(spark, SF_SMALL), 5, 86400)
    s = J.stream_throttle(spark, SF_SMALL, 5, 86400)
    _same(s.select("key", "event_id", "allowed", "remaining"), b.select("key", "event_id", "allowed", "remaining"))


def test_access_counts_equal_batch(spark):
    from shelfspark.operators.catalog import access_rollup
    s = J.stream_access_counts(spark, SF_SMALL).select("file_path", "views", "last_view")
    b = access_rollup(X.access_log(spark, SF_SMALL)).select("file_path", "views", "last_view")
    _same(s, b)


def test_windows_close_with_watermark(spark):
    w = J.access_windows(spark, SF_SMALL)
    mx = X.access_log(spark, SF_SMALL).agg(F.max("accessed_at")).collect()[0][0]
    assert w.count() > 0
    assert all(r.window_end <= mx for r in w.select("window_end").collect())


def _split(folder, name, parts, order):
    """The table of sf0.001 as several files, in order; returns a function that adds the next."""
    import pandas as pd
    df = pd.read_parquet(f"{SF_SMALL}/{name}.parquet").sort_values(order, ignore_index=True)
    cuts = [len(df) * i // parts for i in range(parts + 1)]

    def add(i):
        df.iloc[cuts[i]:cuts[i + 1]].to_parquet(f"{folder}/{name}-{i}.parquet", coerce_timestamps="us")
    return add


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_streams_resume_after_a_restart(spark, tmp_path):
    """One file, then the driver's session is left and another goes on with the other files."""
    import shutil
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("documents",):
        shutil.copy(f"{SF_SMALL}/{name}.parquet", folder / f"{name}.parquet")
    events, labels = _split(folder, "events", 3, ["ts", "event_id"]), _split(folder, "labels", 3, ["doc_id"])
    jobs = {
        "counts": lambda s, **at: J.stream_access_counts(s, str(folder), max_files=1, **at),
        "learn": lambda s, **at: J.stream_corrections(s, str(folder), max_files=1, **at).select("category_id", "keyword", "locale", "weight", "source", "kw_id"),
        "throttle": lambda s, **at: J.stream_throttle(s, str(folder), 5, 86400, max_files=1, **at),
    }
    at = {k: {"checkpoint": str(tmp_path / f"{k}-ckpt"), "sink": str(tmp_path / f"{k}-out")} for k in jobs}
    events(0), labels(0)
    first = {k: _rows(job(spark, **at[k])) for k, job in jobs.items()}
    for i in (1, 2):
        events(i), labels(i)
    resumed = {k: _rows(job(spark.newSession(), **at[k])) for k, job in jobs.items()}
    whole = {k: _rows(job(spark)) for k, job in jobs.items()}
    for k in jobs:
        assert resumed[k] == whole[k] and first[k] != whole[k], k


def test_files_come_out_once_whatever_is_lost(spark, tmp_path):
    """A crash between the rows and the commit records, a lost checkpoint, files that come later."""
    import os

    import pytest
    inbox = tmp_path / "in"
    os.makedirs(inbox / "sub")
    add = lambda *names: [(inbox / n).write_text(f"exam note {n}\nexam") for n in names]
    add("a.txt", "sub/b.md", "c.bin", "broken.docx", ".hidden.txt", "sub/d.jpg")
    cats, kws = X.dictionary(spark)

    class Crash(Exception):
        pass

    def crash(batch_id):
        if batch_id == 1:
            raise Crash

    def ingest(checkpoint, **more):
        return J.stream_ingest_files(spark, str(inbox), cats, kws, checkpoint=str(tmp_path / checkpoint), sink=str(tmp_path / "out"), **more)

    def names(df):
        return sorted(r.path.rpartition("/")[2] for r in df.collect())

    with pytest.raises(Exception, match="Crash"):
        ingest("one", max_files=2, after_write=crash)
    every = ["a.txt", "b.md", "broken.docx", "c.bin", "d.jpg"]
    assert names(ingest("one", max_files=2)) == every
    add("sub/late.md")
    assert names(ingest("one")) == sorted([*every, "late.md"])
    add("e.txt")
    out = ingest("two", max_files=3)  # nothing is known to this checkpoint
    assert names(out) == sorted([*every, "e.txt", "late.md"])
    rows = {r.path.rpartition("/")[2]: r for r in out.collect()}
    assert rows["broken.docx"].error.startswith("DOCX extraction failed") and rows["a.txt"].keywords == ["exam", "note", "a.txt"]
    assert rows["d.jpg"].keywords == [] and rows["c.bin"].file_type == "unknown"
    assert names(ingest("three")) == names(out)


def test_empty_inbox(spark, tmp_path):
    cats, kws = X.dictionary(spark)
    (tmp_path / "in").mkdir()
    assert J.stream_ingest_files(spark, str(tmp_path / "in"), cats, kws).collect() == []


def test_ingest_lists_without_the_driver(spark, tmp_path, monkeypatch):
    """A stream's plan and source log name some parquet files of a listing, not the files of the inbox."""
    inbox = tmp_path / "in"
    inbox.mkdir()
    for i in range(60):
        (inbox / f"n{i}.txt").write_text(f"exam note {i}")
    read, cut = [], J.cut_lineage

    def spy(df, name="stage"):
        if name == "ingest-listing":
            read.append([f for f in df.inputFiles() if "/ledger/" not in f])
        return cut(df, name)

    monkeypatch.setattr(J, "cut_lineage", spy)
    cats, kws = X.dictionary(spark)
    at = {"checkpoint": str(tmp_path / "ckpt"), "sink": str(tmp_path / "out")}
    assert J.stream_ingest_files(spark, str(inbox), cats, kws, **at).count() == 60
    assert len(read) == 1 and len(read[0]) < 60 and not [f for f in read[0] if "/in/" in f]
    logs = [p for p in (tmp_path / "ckpt").rglob("sources/**/*") if p.is_file()]
    assert logs and not [p for p in logs if b"/in/n" in p.read_bytes()]


def test_inbox_files_are_those_of_sparks_source(spark, tmp_path):
    """Names, times and sizes as Spark's source gives them, so that commit records of either meet."""
    import os
    inbox = tmp_path / "in"
    names = ["a.txt", "sp ace.txt", "p%20c.md", "é#ü?.txt", "_h.txt", ".h.txt", "_k=v.txt", "_metadata_x.txt", "x._COPYING_", "sub/_hid/a.txt", "sub/_d=1/b.txt",
             "_metadata_d/d.txt", "_common_metadata", "sub/.dot/e.txt", "star*[1].txt", "brace{a,b}.txt", "back\\slash.txt", "noext"]
    for i, n in enumerate(names):
        (inbox / n).parent.mkdir(parents=True, exist_ok=True)
        (inbox / n).write_text("x" * (i + 1))
        os.utime(inbox / n, ns=(ns := 1_700_000_000_123_999_900 + i * 1_000_000_033, ns))
    (inbox / "empty.txt").write_text("")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "o.txt").write_text("o")
    os.symlink(tmp_path / "other", inbox / "linked")
    os.symlink(inbox / "a.txt", inbox / "link.txt")
    os.symlink(inbox / "missing", inbox / "dangling.txt")
    for at in (str(inbox), f"file://{inbox}/", str(inbox / "a.txt"), str(inbox / "*.txt"), str(inbox / "s*")):
        bodies = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(at).select("path", "modificationTime", "length")
        want = _rows(bodies)
        assert _rows(J.inbox_files(spark, at)) == want and want, at


def test_ingest_goes_on_from_any_listing(spark, tmp_path):
    """A listing left by a crash before the stream began, files that come late with an early time, a file filled later."""
    import os

    import pytest
    inbox = tmp_path / "in"
    inbox.mkdir()
    add = lambda *names: [(inbox / n).write_text(f"exam note {n}") for n in names]
    cats, kws = X.dictionary(spark)
    at = {"checkpoint": str(tmp_path / "ckpt"), "sink": str(tmp_path / "out")}
    ingest = lambda **more: sorted(r.path.rpartition("/")[2] for r in J.stream_ingest_files(spark, str(inbox), cats, kws, **at, **more).collect())
    add("a.txt", "b.txt", "c.txt")
    (inbox / "late.txt").write_text("")
    J.announce(spark, str(inbox), f"{at['checkpoint']}/listing", 2)
    add("d.txt", "e.txt")
    batches = []
    assert ingest(max_files=2, after_write=batches.append) == ["a.txt", "b.txt", "c.txt", "d.txt", "e.txt"]
    sizes = spark.read.parquet(f"{at['sink']}/ledger").groupBy("batch").count().collect()
    assert len(batches) == len(sizes) >= 3 and max(r["count"] for r in sizes) <= 2
    assert ingest() == ["a.txt", "b.txt", "c.txt", "d.txt", "e.txt"]
    add("late.txt", "old.txt")
    os.utime(inbox / "old.txt", (10**9, 10**9))
    assert ingest() == ["a.txt", "b.txt", "c.txt", "d.txt", "e.txt", "late.txt", "old.txt"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        J.stream_ingest_files(spark, str(tmp_path / "nothing"), cats, kws)


def test_ordered_throttle_takes_files_in_any_order(spark, tmp_path):
    """Files shuffled within the lateness; what the watermark has passed is answered as by the batch rule."""
    import random

    import pandas as pd
    rng = random.Random(3)
    base = pd.Timestamp("2024-01-01")
    at, rows = 0, []
    for i in range(400):
        at += rng.choice([0, 1, 5, 20, 200])
        rows.append((i, base + pd.Timedelta(seconds=at), rng.choice([1, 2, 3]), "x", 0.0, "{}"))
    df = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    folder = tmp_path / "in"
    folder.mkdir()
    parts = [df.iloc[i:i + 40] for i in range(0, 400, 40)]
    for k in range(0, 10, 2):  # neighbours come the wrong way round
        parts[k], parts[k + 1] = parts[k + 1], parts[k]
    path = {"checkpoint": str(tmp_path / "ckpt"), "sink": str(tmp_path / "out")}
    for i, part in enumerate(parts):
        part.sample(frac=1, random_state=i).to_parquet(folder / f"events-{i}.parquet", coerce_timestamps="us")
        if i in (4, 9):
            got = J.stream_throttle_ordered(spark, str(folder), 5, 60, max_files=1, lateness="4 hours", **path)
    batch = J.throttle_batch(spark.createDataFrame([(str(r[2]), r[0], r[1].to_pydatetime()) for r in rows], "key string, event_id long, ts timestamp_ntz"), 5, 60)
    end = max(df["ts"]) - pd.Timedelta(hours=4)
    want = sorted((r.key, r.event_id, r.ts, r.allowed, r.remaining) for r in batch.collect() if r.ts <= end)
    assert sorted(tuple(r) for r in got.collect()) == want and 50 < len(want) < 400
