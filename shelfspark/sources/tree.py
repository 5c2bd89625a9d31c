"""Directory trees listed, read and written by tasks.

A tree is listed from a frontier of directories, round by round: each task lists its share of the
frontier and the directories it finds there, until it has listed ``BUDGET`` of them; what is then still
open is the next frontier. Every round is a written table, so the driver holds no path and a lost
executor costs one task of one round. The number of rounds follows the tree's size by the budget, and
its depth only where a level has fewer directories than that.

Tasks reach the store through ``pyarrow.fs`` (a shared mount, HDFS, S3 and the like), by the path or
URI they are given. Spark's own file index is not used, as it hides names that begin with '_'
(``_inbox``, ``_archive``, ``_sensitive``).
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfspark.session import cut_lineage

#: Directories that a task lists in a round.
BUDGET = 2000
#: Rows of a listing, and bytes of file bodies, that a task hands on at a time.
BATCH_ROWS, BATCH_BYTES = 10_000, 8 << 20

_ENTRIES = "path string, is_open boolean, size bigint, modified double, modified_ms bigint"
_SCHEMA = pa.schema([("path", pa.string()), ("is_open", pa.bool_()), ("size", pa.int64()), ("modified", pa.float64()), ("modified_ms", pa.int64())])


def plain_path(path: str) -> str:
    """A local path without its scheme ("file:/x" and "file:///x" as "/x"); other URIs as they are."""
    return re.sub(r"^file:/*", "/", path)


def _store(path: str):
    """(file system, the path in it, what stands before it in a URI)."""
    from pyarrow import fs
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", path):
        system, inner = fs.FileSystem.from_uri(path)
        return system, inner, path[:len(path) - len(inner)] if path.endswith(inner) else ""
    return fs.LocalFileSystem(), path, ""


def _hidden(name: str) -> bool:
    return name.startswith(".")


def hidden_from_spark(name: str) -> bool:
    """Whether Spark's file sources pass over a file or a directory of this name as they list."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _expand(budget: int, recursive: bool, hidden=_hidden):
    """mapInArrow over (path) of open directories: their files, and directories that are left open."""
    def run(batches):
        from collections import deque

        from pyarrow import fs
        rows: list[tuple] = []
        todo = deque(p for batch in batches for p in batch.column("path").to_pylist())
        listed = 0
        while todo:
            directory = todo.popleft()
            if listed >= budget:
                rows.append((directory, True, None, None, None))
            else:
                listed += 1
                system, inner, before = _store(directory)
                for found in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
                    if hidden(found.base_name):
                        continue
                    if found.type == fs.FileType.Directory:
                        if recursive:
                            todo.append(before + found.path)
                    else:
                        ns = found.mtime_ns or 0
                        rows.append((before + found.path, False, found.size, ns / 1e9, ns // 1_000_000))
            while len(rows) >= BATCH_ROWS:
                yield _batch(rows[:BATCH_ROWS])
                rows = rows[BATCH_ROWS:]
        if rows:
            yield _batch(rows)
    return run


def _batch(rows):
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)


def walk(spark: SparkSession, root: str | list[str], recursive: bool = True, budget: int = BUDGET, hidden=_hidden) -> DataFrame:
    """(path, size, modified: epoch seconds, modified_ms: whole milliseconds) of every file below ``root`` (or several)
    whose name, and whose directories' names below ``root``, are not ``hidden``: do not begin with '.'. A missing
    directory has no files."""
    slots = spark.sparkContext.defaultParallelism
    roots = [root] if isinstance(root, str) else root
    frontier, open_, found = spark.createDataFrame([(plain_path(r).rstrip("/") or "/",) for r in roots], "path string"), len(roots), None
    while open_:
        tasks = min(open_, max(slots, open_ // budget))
        entries = cut_lineage(frontier.repartition(tasks, F.xxhash64("path")).mapInArrow(_expand(budget, recursive, hidden), _ENTRIES), "tree")
        files = entries.where("not is_open").drop("is_open")
        found = files if found is None else found.unionByName(files)
        frontier = entries.where("is_open").select("path")
        open_ = frontier.count()
    return found


def is_directory(spark: SparkSession, root: str) -> bool:
    """Whether a task finds a directory there."""
    def look(batches):
        from pyarrow import fs
        for batch in batches:
            system, inner, _ = _store(batch.column("path")[0].as_py())
            yield pa.record_batch({"found": [system.get_file_info(inner).type == fs.FileType.Directory]})
    return spark.createDataFrame([(plain_path(root),)], "path string").coalesce(1).mapInArrow(look, "found boolean").first()[0]


def with_content(files: DataFrame, wanted, convert=None) -> DataFrame:
    """The rows of ``files`` (path, size and others) with ``content`` (bytes), ``text`` and ``error``.

    Only the bytes of rows that meet ``wanted`` (a condition) are read. ``convert(row, bytes)`` may turn them into
    (text, error) in the task; where it gives None the bytes are handed on. A file that cannot be read
    is an error row. A task holds some MB of bodies at a time, and a longer one by itself."""
    schema = StructType(list(files.schema.fields)).add("content", "binary").add("text", "string").add("error", "string")
    names = files.columns

    def one(row):
        try:
            system, inner, _ = _store(row["path"])
            with system.open_input_stream(inner, compression=None) as f:
                data = f.read()
        except OSError as e:
            return None, "", f"Cannot read file: {type(e).__name__}"
        done = convert(row, data) if convert else None
        return (data, None, None) if done is None else (None, *done)

    def run(batches):
        for batch in batches:
            at, held, out = 0, 0, []
            for i, row in enumerate(batch.select(names).to_pylist()):
                out.append(one(row) if batch.column("_wanted")[i].as_py() else (None, None, None))
                held += len(out[-1][0] or b"") + len(out[-1][1] or "")
                if held >= BATCH_BYTES:
                    yield _beside(batch.select(names).slice(at, len(out)), out)
                    at, held, out = i + 1, 0, []
            if out:
                yield _beside(batch.select(names).slice(at, len(out)), out)

    return files.withColumn("_wanted", F.coalesce(wanted, F.lit(False))).mapInArrow(run, schema)


def _beside(batch, out):
    more = [pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.string(), pa.string()))]
    return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "content", "text", "error"])


def write_files(files: DataFrame) -> int:
    """Write (path, content) rows as files, directories included; the number of files. A repeated
    task writes the same files again."""
    def run(batches):
        made = ""  # the directory made last
        for batch in batches:
            for path, body in zip(batch.column("path").to_pylist(), batch.column("content")):
                content = body.as_py()  # one body at a time
                system, inner, _ = _store(path)
                if made != (made := path.rpartition("/")[0]):
                    system.create_dir(inner.rpartition("/")[0], recursive=True)
                with system.open_output_stream(inner, compression=None) as f:
                    f.write(content or b"")
            yield pa.record_batch({"n": pa.array([batch.num_rows], pa.int64())})

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0
