import zlib

from shelfspark.llm.sharding import query, shard_by_bytes
from tests.conftest import SF_SMALL
from tests.llm.util import LONG, docs, rows


def _brute(pairs, shards):
    line = sorted((i is not None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in pairs)
    total, at, out, count = sum(x[2] for x in line), 0, [], {}
    for has, i, size, crc in line:
        shard = min(shards - 1, (2 * at + size) * shards // (2 * total))
        out.append((i if has else None, size, crc, shard, count.get(shard, 0)))
        count[shard] = count.get(shard, 0) + 1
        at += size
    return sorted(out, key=str)


def _got(df):
    return sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in rows(df)), key=str)


def test_small_cases(spark):
    texts = ["a" * (i % 7 * 10) for i in range(60)] + [None, "", LONG, "é", "same", "same"]
    ids = [*range(60), 60, 61, None, None, 7, 7]
    got = _got(shard_by_bytes(docs(spark, texts, ids), shards=5))
    assert got == _brute(list(zip(ids, texts)), 5)


def test_empty(spark):
    assert rows(shard_by_bytes(docs(spark, []))) == []


def test_whole_table(spark):
    pairs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    df = query(spark, SF_SMALL)
    assert _got(df) == _brute(pairs, 40)
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in rows(df))
