import hashlib

import pytest

from shelfspark.llm.byte_bpe import encode_decode, pattern, query, rank_file, ranks_of
from tests.conftest import SF_SMALL
from tests.llm.util import LONG, docs, rows


def _brute(pairs):
    import tiktoken
    enc = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=ranks_of(rank_file()), special_tokens={})
    out = []
    for i, t in pairs:
        ids = enc.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def _got(df):
    return sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(df)), key=str)


TEXTS = [None, "", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "a\n\n\nb c", "tab\tx \t y", "it's WE'LL 've x'", "a b   c ",
         "日本語 テキスト 🙂👍🏽", "été ß ÜBER", "\x00 \x1c x\x1cy", "1234 56,78 !!! ... a_b", LONG, LONG.replace(" ", "　"),
         "same words here", "same words here", "x" * 5000, "<|endoftext|>"]


@pytest.mark.parametrize("bucket_bytes", [8 << 20, 5000])
def test_cases(spark, bucket_bytes):
    ids = [*range(len(TEXTS) - 2), None, 3]
    assert _got(encode_decode(docs(spark, TEXTS, ids), rank_file(), pattern(), bucket_bytes=bucket_bytes)) == _brute(zip(ids, TEXTS))


def test_empty(spark):
    assert rows(encode_decode(docs(spark, []), rank_file(), pattern())) == []


def test_whole_table(spark):
    pairs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert _got(query(spark, SF_SMALL)) == _brute(pairs)
