import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm.ann import nearest, query
from tests.conftest import SF_CHECK
from tests.llm.util import rows

SCHEMA = "vec_id long, embedding array<float>, g long, t int, vec string"


def _table(spark, pairs):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "x")
                                  for i, v in pairs], SCHEMA)


def _brute(pairs, asks, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in pairs
          if i is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in ok:
        if asks(q):
            near = sorted((-float((x * y).sum()), i) for i, y in ok if i != q and len(y) == len(x))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def _got(df):
    out = {}
    for r in sorted(rows(df), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("blocks", [(8192, 4096), (7, 3)])
def test_all_cells_probed_is_exact(spark, blocks):
    rng = np.random.default_rng(1)
    pairs = [(i, rng.integers(-3, 4, 8)) for i in range(80)]
    pairs += [(100 + i, [1, 0, 0, 0, 0, 0, 0, 0]) for i in range(40)]  # a repeated vector
    pairs += [(200, [30.0] * 8), (210, [1e-4] * 8), (211, [1, 2, 3]), (212, [3, 2, 1]), (220, None), (230, []), (240, [0] * 8),
              (250, [1, None] + [0] * 6), (260, [float("nan")] + [1] * 7), (270, [float("inf")] + [1] * 7), (None, [1] * 8)]
    got = _got(nearest(_table(spark, pairs), F.col("vec_id") % 10 == 0, k=5, tables=2, probes=16, block_vectors=blocks[0],
                       block_queries=blocks[1]))
    want = _brute(pairs, lambda i: i % 10 == 0, 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12, atol=1e-12)


def test_only_the_own_row_is_left_out(spark):
    """Rows that repeat the query's identifier, with its vector or another, are candidates; repeated
    queries are answered one by one."""
    pairs = [(20, [1, 0]), (20, [0.5, 1]), (20, [1, 0]), (7, [0.25, 0])]
    got = sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(nearest(_table(spark, pairs), F.col("vec_id") % 10 == 0, k=5))))
    one = [(20, 1, 20, 1.0), (20, 2, 20, 0.5), (20, 3, 7, 0.25)]
    assert got == sorted([*one, *one, (20, 1, 20, 0.5), (20, 2, 20, 0.5), (20, 3, 7, 0.125)])


def test_few_and_none(spark):
    assert _got(nearest(_table(spark, []), F.col("vec_id") % 10 == 0)) == {}
    assert _got(nearest(_table(spark, [(0, [1, 2]), (1, [2, 1])]), F.col("vec_id") % 10 == 0)) == {0: [(1, 4.0)]}


def test_recall(spark):
    pairs = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_CHECK}/embeddings.parquet").collect()]
    got, want = _got(query(spark, SF_CHECK)), _brute(pairs, lambda i: i % 20 == 0, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found / sum(map(len, want.values())) >= 0.93


@pytest.mark.parametrize("blocks", [(8192, 4096), (7, 3)])
def test_few_vectors_in_the_probed_cells_are_completed(spark, blocks):
    vecs = [r["embedding"] for r in spark.read.parquet(f"{SF_CHECK}/embeddings.parquet").orderBy("vec_id").limit(15).collect()]
    pairs = list(enumerate(vecs)) + [(20, [1, 2, 3]), (40, [3, 2, 1])]
    got = _got(nearest(_table(spark, pairs), F.col("vec_id") % 5 == 0, block_vectors=blocks[0], block_queries=blocks[1]))
    want = _brute(pairs, lambda i: i % 5 == 0, 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert [len(got[q]) for q in (0, 5, 10, 20, 40)] == [14, 14, 14, 1, 1]


def test_query_opposite_a_cluster(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=64)
    pairs = [(i, centre + 0.01 * rng.normal(size=64)) for i in range(1, 301)] + [(1000, -centre)]
    got, want = (f(pairs) for f in (lambda p: _got(nearest(_table(spark, p), F.col("vec_id") % 1000 == 0)),
                                    lambda p: _brute(p, lambda i: i == 1000, 20)))
    assert got.keys() == want.keys() and len(got[1000]) == 20
    assert [i for i, _ in got[1000]] == [i for i, _ in want[1000]]


def test_recall_of_widely_differing_norms(spark):
    rng = np.random.default_rng(5)
    vecs = [r["embedding"] for r in spark.read.parquet(f"{SF_CHECK}/embeddings.parquet").orderBy("vec_id").collect()]
    pairs = [(i, np.array(v) * np.exp(1.5 * rng.normal())) for i, v in enumerate(vecs)]
    got, want = _got(nearest(_table(spark, pairs), F.col("vec_id") % 20 == 0)), _brute(pairs, lambda i: i % 20 == 0, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found / sum(map(len, want.values())) >= 0.95
