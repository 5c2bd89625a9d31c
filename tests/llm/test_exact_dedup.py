import hashlib
from collections import defaultdict

import pytest

from shelfspark.llm.exact_dedup import LOWER, UPPER, exact_groups
from tests.llm.util import LONG, docs, rows

FOLD = str.maketrans(UPPER, LOWER)


def _check(pairs, got):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[(t or "").translate(FOLD)].append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    key = lambda x: tuple(map(str, x))
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=key) == sorted(want, key=key)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


@pytest.mark.parametrize("partitions", [1, 7])
def test_groups(spark, partitions):
    texts = [None, "", "Ab", "aB", "AB ", "É", "é", LONG, LONG.upper(), LONG + "x"] + ["Hot TEXT"] * 300 + [f"w{i % 9}" for i in range(50)]
    ids = [*range(len(texts))]
    ids[8] = -(1 << 63)  # the smallest identifier
    ids[3], ids[4], ids[20], ids[21], ids[22] = None, None, None, 19, 19
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _check(list(zip(ids, texts)), rows(exact_groups(docs(spark, texts, ids))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_smallest_identifier_over_several_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 5)
    try:
        ids = [-(1 << 63)] * 200 + [-(1 << 63) + 1] + [None] * 50
        _check([(i, "same") for i in ids], rows(exact_groups(docs(spark, ["same"] * len(ids), ids))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_groups_without_identifiers_and_empty(spark):
    _check([(None, "a"), (None, "A"), (None, "b")], rows(exact_groups(docs(spark, ["a", "A", "b"], [None] * 3))))
    assert rows(exact_groups(docs(spark, []))) == []
