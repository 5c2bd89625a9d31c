"""Operator 9: nearest neighbours by cross-polytope hashing.

A fast pseudo-rotation (three rounds of random signs and a Hadamard transform) turns each unit
vector; its nearest signed axis is its cell. Every table has its own rotation and holds every
vector; a query looks into the cells of its ``probes`` nearest signed axes in each table. All
vectors of those cells are scored exactly on the original components.

Equal vectors are found first and stand once in the tables, with their k + 1 smallest
identifiers, so a vector that a third of the rows repeat is no hot cell. Large cells are cut
into blocks of vectors times blocks of queries: every block is scored, none is dropped, and a
task holds one pair of blocks. A query whose cells hold fewer than k rows is scored against
every vector of its dimension, in the same blocks. Vectors of clearly different norms (a factor of 2^(1/4)) have
tables of their own, as the axes only see directions, and so have other dimensions. A long
vector scores high at a wide angle too, so the axes probed grow with the norm: ``probes`` up
to the dimension's median scale, and times the ratio to it above. A scale of which all axes
would be probed, or that has no more vectors than a query has cells there, is a single cell.

Recall against brute force at the default parameters is measured in tests/llm/test_ann.py.

Cases: vectors that are null, zero or hold null or non-finite components, and rows without
identifier, take no part; equal scores go to the smaller identifier; of a repeated identifier
every row takes part, and a query leaves out its own row only; fewer than k candidates give all; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import read
from shelfspark.session import cut_lineage

TABLES = 8
PROBES = 16
SEED = 20
#: Vectors and queries of a cell that one task scores against each other.
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 4096


def rotate(x: np.ndarray, seed: int, rounds: int = 3) -> np.ndarray:
    """Pseudo-rotation of the rows, padded with zeros to a power of two."""
    d = 1 << max(0, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        x = x * rng.choice([-1.0, 1.0], d)
        h = 1
        while h < d:
            pairs = x.reshape(len(x), -1, 2, h)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), d)
            h *= 2
        x /= np.sqrt(d)
    return x


def axes(x: np.ndarray, seed: int, count: int) -> np.ndarray:
    """The ``count`` nearest signed axes of each row, nearest first."""
    r = rotate(x / np.linalg.norm(x, axis=1, keepdims=True), seed)
    both = np.concatenate([r, -r], axis=1)
    count = min(count, both.shape[1])
    if count == 1:
        return both.argmax(axis=1)[:, None]
    return np.argsort(-both, axis=1, kind="stable")[:, :count]


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _cells(tables: int, count: int, seed: int, with_nth: bool = False):
    """Rows of (g, dim, vec) to rows of (cell, g, vec), one for each table and probe; ``with_nth``
    adds the axis's place among the nearest, from 0."""
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = _matrix(part.column("vec"))
                for t in range(tables):
                    near = axes(x, seed + t, count)
                    for p in range(near.shape[1]):
                        columns = [pa.array(np.full(part.num_rows, t, np.int32)), pa.array(near[:, p].astype(np.int32)),
                                   part.column("dim"), part.column("scale"), part.column("g"), part.column("vec")]
                        names = ["t", "axis", "dim", "scale", "g", "vec"]
                        if with_nth:
                            columns.append(pa.array(np.full(part.num_rows, p, np.int32)))
                            names.append("nth")
                        yield pa.RecordBatch.from_arrays(columns, names)
    return run


def _score(k: int):
    """Exact scores of a block of queries against a block of vectors; the k best of each query."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            x, g = _matrix(left.column("vec")), left.column("g").to_numpy()
            order = np.argsort(g, kind="stable")
            x, g = x[order], g[order]
            q, qg = _matrix(right.column("vec")), right.column("g").to_numpy()
            for at in range(0, len(q), 256):
                rough = q[at:at + 256] @ x.T
                least = np.partition(rough, -k, axis=1)[:, -k] if len(x) > k else np.full(len(rough), -np.inf)
                row, col = np.nonzero(rough >= (least - 1e-9 * (1 + np.abs(least)))[:, None])
                score = (q[at + row] * x[col]).sum(axis=1)  # the same sum wherever the pair meets
                best = np.lexsort((col, -score, row))
                row, col, score = row[best], col[best], score[best]
                first = np.searchsorted(row, np.arange(len(rough)))
                top = np.arange(len(row)) - first[row] < k
                found.append((qg[at + row[top]], g[col[top]], score[top]))
        a, b, s = (np.concatenate(c) for c in zip(*found))
        return pa.table({"qg": pa.array(a, pa.int64()), "g": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})
    return run


def _pairs(index: DataFrame, probe: DataFrame, cell: list[str], k: int, block_vectors: int, block_queries: int) -> DataFrame:
    """Rows (qg, g, score) of the best vectors (cell, g, vec) of each query (cell, g, vec) in every
    block of its cells."""
    # blocks of each cell; the counts are a row for each cell
    sizes = index.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / block_vectors).cast("int").alias("vector_blocks"))
    asks = probe.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / block_queries).cast("int").alias("query_blocks"))
    b = F.broadcast(cut_lineage(sizes.join(asks, cell), "vector-blocks"))
    index = (index.join(b, cell).withColumn("x", F.pmod(F.xxhash64("g"), F.col("vector_blocks")).cast("int"))
             .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))))
    probe = (probe.join(b, cell).withColumn("y", F.pmod(F.xxhash64("g"), F.col("query_blocks")).cast("int"))
             .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("vector_blocks") - 1))))
    key = [*cell, "x", "y"]
    return (index.select(*key, "g", "vec").groupBy(*key).cogroup(probe.select(*key, "g", "vec").groupBy(*key))
            .applyInArrow(_score(k + 1), "qg long, g long, score double"))


def _ranked(pairs: DataFrame, groups: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """ask, query_id, rank, vec_id, score of the k best rows of each row of ``asked``, its own left out: of
    rows with its identifier and its vector one is its own."""
    best = Window.partitionBy("qg").orderBy(F.desc("score"), "id")
    hits = (pairs.groupBy("qg", "g").agg(F.max("score").alias("score"))
            .join(groups.select("g", "ids"), "g").select("qg", "g", "score", "ids", F.posexplode("ids").alias("at", "id"))
            .withColumn("once", F.array_position("ids", F.col("id")) == F.col("at") + 1).drop("ids", "at")
            .withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth"))
    return (asked.join(hits, "qg").where("not (g = qg and id = query_id and once)")
            .withColumn("rank", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "id")))
            .where(F.col("rank") <= k).select("ask", "query_id", "rank", F.col("id").alias("vec_id"), "score"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, probes: int = PROBES,
            seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding", block_vectors: int = BLOCK_VECTORS,
            block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (inner product) of the ``k`` nearest found to
    each row that ``is_query`` (a condition on the input's columns) selects."""
    v = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), is_query.alias("asks"))
         .where("id is not null and vec is not null and size(vec) > 0")
         .where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
         .where(F.exists("vec", lambda x: x != 0)))
    # the group limit of this window works before the shuffle
    few = (v.withColumn("nth", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("nth") <= k + 1))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    groups = cut_lineage(few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
                         .withColumn("dim", F.size("vec")).withColumn("scale", F.round(4 * F.log2(norm)).cast("int"))
                         .withColumn("g", F.monotonically_increasing_id()), "vector-groups")
    asked = cut_lineage(v.where("asks").select("id", "vec").join(groups.select("vec", "g"), "vec").select(
        F.monotonically_increasing_id().alias("ask"), F.col("id").alias("query_id"), F.col("g").alias("qg")), "vector-queries")
    cell = ["t", "axis", "dim", "scale"]
    shape = "t int, axis int, dim int, scale int, g long, vec " + groups.schema["vec"].dataType.simpleString()
    # by powers of 2^(1/4): a bounded number; the scale that half of a dimension's vectors do not exceed asks for ``probes`` axes
    scales = groups.groupBy("dim", "scale").agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy("dim")
    upto = one.orderBy("scale").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scales = (scales.withColumn("middle", 2 * F.sum("n").over(upto) >= F.sum("n").over(one))
              .withColumn("median", F.min(F.when(F.col("middle"), F.col("scale"))).over(one))
              .withColumn("reach", F.ceil(probes * F.pow(F.lit(2.0), F.greatest(F.col("scale") - F.col("median"), F.lit(0)) / 4)))
              .withColumn("whole", (F.col("reach") >= 2 * F.col("dim")) | (F.col("n") <= tables * F.col("reach"))))
    scales = cut_lineage(scales.select("dim", "scale", "reach", "whole"), "vector-scales")
    furthest = scales.where("not whole").agg(F.max("reach")).first()[0] or probes
    near, whole = F.broadcast(scales.where("not whole").drop("whole")), F.broadcast(scales.where("whole").drop("whole"))

    def single(rows):
        return rows.select(F.lit(-1).alias("t"), F.lit(-1).alias("axis"), "dim", "scale", "g", "vec")

    index = (groups.join(near, ["dim", "scale"]).select("g", "dim", "scale", "vec").mapInArrow(_cells(tables, 1, seed), shape)
             .unionByName(single(groups.join(whole, ["dim", "scale"]))))
    asking = groups.join(asked.select(F.col("qg").alias("g")).distinct(), "g", "left_semi").select("g", "dim", "scale", "vec")
    probe = (asking.mapInArrow(_cells(tables, int(furthest), seed, with_nth=True), f"{shape}, nth int").drop("scale")
             .join(near, "dim").where("nth < reach").drop("nth", "reach")
             .unionByName(single(asking.drop("scale").join(whole, "dim"))))
    found = cut_lineage(_ranked(_pairs(index, probe, cell, k, block_vectors, block_queries), groups, asked, k), "vector-neighbours")
    # queries whose cells held fewer than k are scored against every vector of their dimension
    short = cut_lineage(asked.join(found.groupBy("ask").agg(F.count(F.lit(1)).alias("n")), "ask", "left")
                        .where("coalesce(n, 0) < %d" % k).select(*asked.columns), "vector-short-queries")
    if short.isEmpty():
        return found.drop("ask")
    every = groups.select("dim", "g", "vec")
    wide = cut_lineage(every.join(short.select(F.col("qg").alias("g")).distinct(), "g", "left_semi").select("dim", "g", "vec"),
                       "vector-wide-queries")
    full = _ranked(_pairs(every, wide, ["dim"], k, block_vectors, block_queries), groups, short, k)
    return found.join(short, "ask", "left_anti").select(*full.columns).unionByName(full).drop("ask")


#: The stated query set of the search: every twentieth identifier.
QUERY_STEP = 20


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)
