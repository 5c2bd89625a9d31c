"""Connected components by alternating large and small stars, as aggregates and joins.

A vertex with very many neighbours is no large group in one task: the smallest neighbour is a
partial aggregate, and the join back is one that Spark splits. Every round's edges are written
to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: neighbours greater than u are tied to u's smallest neighbour. Small: neighbours
    smaller than u, and u, are tied to the smallest of them. Edges (u, v) with u > v."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = (edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionAll(least.select("u", F.col("m").alias("v"))))
    return out.where("u != v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component): every vertex of an edge, with the smallest vertex it reaches."""
    e = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    seen = None
    while True:
        e = cut_lineage(_star(_star(e, True), False), "edges")
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return (e.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
            .unionAll(e.select(F.col("v").alias("vertex"), F.col("v").alias("component"))).distinct())
