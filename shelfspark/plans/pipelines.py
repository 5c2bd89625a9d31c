"""End-to-end compositions (E2E-1..3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark import constants as K
from shelfspark import fixtures as X
from shelfspark.operators.classify import annotate, classify_annotated, decide_table, prepare, route, score_tables
from shelfspark.operators.learn import apply_corrections
from shelfspark.plans.organize import organize_plan
from shelfspark.session import cut_lineage

#: Characters of the short description of SURVEY and the registered query (an opt-in).
DESCRIPTION_PREFIX = 120


def ingest_pipeline(spark: SparkSession, sf_dir: str, description_chars: int | None = None) -> DataFrame:
    """E2E-1: extract keywords -> classify with them -> route -> organise manifest ->
    auto-description (the text, or its first ``description_chars`` characters, + '。' + category).

    One pass over the texts gives keywords, dictionary rows and the description's text; its rows are
    written once. With ``description_chars`` no text is moved after that: classification, manifest and the
    final join see identifiers, paths, keyword lists and the short text."""
    cats, kws = X.dictionary(spark)
    text = F.col("extracted_text")
    files = X.keyword_files(spark, sf_dir).withColumn(
        "summary", text if description_chars is None else F.substring(text, 1, description_chars))
    carry = ("path", "keywords", "summary")
    rows, indexed = annotate(prepare(files, carry), cats, kws, carry)
    rows = cut_lineage(rows, "ingest-scan")
    routed = route(classify_annotated(rows, indexed, cats, kws)).select("file_id", "category", "confidence", "routed_to")
    done = cut_lineage(rows.select("file_id", *carry).join(routed, "file_id"), "ingest-routed")
    moves = done.select(F.col("file_id").alias("seq"), "path", F.col("routed_to").alias("category"))
    plan = organize_plan(rows.select("path"), moves).select(F.col("seq").alias("file_id"), "dst")
    desc = F.concat("summary", F.lit("。"), F.col("routed_to"))
    return (done.join(plan, "file_id")
            .select("file_id", "path", F.array_join("keywords", "|").alias("keywords"), "category", "confidence",
                    "routed_to", "dst", desc.alias("description")))


def reclassify_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2E-2: corrections -> new weights -> re-classify -> (before, after) counts.

    The texts are read once, for the scores by both dictionaries together."""
    cats, kws = X.dictionary(spark)
    learned = cut_lineage(apply_corrections(kws, cats, X.corrections(spark, sf_dir)), "learned-keywords")
    before, after = reclassify(X.keyword_files(spark, sf_dir), cats, kws, learned)
    return (before.select("file_id", F.col("category").alias("before"))
            .join(after.select("file_id", F.col("category").alias("after")), "file_id")
            .groupBy("before", "after").agg(F.count(F.lit(1)).alias("files")))


def reclassify(files: DataFrame, categories: DataFrame, old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classifications of ``files`` by two keyword tables over the same categories, without reasons. A learned table
    holds the words of the texts themselves and hits each text thousands of times, so the scan of the texts
    gives the scores of both tables, and no hits; its rows are written once."""
    scores = cut_lineage(score_tables(prepare(files), categories, [old, new]), "reclassify-scores")
    return decide_table(scores, 0, categories, old), decide_table(scores, 1, categories, new)


__all__ = ["ingest_pipeline", "reclassify_shift", "K"]
