"""Corpus pipeline: toxicity, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame;
all but the last return the columns of ``documents``. Helper columns get a prefix that no
input column begins with, so extra columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from comboscore.llm import decontaminate, ngram_join, packing, pii, toxicity
from comboscore.llm.queries import table
from comboscore.session import cut_lineage


def _prefix(docs: DataFrame) -> str:
    prefix = "stage_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return prefix


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go."""
    score = _prefix(docs) + "score"
    scored = toxicity.with_score(docs, table(spark, sf_dir, "labels"), score)
    return scored.where(F.col(score) < 0.5).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the smallest doc_id stays.

    Documents without words are in no class and stay; of rows that agree in doc_id and text one
    stays; a class without any doc_id keeps its rows.
    """
    p = _prefix(docs)
    classes = ngram_join.join_classes(docs.select("doc_id", "text"))
    stays = (F.col("n_shingles") == 0) | F.col("component_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))
    keep = (classes.where(stays).groupBy("doc_id", "text_key").agg(F.max("n_shingles").alias("n"))
            .select(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), "text_key").alias(p + "row"),
                    F.col("n").alias(p + "n")))
    rows = docs.withColumn(p + "row", F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")),
                                                 F.col("doc_id").isNull(), F.xxhash64("text")))
    same = Window.partitionBy(p + "row", "doc_id").orderBy(F.col(p + "n"))
    rows = rows.join(keep, p + "row").withColumn(p + "rank", F.row_number().over(same))
    return rows.where((F.col(p + "n") == 0) | (F.col(p + "rank") == 1)).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    p = _prefix(docs)
    found = decontaminate.with_items(docs, table(spark, sf_dir, "benchmark"), p)
    return found.where(F.col(p + "n_hit") == 0).select(docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets; n_chars follows the new text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of 2048 token ids."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_near_duplicates), ("decontaminate", drop_contaminated),
          ("pii", redact_pii), ("packing", pack_tokens)]
# A trained classifier decides the first stage, so SQL cannot express the rows of run();
# tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
