"""The numbered queries: each applies one operator to its whole table and derives the stated columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comboscore.llm import (decontaminate, html_extract, ngram_join, packing, phrases, pii, prefix_trie, quality, secrets,
                            substring_dedup, suffix_dedup, token_output, toxicity)
from comboscore.llm.oracle import ORACLE_SQL  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sha(column) -> F.Column:
    return F.sha2(column, 256)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", sha("base_spans").alias("base_sha256"), "spans", "scores")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_extract.extract_text(table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.drop_repeated_words(table(spark, sf_dir, "documents"), window=50)
    return kept.select("doc_id", "n_words", "n_removed", sha("kept_text").alias("kept_sha256"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, slack=20)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        sha(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
                        F.size("near_items").cast("long").alias("n_near_items"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.drop_repeated_bytes(table(spark, sf_dir, "documents"), length=400)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", sha("kept").alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.pack_ids(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_classes(table(spark, sf_dir, "documents"), n=5, threshold=(80, 100)).drop("text_key")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), every=5, heads=9)
    return nodes.drop("a", "b", "pa", "pb")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.summary(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", sha("base_spans").alias("base_sha256"), "spans")


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_html_extract, op3_substring_dedup, op4_decontaminate, op5_suffix_dedup,
                            op6_quality, op7_token_output, op8_ngram_join, op9_packing, op10_toxicity, op11_prefix_trie, op12_secret_scan,
                            op13_phrase_mining)}
