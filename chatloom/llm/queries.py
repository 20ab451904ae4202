"""The queries of this subpackage for __spark_entry__.py: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversation_repair import damaged, structure
from .decontaminate import benchmark_hits, judged
from .hard_negatives import hard_negatives, labelled
from .line_dedup import drop_common_lines
from .lm_scoring import cross_entropy_difference
from .packing import pack
from .piece_encoding import decoded, encoded
from .pii import KINDS, by_kind, joined, of_kind, personal_data
from .quality_classifier import fit, scored
from .simhash_dedup import near_duplicates
from .substring_dedup import remove_repeated_passages
from .topk_search import top_k
from .warc_archive import archived


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_passages(table(spark, sf_dir, "documents"), window=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_common_lines(table(spark, sf_dir, "documents"), min_documents=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    def told(items: Column) -> dict[str, Column]:
        return {"n_items": F.size(items).cast("long"), "items_sha256": F.sha2(F.array_join(items, ","), 256)}

    hits = judged(benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, told=told), share=20)
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), every=100, k=10, scale=1024)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(by_kind("base", "added")).alias("spans"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"), min_bytes=1000)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return structure(damaged(conversations), conversations)


def op12_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decoded(encoded(table(spark, sf_dir, "documents")))
    n = (F.octet_length("ids") / 4).cast("long")
    return both.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(labelled(table(spark, sf_dir, "embeddings"), every=7), every=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_topk_search": op5_topk_search,
    "op6_pii": op6_pii,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_warc_archive": op8_warc_archive,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_decontaminate": op10_decontaminate,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_piece_encoding": op12_piece_encoding,
    "op13_hard_negatives": op13_hard_negatives,
}
