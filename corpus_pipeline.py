"""The corpus pipeline: documents through the stages, each one's rows written as Parquet and read again for the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.common import staged
from chatloom.llm.decontaminate import benchmark_hits, judged
from chatloom.llm.line_dedup import drop_common_lines
from chatloom.llm.packing import pack
from chatloom.llm.quality_classifier import fit, scored
from chatloom.llm.simhash_dedup import one_of_each

#: SQL cannot express the trained classifier, the fingerprints or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def _bare(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one, so that no name of theirs meets an operator's own."""
    others = [x for x in docs.columns if x not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*[f"`{x}`" for x in others]).alias("other_columns")] if others else []))


def _like(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return rows.select(*[x if x in ("doc_id", "text") else F.col(f"other_columns.`{x}`").alias(x) for x in docs.columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    bare = _bare(docs)
    model = fit(bare, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _like(scored(bare, model, threshold=0.3, keep=tuple(bare.columns)).where("predicted = 1"), docs)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more have; n_chars, if there, is that of what is left."""
    bare = _bare(docs)
    kept = _like(drop_common_lines(bare, min_documents=10, min_chars=1, keep=tuple(bare.columns[2:])), docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of close fingerprints."""
    return _like(one_of_each(_bare(docs), shingle=4, distance=4), docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which passages of the benchmark make less than a twentieth."""
    bare = _bare(docs)
    hits = judged(benchmark_hits(bare, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13), share=20)
    gone = staged(hits.where("contaminated").select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key")).distinct(), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_key"))
    return _like(bare.join(gone, same, "left_anti"), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return pack(docs, capacity=1024, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good_quality),
    ("line_dedup", without_common_lines),
    ("simhash_dedup", one_of_near_duplicates),
    ("decontamination", decontaminated),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
