"""The corpus pipeline: five stages over ``documents``, each one of the operators.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet below the shared scratch folder and the next stage reads it.
Rows with a null id are documents like others. A null, empty or blank text has no
words, so the quality rules reject it; the later stages keep it. Equal rows are
copies: the near-duplicate stage keeps one. An empty table stays empty, and other
columns are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablehaul.llm import bpe, decontaminate, line_chunks, near_dup, quality
from tablehaul.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy rejects go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks and passages leave the texts; a document that had text and has no word left goes."""
    done = line_chunks.dedup_passages(docs)
    kept = done.where((F.col("chunks") == 0) | F.col("text").rlike(r"[^ \t-\r]"))
    length = F.when(F.col("chunks") > 0, F.length("text").cast("long")).otherwise(F.col("rest.n_chars"))
    fields = {"doc_id": F.col("id"), "text": F.col("text"), "n_chars": length}
    return kept.select(*[(fields[c] if c in fields else F.col("rest")[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of every text, with digests of the ids and of the text decoded from them."""
    return bpe.encode_corpus(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("bpe encoding", encoding),
]

#: Signatures and tokenizers can't be written in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = scratch_path(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{i}")
        docs = spark.read.parquet(f"{root}/{i}")
    return docs
