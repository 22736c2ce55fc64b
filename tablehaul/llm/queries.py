"""The registered queries over these operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablehaul.llm import bpe, brown_lm, decontaminate, hosts, line_chunks, near_dup, pii, prefix_trie, quality, revisits, secrets, simhash, sql, vector_codes
from tablehaul.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op3_host_reputation": sql.HOST_REPUTATION,
    "op5_revisits": sql.REVISITS,
    "op10_rule_ledger": sql.RULE_LEDGER,
    "quality_ablations": sql.ABLATIONS,
    "op11_prefix_trie": sql.PREFIX_TRIE,
    "op13_vector_codes": sql.VECTOR_CODES,
}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_pii(spark, sf_dir):
    return pii.pii_digest(table(spark, sf_dir, "documents"))


@query
def op2_near_duplicates(spark, sf_dir):
    return near_dup.near_dup_rows(table(spark, sf_dir, "documents"), k=4, percent=80)


@query
def op3_host_reputation(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return hosts.judge(pages, hosts.page_outcomes(pages, table(spark, sf_dir, "labels")))


@query
def op4_secret_ledger(spark, sf_dir):
    return secrets.secrets_digest(table(spark, sf_dir, "documents"), scratch_path(spark, "blob-ledger"))


@query
def op5_revisits(spark, sf_dir):
    return revisits.revisit_rows(table(spark, sf_dir, "pages"))


@query
def op6_line_chunks(spark, sf_dir):
    return line_chunks.dedup_rows(table(spark, sf_dir, "documents"))


@query
def op7_benchmark_items(spark, sf_dir):
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_class_lm(spark, sf_dir):
    return brown_lm.lm_rows(table(spark, sf_dir, "documents"))


@query
def op9_bpe_lexicon(spark, sf_dir):
    return bpe.encode_rows(table(spark, sf_dir, "documents"))


@query
def op10_rule_ledger(spark, sf_dir):
    return quality.quality_rows(table(spark, sf_dir, "documents"))


@query
def quality_ablations(spark, sf_dir):
    """What each rule of the stored policies rejects, alone and with others."""
    return quality.ablations(quality.measure(table(spark, sf_dir, "documents")), [quality.BASE, quality.DEFAULT])


@query
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.trie_rows(table(spark, sf_dir, "conversations"))


@query
def op12_simhash_ring(spark, sf_dir):
    return simhash.simhash_rows(table(spark, sf_dir, "documents"), k=4, bits=4)


@query
def op13_vector_codes(spark, sf_dir):
    return vector_codes.vector_rows(table(spark, sf_dir, "embeddings"))
