"""Registered queries of the operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from airwise.llm import bwt_dedup, conv_repair, conv_trie, decontam, license_scan, line_quality, lsh_forest, packing, pii_bootstrap, simhash_golay, toxicity_pu, url_lists, warc

QUERIES = {}
ORACLE: dict[str, str] = {}


def tokenizer_path() -> str:
    """File of the public byte-level vocabulary; another path can be given in AIRWISE_TOKENIZER."""
    import public_tokenizers

    return os.environ.get("AIRWISE_TOKENIZER") or str(public_tokenizers.path("byte_bpe_50k.json"))


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_decontamination", decontam.ORACLE_SQL)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


@query("op4_simhash_golay")
def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_golay.near_duplicates(table(spark, sf_dir, "documents")).drop("fp")


@query("op8_exact_packing")
def op8_exact_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op3_line_frequency", line_quality.ORACLE_SQL)
def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.line_quality(table(spark, sf_dir, "documents"))


@query("op6_pii_bootstrap")
def op6_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.personal_data(table(spark, sf_dir, "documents"))


@query("op1_warc_normaliser", warc.ORACLE_SQL)
def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"))


@query("op7_toxicity_pu")
def op7_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_pu.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_bwt_dedup")
def op9_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query("op2_license_scan", license_scan.oracle_sql())
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_labels(table(spark, sf_dir, "documents"))


@query("op5_url_temporal_lists", url_lists.ORACLE_SQL)
def op5_url_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lists.pages_as_of(table(spark, sf_dir, "pages"))


@query("op13_prefix_trie", conv_trie.ORACLE_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_trie.trie(table(spark, sf_dir, "conversations"))


@query("op11_structure_repair")
def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_repair.repair(table(spark, sf_dir, "conversations"))


@query("op12_lsh_forest", lsh_forest.ORACLE_SQL)
def op12_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"))
