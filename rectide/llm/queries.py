"""The registered queries of this subpackage: each operator over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rectide.llm.backoff_lm import backoff_lm
from rectide.llm.budget_mix import budget_mix
from rectide.llm.collocations import collocations
from rectide.llm.decontaminate import decontaminate
from rectide.llm.ftrl_quality import ftrl_quality
from rectide.llm.host_rules import host_rules
from rectide.llm.html_extract import extract_main_text
from rectide.llm.license_scan import license_scan, license_windows
from rectide.llm.oracle import LLM_ORACLE  # noqa: F401
from rectide.llm.ring_shards import ring_shards
from rectide.llm.simhash_dedup import simhash_dedup
from rectide.llm.spelling import spelling_variants
from rectide.llm.suffix_dedup import suffix_dedup
from rectide.llm.window_dedup import window_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op1_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_windows(_table(spark, sf_dir, "documents"))


def op2_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_shards(_table(spark, sf_dir, "documents"), shards=40)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("row_key")


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(_table(spark, sf_dir, "documents")).drop("host", "host_shrunk")


def op5_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup(_table(spark, sf_dir, "documents")).drop("kept_text")


def op6_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ftrl_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents")).drop("kept", "spans")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(_table(spark, sf_dir, "documents")).drop("row_key", "root")


def op9_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget_mix(_table(spark, sf_dir, "documents")).drop("copies", "row_key")


def op10_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm(_table(spark, sf_dir, "documents"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


LLM_QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op1_license_windows,
        op2_ring_shards,
        op3_decontaminate,
        op4_host_rules,
        op5_window_dedup,
        op6_ftrl_quality,
        op7_suffix_dedup,
        op8_simhash_dedup,
        op9_budget_mix,
        op10_backoff_lm,
        op11_main_text,
        op12_collocations,
        op13_spelling,
    )
}
