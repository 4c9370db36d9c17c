"""The registered queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shardlens.llm.bitplanes import cluster
from shardlens.llm.common import table
from shardlens.llm.curriculum import mix_report
from shardlens.llm.decontaminate import find_leaks
from shardlens.llm.fill_in_middle import fim_digests
from shardlens.llm.html_extract import extract_main_text, fit
from shardlens.llm.packing import pack_documents
from shardlens.llm.quality_rules import quality_verdicts
from shardlens.llm.secrets import secret_report
from shardlens.llm.sharding import shard_by_bytes
from shardlens.llm.simhash import near_duplicate_report
from shardlens.llm.sql import OP6_SQL, OP8_SQL, OP10_SQL, OP11_SQL, OP12_SQL, OP13_SQL
from shardlens.llm.substring_dedup import remove_recurring
from shardlens.llm.url_filter import judge_urls
from shardlens.llm.warc import read_warc, write_warc
from shardlens.session import tune

SHARDS = 24


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_main_text(pages, fit(pages))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), SHARDS)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_report(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents")).drop("_key")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(table(spark, sf_dir, "pages")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_recurring(table(spark, sf_dir, "documents"))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digests(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _tuned(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(tune(spark), sf_dir)


QUERIES = {
    f.__name__: _tuned(f)
    for f in (
        op1_secret_scan,
        op2_html_extraction,
        op3_sharding,
        op4_simhash,
        op5_decontamination,
        op6_url_filter,
        op7_packing,
        op8_quality_rules,
        op9_warc,
        op10_substring_dedup,
        op11_source_mixing,
        op12_centroid_clustering,
        op13_fill_in_middle,
        pipeline,
    )
}
ORACLES = {
    "op6_url_filter": OP6_SQL,
    "op8_quality_rules": OP8_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op11_source_mixing": OP11_SQL,
    "op12_centroid_clustering": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
