"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bm25_packing, boosted_quality, deleted_interpolation, latent_decontam, quality_rules, signature_join, surrogates, token_frames, toxicity, url_filter
from .common import table, tokenizer_path


def op1_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_frames.write(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_frames.read(manifest, with_ids=False)


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interpolation.score(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op5_latent_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), window=1024, end_id=0)


def op7_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return boosted_quality.score(docs, boosted_quality.train(docs, table(spark, sf_dir, "labels")))


def op8_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.near_duplicates(table(spark, sf_dir, "documents"), width=4, num=85)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), surrogates.secret_key(spark))


QUERIES = {f.__name__: f for f in (
    op1_token_frames, op2_deleted_interpolation, op3_toxicity, op4_quality_rules, op5_latent_decontam,
    op6_bm25_packing, op7_boosted_quality, op8_signature_join, op9_url_filter, op10_surrogates)}
ORACLE_SQL = {"op4_quality_rules": quality_rules.oracle_sql(), "op9_url_filter": url_filter.oracle_sql()}
