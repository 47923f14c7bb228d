"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import media, mixing, packing, simhash_forest, token_counts, token_store, topk_search, toxicity, url_filters, warc_index


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_documents(_table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_forest.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.flag_toxic(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_index.archive_and_look_up(_table(spark, sf_dir, "pages"))


def op7_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.fingerprint_embeddings(_table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_token_counts(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", F.col(mixed.columns[-1]).alias("n_copies"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_url_filters, op2_topk_search, op3_token_store, op4_simhash_near_dedup, op5_toxicity, op6_warc_index, op7_media_fingerprints, op8_token_counts, op9_best_fit_packing, op10_mixing)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_topk_search": topk_search.SQL, "op6_warc_index": warc_index.SQL}
