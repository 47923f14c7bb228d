"""From raw documents to packed training sequences: toxicity, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the docs of the
next one. All but the last return the columns of documents. Stage by stage: rows that are toxic go; one row of each
group of near-duplicates stays; rows of scarce sources and languages are repeated as often as the mix asks, none goes; the
texts are packed into sequences of 2,048 tokens. The last two stages count tokens each for itself, as a stage hands on the
columns of documents only.

Defined results: rows with a null text aren't toxic, nor duplicates of anything, and stay until packing, for which they, like empty
texts, have no piece; rows with a null doc_id go through like others, but have no label; of rows that are equal in text the one
with the lowest doc_id stays, of those equal in that too just one; null sources and languages count as one of their own;
very long texts are taken whole and packed into as many sequences as they need; without labels of both classes nothing is
toxic; an empty table gives an empty table of packed pieces; other columns stay, whatever their names, until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitefold.llm import mixing, packing, simhash_forest, toxicity
from sitefold.llm.shared import new_path, remove
from sitefold.shipping import ship


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash_forest.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    mixed, _ = mixing.mix(docs)
    return mixing.repeated(mixed, mixed.columns[-1])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("mixing_to_target_weights", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Model scores, LSH tries, flows and least squares aren't SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on the documents in sf_dir."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)  # nothing reads it any more
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
