"""The corpus pipeline: documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatledger.llm import language, mixing, near, packing, pii
from chatledger.llm.common import free_name, row_key
from chatledger.plans.materialize import scratch_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the output codes can tell; learned from the labelled ones among them."""
    return language.reject(docs, language.train(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id, if any has one. Rows are told apart
    by 128 bits over all columns, so null and reused doc_ids are no matter; of equal rows one stays. Different rows that
    share the half which names them to ``near_duplicates`` stay or go together. Columns may have any names."""
    columns = docs.columns
    row, place = free_name(columns, "row_"), free_name(columns, "place_")
    keyed = docs.withColumn(row, row_key(docs))
    named = keyed.select(F.col(row)["a"].alias("node"), "doc_id", "text")
    decided = near.near_duplicates(named.select(F.col("node").alias("doc_id"), "text")).select(
        F.col("doc_id").alias("node"), "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node"))
    kept = decided.join(named.select("node", "doc_id"), "node").groupBy("component_id").agg(first.alias("first"))
    kept = kept.select(F.col("first.node").alias("node"))
    # The texts are shuffled once, by the naming half, for the join and for the choice among equal rows.
    one = keyed.join(kept, F.col(row)["a"] == kept["node"], "left_semi").withColumn(
        place, F.row_number().over(Window.partitionBy(F.col(row)["a"], F.col(row)["b"]).orderBy(F.lit(0))))
    return one.where(F.col(place) == 1).select(*columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind."""
    return pii.redact(docs, pii.train(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of domains, languages and sources asks for."""
    return mixing.repeat(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, with their token ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("language", known_language), ("near", one_of_each), ("pii", without_personal_data), ("mixing", mixed),
    ("packing", packed),
]

#: Learned classifiers, sketches and tokenizers have no SQL form; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written, and the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
