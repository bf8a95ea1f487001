"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatledger.llm import (
    automaton,
    chat,
    collocations,
    language,
    lines,
    mixing,
    near,
    neighbours,
    packing,
    periods,
    pii,
    quality,
    transforms,
)
from chatledger.llm.common import table


def op1_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.remove_repeats(table(spark, sf_dir, "documents")).drop("n_spans", "kept")


def op2_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language.identify(documents, language.train(documents))


def op4_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op5_hierarchical_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(embeddings, embeddings.where("vec_id % 50 = 0"))


def op7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_turns(chat.with_trap(table(spark, sf_dir, "conversations"))))


def op8_merged_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op10_boosted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pii.detect(documents, pii.train(documents))


def op11_sorted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.remove_shared(table(spark, sf_dir, "documents"))


def op12_weighted_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_internal_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.runs(table(spark, sf_dir, "documents"))


REGISTERED = {
    "op1_suffix_automata": op1_suffix_automata,
    "op2_retrieval_packing": op2_retrieval_packing,
    "op3_output_codes": op3_output_codes,
    "op4_odd_sketches": op4_odd_sketches,
    "op5_hierarchical_budget": op5_hierarchical_budget,
    "op6_multi_index": op6_multi_index,
    "op7_round_trip": op7_round_trip,
    "op8_merged_transforms": op8_merged_transforms,
    "op9_weak_supervision": op9_weak_supervision,
    "op10_boosted_spans": op10_boosted_spans,
    "op11_sorted_lines": op11_sorted_lines,
    "op12_weighted_graph": op12_weighted_graph,
    "op13_internal_matches": op13_internal_matches,
}

ORACLE = {
    "op5_hierarchical_budget": mixing.oracle(),
    "op11_sorted_lines": lines.oracle(),
    "op12_weighted_graph": collocations.oracle(),
}
