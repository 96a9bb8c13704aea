"""The queries of this subpackage and their DuckDB counterparts, where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, decontaminate, exact_dedup, language_id, language_model, line_dedup, mixing, packing, pii, quality, simhash, spelling_variants, toxicity
from .common import table


def op1_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The key of this query is no secret: its results are for comparison only.
    return pii.pseudonymise(table(spark, sf_dir, "documents"), spark.conf.get(pii.KEY_SETTING, None) or "comparison")


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"), similarity=0.8)


def op4_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op6_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.held_out_scores(table(spark, sf_dir, "documents"))


def op7_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


def op9_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op10_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages conversations by a hash, then repairs them: one row for each conversation."""
    return conversation_repair.repair_report(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its near words, form and root."""
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix of all sources takes."""
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_feistel, op2_ppm, op3_fuzzy_lines, op4_content_sort, op5_simhash, op6_backoff_automaton, op7_wu_manber, op8_packing, op9_weak_supervision, op10_boosted_trees, op11_conversation_repair, op12_spelling_variants, op13_mixing)}

ORACLES = {"op4_content_sort": exact_dedup.ORACLE, "op7_wu_manber": decontaminate.ORACLE, "op11_conversation_repair": conversation_repair.ORACLE, "op12_spelling_variants": spelling_variants.ORACLE, "op13_mixing": mixing.ORACLE}
