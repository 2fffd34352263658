"""Queries over the driver's tables, one for each operator of this subpackage, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from quire.llm import decontamination, near, packing, pieces, repetition, roles, substring, templates, tokens, urls
from quire.llm.session import table


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids) of every document, as read back from the table that holds them."""
    return tokens.token_table(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, duplicate_of): every document that has a near-duplicate with a lesser id."""
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rules match every page's URL, and the decision."""
    return urls.url_decisions(table(spark, sf_dir, "pages"), urls.rules_table(spark))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every conversation is placed: its turns are its segments, the assistant's tokens bear loss."""
    turns = pieces.with_token_counts(table(spark, sf_dir, "conversations"), keep=["conv_id", "turn", "role"])
    loss = F.when(F.col("role") == "assistant", F.col("n_tokens")).otherwise(0)
    in_order = F.sort_array(F.collect_list(F.struct("turn", F.col("n_tokens").alias("tokens"), loss.alias("loss"))))
    examples = turns.groupBy("conv_id").agg(in_order.alias("turns"))
    return packing.pack(examples, "conv_id", turns_col="turns")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens): the greedy pieces of every document."""
    return pieces.with_token_counts(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the repetition rules keep, with their scores."""
    scores = repetition.repetition_scores(table(spark, sf_dir, "documents"))
    return scores.where(f"repeated_fraction <= {repetition.MAX_COVERED} AND longest_repeat <= {repetition.MAX_LONGEST}")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, ...): every overlap of a document with a benchmark item."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every page without the templates of its host."""
    return templates.extract(table(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of every document that occurred before, with the document that has the first occurrence."""
    return substring.repeated_spans(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with its roles repaired, rendered."""
    return roles.format_chats(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_token_ids,
        op2_simhash_near_dedup,
        op3_url_filters,
        op4_packing,
        op5_token_counts,
        op6_quality_rules,
        op7_benchmark_decontamination,
        op8_html_extraction,
        op9_substring_dedup,
        op10_chat_formatting,
    ]
    return {f.__name__: f for f in named} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """What SQL can express; the others are compared with brute force in tests/llm."""
    return {"op3_url_filters": urls.oracle()}
