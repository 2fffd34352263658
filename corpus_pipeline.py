"""From documents to packed training sequences.

STAGES holds (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.  All but the last return the columns of documents.

1. quality      operator 6: documents that mostly repeat themselves go
2. near_dedup   operator 2: one document of each group of near-duplicates stays, that with the least id
3. substrings   operator 9: of passages of 50 words and more that occur again, the first occurrence stays
4. leaks        operator 7: documents that overlap with a benchmark item go
5. packing      operators 5 and 4: pieces are counted and documents placed into training sequences

Rows with nulls, empty and blank texts pass all filters (nothing speaks against them) and take a segment of a
sequence without tokens; an empty table gives empty results in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontamination, near, packing, pieces, repetition, shared, substring
from quire.llm.session import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that mostly repeat themselves go.  Empty and null texts stay, as do null ids; repeated rows share their fate."""
    return repetition.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the least id stays.  Texts without words and rows with a null id stay; of rows that repeat an id one stays."""
    return near.near_dedup(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay only where they occur first; a document of which no word is left goes.  Empty and null texts, and null ids, stay as they are."""
    return substring.substring_dedup(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go.  Empty and null texts, and null ids, stay; an empty benchmark removes nothing."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document, or piece of one, is placed.  A document without text is a segment without tokens; null ids and repeated rows are placed like others."""
    counted = pieces.with_token_counts(docs, keep=["doc_id"])
    return packing.pack(counted, "doc_id", "n_tokens", max_loss=packing.MAX_TOKENS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substrings", substrings),
    ("leaks", leaks),
    ("packing", pack),
]

#: SQL expresses neither the suffix arrays nor the searches; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, shared.written(stage(spark, docs, sf_dir), f"stage-{name}")
        if i:
            shared.drop(before)
    return docs
