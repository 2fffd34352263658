"""Loading of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.sources import tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as its files are split: a page costs the operators a few milliseconds, so that a shuffle to make tasks smaller isn't worth its disk."""
    return tables.load(spark, sf_dir, name, bounded=False)
