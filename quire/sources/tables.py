"""Reading of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of long texts, whose rows are worth spreading over all cores when a file has fewer splits than there are cores.
TEXTS = ("documents", "pages", "conversations")
#: Bytes of a file of pages that one task reads at most; a page costs about ten milliseconds, and 4 MB hold about 2,000.
PAGES_BYTES = 4 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over at least as many partitions as there are cores; as it is, without a shuffle, where it has them.

    With keys it is dealt by them, into a number of partitions that adaptive execution keeps: for a grouping by them
    that makes little data for much work, which would else be put into one task.  The grouping needs no shuffle of its own.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if keys:
        return df.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def load(spark: SparkSession, sf_dir: str, name: str, bounded: bool = True) -> DataFrame:
    """A table; pages in tasks of PAGES_BYTES at most, which shuffles them, unless bounded is false."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "pages" and bounded:
        least = -(-size(spark, f"{sf_dir}/{name}.parquet") // PAGES_BYTES)
        if max(least, spark.sparkContext.defaultParallelism) > df.rdd.getNumPartitions():
            return df.repartition(max(least, spark.sparkContext.defaultParallelism))
        return df
    return spread(df) if name in TEXTS else df
