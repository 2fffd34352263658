"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir.

    Where it is unset, a temporary one is set if all executors are on this machine, as in tests; on a cluster that is an error,
    as no executor would find what another wrote.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df written as Parquet in the shared folder and read again: later stages don't recompute it, and it outlives its executors."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def fresh(columns: list[str], name: str) -> str:
    """name, or name with underscores behind it, such that no column is called so."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def drop(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
