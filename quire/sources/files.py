"""Sources and sinks: directories of pages, reference pairs, documents, artifacts and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, stem, content): the .htm and .html files below a directory, or one file.  Content is read lazily, as bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{htm,html,HTM,HTML}").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, r"(?i)\.html?$", "").alias("stem"), "content")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(stem, text) of the Markdown documents below a directory."""
    files = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.bio)?\.md$", 1).alias("stem"), F.col("value").alias("text"))


def pair(produced: DataFrame, reference: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """(stem, produced, reference[, source]) joined by stem; a side that is absent is ''."""
    both = produced.select("stem", F.col("text").alias("produced")).join(reference.select("stem", F.col("text").alias("reference")), "stem", "full_outer")
    if source is not None:
        both = both.join(source.select("stem", F.col("text").alias("source")), "stem", "left")
    return both.fillna("")


def write_documents(docs: DataFrame, path: str, stem: str = "stem", text: str = "text") -> None:
    """One Parquet table of documents, or rather of runs: the commit protocol makes each write appear at once or not at all."""
    docs.select(F.col(stem).alias("stem"), F.col(text).alias("text")).write.mode("append").parquet(path)


def export_documents(docs: DataFrame, folder: str, stem: str = "stem", text: str = "text") -> None:
    """<stem>.md files, each written beside its place and renamed; run on the executors, for folders that all of them see."""

    def save(rows) -> None:
        import os
        import re
        import uuid

        os.makedirs(folder, exist_ok=True)
        for row in rows:
            name = re.sub(r"[^\w.-]+", "_", str(row[0])) or "_"
            part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
            with open(part, "w", encoding="utf-8") as out:
                out.write(row[1] or "")
            os.replace(part, os.path.join(folder, f"{name}.md"))

    docs.select(stem, text).foreachPartition(save)


def safe_name(name, content) -> F.Column:
    """A job's folder name: what is safe of the name, and 12 digits of the content's hash."""
    name = F.col(name) if isinstance(name, str) else name
    content = F.col(content) if isinstance(content, str) else content
    return F.concat_ws("-", F.regexp_replace(name, r"[^\p{L}\p{N}._-]+", "_"), F.substring(F.sha2(content.cast("binary"), 256), 1, 12))


def append_artifacts(artifact: DataFrame, path: str, run_id: str) -> None:
    """Stage artifacts, partitioned by run, so that a run is read or dropped as one folder."""
    artifact.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def save_profile(profile: dict[str, DataFrame], path: str) -> None:
    for name, table in profile.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


PROFILE = ("fingerprint_freq", "stable_chrome", "lexicon")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def load_profile(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in (*PROFILE, *(["encodings"] if _exists(spark, f"{path}/encodings") else []))}


def write_json(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)
