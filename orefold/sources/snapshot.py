"""A checkout or a stored table as a snapshot of files (A1-A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkout(spark: SparkSession, folder: str, repository: str, commit: str, most_bytes: int = 524_288) -> DataFrame:
    """(repository, commit_sha, path, sha, size, text): the files below a folder; larger ones without text.

    Paths and sizes need no content: Spark reads contents only where text or sha is selected.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^.*" + folder.split("://")[-1].strip("/").replace(".", r"\.") + "/", "")
    text = F.when(F.col("length") <= most_bytes, F.col("content").cast("string"))
    return raw.select(F.lit(repository).alias("repository"), F.lit(commit).alias("commit_sha"), path.alias("path"), F.sha1("content").alias("sha"), F.col("length").alias("size"), text.alias("text"))


def store(files: DataFrame, at: str) -> None:
    """Snapshots by repository and commit, so a read of one prunes the others."""
    files.write.mode("append").partitionBy("repository", "commit_sha").parquet(at)


def load(spark: SparkSession, at: str, repository: str, commit: str) -> DataFrame:
    return spark.read.parquet(at).where((F.col("repository") == repository) & (F.col("commit_sha") == commit))


def read_file(files: DataFrame, path: str) -> DataFrame:
    """A4: a point read; the filter reaches the scan."""
    return files.where(F.col("path") == path).select("path", "text")
