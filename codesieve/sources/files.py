"""File sources and sinks: whole files, arriving files, rewritten files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.functions.text import base_name, normal_newlines, trim_control

COLUMNS = ("file_id", "repo", "path", "code")


def _shaped(rows: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    return rows.select(
        F.xxhash64(path).alias("file_id"), F.element_at(F.split(path, "/"), -2).alias("repo"), path.alias("path"),
        normal_newlines(F.col("value")).alias("code"),
    )


def read_source_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: file_id (hash of the path), repo (its folder), path, code.

    Files without a byte give no row.
    """
    return _shaped(spark.read.text(path, wholetext=True))


def stream_source_files(spark: SparkSession, path: str) -> DataFrame:
    """The same rows from files as they arrive."""
    return _shaped(spark.readStream.text(path, wholetext=True))


def without_empty(files: DataFrame) -> DataFrame:
    """Files that hold more than blanks, newlines and other characters up to U+0020."""
    return files.where(trim_control(F.coalesce("code", F.lit(""))) != "")


def normalised(files: DataFrame) -> DataFrame:
    """Newlines as LF, a final one on every text, empty files left out."""
    return without_empty(files.withColumn("code", normal_newlines(F.col("code"))))


def rewritten_names(files: DataFrame, prefix: str = "fixed_") -> DataFrame:
    return files.withColumn("name", base_name(F.col("path"))).withColumn("out_name", F.concat(F.lit(prefix), F.col("name")))


def write_rewritten(files: DataFrame, path: str, prefix: str = "fixed_") -> None:
    """Rewritten texts by repo, with their output names."""
    rewritten_names(files, prefix).write.mode("overwrite").partitionBy("repo").parquet(path)
