"""Streams: arriving source files through the scan, decisions through a watermark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.operators.rules import SECURITY
from codesieve.operators.scan import scan_summary


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one in local tests only."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="streams-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all that is there, append to Parquet, return the rows."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start(f"{folder}/rows")
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def scan_stream(files: DataFrame) -> DataFrame:
    """The stateless scan; ``files`` may be a stream or a table."""
    return scan_summary(files, SECURITY)


def decisions(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    """Decision events as a stream, each version once within the delay."""
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).parquet(f"{path}*")
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
        .select("event_id", "ts", "user_id", F.col("event_type").isin("purchase", "signup", "click").alias("approved"))
    )


def decision_windows(stream: DataFrame, width: str = "1 day") -> DataFrame:
    """Approved and rejected decisions per tumbling window, counted in the stream.

    In append mode a window leaves when the watermark has passed its end; windows
    that are still open stay in the state.
    """
    return stream.groupBy(F.window("ts", width).alias("w")).agg(
        F.count_if("approved").alias("approved"), F.count_if(~F.col("approved")).alias("rejected")
    ).select(F.col("w.start").cast("string").alias("window_start"), "approved", "rejected")
