"""Streams of result files: bounded reading, chunk commits that can be repeated, and windowed counts (an addition of ours)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelake.operators.chunks import commit_chunks
from allelake.schemas import RESULTS


def read_stream(spark: SparkSession, folder: str, schema: T.StructType = RESULTS, files_at_once: int = 1) -> DataFrame:
    """Rows of Parquet files as they arrive, at most so many files at a time (bounded read-ahead and back-pressure)."""
    if files_at_once < 1:
        raise ValueError("at least one file at a time")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def not_null(stream: DataFrame, column: str) -> DataFrame:
    """The stream, failing at a row without a value."""
    return stream.withColumn(column, F.when(F.col(column).isNotNull(), F.col(column)).otherwise(F.raise_error(F.lit(f"{column} must not be null"))))


def commit_stream(stream: DataFrame, folder: str, checkpoint: str):
    """Commit arriving results as chunks until no file is left. A chunk's rows may come in many batches; a restart goes on
    after the last committed batch, and a batch that runs twice replaces its own rows alone."""
    return stream.writeStream.foreachBatch(lambda batch, number: commit_chunks(batch, folder, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str = "ts", kind: str = "event_type", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Count and sum by window and kind, with late rows up to a bound."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, size).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")
