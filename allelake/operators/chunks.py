"""Result chunks: committed one by one, skipped on restart, compacted at the end."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelake.schemas import RESULTS, to_schema


#: The part of a chunk that a whole run writes; streams number theirs by batch.
WHOLE = -1


def with_chunks(results: DataFrame, plan: DataFrame, size: int, index: str = "variant_index") -> DataFrame:
    """Results with their chunk's number and half-open index range from the ``plan`` (a row for each chunk and chromosome)."""
    ranges = plan.select("chunk_identifier", "chrom", "variant_start_index", "variant_stop_index")
    return results.withColumn("chunk_identifier", F.floor(F.col(index) / size)).join(ranges, ["chunk_identifier", "chrom"])


def claim(spark: SparkSession, folder: str, facts: dict) -> None:
    """Record what a run folder's chunks are made from; an error if the folder belongs to another run.

    Chunk numbers mean nothing under another chunk size or for other inputs, so such chunks must not count as done.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/run.json")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, False)
        out.write(bytearray(json.dumps(facts, sort_keys=True).encode()))
        out.close()
        return
    stream = fs.open(path)
    try:
        found = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    other = sorted(k for k in facts.keys() | found.keys() if facts.get(k) != found.get(k))
    if other:
        raise ValueError(f"{folder} holds chunks of another run; other values of: {', '.join(other)}")


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of the chunks in a run folder; none if there is no folder yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/chunks")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "chunk_identifier long")
    return read_chunks(spark, folder).select("chunk_identifier").distinct()


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the committed chunks."""
    return spark.read.schema(T.StructType([*RESULTS, T.StructField("part", T.LongType())])).parquet(f"{folder}/chunks").drop("part")


def remaining(plan: DataFrame, done: DataFrame) -> DataFrame:
    """Planned chunks that aren't committed."""
    return plan.join(done.select("chunk_identifier").distinct(), "chunk_identifier", "left_anti")


def commit_chunks(results: DataFrame, folder: str, part: int = WHOLE) -> None:
    """Write results, one folder per chunk and ``part``: what the same part of a chunk held before is replaced, all else
    stays. A retry does no harm, and a chunk may arrive in any number of parts."""
    out = to_schema(results, RESULTS).withColumn("part", F.lit(part))
    (out.repartition("chunk_identifier").sortWithinPartitions("chunk_identifier", "genpos")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("chunk_identifier", "part").parquet(f"{folder}/chunks"))


def finalize(spark: SparkSession, folder: str) -> str | None:
    """Compact the committed chunks to one ordered data set; gives its path, or None if there are none."""
    if committed(spark, folder).isEmpty():
        return None
    rows = read_chunks(spark, folder)
    out = f"{folder}/final.parquet"
    to_schema(rows, RESULTS).repartitionByRange("variant_start_index", "genpos").sortWithinPartitions("variant_start_index", "genpos", "variant_id").write.mode("overwrite").option("compression", "zstd").parquet(out)
    return out
