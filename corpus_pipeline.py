"""Corpus pipeline over ``documents``: stages of training-data operators, each taking what the one before has kept.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give rows of ``documents`` with all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelake.llm.common import stage, work_dir
from allelake.llm.decontaminate import keep_clean
from allelake.llm.jaccard_join import BROADCAST_BYTES, jaccard_components
from allelake.llm.language_id import keep_known
from allelake.llm.packing import pack_documents
from allelake.llm.quality import keep_good
from allelake.llm.queries import tokenizer_file


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told from their text (those without letters go)."""
    return keep_known(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels of those that are left, takes for good."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one of the smallest doc_id (null ones last; one of those that repeat it).

    Groups are components of links between documents whose sets of five-word shingles have a Jaccard similarity of 0.8 at
    least. Every row is a document of its own here, whether its doc_id is null, repeated or neither. Documents without words
    are in no group and stay.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("id"), F.struct("*").alias("row"))
    rows = stage(rows, work_dir(spark, "pipeline-rows"))
    groups = jaccard_components(rows.select(F.col("id").alias("doc_id"), "row.text"), k=5, percent=80, name="pipeline-jaccard")
    groups = groups.select(F.col("doc_id").alias("id"), "component_id")
    order = F.struct(F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id").alias("doc_id"), "id")
    placed = rows.select("id", order.alias("place")).join(groups, "id")
    kept = placed.groupBy("component_id").agg(F.min("place").alias("place"))
    dropped = placed.select("id").join(kept.select("place.id"), "id", "left_anti")
    dropped = stage(dropped, work_dir(spark, "pipeline-dropped"))
    if dropped.count() * 8 <= BROADCAST_BYTES:  # rows then stay where they are
        dropped = F.broadcast(dropped)
    return rows.join(dropped, "id", "left_anti").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, edited copies included."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens."""
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"), end_id=1, max_tokens=4096, name="pipeline-packing")


STAGES = [
    ("language_id", language_id),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: Learned stages can't be expressed in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage's result is written and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), work_dir(spark, "pipeline")
    for i, (name, apply) in enumerate(STAGES):
        docs = stage(apply(spark, docs, sf_dir).select("*"), f"{folder}/{i}-{name}")
    return docs
