"""One query for each training-data operator, over its whole table, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelake.llm.common import work_dir
from allelake.llm.compaction import compacted
from allelake.llm.decontaminate import find_contamination
from allelake.llm.hnsw import nearest
from allelake.llm.html_text import extract_text
from allelake.llm.huffman import token_round_trip
from allelake.llm.jaccard_join import jaccard_components
from allelake.llm.language_id import identify_languages
from allelake.llm.packing import pack_documents
from allelake.llm.quality import score_quality
from allelake.llm.warc import capture_histories


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, edited copies included."""
    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, from the merged index of the archives."""
    rows = capture_histories(_table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Huffman-coded token files, read back."""
    return token_round_trip(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)


def op4_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of all pages, laid out."""
    return extract_text(_table(spark, sf_dir, "pages"))


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from three of four folds."""
    return identify_languages(_table(spark, sf_dir, "documents"), folds=4, held_out_fold=2)


def op6_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th one."""
    return nearest(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share at least 85 percent of their four-word shingles."""
    return jaccard_components(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1, max_tokens=4096)


def op9_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents appended as small shards, compacted, and read from the newest manifest."""
    rows = compacted(_table(spark, sf_dir, "documents"), work_dir(spark, "shards"))
    return rows.select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("text_bytes"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op10_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from labels of four of five folds."""
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), folds=5, held_out_fold=0, threshold=0.3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_warc_index": op2_warc_index,
    "op3_token_huffman": op3_token_huffman,
    "op4_html_layout": op4_html_layout,
    "op5_language_mixture": op5_language_mixture,
    "op6_hnsw_search": op6_hnsw_search,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_size_tiered_shards": op9_size_tiered_shards,
    "op10_quality_attention": op10_quality_attention,
}
