"""Text genotypes and side files: VCF, haplotypes, sets, masks, write lists, LD matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelake.functions.genotype import probability_count, split_list
from allelake.sources.files import read_lines


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Calls of a VCF: one row per variant and sample with ploidy, phase and genotype or haplotype probabilities.

    The number of probabilities must fit ploidy and alleles. Variants are known by their place in the file, as positions and
    identifiers may repeat.
    """
    lines = spark.read.text(path)
    names = lines.where(F.col("value").startswith("#CHROM")).first()[0].split("\t")[9:]
    numbered = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.monotonically_increasing_id().alias("variant_key"), F.split("value", "\t").alias("p"))
    base = numbered.select("variant_key", F.col("p")[0].alias("chrom"), F.col("p")[1].cast("long").alias("genpos"), F.col("p")[2].alias("variant_id"), F.col("p")[3].alias("ref"), F.split(F.col("p")[4], ",").alias("alts"), F.split(F.col("p")[8], ":").alias("format"), F.slice("p", 10, len(names)).alias("calls"))
    calls = base.select("*", F.posexplode("calls").alias("i", "call")).withColumn("fields", F.split("call", ":"))
    part = lambda key: F.when(F.array_contains("format", key), F.col("fields")[F.array_position("format", key).cast("int") - 1])
    sample = F.element_at(F.array(*(F.lit(x) for x in names)), F.col("i") + 1)
    gt = part("GT")
    out = calls.select("variant_key", "chrom", "genpos", "variant_id", "ref", "alts", sample.alias("sample"), gt.alias("gt"), F.size(F.split(gt, "[/|]")).alias("ploidy"), part("HP").isNotNull().alias("by_haplotype"), F.transform(F.split(F.coalesce(part("GP"), part("HP")), ","), lambda x: x.cast("double")).alias("probabilities"))
    wanted = probability_count(F.col("ploidy"), F.size("alts") + 1, F.col("by_haplotype"))
    fits = F.col("probabilities").isNull() | F.col("gt").isNull() | (F.size("probabilities") == wanted)
    return out.withColumn("probabilities", F.when(fits, F.col("probabilities")).otherwise(F.raise_error(F.concat(F.col("variant_id"), F.lit(": the number of probabilities doesn't fit ploidy and alleles")))))


def read_haps(spark: SparkSession, path: str) -> DataFrame:
    """Haplotypes: variants with the dosages of the second allele of each pair of haplotypes."""
    p = spark.read.text(path).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("p"))
    n = (F.size("p") - 6) / 2
    pair = lambda i: F.element_at("p", (7 + 2 * i).cast("int")).cast("float") + F.element_at("p", (8 + 2 * i).cast("int")).cast("float")
    return p.select(F.col("p")[0].alias("chrom"), F.col("p")[3].cast("long").alias("genpos"), F.col("p")[2].alias("variant_id"), F.col("p")[4].alias("allele0"), F.col("p")[5].alias("allele1"), F.transform(F.sequence(F.lit(0), n.cast("int") - 1), pair).alias("dosages"))


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    """Set list: set, chromosome, position, variants (separated by commas or blanks)."""
    p = F.split(F.trim("value"), r"\s+", 4)
    return spark.read.text(path).where("trim(value) <> ''").select(p[0].alias("set_id"), p[1].alias("chrom"), p[2].cast("long").alias("genpos"), split_list(p[3]).alias("variants"))


def _named_lists(spark: SparkSession, path: str, name: str, items: str) -> DataFrame:
    p = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).where("trim(value) <> ''").select(p[0].alias(name), split_list(p[1]).alias(items))


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    return _named_lists(spark, path, "mask_id", "annotations")


def read_write_sets(spark: SparkSession, path: str) -> DataFrame:
    return _named_lists(spark, path, "prefix", "masks")


def read_joint_sets(spark: SparkSession, path: str) -> DataFrame:
    """Lists of sets; each row is separated by commas or by blanks."""
    return spark.read.text(path).where("trim(value) <> ''").select(split_list(F.col("value")).alias("sets"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(p[0].alias("variant_id"), p[1].alias("set_id"), p[2].alias("annotation"))


def read_ld(spark: SparkSession, path: str) -> DataFrame:
    """Squared correlations of a binary LD file as rows (i, j, r2, variant_i, variant_j), i < j, named by the .snplist file."""
    names = read_lines(path + ".snplist")
    width = len(names)

    def run(batches):
        named = pa.array(names, pa.string())
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                n = int(np.frombuffer(data, "<i4", 2)[1])
                if n != width:
                    raise ValueError(f"{n} variants, but {width} names")
                low = np.frombuffer(data, "<u2", n * (n - 1) // 2, 8) / 65535.0
                i, j = np.tril_indices(n, -1)
                yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(i, pa.int32()), pa.array(low), named.take(pa.array(j)), named.take(pa.array(i))], ["i", "j", "r2", "variant_i", "variant_j"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "i int, j int, r2 double, variant_i string, variant_j string")


def encode_ld(r2: np.ndarray, samples: int) -> bytes:
    """A binary LD file of a symmetric matrix of squared correlations."""
    i, j = np.tril_indices(len(r2), -1)
    return np.array([samples, len(r2)], "<i4").tobytes() + np.round(r2[i, j] * 65535).astype("<u2").tobytes()
