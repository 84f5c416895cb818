"""Sample files and the text tables of samples: phenotypes, covariates, predictions."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelake.operators.align import KEY, long_predictions
from allelake.schemas import SAMPLES
from allelake.sources.files import exists, read_lines


def parse_samples(lines: list[str]) -> list[tuple[int, str, str]]:
    """(index, family, individual) of the lines of a sample file.

    A header of column names and a row of column types come first; the first column must have type 0, and so must a second
    identifier column. With one identifier column it serves for both identifiers. Every row has as many values as the
    header declares columns.
    """
    if len(lines) < 2:
        raise ValueError("a sample file has a header and a type row")
    header, types = lines[0].split(), lines[1].split()
    if not types or types[0] != "0":
        raise ValueError("The type row must mark the first identifier column with type '0'")
    two = len(header) > 1 and header[:2] == ["ID_1", "ID_2"]
    if two and (len(types) < 2 or types[1] != "0"):
        raise ValueError("The type row must mark the second identifier column with type '0'")
    out = []
    for number, line in enumerate(lines[2:]):
        values = line.split()
        if not values:
            continue
        if len(values) != len(header):
            raise ValueError(f"Line {number + 3} has {len(values)} values, but the header declares {len(header)} columns")
        out.append((len(out), values[0], values[1] if two else values[0]))
    return out


def load_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a sample file, in its order (one row for each sample; the file is as long as a genotype row)."""
    return spark.createDataFrame(parse_samples(read_lines(path)), SAMPLES)


def resolve_sample_path(genotypes: str, sample: str | None = None) -> str | None:
    """The given path, else the file beside the genotypes with the ending .sample, else None."""
    if sample is not None:
        return sample
    beside = os.path.splitext(genotypes)[0] + ".sample"
    return beside if exists(beside) else None


def generated_samples(spark: SparkSession, count: int) -> DataFrame:
    """Samples without a file or embedded names."""
    index = spark.range(count).withColumnRenamed("id", "sample_index")
    name = F.concat(F.lit("sample_"), F.col("sample_index").cast("string"))
    return index.select("sample_index", name.alias("family_identifier"), name.alias("individual_identifier"))


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A blank- or tab-separated table of samples with a header FID IID name...: identifiers as strings, values as doubles,
    NA and empty values null. The schema comes from the header; only the named columns are parsed."""
    first = spark.read.text(path).limit(1).first()
    names = first[0].split()
    if names[:2] != ["FID", "IID"]:
        raise ValueError(f"{path}: the header must begin with FID IID")
    wanted = columns or names[2:]
    unknown = [c for c in wanted if c not in names]
    if unknown:
        raise ValueError(f"{path}: no column {unknown}")
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("p")).where(F.col("p")[0] != "FID")
    short = F.when(F.size("p") != len(names), F.raise_error(F.concat(F.lit("a row has "), F.size("p").cast("string"), F.lit(f" values, but the header declares {len(names)} columns")))).otherwise(F.col("p"))
    rows = rows.select(short.alias("p"))
    value = lambda c: F.when(~F.col("p")[names.index(c)].isin("NA", "nan", "."), F.col("p")[names.index(c)].cast("double")).alias(c)
    return rows.select(F.col("p")[0].alias(KEY[0]), F.col("p")[1].alias(KEY[1]), *(value(c) for c in wanted))


def read_predictions(spark: SparkSession, list_path: str, trait: str | None = None) -> DataFrame:
    """Per-chromosome predictions of a list file (lines: trait, path): family, individual, chrom, loco_pred.

    A prediction file has a header of FID_IID sample names and a row for each chromosome, or one row per sample with
    FID IID and a column for each chromosome.
    """
    entries = [x.split() for x in read_lines(list_path) if x.strip()]
    path = next((p for t, p in entries if trait in (None, t)), None)
    if path is None:
        raise ValueError(f"{list_path}: no trait {trait}")
    header = spark.read.text(path).limit(1).first()[0].split()
    if header[:2] == ["FID", "IID"]:
        return long_predictions(read_table(spark, path))
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.col("p")[0] != header[0])
    names = F.array(*(F.lit(x) for x in header[1:]))
    long = rows.select(F.col("p")[0].alias("chrom"), F.posexplode(F.slice("p", 2, len(header) - 1)).alias("i", "v")).select("chrom", F.element_at(names, F.col("i") + 1).alias("name"), F.col("v").cast("double").alias("loco_pred"))
    ids = F.split("name", "_", 2)
    return long.select(ids[0].alias(KEY[0]), ids[1].alias(KEY[1]), "chrom", "loco_pred")


SAMPLE_TABLE = T.StructType([T.StructField(KEY[0], T.StringType()), T.StructField(KEY[1], T.StringType())])
