"""Column layouts and enumerations shared by sources, operators and sinks."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Device(StrEnum):
    """Accepted for compatibility; Spark picks where code runs."""

    CPU = "cpu"
    GPU = "gpu"


class AssociationMode(StrEnum):
    STEP2_LINEAR = "step2_linear"
    STEP2_BINARY = "step2_binary"


class TraitType(StrEnum):
    QUANTITATIVE = "quantitative"
    BINARY = "binary"


class BinaryCorrection(StrEnum):
    FIRTH_APPROXIMATE = "firth_approximate"
    SPA = "spa"


class GenotypeFormat(StrEnum):
    PLINK = "plink"
    BGEN = "bgen"


class SampleIdentifierSource(StrEnum):
    EMBEDDED = "embedded"
    EXTERNAL = "external"
    GENERATED = "generated"


class ArrayOrder(StrEnum):
    K = "K"
    A = "A"
    C = "C"
    F = "F"


#: One row per variant; dosages are in sample order, null where missing.
GENOTYPES = T.StructType([T.StructField("variant_index", T.LongType()), T.StructField("chrom", T.StringType()), T.StructField("genpos", T.LongType()), T.StructField("variant_id", T.StringType()), T.StructField("allele0", T.StringType()), T.StructField("allele1", T.StringType()), T.StructField("dosages", T.ArrayType(T.FloatType()))])
#: Samples in file order.
SAMPLES = T.StructType([T.StructField("sample_index", T.LongType()), T.StructField("family_identifier", T.StringType()), T.StructField("individual_identifier", T.StringType())])
#: One row per tested variant.
RESULTS = T.StructType(
    [
        T.StructField("chunk_identifier", T.LongType()), T.StructField("variant_start_index", T.LongType()), T.StructField("variant_stop_index", T.LongType()),
        T.StructField("chrom", T.StringType()), T.StructField("genpos", T.LongType()), T.StructField("variant_id", T.StringType()), T.StructField("allele0", T.StringType()), T.StructField("allele1", T.StringType()),
        T.StructField("a1freq", T.FloatType()), T.StructField("n", T.IntegerType()), T.StructField("beta", T.FloatType()), T.StructField("se", T.FloatType()), T.StructField("chisq", T.FloatType()), T.StructField("log10p", T.FloatType()), T.StructField("extra_code", T.IntegerType()),
    ]
)


def to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its order and types; those that ``df`` lacks are null."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def checked(column: Column, kind: type[StrEnum]) -> Column:
    """The column, or an error at run time for a value that is not of the enumeration."""
    return F.when(column.isin([x.value for x in kind]), column).otherwise(F.raise_error(F.concat(F.lit(f"not one of {[x.value for x in kind]}: "), column.cast("string"))))


def missing_equal(a: Column, b: Column) -> Column:
    """Equality under which a missing value equals everything."""
    return a.isNull() | b.isNull() | (a == b)
