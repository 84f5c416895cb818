"""Counts, frequencies and quality control of variants, from long genotypes (variant, sample, g) by one aggregation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelake.functions.pvalue import log10p


def frequency(g: Column) -> Column:
    """Frequency of the counted allele among observed genotypes."""
    return F.sum(g) / (F.lit(2.0) * F.count(g))


def observed(g: Column) -> Column:
    return F.count(g)


def missingness(g: Column) -> Column:
    """Share of missing genotypes."""
    return F.avg(g.isNull().cast("int"))


def minor(frequency: Column) -> Column:
    """Minor allele frequency."""
    return F.least(frequency, F.lit(1.0) - frequency)


def allele_counts(genotypes: DataFrame, by: list[str], g: str = "g") -> DataFrame:
    """Genotype classes, allele counts, frequency, observed and missing genotypes of each variant."""
    x = F.col(g)
    return genotypes.groupBy(*by).agg(
        F.count_if(x == 0).alias("n0"), F.count_if(x == 1).alias("n1"), F.count_if(x == 2).alias("n2"),
        F.sum(x).alias("allele1_count"), (F.lit(2) * F.count(x) - F.sum(x)).alias("allele0_count"),
        frequency(x).alias("a1freq"), F.count(x).alias("n"), F.count_if(x.isNull()).alias("n_missing"),
    )


def hwe_chisq(n0: Column, n1: Column, n2: Column) -> Column:
    """Chi-square of Hardy-Weinberg equilibrium (one degree of freedom); null for a variant with one allele."""
    n = (n0 + n1 + n2).cast("double")
    f = (n1 + F.lit(2) * n2) / (F.lit(2.0) * n)
    e0, e1, e2 = n * (1 - f) * (1 - f), F.lit(2.0) * n * f * (1 - f), n * f * f
    return F.when((f > 0) & (f < 1), (n0 - e0) * (n0 - e0) / e0 + (n1 - e1) * (n1 - e1) / e1 + (n2 - e2) * (n2 - e2) / e2)


def autosomal(chrom: Column) -> Column:
    """Whether a chromosome is one of 1 to 22, with or without ``chr``."""
    return F.regexp_replace(chrom.cast("string"), "^(?i)chr", "").rlike("^0?([1-9]|1[0-9]|2[0-2])$")


def quality_control(genotypes: DataFrame, by: list[str], sample: str, g: str = "g", mind: float = 0.1, geno: float = 0.01, maf: float = 0.01, hwe_max: float | None = None, hwe_p: float | None = None, chrom: str | None = None) -> DataFrame:
    """Genotypes of samples with at most ``mind`` missing and variants with at most ``geno`` missing, a minor allele
    frequency of ``maf`` at least and, if given, a Hardy-Weinberg chi-square of ``hwe_max`` at most, or one whose
    probability is over ``hwe_p`` (variants of one allele pass that). With ``chrom``, a column, autosomes alone."""
    x = F.col(g)
    if chrom is not None:
        genotypes = genotypes.where(autosomal(F.col(chrom)))
    good_samples = genotypes.groupBy(sample).agg(missingness(x).alias("m")).where(F.col("m") <= mind).select(sample)
    kept = genotypes.join(good_samples, sample, "left_semi")
    stats = kept.groupBy(*by).agg(missingness(x).alias("m"), minor(frequency(x)).alias("f"), F.count_if(x == 0).alias("n0"), F.count_if(x == 1).alias("n1"), F.count_if(x == 2).alias("n2"))
    good = stats.where((F.col("m") <= geno) & (F.col("f") >= maf))
    if hwe_max is not None:
        good = good.where(hwe_chisq(F.col("n0"), F.col("n1"), F.col("n2")) <= hwe_max)
    if hwe_p is not None:
        good = good.where(F.coalesce(log10p(hwe_chisq(F.col("n0"), F.col("n1"), F.col("n2"))), F.lit(0.0)) < -math.log10(hwe_p))
    return kept.join(good.select(*by), by, "left_semi")
