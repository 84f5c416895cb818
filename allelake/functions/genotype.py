"""Scalar functions on genotypes, model codes and identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Clip of probabilities: the larger of the declared minimum and the float32 epsilon.
MINIMUM_PROBABILITY = 1e-10
FLOAT32_EPSILON = 2.0**-23
EPSILON = max(MINIMUM_PROBABILITY, FLOAT32_EPSILON)
#: Labels of the codes of a logistic fit.
ERROR_LABELS = {1: "FIRTH_CONVERGE_FAIL", 2: "LOGISTIC_CONVERGE_FAIL", 3: "UNFINISHED", 0: "."}
METHOD_STANDARD, METHOD_FIRTH = 0, 1


def dosage(probabilities: Column, phased: bool) -> Column:
    """Expected count of the second allele: p1 + 2 p2 of three unphased, p1 + p3 of four phased probabilities."""
    p = lambda i: probabilities[i].cast("double")
    value = p(1) + p(3) if phased else p(1) + F.lit(2.0) * p(2)
    wanted = 4 if phased else 3
    return F.when(F.size(probabilities) == wanted, value).otherwise(F.raise_error(F.lit(f"{wanted} probabilities expected")))


def probability(eta: Column, epsilon: float = EPSILON) -> Column:
    """Logistic probability of a linear predictor, clipped to [epsilon, 1 - epsilon]."""
    return F.greatest(F.lit(epsilon), F.least(F.lit(1 - epsilon), F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))))


def log_likelihood(y: Column, p: Column, epsilon: float = EPSILON) -> Column:
    """Sum of Bernoulli log-likelihoods, an aggregate."""
    q = F.greatest(F.lit(epsilon), F.least(F.lit(1 - epsilon), p))
    return F.sum(F.when(y == 1, F.log(q)).otherwise(F.log(F.lit(1.0) - q)))


def method_label(code: Column) -> Column:
    """Y for a Firth fit, N for any other."""
    return F.when(code == METHOD_FIRTH, "Y").otherwise("N")


def error_label(code: Column) -> Column:
    """Label of an error code; a dot for none and unknown ones."""
    table = F.create_map(*(F.lit(x) for pair in ERROR_LABELS.items() for x in pair))
    return F.coalesce(table[code], F.lit("."))


def probability_count(ploidy: Column, alleles: Column, phased: Column) -> Column:
    """Number of probabilities of a genotype: C(ploidy + alleles - 1, alleles - 1) unphased, ploidy x alleles phased."""
    choose = F.aggregate(F.sequence(F.lit(1), alleles - 1), F.lit(1).cast("long"), lambda acc, i: (acc * (ploidy + i) / i).cast("long"))
    return F.when(phased, ploidy * alleles).when(alleles <= 1, F.lit(1)).otherwise(choose).cast("long")


def unpack_r2(value: Column) -> Column:
    """Squared correlation of its 16-bit code."""
    return value.cast("double") / F.lit(65535.0)


def pack_r2(value: Column) -> Column:
    """16-bit code of a squared correlation."""
    return F.floor(value * F.lit(65535.0) + F.lit(0.5)).cast("int")


def split_list(text: Column) -> Column:
    """Items of a list separated by commas or blanks."""
    return F.filter(F.split(text, "[,\\s]+"), lambda x: x != "")


def hex_groups(data: Column) -> Column:
    """Hexadecimal bytes, a bar after every four."""
    return F.regexp_replace(F.lower(F.hex(data)), "(.{8})(?=.)", "$1|")


def now_text() -> Column:
    """Current time to the second."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def haplotype_dosage(a: Column, b: Column) -> Column:
    """Dosage of two haplotype alleles 0 or 1; null if either is missing."""
    return a.cast("int") + b.cast("int")
