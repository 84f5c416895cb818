"""Sample alignment: which samples are analysed, in which order, with which values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["family_identifier", "individual_identifier"]


def align_samples(samples: DataFrame, phenotypes: DataFrame, covariates: DataFrame | None = None, key: list[str] = KEY, trait: str | None = None, covariate_names: list[str] | None = None) -> DataFrame:
    """Samples that have the trait and all covariates, with both; the samples' own order is kept in ``sample_index``."""
    wanted = [c for c in phenotypes.columns if c not in key] if trait is None else [trait]
    out = samples.join(phenotypes.select(*key, *wanted), key)
    if covariates is not None:
        names = covariate_names or [c for c in covariates.columns if c not in key]
        out, wanted = out.join(covariates.select(*key, *names), key), [*wanted, *names]
    return out.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in wanted)))


def select_samples(dosages: Column, positions: Column) -> Column:
    """Dosages at the given positions, in the order of the positions."""
    return F.transform(positions, lambda i: F.element_at(dosages, i.cast("int") + 1))


def keep(table: DataFrame, listed: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is listed."""
    return table.join(listed.select(*on).distinct(), on, "left_semi")


def remove(table: DataFrame, listed: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not listed."""
    return table.join(listed.select(*on).distinct(), on, "left_anti")


def identifier(embedded: Column, external: Column, index: Column) -> tuple[Column, Column]:
    """An identifier and where it is from: external file, else embedded in the genotypes, else generated."""
    name = F.coalesce(external, embedded, F.concat(F.lit("sample_"), index.cast("string")))
    origin = F.when(external.isNotNull(), "external").when(embedded.isNotNull(), "embedded").otherwise("generated")
    return name, origin


def long_predictions(wide: DataFrame, key: list[str] = KEY, name: str = "chrom", value: str = "loco_pred") -> DataFrame:
    """Per-chromosome predictions, one column a chromosome, as rows."""
    chroms = [c for c in wide.columns if c not in key]
    return wide.unpivot(key, chroms, name, value)
