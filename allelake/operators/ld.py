"""Linkage disequilibrium: correlations of pairs of variants within a window, and pruning by them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from allelake.operators.binary import dosage_rows


def pairs_within(genotypes: DataFrame, variant: str, sample: str, g: str = "g", window: int | None = None, by: list[str] | None = None) -> DataFrame:
    """r and r2 of each pair i < j of variants (of one group, at most ``window`` apart): by, i, j, r, r2, n.

    Pairs meet by sample; the sums of a pair are combined before the shuffle. Without a window, the number of pairs is the
    square of a group's variants, as the result itself is.
    """
    by = by or []
    a = genotypes.select(*by, sample, F.col(variant).alias("i"), F.col(g).cast("double").alias("x"))
    b = genotypes.select(*by, sample, F.col(variant).alias("j"), F.col(g).cast("double").alias("y"))
    if window is not None:  # a bin meets itself and the next one
        a = a.withColumn("_bin", F.floor(F.col("i") / window))
        b = b.withColumn("_bin", F.explode(F.array(F.floor(F.col("j") / window), F.floor(F.col("j") / window) - 1)))
        met = a.join(b, [*by, sample, "_bin"]).where((F.col("i") < F.col("j")) & (F.col("j") - F.col("i") <= window))
    else:
        met = a.join(b, [*by, sample]).where("i < j")
    return met.groupBy(*by, "i", "j").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n")).select(*by, "i", "j", "r", (F.col("r") * F.col("r")).alias("r2"), "n")


def sparse(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose correlation is ``threshold`` or more in absolute value."""
    return pairs.where(F.abs("r") >= threshold)


def mirrored(pairs: DataFrame, variants: DataFrame, variant: str, value: str = "r2") -> DataFrame:
    """Full symmetric matrix with ones on the diagonal, as rows (i, j, value)."""
    upper = pairs.select("i", "j", value)
    diagonal = variants.select(F.col(variant).alias("i"), F.col(variant).alias("j"), F.lit(1.0).alias(value)).distinct()
    return upper.union(pairs.select("j", "i", value)).union(diagonal)


def prune(wide: DataFrame, by: str = "chrom", order: str = "variant_index", dosages: str = "dosages", window: int = 1000, step: int = 100, r2: float = 0.9) -> DataFrame:
    """Variants left by greedy pruning in windows of ``window`` variants that move by ``step``: of two variants with a larger
    squared correlation the one of smaller minor allele frequency goes (of equal ones the later).

    A chromosome is cut into stretches that are pruned by one task each, with ``window`` variants of overlap before them, so
    a task holds a bounded number of variants whatever the chromosome's length.
    """
    stretch = window * 8
    number = F.row_number().over(W.partitionBy(by).orderBy(order)) - 1
    rows = wide.withColumn("_n", number).withColumn("_home", F.floor(F.col("_n") / stretch))
    spread = rows.withColumn("_part", F.explode(F.when((F.col("_n") % stretch >= stretch - window), F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_n")
        x = np.stack(list(dosage_rows(table.column("dosages").combine_chunks())))
        x = np.where(np.isnan(x), np.nanmean(x, axis=1, keepdims=True), x)
        f = x.mean(1) / 2
        maf = np.minimum(f, 1 - f)
        z = x - x.mean(1, keepdims=True)
        norm = np.sqrt((z * z).sum(1))
        z /= np.where(norm > 0, norm, 1)[:, None]
        alive = norm > 0
        for lo in range(0, len(x), step):
            own = lo + np.flatnonzero(alive[lo : lo + window])
            near = (z[own] @ z[own].T) ** 2 > r2
            for i in range(len(own)):
                for j in np.flatnonzero(near[i, i + 1 :]) + i + 1:
                    if alive[own[i]] and alive[own[j]]:
                        alive[own[j] if maf[own[i]] >= maf[own[j]] else own[i]] = False
        home = table.column("_home").to_numpy() == table.column("_part").to_numpy()
        return pa.table({by: table.column(by).filter(pa.array(alive & home)), order: table.column(order).filter(pa.array(alive & home))})

    kinds = {f.name: f.dataType.simpleString() for f in wide.schema}
    chosen = spread.select(by, order, F.col(dosages).alias("dosages"), "_n", "_home", "_part")
    return chosen.groupBy(by, "_part").applyInArrow(run, f"{by} {kinds[by]}, {order} {kinds[order]}")
