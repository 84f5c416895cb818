"""Tests of sets of variants, conditional analysis, and relationship matrices in parts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelake.operators.binary import _log10p, dosage_rows
from allelake.operators.meta import chisq_mixture_p


def beta_weights(frequency: np.ndarray, a: float = 1.0, b: float = 25.0) -> np.ndarray:
    """Density of a beta distribution at the minor allele frequency: larger for rarer variants."""
    f = np.clip(np.minimum(frequency, 1 - frequency), 1e-12, 1)
    return np.exp((a - 1) * np.log(f) + (b - 1) * np.log1p(-f) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))


def _cauchy(p: np.ndarray, w: np.ndarray) -> float:
    p = np.clip(p, 1e-300, 1 - 1e-15)
    t = float((w * np.where(p < 1e-15, 1 / (p * math.pi), np.tan((0.5 - p) * math.pi))).sum() / w.sum())
    return 1 / (t * math.pi) if t > 1e15 else 0.5 - math.atan(t) / math.pi


def set_tests(g: np.ndarray, x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> dict[str, float | int | None]:
    """Burden, SKAT, SKAT-O (Cauchy combination over a grid of correlations), ACAT-V and their combination for a set's
    dosages (samples x variants, nan missing), covariates with intercept ``x`` and a quantitative trait."""
    g = np.where(np.isnan(g), np.nanmean(np.where(np.isnan(g).all(0), 0, g), axis=0), g)
    w = beta_weights(g.mean(0) / 2) if weights is None else weights
    q, _ = np.linalg.qr(x)
    r = y - q @ (q.T @ y)
    s2 = float(r @ r) / max(1, len(y) - q.shape[1])
    free = g - q @ (q.T @ g)
    alive = (free * free).sum(0) > 1e-10
    out: dict[str, float | int | None] = {"variants": int(alive.sum()), "burden_p": None, "skat_p": None, "skato_p": None, "acatv_p": None, "acato_p": None}
    if not alive.any():
        return out
    z, w = free[:, alive] * w[alive], w[alive]
    score, kernel = z.T @ r / math.sqrt(s2), z.T @ z

    def mixed(rho: float) -> float:
        stat = (1 - rho) * float(score @ score) + rho * float(score.sum()) ** 2
        half = np.linalg.cholesky((1 - rho) * np.eye(len(w)) + rho + 1e-12 * np.eye(len(w)))
        values = np.linalg.eigvalsh(half.T @ kernel @ half)
        return chisq_mixture_p(stat, values[values > 1e-10 * values.max()])

    p = 10.0 ** -np.array([_log10p(float(s * s / k)) for s, k in zip(score, np.diag(kernel), strict=True)])
    total = float(kernel.sum())
    out["burden_p"] = 10.0 ** -_log10p(float(score.sum()) ** 2 / total) if total > 1e-10 else 1.0
    out["skat_p"] = mixed(0.0)
    grid = np.array([mixed(rho) for rho in (0.0, 0.01, 0.04, 0.09, 0.25, 0.5)] + [out["burden_p"]])
    out["skato_p"] = _cauchy(grid, np.ones(len(grid)))
    out["acatv_p"] = _cauchy(p, w * w)
    out["acato_p"] = _cauchy(np.array([out["burden_p"], out["skat_p"], out["acatv_p"]]), np.ones(3))
    return out


def run_set_tests(wide: DataFrame, membership: DataFrame, x: np.ndarray, y: np.ndarray, by: list[str], variant: str = "variant_id", dosages: str = "dosages") -> DataFrame:
    """Set tests of wide genotypes: one row per set. A task holds the dosages of one set; ``x`` and ``y`` are broadcast."""
    shared = wide.sparkSession.sparkContext.broadcast((x, y))
    kinds = {f.name: f.dataType.simpleString() for f in membership.schema}

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        g = np.stack(list(dosage_rows(table.column("dosages").combine_chunks()))).T
        found = set_tests(g, *shared.value)
        return pa.table({k: [v.as_py()] for k, v in zip(by, key, strict=True)} | {k: pa.array([v], pa.int32() if k == "variants" else pa.float64()) for k, v in found.items()})

    rows = wide.select(variant, F.col(dosages).alias("dosages")).join(membership, variant).select(*by, "dosages")
    return rows.groupBy(*by).applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", variants int, burden_p double, skat_p double, skato_p double, acatv_p double, acato_p double")


def conditioned(samples: DataFrame, genotypes: DataFrame, variants: list, variant: str, sample: str = "sample_index", g: str = "g") -> tuple[DataFrame, list[str]]:
    """Samples with the dosages of some variants as covariates (missing: the variant's mean), and the covariates' names."""
    names = [f"given_{i}" for i in range(len(variants))]
    rows = genotypes.where(F.col(variant).isin(variants))
    dosages = rows.groupBy(sample).agg(*(F.max(F.when(F.col(variant) == v, F.col(g))).alias(n) for v, n in zip(variants, names, strict=True)))
    means = dosages.agg(*(F.avg(n).alias(n) for n in names)).first().asDict()
    return samples.join(dosages, sample, "left").fillna({n: means[n] or 0.0 for n in names}), names


def sparse_relationships(parts: list[DataFrame], cut: float = 0.05) -> DataFrame:
    """Parts of a relationship matrix (i, j, value) as one, without values below ``cut``; the diagonal stays."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.where((F.col("value") >= cut) | (F.col("i") == F.col("j")))
