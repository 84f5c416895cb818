"""Combining tests: inverse-variance meta-analysis, ACAT, and sums of chi-squares."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelake.functions.pvalue import log10p


def inverse_variance(results: DataFrame, by: list[str], beta: str = "beta", se: str = "se") -> DataFrame:
    """Fixed-effect meta-analysis over cohorts: by, cohorts, beta, se, chisq, log10p."""
    b, w = F.col(beta), 1 / (F.col(se) * F.col(se))
    t = results.where((F.col(se) > 0) & b.isNotNull()).groupBy(*by).agg(F.count("*").alias("cohorts"), F.sum(b * w).alias("bw"), F.sum(w).alias("w"))
    c = F.col
    chisq = c("bw") * c("bw") / c("w")
    return t.select(*by, "cohorts", (c("bw") / c("w")).alias("beta"), F.sqrt(1 / c("w")).alias("se"), chisq.alias("chisq"), log10p(chisq).alias("log10p"))


def acat(p: Column, weight: Column) -> Column:
    """P-value of a Cauchy combination, an aggregate; p near 0 by the tangent's limit, so that nothing overflows."""
    term = F.when(p < 1e-15, 1 / (p * F.lit(math.pi))).otherwise(F.tan((F.lit(0.5) - p) * F.lit(math.pi)))
    t = F.sum(weight * term) / F.sum(weight)
    return F.when(t > 1e15, 1 / (t * F.lit(math.pi))).otherwise(F.lit(0.5) - F.atan(t) / F.lit(math.pi))


def skat_q(score: Column, weight: Column) -> Column:
    """SKAT statistic of a set's variant scores, an aggregate."""
    return F.sum(weight * weight * score * score)


def chisq_mixture_p(q: float, weights: np.ndarray, points: int = 20_000) -> float:
    """P(sum of weights x chi-square(1) > q) by inverting the characteristic function (Imhof's integral)."""
    weights = np.asarray(weights, np.float64)
    weights = weights[np.abs(weights) > 1e-14]
    if not len(weights):
        return float(q < 0)
    scale = np.abs(weights).max()
    w, x = weights / scale, q / scale
    # The integrand falls as u^-(1 + n/2): cut where the bound on the rest is below 1e-9, 2000 at most.
    top = min(2000.0, max(30.0, (1e-9 * math.pi * len(w) / 2 * np.prod(np.sqrt(np.abs(w)))) ** (-2 / len(w))))
    edges = np.concatenate([[0], np.geomspace(1e-4, top, points // 8)])
    nodes, weight = np.polynomial.legendre.leggauss(8)
    u = ((edges[1:] + edges[:-1])[:, None] + np.diff(edges)[:, None] * nodes) / 2
    theta = 0.5 * np.arctan(w * u[..., None]).sum(-1) - 0.5 * x * u
    rho = np.exp(0.25 * np.log1p((w * u[..., None]) ** 2).sum(-1))
    value = (np.sin(theta) / (u * rho) * weight).sum(1) @ (np.diff(edges) / 2)
    return float(min(1.0, max(0.0, 0.5 + value / math.pi)))


def normal_orthant(lower: np.ndarray, covariance: np.ndarray, points: int = 20_000) -> tuple[float, float]:
    """P(every component > its bound) of a centred normal vector, and an error estimate (Genz's separation of variables
    with a randomly shifted lattice, seeded)."""
    lower, covariance = np.asarray(lower, np.float64), np.asarray(covariance, np.float64)
    n = len(lower)
    try:
        chol = np.linalg.cholesky(covariance)
    except np.linalg.LinAlgError as e:
        raise ValueError("the covariance must be positive definite") from e
    rng, values = np.random.default_rng(5), []
    step = np.sqrt(np.array([2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71][: max(1, n - 1)]))
    if n - 1 > len(step):
        raise ValueError("at most 21 components")
    for _ in range(12):
        shift = rng.random(len(step))
        z = np.abs(2 * ((np.arange(1, points // 12 + 1)[:, None] * step + shift) % 1) - 1)
        y, product = np.zeros((len(z), n)), np.ones(len(z))
        for i in range(n):
            d = _phi((lower[i] - (y[:, :i] @ chol[i, :i])) / chol[i, i])
            product = product * (1 - d)
            if i < n - 1:
                y[:, i] = _phi_inverse(np.clip(d + z[:, i] * (1 - d), 1e-16, 1 - 1e-16))
        values.append(product.mean())
    return float(np.mean(values)), float(3 * np.std(values) / math.sqrt(len(values)))


_erf = np.vectorize(math.erf, otypes=[float])


def _phi(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(np.asarray(x) / math.sqrt(2)))


def _phi_inverse(p: np.ndarray) -> np.ndarray:
    """Normal quantile by Newton steps from the logistic approximation."""
    x = np.log(p / (1 - p)) / 1.702
    for _ in range(8):
        x = x - np.clip((_phi(x) - p) / np.maximum(np.exp(-x * x / 2) / math.sqrt(2 * math.pi), 1e-300), -1, 1)
    return x
