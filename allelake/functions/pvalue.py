"""Tail probabilities as column expressions (Spark has no erf)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the published rational-exponential approximation of erfc, constant term first.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def log_erfc(z: Column) -> Column:
    """Natural logarithm of erfc(z) for z >= 0; no underflow."""
    t = F.lit(1.0) / (F.lit(1.0) + z * F.lit(0.5))
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    return F.log(t) - z * z + poly


def log10p(chisq: Column) -> Column:
    """-log10 of the probability that a chi-square variable of one degree of freedom is larger."""
    return -log_erfc(F.sqrt(chisq * F.lit(0.5))) / F.lit(math.log(10.0))


def p_value(chisq: Column) -> Column:
    """That probability itself."""
    return F.exp(log_erfc(F.sqrt(chisq * F.lit(0.5))))


def log10p_sql(chisq: str) -> str:
    """The same expression for other SQL engines."""
    z, t = f"sqrt(({chisq}) * 0.5e0)", f"(1e0 / (1e0 + sqrt(({chisq}) * 0.5e0) * 0.5e0))"
    poly = f"{ERFC[-1]!r}e0"
    for c in reversed(ERFC[:-1]):
        poly = f"({c!r}e0 + {t} * {poly})"
    return f"(-(ln({t}) - {z} * {z} + {poly}) / {math.log(10.0)!r}e0)"
