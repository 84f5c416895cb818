"""Survival: Cox score tests by risk-set sums, and Cox fits (plain, Firth, ridge path)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelake.functions.pvalue import log10p
from allelake.operators.ordered import risk_sets


def cox_score(table: DataFrame, time: str = "time", status: str = "status", g: str = "g", by: list[str] | None = None) -> DataFrame:
    """Score test of one covariate at zero effect with Breslow's ties: by, events, u, information, chisq, log10p."""
    by = by or []
    x = F.col(g).cast("double")
    at = table.withColumn("_g", x).withColumn("_eg", x * F.col(status))
    sets = risk_sets(at, time, status, {"s1": "_g", "s2": "_g * _g"}, by)
    events = at.groupBy(*by, time).agg(F.sum("_eg").alias("eg"))
    joined = sets.join(events, [*by, time])
    c = F.col
    mean = c("s1") / c("at_risk")
    t = joined.groupBy(*by).agg(F.sum("events").alias("events"), F.sum(c("eg") - c("events") * mean).alias("u"), F.sum(c("events") * (c("s2") / c("at_risk") - mean * mean)).alias("information"))
    chisq = F.when(c("information") > 1e-12, c("u") * c("u") / c("information"))
    return t.select(*by, "events", "u", "information", chisq.alias("chisq"), log10p(chisq).alias("log10p"))


def _ordered(x: np.ndarray, time: np.ndarray, status: np.ndarray):
    order = np.lexsort((-status, -time))  # from the longest time: the risk set is what came before
    x, time, status = x[order], time[order], status[order]
    last = np.searchsorted(-time, -time, "right") - 1  # ties share the risk set
    return x, status.astype(np.float64), last


def cox_likelihood(beta: np.ndarray, x: np.ndarray, status: np.ndarray, last: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Breslow partial log-likelihood, gradient and information of data in order of falling time."""
    eta = np.clip(x @ beta, -500, 500)
    w = np.exp(eta - eta.max())
    s0 = np.cumsum(w)[last]
    s1 = np.cumsum(w[:, None] * x, 0)[last]
    s2 = np.cumsum(w[:, None, None] * x[:, :, None] * x[:, None, :], 0)[last]
    mean = s1 / s0[:, None]
    value = float((status * (eta - eta.max() - np.log(s0))).sum())
    gradient = (status[:, None] * (x - mean)).sum(0)
    information = (status[:, None, None] * (s2 / s0[:, None, None] - mean[:, :, None] * mean[:, None, :])).sum(0)
    return value, gradient, information


def cox_fit(x: np.ndarray, time: np.ndarray, status: np.ndarray, ridge: float = 0.0, firth: bool = False, start: np.ndarray | None = None, rounds: int = 100, tolerance: float = 1e-6, max_step: float = 1.0) -> tuple[np.ndarray, float, bool]:
    """Coefficients, (penalised) log-likelihood and whether it converged, by Newton steps with halving."""
    x, status, last = _ordered(np.asarray(x, np.float64).reshape(len(time), -1), np.asarray(time), np.asarray(status))
    beta = np.zeros(x.shape[1]) if start is None else start.copy()

    def value(b):
        v, g, i = cox_likelihood(b, x, status, last)
        penalty = 0.5 * ridge * float(b @ b)
        return v - penalty + (0.5 * np.linalg.slogdet(i)[1] if firth else 0.0), g - ridge * b, i + ridge * np.eye(len(b))

    now, gradient, information = value(beta)
    for _ in range(rounds):
        if firth:  # the penalty's gradient by central differences
            h = 1e-5
            half = lambda b: 0.5 * np.linalg.slogdet(cox_likelihood(b, x, status, last)[2])[1]
            gradient = gradient + np.array([(half(beta + h * e) - half(beta - h * e)) / (2 * h) for e in np.eye(len(beta))])
        step = np.linalg.pinv(information) @ gradient
        size = np.abs(step).max()
        step *= min(1.0, max_step / max(size, 1e-300))
        for _ in range(30):
            then = value(beta + step)
            if then[0] >= now - 1e-12:
                break
            step /= 2
        beta, (now, gradient, information) = beta + step, then
        if np.abs(step).max() < tolerance:
            return beta, now, True
    return beta, now, False


def cox_ridge_path(x: np.ndarray, time: np.ndarray, status: np.ndarray, count: int = 100, ratio: float = 1e-3) -> list[tuple[float, np.ndarray, float]]:
    """(lambda, coefficients, deviance ratio) from the largest lambda (the gradient at zero) down, each fit from the last."""
    xo, so, last = _ordered(np.asarray(x, np.float64), np.asarray(time), np.asarray(status))
    null, gradient, _ = cox_likelihood(np.zeros(xo.shape[1]), xo, so, last)
    top = max(1e-8, float(np.abs(gradient).max()) * 1e3 / len(time))
    out, beta = [], np.zeros(xo.shape[1])
    for penalty in np.geomspace(top, top * ratio, count):
        beta, _, _ = cox_fit(x, time, status, ridge=float(penalty), start=beta)
        value = cox_likelihood(beta, xo, so, last)[0]
        out.append((float(penalty), beta, 1 - value / null if null else 0.0))
    return out
