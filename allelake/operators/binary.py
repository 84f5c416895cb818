"""Tests of binary traits, interactions of them, and heteroskedastic models: kernels of one variant each, over Arrow batches.

The null model is fitted once on the samples; its arrays (one number for each sample) are broadcast, and each row of wide
genotypes is tested by itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from allelake.functions.genotype import EPSILON
from allelake.operators.meta import _phi

#: Codes of extra_code: none, Firth did not converge, the logistic fit did not, saddlepoint was used.
NONE, FIRTH_FAILED, LOGISTIC_FAILED = 0, 1, 2


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.clip(0.5 * (1 + np.tanh(x / 2)), EPSILON, 1 - EPSILON)


def logistic_fit(x: np.ndarray, y: np.ndarray, offset: np.ndarray | float = 0.0, firth: bool = False, rounds: int = 100, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray, bool]:
    """Coefficients, their covariance, and whether Newton steps converged; ``firth`` adds half the log determinant."""
    beta = np.zeros(x.shape[1])

    def value(b: np.ndarray) -> float:
        p = sigmoid(x @ b + offset)
        out = float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
        return out + 0.5 * np.linalg.slogdet((x * (p * (1 - p))[:, None]).T @ x)[1] if firth else out

    last = value(beta)
    covariance = np.full((x.shape[1], x.shape[1]), np.nan)
    for _ in range(rounds):
        p = sigmoid(x @ beta + offset)
        w = p * (1 - p)
        covariance = np.linalg.pinv((x * w[:, None]).T @ x)
        residual = y - p
        if firth:
            hat = w * ((x @ covariance) * x).sum(1)
            residual = residual + hat * (0.5 - p)
        score = x.T @ residual
        step = covariance @ score
        size = np.abs(step).max()
        if size > 5:
            step *= 5 / size
        for _ in range(20):  # halve until it doesn't get worse
            now = value(beta + step)
            if now >= last - 1e-12:
                break
            step /= 2
        beta, last = beta + step, now
        if np.abs(step).max() < tolerance:
            return beta, covariance, True
    return beta, covariance, False


def _log10p(chisq: float) -> float:
    """-log10 of the tail of chi-square(1)."""
    z = math.sqrt(max(chisq, 0) / 2)
    if z < 25:
        return -math.log10(max(math.erfc(z), 1e-300))
    return (z * z + math.log(z * math.sqrt(math.pi)) - math.log1p(-1 / (2 * z * z))) / math.log(10)


def saddlepoint_p(g: np.ndarray, mu: np.ndarray, score: float) -> float | None:
    """Two-sided p-value of sum g (y - mu) by the saddlepoint approximation; None if no root is found."""

    def tail(s: float) -> float | None:
        if s * np.sign(s) >= np.abs(g).sum():
            return None
        t = 0.0
        for _ in range(100):
            e = mu * np.exp(np.clip(g * t, -500, 500))
            q = e / (1 - mu + e)
            k1, k2 = float((g * (q - mu)).sum()), float((g * g * q * (1 - q)).sum())
            if k2 <= 0:
                return None
            step = float(np.clip((s - k1) / k2, -5, 5))
            t += step
            if abs(step) < 1e-10 * max(1, abs(t)):
                break
        else:
            return None
        k = float(np.log1p(mu * np.expm1(np.clip(g * t, -500, 500))).sum() - t * (g * mu).sum())
        e = mu * np.exp(np.clip(g * t, -500, 500))
        q = e / (1 - mu + e)
        k2 = float((g * g * q * (1 - q)).sum())
        w2 = 2 * (t * s - k)
        if w2 <= 0 or abs(t) < 1e-8:
            return None
        w, v = math.copysign(math.sqrt(w2), t), t * math.sqrt(k2)
        r = w + math.log(v / w) / w
        return float(0.5 * math.erfc(abs(r) / math.sqrt(2)))

    a, b = tail(abs(score)), tail(-abs(score))
    return None if a is None or b is None else min(1.0, a + b)


def variant_test(g: np.ndarray, x: np.ndarray, y: np.ndarray, mu: np.ndarray, correction: str, threshold: float = 0.05) -> dict:
    """Score test of one variant given the null fit ``mu``; below ``threshold`` it is corrected by Firth or saddlepoint."""
    seen = ~np.isnan(g)
    n = int(seen.sum())
    out: dict = {"a1freq": None, "n": n, "beta": None, "se": None, "chisq": None, "log10p": None, "extra_code": NONE}
    if not n:
        return out
    g = np.where(seen, g, g[seen].mean())
    out["a1freq"] = float(g.mean() / 2)
    w = mu * (1 - mu)
    free = g - x @ (np.linalg.pinv((x * w[:, None]).T @ x) @ (x.T @ (w * g)))
    den, num = float((w * free * free).sum()), float((free * (y - mu)).sum())
    if den <= 1e-12:
        return out
    chisq = num * num / den
    out |= {"beta": num / den, "se": 1 / math.sqrt(den), "chisq": chisq, "log10p": _log10p(chisq)}
    if out["log10p"] < -math.log10(threshold):
        return out
    if correction == "spa":
        p = saddlepoint_p(free, mu, num)
        if p is not None and p > 0:
            out["log10p"] = -math.log10(p)
    elif correction == "firth_approximate":
        offset = np.log(mu / (1 - mu))
        beta, covariance, fine = logistic_fit(free[:, None], y, offset, firth=True)
        if not fine:
            return out | {"extra_code": FIRTH_FAILED}
        null, full = _firth_value(free, y, offset, 0.0), _firth_value(free, y, offset, float(beta[0]))
        lrt = max(0.0, 2 * (full - null))
        out |= {"beta": float(beta[0]), "se": abs(float(beta[0])) / math.sqrt(lrt) if lrt > 0 else float(np.sqrt(covariance[0, 0])), "chisq": lrt, "log10p": _log10p(lrt)}
    return out


def _firth_value(g: np.ndarray, y: np.ndarray, offset: np.ndarray, b: float) -> float:
    p = sigmoid(offset + g * b)
    return float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum() + 0.5 * math.log((g * g * p * (1 - p)).sum()))


def hlm_fit(x: np.ndarray, v: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Heteroskedastic linear model, mean ``x`` alpha and log-variance ``v`` beta: alpha, beta and the objective
    mean(v beta + exp(-v beta) (y - x alpha)^2), by Newton steps on beta with alpha solved anew each time."""
    beta = np.zeros(v.shape[1])

    def alpha_of(b):
        w = np.exp(-np.clip(v @ b, -50, 50))
        return np.linalg.pinv((x * w[:, None]).T @ x) @ ((x * w[:, None]).T @ y)

    def value(b):
        e = y - x @ alpha_of(b)
        s = np.clip(v @ b, -50, 50)
        return float((s + np.exp(-s) * e * e).mean())

    last = value(beta)
    for _ in range(rounds):
        e = y - x @ alpha_of(beta)
        d = np.exp(-np.clip(v @ beta, -50, 50)) * e * e
        gradient = v.T @ (1 - d) / len(y)
        step = np.linalg.pinv((v * np.maximum(d, 1e-12)[:, None]).T @ v / len(y) + 1e-9 * np.eye(v.shape[1])) @ gradient
        size = np.abs(step).max()
        step = -step * min(1.0, 2 / max(size, 1e-300))
        for _ in range(40):
            now = value(beta + step)
            if now <= last:
                break
            step /= 2
        if now > last:
            break
        beta, change, last = beta + step, last - now, now
        if np.abs(step).max() < 1e-9 and change < 1e-12:
            break
    return alpha_of(beta), beta, last


def dosage_rows(column: pa.ListArray) -> Iterator[np.ndarray]:
    """Dosages of each variant (nan: missing), straight from the array's flat buffer."""
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield values[a:b].astype(np.float64)


def over_variants(wide: DataFrame, kernel: Callable[..., dict], schema: str, keep: list[str], dosages: str = "dosages", given: list[str] | None = None) -> DataFrame:
    """One row per variant: the columns ``keep`` and the fields of ``kernel(dosages, *values of the columns given)``;
    dosages may be null (missing)."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    kinds = {f.name: f.dataType.simpleString() for f in wide.schema}

    def run(batches):
        for batch in batches:
            others = [batch.column(c).to_pylist() for c in given or []]
            rows = [kernel(x, *more) for x, *more in zip(dosage_rows(batch.column(dosages)), *others, strict=True)]
            yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in keep} | {k: pa.array([r.get(k) for r in rows], _ARROW[kind]) for k, kind in zip(names, (x.strip().split(" ")[1] for x in schema.split(",")), strict=True)})

    return wide.select(*keep, dosages).mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keep), schema]))


_ARROW = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
RESULT = "a1freq double, n int, beta double, se double, chisq double, log10p double, extra_code int"


def binary_test(wide: DataFrame, y: np.ndarray, covariates: np.ndarray | None, keep: list[str], correction: str = "firth_approximate", threshold: float = 0.05) -> DataFrame:
    """Binary-trait tests of wide genotypes; ``y`` and ``covariates`` are in the dosages' sample order."""
    x = np.column_stack([np.ones(len(y)), *([covariates] if covariates is not None else [])])
    null, _, fine = logistic_fit(x, y)
    if not fine:
        raise ValueError("the null logistic model does not converge")
    shared = wide.sparkSession.sparkContext.broadcast((x, y, sigmoid(x @ null)))
    return over_variants(wide, lambda g: variant_test(g, *shared.value, correction, threshold), RESULT, keep)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return _phi(x)


def interaction_kernel(y: np.ndarray, exposure: np.ndarray, covariates: np.ndarray | None = None, model: str = "qt") -> Callable[[np.ndarray], dict]:
    """Test of dosage x exposure for one variant under a linear (qt), heteroskedastic (hlm), logistic (bt) or Firth model."""
    base = np.column_stack([np.ones(len(y)), exposure, *([covariates] if covariates is not None else [])])

    def test(g: np.ndarray) -> dict:
        seen = ~np.isnan(g)
        out: dict = {"n": int(seen.sum()), "beta": None, "se": None, "chisq": None, "log10p": None, "extra_code": NONE}
        if not seen.any():
            return out
        g = np.where(seen, g, g[seen].mean())
        x = np.column_stack([base, g, g * exposure])
        if np.linalg.matrix_rank(x) < x.shape[1]:
            return out
        if model in ("bt", "firth"):
            b, cov, fine = logistic_fit(x, y, firth=model == "firth")
            if not fine:
                return out | {"extra_code": FIRTH_FAILED if model == "firth" else LOGISTIC_FAILED}
        else:
            weight = np.ones(len(y))
            if model == "hlm":
                _, variance, _ = hlm_fit(base, np.column_stack([np.ones(len(y)), exposure]), y)
                weight = np.exp(-np.clip(np.column_stack([np.ones(len(y)), exposure]) @ variance, -50, 50))
            inverse = np.linalg.inv((x * weight[:, None]).T @ x)
            b = inverse @ ((x * weight[:, None]).T @ y)
            e = y - x @ b
            cov = inverse * float((weight * e * e).sum() / (len(y) - x.shape[1]))
        se = math.sqrt(cov[-1, -1])
        chisq = float(b[-1] / se) ** 2
        return out | {"beta": float(b[-1]), "se": se, "chisq": chisq, "log10p": _log10p(chisq)}

    return test


INTERACTION = "n int, beta double, se double, chisq double, log10p double, extra_code int"
