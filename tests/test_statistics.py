"""Kernels against numpy or closed forms, and metamorphic properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelake.functions import genotype as G
from allelake.functions.pvalue import log10p
from allelake.operators import binary, ld, linear, meta, survival

RNG = np.random.default_rng(3)


def test_log10p(spark):
    x = [0.0, 0.1, 1.0, 3.84, 30.0, 500.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(log10p(F.col("x"))).collect()]
    assert np.allclose(got, [-math.log10(math.erfc(math.sqrt(v / 2))) for v in x], rtol=1e-6, atol=1e-6)


def long_table(spark, g, y, c):
    rows = [(j, i, float(g[i, j]) if not np.isnan(g[i, j]) else None) for i in range(g.shape[0]) for j in range(g.shape[1])]
    return spark.createDataFrame(rows, "v long, sample_index long, g double"), spark.createDataFrame([(i, float(y[i]), *map(float, c[i])) for i in range(len(y))], "sample_index long, y double, a double, b double")


def reference(g, y, c):
    x = np.column_stack([np.ones(len(y)), c])
    q, _ = np.linalg.qr(x)
    r = y - q @ (q.T @ y)
    s2 = r @ r / (len(y) - x.shape[1])
    out = []
    for j in range(g.shape[1]):
        v = np.where(np.isnan(g[:, j]), np.nanmean(g[:, j]), g[:, j])
        den = v @ v - ((q.T @ v) ** 2).sum()
        out.append((v @ r / den, (v @ r) ** 2 / (s2 * den)))
    return np.array(out)


def test_score_with_covariates_and_missing(spark):
    n = 80
    g = RNG.integers(0, 3, (n, 5)).astype(float)
    g[RNG.random(g.shape) < 0.1] = np.nan
    c = RNG.normal(size=(n, 2))
    y = c @ [0.5, -1] + np.nan_to_num(g[:, 1]) + RNG.normal(size=n)
    long, samples = long_table(spark, g, y, c)
    run = lambda t: np.array(linear.score_test(t, samples, ["v"], covariates=["a", "b"]).orderBy("v").select("beta", "chisq").toPandas())
    assert np.allclose(run(long), reference(g, y, c), rtol=1e-9)
    assert np.allclose(run(long.where("g is not null")), reference(g, y, c), rtol=1e-9)  # absent rows are missing ones
    flipped = run(long.withColumn("g", 2 - F.col("g")))
    assert np.allclose(flipped[:, 0], -reference(g, y, c)[:, 0]) and np.allclose(flipped[:, 1], reference(g, y, c)[:, 1])


def test_interaction(spark):
    n = 60
    g, e = RNG.integers(0, 3, n).astype(float), RNG.normal(size=n)
    y = g + e + 0.7 * g * e + RNG.normal(size=n)
    x = np.column_stack([np.ones(n), g, e, g * e])
    b, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
    se = math.sqrt(rss[0] / (n - 4) * np.linalg.inv(x.T @ x)[3, 3])
    long = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(g)], "v long, sample_index long, g double")
    samples = spark.createDataFrame([(i, float(y[i]), float(e[i])) for i in range(n)], "sample_index long, y double, e double")
    r = linear.interaction_test(long, samples, "e", ["v"]).first()
    assert np.allclose([r.beta_gxe, r.se_gxe], [b[3], se])


def test_probability_and_loglikelihood(spark):
    e = G.EPSILON
    r = spark.createDataFrame([(0.0,), (100.0,), (-100.0,)], "x double").select(G.probability(F.col("x"))).collect()
    assert np.allclose([v[0] for v in r], [0.5, 1 - e, e], rtol=1e-5)
    t = spark.createDataFrame([(1, 0.5), (1, 0.8), (0, 0.2)], "y int, p double").agg(G.log_likelihood(F.col("y"), F.col("p"))).first()[0]
    assert math.isclose(t, math.log(0.5) + 2 * math.log(0.8), rel_tol=1e-9)
    t = spark.createDataFrame([(1, 0.0), (0, 1.0), (1, 0.5)], "y int, p double").agg(G.log_likelihood(F.col("y"), F.col("p"))).first()[0]
    assert math.isclose(t, 2 * math.log(e) + math.log(0.5), rel_tol=1e-5)


def test_dosage_arity(spark):
    t = spark.createDataFrame([([0.1, 0.2, 0.7],)], "p array<double>")
    assert math.isclose(t.select(G.dosage(F.col("p"), False)).first()[0], 1.6)
    with pytest.raises(Exception, match="4 probabilities"):
        t.select(G.dosage(F.col("p"), True)).collect()


def test_firth_is_finite_under_separation():
    g = np.array([0.0] * 20 + [1.0] * 20)
    y = (g > 0).astype(float)
    b, _, fine = binary.logistic_fit(np.column_stack([np.ones(40), g]), y, firth=True)
    assert fine and 3 < b[1] < 12


def test_binary_test_agrees_with_plain_fit():
    n = 400
    g = RNG.integers(0, 3, n).astype(float)
    y = (RNG.random(n) < 1 / (1 + np.exp(0.8 - 0.5 * g))).astype(float)
    x = np.ones((n, 1))
    b0, _, _ = binary.logistic_fit(x, y)
    mu = binary.sigmoid(x @ b0)
    plain, _, _ = binary.logistic_fit(np.column_stack([x, g]), y)
    firth = binary.variant_test(g, x, y, mu, "firth_approximate", 0.9)
    assert abs(firth["beta"] - plain[1]) < 0.05
    score, spa = binary.variant_test(g, x, y, mu, "none"), binary.variant_test(g, x, y, mu, "spa", 0.9)
    assert abs(score["log10p"] - spa["log10p"]) < 0.3
    assert binary.variant_test(np.full(n, np.nan), x, y, mu, "spa")["n"] == 0


def test_hlm_finds_the_variance():
    n = 3000
    e = RNG.normal(size=n)
    y = 1 + 2 * e + RNG.normal(size=n) * np.exp(0.5 * (0.3 + 0.8 * e))
    alpha, beta, _ = binary.hlm_fit(np.column_stack([np.ones(n), e]), np.column_stack([np.ones(n), e]), y)
    assert np.allclose(alpha, [1, 2], atol=0.1) and np.allclose(beta, [0.3, 0.8], atol=0.1)


def test_cox():
    n = 300
    g = RNG.integers(0, 3, n).astype(float)
    time = np.ceil(RNG.exponential(1 / np.exp(0.6 * g)) * 20)
    status = (RNG.random(n) < 0.8).astype(int)
    b, value, fine = survival.cox_fit(g[:, None], time, status)
    assert fine and 0.2 < b[0] < 1.0
    x, s, last = survival._ordered(g[:, None], time, status)
    for h in (-1e-3, 1e-3):
        assert survival.cox_likelihood(b + h, x, s, last)[0] < value
    # The risk sets by brute force.
    _, u, i = survival.cox_likelihood(np.zeros(1), x, s, last)
    bu = sum(g[k] - g[time >= time[k]].mean() for k in range(n) if status[k])
    bi = sum(g[time >= time[k]].var() for k in range(n) if status[k])
    assert np.allclose([u[0], i[0, 0]], [bu, bi])
    path = survival.cox_ridge_path(g[:, None], time, status, 20, 1e-6)
    assert abs(path[0][1][0]) < abs(path[-1][1][0]) and np.isclose(path[-1][1][0], b[0], atol=1e-2)
    assert survival.cox_fit(g[:, None], time, status, firth=True)[2]


def test_cox_score_by_sql_window(spark):
    t = spark.createDataFrame([(5, 1, 1.0), (5, 1, 0.0), (7, 0, 2.0), (9, 1, 1.0)], "time long, status int, g double")
    r = survival.cox_score(t).first()
    means = [1.0, 1.0, 1.0]
    assert r.events == 3 and math.isclose(r.u, (1 - means[0]) + (0 - means[1]) + (1 - 1.0), abs_tol=1e-12)
    assert math.isclose(r.information, 2 * np.var([1, 0, 2, 1]), rel_tol=1e-12)


def test_mixture_and_orthant():
    assert abs(meta.chisq_mixture_p(3.841, np.array([1.0])) - 0.05) < 2e-3
    assert abs(meta.chisq_mixture_p(5.991, np.array([1.0, 1.0])) - 0.05) < 1e-4
    assert abs(meta.chisq_mixture_p(4 * 9.488, np.array([4.0] * 4)) - 0.05) < 1e-4
    p, error = meta.normal_orthant(np.zeros(2), np.array([[1, 0.5], [0.5, 1]]))
    assert abs(p - 1 / 3) < 2e-3 and error < 0.01
    with pytest.raises(ValueError):
        meta.normal_orthant(np.zeros(2), np.ones((2, 2)))


def test_acat(spark):
    t = spark.createDataFrame([(1, 0.3), (1, 0.3), (2, 1e-20), (2, 0.5)], "k int, p double").groupBy("k").agg(meta.acat(F.col("p"), F.lit(1.0)).alias("p")).orderBy("k").collect()
    assert math.isclose(t[0].p, 0.3, rel_tol=1e-9) and math.isclose(t[1].p, 2e-20, rel_tol=1e-6)


def test_pruning_keeps_one_of_equal_variants(spark):
    g = RNG.integers(0, 3, 50).astype(float).tolist()
    h = RNG.integers(0, 3, 50).astype(float).tolist()
    wide = spark.createDataFrame([("1", 0, g), ("1", 1, g), ("1", 2, h), ("2", 3, g), ("1", 4, [1.0] * 50)], "chrom string, variant_index long, dosages array<double>")
    assert sorted(r.variant_index for r in ld.prune(wide, window=10, step=5).collect()) == [0, 2, 3]
