"""Set tests, conditional analysis, interactions of all models, and BGEN tools."""

import math

import numpy as np
import pytest

from allelake.operators import binary, gene, linear
from allelake.sources import bgen, bgen_tools
from tests.test_sources import write_bgen


def test_set_tests_under_null_and_alternative():
    rng = np.random.default_rng(1)
    n, m = 500, 8
    p = []
    for i in range(40):
        g = rng.binomial(2, 0.05, (n, m)).astype(float)
        x = np.ones((n, 1))
        found = gene.set_tests(g, x, rng.normal(size=n))
        assert all(0 <= found[k] <= 1 for k in found if k.endswith("_p"))
        p.append([found["skat_p"], found["burden_p"], found["acato_p"]])
    assert (np.mean(p, axis=0) > 0.3).all() and (np.mean(p, axis=0) < 0.7).all()
    y = g @ np.where(np.arange(m) % 2, 1.2, -1.2) + rng.normal(size=n)
    strong = gene.set_tests(g, x, y)
    assert strong["skat_p"] < 1e-6 and strong["skato_p"] < 1e-5 and strong["burden_p"] > strong["skat_p"]
    assert gene.set_tests(np.full((n, 2), 1.0), x, y)["variants"] == 0


def test_one_variant_set_is_the_score_test():
    rng = np.random.default_rng(2)
    g, y = rng.binomial(2, 0.2, (300, 1)).astype(float), rng.normal(size=300)
    found = gene.set_tests(g, np.ones((300, 1)), y, np.ones(1))
    c = np.corrcoef(g[:, 0], y)[0, 1]
    r = y - y.mean()
    chisq = (g[:, 0] @ r) ** 2 / (r @ r / 299 * ((g - g.mean()) ** 2).sum())
    assert math.isclose(chisq, c * c * 299, rel_tol=1e-9)
    expected = math.erfc(math.sqrt(chisq / 2))
    assert math.isclose(found["burden_p"], expected, rel_tol=1e-6) and abs(found["skat_p"] - expected) < 5e-3


def test_sets_on_spark(spark):
    rng = np.random.default_rng(3)
    g = rng.binomial(2, 0.3, (6, 100)).astype(float)
    wide = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(g)], "variant_id string, dosages array<double>")
    members = spark.createDataFrame([("A", "v0"), ("A", "v1"), ("B", "v2"), ("B", "absent")], "set_id string, variant_id string")
    y = rng.normal(size=100)
    got = {r.set_id: r for r in gene.run_set_tests(wide, members, np.ones((100, 1)), y, ["set_id"]).collect()}
    assert math.isclose(got["A"].skat_p, gene.set_tests(g[:2].T, np.ones((100, 1)), y)["skat_p"]) and got["B"].variants == 1


def test_conditioning_removes_a_copy(spark):
    rng = np.random.default_rng(4)
    a = rng.binomial(2, 0.4, 80).astype(float)
    b = rng.binomial(2, 0.4, 80).astype(float)
    y = a + rng.normal(size=80)
    long = spark.createDataFrame([(j, i, float(v[i])) for j, v in enumerate((a, a, b)) for i in range(80)], "v long, sample_index long, g double")
    samples = spark.createDataFrame([(i, float(y[i])) for i in range(80)], "sample_index long, y double")
    with_given, names = gene.conditioned(samples, long, [0], "v")
    got = {r.v: r for r in linear.score_test(long, with_given, ["v"], covariates=names).collect()}
    assert got[1].chisq is None and got[2].chisq is not None


def test_relationships(spark):
    parts = [spark.createDataFrame(x, "i int, j int, value double") for x in ([(0, 0, 0.01), (0, 1, 0.2)], [(1, 2, 0.01)])]
    assert sorted((r.i, r.j) for r in gene.sparse_relationships(parts).collect()) == [(0, 0), (0, 1)]


@pytest.mark.parametrize("model", ["qt", "hlm", "bt", "firth"])
def test_interactions(model):
    rng = np.random.default_rng(5)
    n = 1500
    e, g = rng.normal(size=n), rng.binomial(2, 0.4, n).astype(float)
    eta = 0.3 * g + 0.2 * e + 0.6 * g * e
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(float) if model in ("bt", "firth") else eta + rng.normal(size=n) * np.exp(0.3 * e)
    test = binary.interaction_kernel(y, e, model=model)
    found = test(g)
    assert abs(found["beta"] - 0.6) < 0.3 and found["log10p"] > 3
    assert test(np.ones(n))["beta"] is None and test(np.full(n, np.nan))["n"] == 0


def test_bgen_tools(spark, tmp_path):
    g = np.random.default_rng(6).integers(0, 3, (5, 4)).astype(float)
    a, b = (tmp_path / "a.bgen"), (tmp_path / "b.bgen")
    write_bgen(a, g)
    write_bgen(b, 2 - g)
    out = str(tmp_path / "ab.bgen")
    assert bgen_tools.concatenate([str(a), str(b)], out, free_data=b"note") == 8
    got = np.array([r.dosages for r in bgen.read_bgen(spark, out, 3).orderBy("variant_index").collect()])
    assert np.allclose(got, np.vstack([g.T, (2 - g).T]))
    with pytest.raises(FileExistsError):
        bgen_tools.concatenate([str(a)], out)
    bgen_tools.edit(out, str(tmp_path / "c.bgen"), drop_samples=True)
    with bgen.open_file(str(tmp_path / "c.bgen")) as f:
        h = bgen.read_header(f)
    assert h.sample_names is None and h.free_data == b"note" and h.variants == 8
    lines = [r.value for r in bgen_tools.to_vcf(bgen.read_bgen(spark, str(a))).orderBy("variant_index").collect()]
    assert lines[0].split("\t")[:5] == ["1", "100", "rs0", "A", "G"] and len(lines[0].split("\t")) == 14
