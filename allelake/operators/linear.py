"""Score tests of quantitative traits.

Everything a variant needs is a sum over samples, so a variant's test is one aggregation with map-side combination, and
the rest is arithmetic on its sums: with X = [1, covariates], A = X'X, u = X'g and r the trait's residual on X,
num = g'r, den = g'g - u'inv(A)u, sigma2 = r'r / (N - columns of X). Only A and X'y, a few numbers, go to the driver.
Missing dosages count as the variant's mean, which needs the sums over its observed samples alone.

Dosages, traits and covariates that are all integers or decimals are summed as such, exactly, so the result doesn't depend
on the order in which partitions are added; floating-point ones are centred first, which keeps their precision.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelake.functions.pvalue import log10p

TINY = 1e-9


def statistics(num: Column, den: Column, sigma2: Column) -> dict[str, Column]:
    """beta, se, chisq and log10p; null where the dosage has no variance left."""
    fine = den > TINY
    chisq = num * num / (sigma2 * den)
    return {"beta": F.when(fine, num / den), "se": F.when(fine, F.sqrt(sigma2 / den)), "chisq": F.when(fine, chisq), "log10p": F.when(fine, log10p(chisq))}


def _exact(*fields: T.StructField) -> bool:
    return all(isinstance(f.dataType, (T.IntegralType, T.DecimalType)) for f in fields)


def null_model(samples: DataFrame, traits: list[str], covariates: list[str]) -> dict:
    """Gram matrix and trait sums of the samples: (1 + covariates) squared numbers for each trait."""
    exact = _exact(*(samples.schema[c] for c in (*traits, *covariates)))
    number = (lambda c: F.col(c)) if exact else (lambda c: F.col(c).cast("double"))
    x = [F.lit(1) if exact else F.lit(1.0), *(number(c) for c in covariates)]
    sums = {f"a{i}_{j}": F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))}
    for t in traits:
        y = number(t)
        sums |= {f"{t}|b{i}": F.sum(x[i] * y) for i in range(len(x))} | {f"{t}|yy": F.sum(y * y)}
    row = samples.agg(*(v.alias(k) for k, v in sums.items())).first().asDict()
    row = {k: float(v or 0) for k, v in row.items()}
    k = len(x)
    a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    inverse, n, out = np.linalg.pinv(a), a[0, 0], {}
    for t in traits:
        b = np.array([row[f"{t}|b{i}"] for i in range(k)])
        effect = inverse @ b
        out[t] = {"effect": effect, "sigma2": float((row[f"{t}|yy"] - b @ effect) / max(1.0, n - k))}
    return {"n": int(n), "inverse": inverse, "totals": a[0], "traits": out}


def score_test(genotypes: DataFrame, samples: DataFrame, by: list[str], trait: str = "y", covariates: list[str] | None = None, sample: str = "sample_index", g: str = "g", model: dict | None = None) -> DataFrame:
    """One row per variant: ``by``, a1freq, n (observed), beta, se, chisq, log10p.

    ``genotypes`` (by, sample, g) are long; ``samples`` (sample, trait, covariates) are aligned and hold no null. Samples
    that a variant has no row for count as missing, as null dosages do.
    """
    covariates = covariates or []
    model = model or null_model(samples, [trait], covariates)
    null = model["traits"][trait]
    joined = genotypes.join(samples.select(sample, trait, *covariates), sample)
    exact = _exact(genotypes.schema[g], *(samples.schema[c] for c in (trait, *covariates)))
    number = (lambda c: F.col(c)) if exact else (lambda c: F.col(c).cast("double"))
    v, y = number(g), number(trait)
    x = [F.lit(1) if exact else F.lit(1.0), *(number(c) for c in covariates)]
    seen = F.when(v.isNotNull(), x[0])
    fitted = lambda parts: sum((F.lit(float(e)) * part for e, part in zip(null["effect"], parts, strict=True)), F.lit(0.0))
    target = y if exact else y - fitted(x)
    sums = {"s1": F.sum(v), "s2": F.sum(v * v), "sr": F.sum(v * target), "mr": F.sum(seen * target)}
    for i in range(len(x)):
        sums |= {f"u{i}": F.sum(v * x[i]), f"m{i}": F.sum(seen * x[i])}
    t = joined.groupBy(*by).agg(F.count(v).alias("n"), *(e.cast("double").alias(k) for k, e in sums.items())).where("n > 0")
    c = F.col
    if exact:
        t = t.withColumns({"sr": c("sr") - fitted([c(f"u{i}") for i in range(len(x))]), "mr": c("mr") - fitted([c(f"m{i}") for i in range(len(x))])})
    mean, gone = c("s1") / c("n"), F.lit(float(model["n"])) - c("n")
    u = [c(f"u{i}") + mean * (F.lit(float(model["totals"][i])) - c(f"m{i}")) for i in range(len(x))]
    quad = sum((F.lit(float(model["inverse"][i, j])) * u[i] * u[j] for i in range(len(x)) for j in range(len(x))), F.lit(0.0))
    # Residuals sum to nought over all samples, so over the unseen ones to minus the sum of the seen ones.
    num = c("sr") - mean * c("mr")
    den = c("s2") + mean * mean * gone - quad
    tests = statistics(F.col("_num"), F.col("_den"), F.lit(null["sigma2"]))
    out = t.select(*by, (mean / 2).alias("a1freq"), c("n").cast("int").alias("n"), num.alias("_num"), den.alias("_den"))
    return out.select(*by, "a1freq", "n", *(e.alias(k) for k, e in tests.items()))


def score_test_loco(genotypes: DataFrame, samples: DataFrame, predictions: DataFrame, by: list[str], trait: str = "y", sample: str = "sample_index", chrom: str = "chrom", g: str = "g") -> DataFrame:
    """Score test in which each chromosome's variants are tested on the trait less the prediction made without it.

    ``predictions`` (sample, chrom, loco_pred). The null model is [1]; centred sums of each chromosome are joined back.
    """
    y = samples.select(sample, F.col(trait).cast("double").alias("_y")).join(predictions, sample).select(sample, chrom, (F.col("_y") - F.col("loco_pred")).alias("r"))
    rows = genotypes.where(F.col(g).isNotNull()).join(y, [sample, chrom])
    v = F.col(g).cast("double")
    keys = list(dict.fromkeys([chrom, *by]))
    t = rows.groupBy(*keys).agg(F.regr_sxy("r", v).alias("_num"), F.regr_sxx("r", v).alias("_den"), F.regr_syy("r", v).alias("_yy"), F.count(v).alias("n"), (F.avg(v) / 2).alias("a1freq"))
    tests = statistics(F.col("_num"), F.col("_den"), F.col("_yy") / (F.col("n") - 1))
    return t.select(*keys, "a1freq", F.col("n").cast("int").alias("n"), *(e.alias(k) for k, e in tests.items()))


def score_test_traits(genotypes: DataFrame, samples: DataFrame, traits: list[str], by: list[str], sample: str = "sample_index", g: str = "g") -> DataFrame:
    """Score tests of several traits in one pass over the genotypes: by, trait, n, beta, se, chisq, log10p."""
    rows = genotypes.where(F.col(g).isNotNull()).join(samples.select(sample, *traits), sample)
    v = F.col(g).cast("double")
    sums = [F.struct(F.lit(t).alias("trait"), F.regr_sxy(F.col(t).cast("double"), v).alias("num"), F.regr_sxx(F.col(t).cast("double"), v).alias("den"), F.regr_syy(F.col(t).cast("double"), v).alias("yy"), F.regr_count(F.col(t).cast("double"), v).alias("n")) for t in traits]
    t = rows.groupBy(*by).agg(F.array(*sums).alias("all")).select(*by, F.explode("all").alias("x")).select(*by, "x.*")
    tests = statistics(F.col("num"), F.col("den"), F.col("yy") / (F.col("n") - 1))
    return t.select(*by, "trait", F.col("n").cast("int").alias("n"), *(e.alias(k) for k, e in tests.items()))


def interaction_test(genotypes: DataFrame, samples: DataFrame, exposure: str, by: list[str], trait: str = "y", sample: str = "sample_index", g: str = "g") -> DataFrame:
    """Effect of dosage x exposure in the model [1, g, e, g e]: by, n, beta_gxe, se_gxe, chisq.

    Frisch-Waugh in closed form: the 2 x 2 system of g and e is eliminated from the product's sums.
    """
    rows = genotypes.where(F.col(g).isNotNull()).join(samples.select(sample, trait, exposure), sample)
    v, e, y = F.col(g).cast("double"), F.col(exposure).cast("double"), F.col(trait).cast("double")
    p = v * e
    names, values = ["g", "e", "p", "y"], [v, e, p, y]
    sums = [F.count(v).alias("n")]
    for i in range(4):
        sums.append(F.sum(values[i]).alias(f"s_{names[i]}"))
        for j in range(i, 4):
            sums.append(F.sum(values[i] * values[j]).alias(f"q_{names[i]}{names[j]}"))
    t, c = rows.groupBy(*by).agg(*sums), F.col
    s = lambda a, b: c(f"q_{a}{b}") - c(f"s_{a}") * c(f"s_{b}") / c("n")
    for a, b in ("gg", "ge", "gp", "gy", "ee", "ep", "ey", "pp", "py", "yy"):
        t = t.withColumn(f"c{a}{b}", s(a, b))
    det = c("cgg") * c("cee") - c("cge") * c("cge")
    solve = lambda a, b: ((c("cee") * c(f"cg{a}") - c("cge") * c(f"{'ce' + a}")) * c(f"cg{b}") + (c("cgg") * c(f"ce{a}") - c("cge") * c(f"cg{a}")) * c(f"ce{b}")) / det
    t = t.withColumn("dpp", c("cpp") - solve("p", "p")).withColumn("dpy", c("cpy") - solve("p", "y")).withColumn("dyy", c("cyy") - solve("y", "y"))
    beta = c("dpy") / c("dpp")
    sigma2 = (c("dyy") - beta * c("dpy")) / (c("n") - 4)
    return t.select(*by, c("n").cast("int").alias("n"), beta.alias("beta_gxe"), F.sqrt(sigma2 / c("dpp")).alias("se_gxe"), (beta * beta * c("dpp") / sigma2).alias("chisq"))
