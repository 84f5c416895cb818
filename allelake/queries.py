"""Queries over the driver's tables, and the SQL that gives the same rows.

Roles of the tables: embeddings are genotypes (element = variant, 16 to a chromosome; vec_id = sample; value = dosage) with
label as trait; lineitem holds long genotypes (l_partkey = variant, dosage from l_discount); part holds variants with
positions (p_partkey); nation and region hold regions; orders and customer are aligned as samples; documents with labels
are survival data, where a document without label is a missing observation; events are an ordered index.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelake.functions import genotype as G
from allelake.functions.pvalue import log10p, log10p_sql, p_value
from allelake.operators import align, binary, chunks, ld, linear, meta, ordered, ranges, sets, survival, variant_stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def embedded_genotypes(spark: SparkSession, d: str) -> DataFrame:
    """(variant_index, chrom, sample_index, g) of embeddings."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_index"), F.posexplode("embedding").alias("variant_index", "g"))
    return e.select(F.col("variant_index").cast("long").alias("variant_index"), F.floor(F.col("variant_index") / 16).cast("string").alias("chrom"), "sample_index", F.col("g").cast("double").alias("g"))


def embedded_samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_index"), F.col("label").cast("double").alias("y"), (F.col("vec_id") % 7).cast("double").alias("c"), (F.col("label") >= 5).cast("int").alias("case"))


def item_genotypes(spark: SparkSession, d: str) -> DataFrame:
    """(variant, sample, g, cohort, y) of lineitem."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("variant"), F.col("l_orderkey").alias("sample"), (F.round(F.col("l_discount") * 100).cast("int") % 3).alias("g"), F.col("l_linestatus").alias("cohort"), F.col("l_quantity").alias("y"))


#: The same, as SQL.
EMB = "e AS (SELECT vec_id AS s, label, CAST(unnest(range(0, len(embedding))) AS BIGINT) AS v, CAST(unnest(embedding) AS DOUBLE) AS g FROM embeddings)"
ITEM = "i AS (SELECT l_partkey AS variant, l_orderkey AS sample, CAST(round(l_discount * 100) AS INT) % 3 AS g, l_linestatus AS cohort, l_quantity AS y FROM lineitem)"
DOCS = "dl AS (SELECT d.doc_id, d.n_chars AS time, l.quality AS g, l.toxic AS toxic, d.source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def _tests(num: str, den: str, sigma2: str) -> str:
    chisq = f"(({num}) * ({num}) / (({sigma2}) * ({den})))"
    return f"round(({num}) / ({den}), 6) AS beta, round(sqrt(({sigma2}) / ({den})), 6) AS se, round({chisq}, 6) AS chisq, round({log10p_sql(chisq)}, 6) AS log10p"


STATS = ("a1freq", "beta", "se", "chisq", "log10p")


@query(f"""WITH {EMB}, t AS (SELECT v, count(g) AS n, avg(g) / 2 AS f, regr_sxy(label, g) AS xy, regr_sxx(label, g) AS xx, regr_syy(label, g) AS yy FROM e GROUP BY v)
SELECT v AS variant_index, CAST(v // 16 AS VARCHAR) AS chrom, round(f, 6) AS a1freq, CAST(n AS INT) AS n, {_tests("xy", "xx", "yy / (n - 1)")} FROM t""")
def assoc_score_intercept(spark, d):
    """Score test of every variant with an intercept alone."""
    out = linear.score_test(embedded_genotypes(spark, d), embedded_samples(spark, d), ["variant_index", "chrom"])
    return rounded(out, *STATS)


@query(f"""WITH {EMB}, t AS (SELECT v, count(g) AS n, avg(g) / 2 AS f, covar_pop(g, label) * count(*) AS gy, var_pop(g) * count(*) AS gg, var_pop(label) * count(*) AS yy,
  covar_pop(g, s % 7) * count(*) AS gc, covar_pop(s % 7, label) * count(*) AS cy, var_pop(s % 7) * count(*) AS cc FROM e GROUP BY v)
SELECT v AS variant_index, round(f, 6) AS a1freq, CAST(n AS INT) AS n, {_tests("gy - gc * cy / cc", "gg - gc * gc / cc", "(yy - cy * cy / cc) / (n - 2)")} FROM t""")
def assoc_score_covariate(spark, d):
    """Score test with a covariate."""
    out = linear.score_test(embedded_genotypes(spark, d), embedded_samples(spark, d), ["variant_index"], covariates=["c"])
    return rounded(out, *STATS)


@query(f"""WITH {EMB}, m AS (SELECT s, v, label, CASE WHEN (s + v) % 11 = 0 THEN NULL ELSE g END AS g FROM e), a AS (SELECT v, avg(g) AS mean, count(g) AS n FROM m GROUP BY v),
f AS (SELECT m.v, a.n, a.mean, coalesce(m.g, a.mean) AS g, label FROM m JOIN a ON m.v = a.v),
t AS (SELECT v, any_value(n) AS n, any_value(mean) AS mean, regr_sxy(label, g) AS xy, regr_sxx(label, g) AS xx, regr_syy(label, g) AS yy, count(*) AS c FROM f GROUP BY v)
SELECT v AS variant_index, round(mean / 2, 6) AS a1freq, CAST(n AS INT) AS n, {_tests("xy", "xx", "yy / (c - 1)")} FROM t""")
def assoc_score_missing(spark, d):
    """Score test with missing dosages taken as the variant's mean."""
    g = embedded_genotypes(spark, d).withColumn("g", F.when((F.col("sample_index") + F.col("variant_index")) % 11 != 0, F.col("g")))
    return rounded(linear.score_test(g, embedded_samples(spark, d), ["variant_index"]), *STATS)


@query(f"""WITH {EMB}, p AS (SELECT s, c, 0.1e0 * (sum(total) OVER (PARTITION BY s) - total) AS pred FROM (SELECT s, v // 16 AS c, sum(g) AS total FROM e GROUP BY s, v // 16)),
r AS (SELECT e.v, e.g, e.label - p.pred AS r FROM e JOIN p ON e.s = p.s AND e.v // 16 = p.c),
t AS (SELECT v, count(g) AS n, avg(g) / 2 AS f, regr_sxy(r, g) AS xy, regr_sxx(r, g) AS xx, regr_syy(r, g) AS yy FROM r GROUP BY v)
SELECT CAST(v // 16 AS VARCHAR) AS chrom, v AS variant_index, round(f, 6) AS a1freq, CAST(n AS INT) AS n, {_tests("xy", "xx", "yy / (n - 1)")} FROM t""")
def assoc_score_loco(spark, d):
    """Score test on the trait less a prediction from the other chromosomes."""
    g = embedded_genotypes(spark, d)
    sums = g.groupBy("sample_index", "chrom").agg(F.sum("g").alias("total"))
    whole = g.groupBy("sample_index").agg(F.sum("g").alias("whole"))
    predictions = sums.join(whole, "sample_index").select("sample_index", "chrom", (F.lit(0.1) * (F.col("whole") - F.col("total"))).alias("loco_pred"))
    return rounded(linear.score_test_loco(g, embedded_samples(spark, d), predictions, ["variant_index"]), *STATS)


_TRAITS = "SELECT v, {0!r} AS trait, count(g) AS n, regr_sxy({1}, g) AS xy, regr_sxx({1}, g) AS xx, regr_syy({1}, g) AS yy FROM e GROUP BY v"


@query(f"""WITH {EMB}, t AS ({_TRAITS.format("y", "label")} UNION ALL {_TRAITS.format("c", "(s % 7)")})
SELECT v AS variant_index, trait, CAST(n AS INT) AS n, {_tests("xy", "xx", "yy / (n - 1)")} FROM t""")
def assoc_multi_trait(spark, d):
    """Two traits in one pass."""
    out = linear.score_test_traits(embedded_genotypes(spark, d), embedded_samples(spark, d), ["y", "c"], ["variant_index"])
    return rounded(out, "beta", "se", "chisq", "log10p")


@query(f"""WITH {EMB}, q AS (SELECT v, g, CAST(s % 7 AS DOUBLE) AS e, g * (s % 7) AS p, CAST(label AS DOUBLE) AS y FROM e),
c AS (SELECT v, count(*) AS n, regr_sxx(y, g) AS gg, regr_sxy(e, g) AS ge, regr_sxy(p, g) AS gp, regr_sxy(y, g) AS gy, regr_sxx(y, e) AS ee, regr_sxy(p, e) AS ep, regr_sxy(y, e) AS ey, regr_sxx(y, p) AS pp, regr_sxy(y, p) AS py, regr_syy(y, g) AS yy FROM q GROUP BY v),
s AS (SELECT *, gg * ee - ge * ge AS det FROM c),
k AS (SELECT *, (ee * gp - ge * ep) / det AS bg, (gg * ep - ge * gp) / det AS be, (ee * gy - ge * ey) / det AS yg, (gg * ey - ge * gy) / det AS ye FROM s),
r AS (SELECT v, n, pp - bg * gp - be * ep AS dpp, py - bg * gy - be * ey AS dpy, yy - yg * gy - ye * ey AS dyy FROM k),
z AS (SELECT *, dpy / dpp AS b, (dyy - dpy * dpy / dpp) / (n - 4) AS s2 FROM r)
SELECT v AS variant_index, CAST(n AS INT) AS n, round(b, 6) AS beta_gxe, round(sqrt(s2 / dpp), 6) AS se_gxe, round(b * b * dpp / s2, 6) AS chisq FROM z""")
def assoc_interaction(spark, d):
    """Dosage by exposure interaction."""
    return rounded(linear.interaction_test(embedded_genotypes(spark, d), embedded_samples(spark, d), "c", ["variant_index"]), "beta_gxe", "se_gxe", "chisq")


@query(f"""WITH {EMB}, t AS (SELECT v, count(g) AS n, regr_sxy(label, g) AS xy, regr_sxx(label, g) AS xx, regr_syy(label, g) AS yy FROM e GROUP BY v),
r AS (SELECT v AS variant_index, {_tests("xy", "xx", "yy / (n - 1)")} FROM t)
SELECT variant_index, chisq, log10p FROM r ORDER BY chisq DESC, variant_index LIMIT 10""")
def top_hits(spark, d):
    """The ten strongest variants (a top-k report)."""
    return assoc_score_intercept(spark, d).select("variant_index", "chisq", "log10p").orderBy(F.desc("chisq"), "variant_index").limit(10)


_ITEM_SCORE = f"""WITH {ITEM}, d AS (SELECT variant, sample, max(g) AS g FROM i GROUP BY 1, 2), o AS (SELECT o_orderkey AS sample, CAST(o_totalprice AS DECIMAL(18, 2)) AS y FROM orders),
m AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS sy, CAST(sum(y * y) AS DOUBLE) AS yy FROM o), k AS (SELECT n, 1 / n AS inv, 1 / n * sy AS e, (yy - sy * (1 / n * sy)) / (n - 1) AS s2 FROM m),
a AS (SELECT variant, CAST(count(*) AS DOUBLE) AS c, CAST(sum(g) AS DOUBLE) AS s1, CAST(sum(g * g) AS DOUBLE) AS sq, CAST(sum(g * y) AS DOUBLE) AS gy, CAST(sum(y) AS DOUBLE) AS my FROM d JOIN o ON d.sample = o.sample GROUP BY variant),
b AS (SELECT variant, c, s1 / c AS f, s2, gy - e * s1 - s1 / c * (my - e * c) AS num, sq + s1 / c * (s1 / c) * (n - c) - inv * (s1 + s1 / c * (n - c)) * (s1 + s1 / c * (n - c)) AS den FROM a, k)
SELECT variant, round(f / 2, 6) AS a1freq, CAST(c AS INT) AS n, CASE WHEN den > 1e-9 THEN round(num / den / 1000, 4) END AS beta, CASE WHEN den > 1e-9 THEN round(num * num / (s2 * den), 5) END AS chisq FROM b"""


@query(_ITEM_SCORE)
def assoc_items(spark, d):
    """Score test of many variants, each observed in few samples (the others count as the mean); beta is per 1000 of the price.

    Prices are taken as the decimals they are, so all sums are exact, whatever the number of partitions."""
    g = item_genotypes(spark, d).groupBy("variant", "sample").agg(F.max("g").alias("g"))
    samples = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample"), F.col("o_totalprice").cast("decimal(18, 2)").alias("y"))
    out = linear.score_test(g, samples, ["variant"], sample="sample")
    fine = F.col("se").isNotNull()
    return out.select("variant", F.round("a1freq", 6).alias("a1freq"), "n", F.when(fine, F.round(F.col("beta") / 1000, 4)).alias("beta"), F.when(fine, F.round("chisq", 5)).alias("chisq"))


@query(f"""WITH {ITEM} SELECT variant, count(*) FILTER (g = 0) AS n0, count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 2) AS n2, CAST(sum(g) AS BIGINT) AS allele1_count,
  CAST(2 * count(g) - sum(g) AS BIGINT) AS allele0_count, round(sum(g) / (2e0 * count(g)), 6) AS a1freq, count(g) AS n, count(*) - count(g) AS n_missing FROM i GROUP BY variant""")
def allele_freq_n(spark, d):
    """Counts and frequencies of each variant."""
    return rounded(variant_stats.allele_counts(item_genotypes(spark, d), ["variant"]), "a1freq")


@query(f"""WITH {ITEM}, c AS (SELECT variant, count(*) FILTER (g = 0) AS a, count(*) FILTER (g = 1) AS b, count(*) FILTER (g = 2) AS c, CAST(count(*) AS DOUBLE) AS n FROM i GROUP BY variant),
f AS (SELECT *, (b + 2 * c) / (2 * n) AS f FROM c), x AS (SELECT *, n * (1 - f) * (1 - f) AS ea, 2 * n * f * (1 - f) AS eb, n * f * f AS ec FROM f),
y AS (SELECT variant, (a - ea) * (a - ea) / ea + (b - eb) * (b - eb) / eb + (c - ec) * (c - ec) / ec AS x FROM x WHERE f > 0 AND f < 1)
SELECT variant, round(x, 6) AS chisq, round({log10p_sql("x")}, 6) AS log10p FROM y""")
def hwe_chisq(spark, d):
    """Hardy-Weinberg test of each variant with two alleles."""
    t = variant_stats.allele_counts(item_genotypes(spark, d), ["variant"]).select("variant", variant_stats.hwe_chisq(F.col("n0"), F.col("n1"), F.col("n2")).alias("chisq")).where("chisq is not null")
    return t.select("variant", F.round("chisq", 6).alias("chisq"), F.round(log10p(F.col("chisq")), 6).alias("log10p"))


@query(f"WITH {ITEM}, f AS (SELECT variant, least(sum(g) / (2e0 * count(g)), 1 - sum(g) / (2e0 * count(g))) AS maf FROM i GROUP BY variant) SELECT variant, round(maf, 6) AS maf FROM f WHERE maf >= 0.4")
def maf_filter(spark, d):
    """Variants of a minor allele frequency of 0.4 at least."""
    t = item_genotypes(spark, d).groupBy("variant").agg(variant_stats.minor(variant_stats.frequency(F.col("g"))).alias("maf"))
    return rounded(t.where(F.col("maf") >= 0.4), "maf")


@query(f"""WITH {ITEM}, m AS (SELECT variant, sample, cohort, y, CASE WHEN (variant + sample) % 13 <> 0 THEN g END AS g FROM i),
s AS (SELECT sample FROM m GROUP BY sample HAVING avg(CASE WHEN g IS NULL THEN 1 ELSE 0 END) <= 0.3), k AS (SELECT m.* FROM m WHERE sample IN (SELECT sample FROM s)),
v AS (SELECT variant FROM k GROUP BY variant HAVING avg(CASE WHEN g IS NULL THEN 1 ELSE 0 END) <= 0.1 AND least(sum(g) / (2e0 * count(g)), 1 - sum(g) / (2e0 * count(g))) >= 0.2)
SELECT variant, count(*) AS rows_left, count(g) AS observed FROM k WHERE variant IN (SELECT variant FROM v) GROUP BY variant""")
def quality_control(spark, d):
    """Sample and variant missingness and frequency filters, in that order."""
    g = item_genotypes(spark, d).withColumn("g", F.when((F.col("variant") + F.col("sample")) % 13 != 0, F.col("g")))
    kept = variant_stats.quality_control(g, ["variant"], "sample", mind=0.3, geno=0.1, maf=0.2)
    return kept.groupBy("variant").agg(F.count("*").alias("rows_left"), F.count("g").alias("observed"))


def _documents(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.col("n_chars").alias("time"), F.col("quality").alias("g"), "toxic", "source")


@query(f"WITH {DOCS} SELECT source, round(avg(CASE WHEN g IS NULL THEN 1 ELSE 0 END), 6) AS missingness, count(g) AS n, bool_or(g IS NULL) AS has_missing_values FROM dl GROUP BY source")
def variant_missingness(spark, d):
    """Missing share by group, observed values, and whether any is missing."""
    return rounded(_documents(spark, d).groupBy("source").agg(variant_stats.missingness(F.col("g")).alias("missingness"), F.count("g").alias("n"), F.bool_or(F.col("g").isNull()).alias("has_missing_values")), "missingness")


@query(f"WITH {DOCS}, s AS (SELECT doc_id, (CASE WHEN g IS NULL THEN 1 ELSE 0 END + CASE WHEN toxic IS NULL THEN 1 ELSE 0 END) / 2e0 AS missingness FROM dl) SELECT missingness, count(*) AS samples FROM s GROUP BY missingness")
def sample_missingness(spark, d):
    """How many samples miss which share of their values."""
    long = _documents(spark, d).unpivot(["doc_id"], ["g", "toxic"], "variant", "g")
    return long.groupBy("doc_id").agg(variant_stats.missingness(F.col("g")).alias("missingness")).groupBy("missingness").agg(F.count("*").alias("samples"))


@query(f"WITH {DOCS}, m AS (SELECT avg(g) AS mean FROM dl) SELECT doc_id, round(coalesce(CAST(g AS DOUBLE), mean), 6) AS g FROM dl, m")
def missing_mean_impute(spark, d):
    """Missing values as the mean of the observed ones (one number)."""
    t = _documents(spark, d)
    mean = t.agg(F.avg("g").alias("mean"))
    return t.crossJoin(F.broadcast(mean)).select("doc_id", F.round(F.coalesce(F.col("g").cast("double"), "mean"), 6).alias("g"))


@query("""SELECT c.c_custkey AS sample_index, c.c_mktsegment AS segment, o.trait, round(c.c_acctbal, 2) AS covariate FROM customer c
JOIN (SELECT o_custkey, count(*) AS trait FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey""")
def align_samples(spark, d):
    """Samples that have a trait and a covariate."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("sample_index"), F.col("c_mktsegment").alias("segment"), F.round("c_acctbal", 2).alias("covariate"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("sample_index")).agg(F.count("*").alias("trait"))
    return align.align_samples(c.select("sample_index", "segment"), o, c.select("sample_index", "covariate"), key=["sample_index"]).select("sample_index", "segment", "trait", "covariate")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def keep_semi(spark, d):
    """Rows of the listed samples."""
    listed = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return align.keep(table(spark, d, "orders").select("o_orderkey", "o_custkey"), listed, ["o_custkey"])


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)")
def remove_anti(spark, d):
    """Rows that aren't listed."""
    listed = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return align.remove(table(spark, d, "part").select("p_partkey", "p_name"), listed, ["p_partkey"])


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10)""")
def keep_extract(spark, d):
    """A keep list of samples, then an extract list of variants."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    rows = align.keep(rows, table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"])
    return align.keep(rows, table(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("l_partkey")), ["l_partkey"]).select("l_orderkey", "l_linenumber")


@query("SELECT s_suppkey AS k FROM supplier INTERSECT SELECT c_custkey FROM customer")
def sample_intersection(spark, d):
    """Samples of both of two lists."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")).intersect(table(spark, d, "customer").select("c_custkey"))


def _regions(spark, d):
    return table(spark, d, "nation").select((F.col("n_nationkey") * 70 + 5).cast("long").alias("start"), (F.col("n_nationkey") * 70 + 5 + F.col("n_regionkey") * 12).cast("long").alias("end"), "n_name")


_REGIONS = "SELECT n_nationkey * 70 + 5 AS a, n_nationkey * 70 + 5 + n_regionkey * 12 AS b, n_name FROM nation"


@query(f"SELECT p_partkey, p_brand FROM part WHERE EXISTS (SELECT 1 FROM ({_REGIONS}) r WHERE p_partkey BETWEEN a AND b)")
def range_include(spark, d):
    """Variants in regions."""
    return ranges.in_regions(table(spark, d, "part").select("p_partkey", "p_brand"), _regions(spark, d), "p_partkey", None, 64)


@query(f"SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM ({_REGIONS}) r WHERE p_partkey BETWEEN a AND b)")
def range_exclude(spark, d):
    """Variants outside of regions."""
    return ranges.in_regions(table(spark, d, "part").select("p_partkey", "p_brand"), _regions(spark, d), "p_partkey", None, 64, exclude=True)


@query(f"SELECT p_partkey, n_name FROM part JOIN ({_REGIONS}) r ON p_partkey BETWEEN a AND b")
def range_pairs(spark, d):
    """Variants with the regions that hold them."""
    return ranges.with_regions(table(spark, d, "part").select("p_partkey"), _regions(spark, d), "p_partkey", None, 64).select("p_partkey", "n_name")


@query(f"SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#12' OR EXISTS (SELECT 1 FROM ({_REGIONS}) r WHERE p_partkey BETWEEN a AND b)")
def ids_or_ranges(spark, d):
    """Variants in regions or listed by name, each once."""
    names = table(spark, d, "part").select("p_brand").where("p_brand = 'Brand#12'")
    return ranges.in_regions_or_listed(table(spark, d, "part").select("p_partkey", "p_brand"), _regions(spark, d), names, "p_partkey", None, "p_brand", "p_partkey", 64)


_CHUNKS = "SELECT CAST(p_partkey // 256 AS BIGINT) AS chunk_identifier, p_brand AS chrom, min(p_partkey) AS variant_start_index, max(p_partkey) + 1 AS variant_stop_index, count(*) AS variants FROM part GROUP BY 1, 2"


@query(_CHUNKS)
def chunk_split_chrom(spark, d):
    """Chunks split by chromosome."""
    return ordered.chunk_plan(table(spark, d, "part").select(F.col("p_partkey").alias("variant_index"), F.col("p_brand").alias("chrom")), size=256)


@query("SELECT p_partkey AS variant_index, CAST(p_partkey // 8192 AS BIGINT) AS chunk_identifier FROM part")
def chunk_plan(spark, d):
    """Chunk of each variant."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("variant_index"), ordered.chunk_of("p_partkey").alias("chunk_identifier"))


@query(f"SELECT * FROM ({_CHUNKS}) WHERE chunk_identifier NOT IN (SELECT l_suppkey // 16 FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40)")
def chunk_resume(spark, d):
    """Chunks that a restart still has to do."""
    done = table(spark, d, "lineitem").where("l_returnflag = 'A' and l_quantity > 40").select(F.floor(F.col("l_suppkey") / 16).alias("chunk_identifier"))
    return chunks.remaining(chunk_split_chrom(spark, d), done)


@query("SELECT p_partkey AS variant_index, p_brand AS chrom FROM part WHERE p_partkey >= 100 AND p_partkey < 300")
def variant_slice(spark, d):
    """Half-open slice of variants."""
    return table(spark, d, "part").where("p_partkey >= 100 and p_partkey < 300").select(F.col("p_partkey").alias("variant_index"), F.col("p_brand").alias("chrom"))


@query("""WITH o AS (SELECT event_id, event_type, lag(event_type) OVER (ORDER BY event_id) AS before FROM events), s AS (SELECT event_id, event_type FROM o WHERE before IS NULL OR before <> event_type)
SELECT event_id AS start_index, coalesce(lead(event_id) OVER (ORDER BY event_id), (SELECT max(event_id) + 1 FROM events)) AS stop_index, event_type FROM s""")
def chrom_boundaries(spark, d):
    """Runs of equal values in index order."""
    return ordered.run_boundaries(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id").select("start_index", "stop_index", "event_type")


@query("""WITH c AS (SELECT n_regionkey AS chrom, CAST(max(n_nationkey) AS BIGINT) AS chr_len FROM nation GROUP BY 1), t AS (SELECT chrom, CAST(sum(chr_len) OVER (ORDER BY chrom) - chr_len AS BIGINT) AS tot FROM c)
SELECT n_name, n_regionkey AS chrom, CAST(n_nationkey + tot AS BIGINT) AS cumulative_position FROM nation JOIN t ON chrom = n_regionkey ORDER BY 2, 3""")
def chrom_cumulative_offset(spark, d):
    """Positions on one axis over all chromosomes, in genomic order."""
    n = table(spark, d, "nation").select("n_name", F.col("n_regionkey").alias("chrom"), F.col("n_nationkey").cast("long").alias("genpos"))
    return ordered.with_cumulative_position(n).select("n_name", "chrom", "cumulative_position").orderBy("chrom", "cumulative_position")


@query("SELECT doc_id, source, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM documents")
def cumulative_sum(spark, d):
    """Running sums."""
    return ordered.cumulative_sum(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "n_chars", ["doc_id"], ["source"]).select("doc_id", "source", "cumulative")


@query("SELECT doc_id, source, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS cumulative FROM documents")
def reverse_cumulative_sum(spark, d):
    """Running sums from the end."""
    return ordered.cumulative_sum(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "n_chars", ["doc_id"], ["source"], reverse=True).select("doc_id", "source", "cumulative")


@query(f"""WITH {DOCS}, t AS (SELECT time, count(*) AS members, CAST(sum(toxic) AS BIGINT) AS events FROM dl WHERE toxic IS NOT NULL GROUP BY time)
SELECT time, members, events, CAST(sum(members) OVER (ORDER BY time DESC) AS BIGINT) AS at_risk FROM t""")
def risk_set_counts(spark, d):
    """Members at risk at each time."""
    return ordered.risk_sets(_documents(spark, d).where("toxic is not null"), "time", "toxic")


@query(f"WITH {DOCS}, t AS (SELECT time, count(*) AS size FROM dl GROUP BY time) SELECT time, CAST(coalesce(sum(size) OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_index, size FROM t")
def tie_groups(spark, d):
    """First index and size of each group of equal times."""
    return ordered.tie_groups(_documents(spark, d), "time", "doc_id")


@query(f"""WITH {DOCS}, k AS (SELECT doc_id, time, CAST(toxic AS DOUBLE) AS e, CAST(g AS DOUBLE) AS g FROM dl WHERE toxic IS NOT NULL),
w AS (SELECT doc_id, e, g, count(*) OVER o AS s0, sum(g) OVER o AS s1, sum(g * g) OVER o AS s2 FROM k WINDOW o AS (ORDER BY time DESC RANGE UNBOUNDED PRECEDING)),
t AS (SELECT sum(e) AS events, sum(e * (g - s1 / s0)) AS u, sum(e * (s2 / s0 - (s1 / s0) * (s1 / s0))) AS i FROM w)
SELECT CAST(events AS BIGINT) AS events, round(u, 6) AS u, round(i, 6) AS information, round(u * u / i, 6) AS chisq, round({log10p_sql("u * u / i")}, 6) AS log10p FROM t""")
def cox_score(spark, d):
    """Cox score test of one covariate."""
    return rounded(survival.cox_score(_documents(spark, d).where("toxic is not null"), "time", "toxic", "g"), "u", "information", "chisq", "log10p")


@query(f"""WITH {ITEM}, p AS (SELECT cohort, g, greatest(1.1920928955078125e-7, least(1 - 1.1920928955078125e-7, 1 / (1 + exp(-(-0.5e0 + 0.02e0 * y))))) AS p FROM i)
SELECT cohort, round(sum(CASE WHEN g = 1 THEN ln(p) ELSE ln(1 - p) END), 4) AS loglik, count(*) AS n FROM p GROUP BY cohort""")
def loglik_bernoulli(spark, d):
    """Log-likelihood of a logistic model with given coefficients."""
    i = item_genotypes(spark, d)
    t = i.groupBy("cohort").agg(G.log_likelihood(F.col("g"), G.probability(F.lit(-0.5) + F.lit(0.02) * F.col("y"))).alias("loglik"), F.count("*").alias("n"))
    return rounded(t, "loglik", digits=4)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'Y' ELSE 'N' END AS method, CASE l_linenumber WHEN 1 THEN 'FIRTH_CONVERGE_FAIL' WHEN 2 THEN 'LOGISTIC_CONVERGE_FAIL' WHEN 3 THEN 'UNFINISHED' ELSE '.' END AS error FROM lineitem")
def method_error_labels(spark, d):
    """Labels of method and error codes."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", G.method_label(F.col("l_linenumber")).alias("method"), G.error_label(F.col("l_linenumber")).alias("error"))


_PAIRS = f"""{EMB}, p AS (SELECT a.v AS i, b.v AS j, corr(a.g, b.g) AS r, count(*) AS n FROM e a JOIN e b ON a.s = b.s AND a.v < b.v AND a.v // 16 = b.v // 16 GROUP BY a.v, b.v)"""


def _pairs(spark, d):
    return ld.pairs_within(embedded_genotypes(spark, d), "variant_index", "sample_index", by=["chrom"])


@query(f"WITH {_PAIRS} SELECT CAST(i // 16 AS VARCHAR) AS chrom, i, j, round(r, 6) AS r, round(r * r, 6) AS r2, n FROM p")
def ld_pairs(spark, d):
    """Correlations of pairs of variants of a chromosome."""
    return rounded(_pairs(spark, d), "r", "r2")


@query(f"WITH {_PAIRS.replace('a.v // 16 = b.v // 16', 'b.v - a.v <= 5')} SELECT i, j, round(r, 6) AS r, n FROM p")
def ld_window(spark, d):
    """Correlations of variants at most five apart."""
    return rounded(ld.pairs_within(embedded_genotypes(spark, d), "variant_index", "sample_index", window=5).select("i", "j", "r", "n"), "r")


@query(f"WITH {_PAIRS} SELECT CAST(i // 16 AS VARCHAR) AS chrom, i, j, round(r, 6) AS r FROM p WHERE abs(r) >= 0.05")
def ld_sparse(spark, d):
    """The larger ones of them."""
    return rounded(ld.sparse(_pairs(spark, d), 0.05).select("chrom", "i", "j", "r"), "r")


@query(f"WITH {_PAIRS}, q AS (SELECT i, j, r * r AS r2 FROM p) SELECT i, j, round(r2, 6) AS r2 FROM (SELECT i, j, r2 FROM q UNION ALL SELECT j, i, r2 FROM q UNION ALL SELECT DISTINCT v, v, 1e0 FROM e)")
def ld_matrix_mirror(spark, d):
    """The symmetric matrix with its diagonal."""
    return rounded(ld.mirrored(_pairs(spark, d), embedded_genotypes(spark, d), "variant_index"), "r2")


@query("SELECT l_orderkey, l_linenumber, CAST(floor(l_discount * 65535 + 0.5e0) AS INT) AS code, round(floor(l_discount * 65535 + 0.5e0) / 65535e0, 9) AS r2 FROM lineitem")
def r2_codes(spark, d):
    """16-bit codes of squared correlations, and back."""
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", G.pack_r2(F.col("l_discount")).alias("code"))
    return t.withColumn("r2", F.round(G.unpack_r2(F.col("code")), 9))


_PROBS = "SELECT vec_id, list_transform(embedding[1:{n}], lambda x: abs(CAST(x AS DOUBLE))) AS a FROM embeddings"


@query(f"SELECT vec_id, round((a[2] + 2 * a[3]) / (a[1] + a[2] + a[3]), 6) AS dosage FROM ({_PROBS.format(n=3)})")
def dosage_unphased(spark, d):
    """Dosage of three genotype probabilities."""
    p = F.transform(F.slice("embedding", 1, 3), lambda x: F.abs(x.cast("double")))
    whole = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return table(spark, d, "embeddings").select("vec_id", F.round(G.dosage(F.transform(p, lambda x: x / whole), False), 6).alias("dosage"))


@query(f"SELECT vec_id, round(a[2] / (a[1] + a[2]) + a[4] / (a[3] + a[4]), 6) AS dosage FROM ({_PROBS.format(n=4)})")
def dosage_phased(spark, d):
    """Dosage of two haplotypes' probabilities."""
    p = lambda i: F.abs(F.col("embedding")[i].cast("double"))
    probabilities = F.array(p(0) / (p(0) + p(1)), p(1) / (p(0) + p(1)), p(2) / (p(2) + p(3)), p(3) / (p(2) + p(3)))
    return table(spark, d, "embeddings").select("vec_id", F.round(G.dosage(probabilities, True), 6).alias("dosage"))


@query("""SELECT ploidy, alleles, CAST(ploidy * alleles AS BIGINT) AS phased, CAST(round(gamma(ploidy + alleles) / (gamma(alleles) * gamma(ploidy + 1))) AS BIGINT) AS unphased
FROM (SELECT DISTINCT n_regionkey + 1 AS ploidy FROM nation) a, (SELECT DISTINCT n_regionkey + 2 AS alleles FROM nation) b""")
def probability_counts(spark, d):
    """Number of probabilities by ploidy and alleles."""
    r = table(spark, d, "nation").select("n_regionkey").distinct()
    t = r.select((F.col("n_regionkey") + 1).alias("ploidy"), F.explode(F.sequence(F.lit(2), F.lit(6))).alias("alleles"))
    return t.select("ploidy", "alleles", G.probability_count(F.col("ploidy"), F.col("alleles"), F.lit(True)).alias("phased"), G.probability_count(F.col("ploidy"), F.col("alleles"), F.lit(False)).alias("unphased"))


def _sets(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("set_id")).agg(F.sort_array(F.collect_set("p_partkey")).alias("variants"))


@query("SELECT p_brand AS set_id, p_partkey AS variant_id FROM part")
def set_membership(spark, d):
    """Variants of each set."""
    return sets.members(_sets(spark, d))


@query(f"""WITH {ITEM}, m AS (SELECT p_brand AS set_id, CASE WHEN p_size <= 25 THEN 'M1' ELSE 'M2' END AS mask_id, p_partkey AS variant FROM part UNION SELECT p_brand, 'M3', p_partkey FROM part)
SELECT set_id, mask_id, sample, CAST(max(g) AS INT) AS g FROM i JOIN m ON i.variant = m.variant GROUP BY 1, 2, 3""")
def mask_burden(spark, d):
    """Burden genotypes of sets and masks."""
    part = table(spark, d, "part")
    notes = part.select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("variant_id"), F.when(F.col("p_size") <= 25, "small").otherwise("large").alias("annotation"))
    masks = spark.createDataFrame([("M1", ["small"]), ("M2", ["large"]), ("M3", ["small", "large"])], "mask_id string, annotations array<string>")
    held = sets.masked(_sets(spark, d), notes, masks)
    return sets.burden(item_genotypes(spark, d).withColumnRenamed("variant", "variant_id"), held, ["set_id", "mask_id"], "sample")


@query(f"""WITH {ITEM}, b AS (SELECT p_brand AS set_id, sample, max(g) AS g FROM i JOIN part ON p_partkey = variant GROUP BY 1, 2), y AS (SELECT sample, sum(y) AS y FROM i GROUP BY 1),
t AS (SELECT set_id, regr_sxy(y, g) AS xy, regr_sxx(y, g) AS xx, regr_syy(y, g) AS yy, count(*) AS n FROM b JOIN y ON b.sample = y.sample GROUP BY set_id)
SELECT set_id, 'y' AS trait, CAST(n AS INT) AS n, {_tests("xy", "xx", "yy / (n - 1)")} FROM t""")
def burden_assoc(spark, d):
    """Score test of burden genotypes, over each set's carriers of genotypes."""
    g = item_genotypes(spark, d)
    held = table(spark, d, "part").select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("variant_id"))
    b = sets.burden(g.withColumnRenamed("variant", "variant_id"), held, ["set_id"], "sample")
    y = g.groupBy("sample").agg(F.sum("y").alias("y"))
    return rounded(linear.score_test_traits(b, y, ["y"], ["set_id"], "sample"), "beta", "se", "chisq", "log10p")


_COHORTS = f"""{ITEM}, p AS (SELECT p_brand AS set_id, cohort, count(*) AS n, regr_sxy(y, g) AS xy, regr_sxx(y, g) AS xx, regr_syy(y, g) AS yy FROM i JOIN part ON p_partkey = variant GROUP BY 1, 2),
c AS (SELECT set_id, cohort, xy / xx AS b, sqrt(yy / (n - 1) / xx) AS s, xy * xy / (yy / (n - 1) * xx) AS x FROM p)"""


def _cohorts(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("variant"), F.col("p_brand").alias("set_id"))
    t = item_genotypes(spark, d).join(part, "variant").groupBy("set_id", "cohort").agg(F.regr_sxy("y", "g").alias("xy"), F.regr_sxx("y", "g").alias("xx"), F.regr_syy("y", "g").alias("yy"), F.count("*").alias("n"))
    return t.select("set_id", "cohort", *(e.alias(k) for k, e in linear.statistics(F.col("xy"), F.col("xx"), F.col("yy") / (F.col("n") - 1)).items()))


@query(f"""WITH {_COHORTS}, t AS (SELECT set_id, count(*) AS cohorts, sum(b / (s * s)) AS bw, sum(1 / (s * s)) AS w FROM c GROUP BY set_id)
SELECT set_id, cohorts, round(bw / w, 6) AS beta, round(sqrt(1 / w), 6) AS se, round(bw * bw / w, 6) AS chisq, round({log10p_sql("bw * bw / w")}, 6) AS log10p FROM t""")
def meta_inverse_variance(spark, d):
    """Meta-analysis over cohorts."""
    return rounded(meta.inverse_variance(_cohorts(spark, d), ["set_id"]), "beta", "se", "chisq", "log10p")


@query(f"""WITH {_COHORTS}, z AS (SELECT set_id, pow(1e1, -{log10p_sql("x")}) AS p FROM c), t AS (SELECT set_id, sum(tan((0.5e0 - p) * pi())) / count(*) AS t FROM z GROUP BY set_id)
SELECT set_id, round(0.5e0 - atan(t) / pi(), 6) AS p FROM t""")
def acat_combination(spark, d):
    """Cauchy combination of the cohorts' p-values."""
    return rounded(_cohorts(spark, d).groupBy("set_id").agg(meta.acat(p_value(F.col("chisq")), F.lit(1.0)).alias("p")), "p")


@query(f"""WITH {EMB}, m AS (SELECT avg(label) AS m, var_samp(label) AS s2 FROM embeddings), z AS (SELECT v, sum(g * (label - m)) AS s, any_value(s2) AS s2 FROM e, m GROUP BY v)
SELECT CAST(v // 16 AS VARCHAR) AS chrom, round(sum(s * s / s2), 5) AS q, count(*) AS variants FROM z GROUP BY 1""")
def skat_statistic(spark, d):
    """SKAT statistic of each chromosome's variants, weights one."""
    s = embedded_samples(spark, d)
    one = s.agg(F.avg("y").alias("m"), F.var_samp("y").alias("s2"))
    z = embedded_genotypes(spark, d).join(s, "sample_index").crossJoin(F.broadcast(one)).groupBy("chrom", "variant_index").agg((F.sum(F.col("g") * (F.col("y") - F.col("m"))) / F.sqrt(F.first("s2"))).alias("z"))
    return rounded(z.groupBy("chrom").agg(meta.skat_q(F.col("z"), F.lit(1.0)).alias("q"), F.count("*").alias("variants")), "q", digits=5)


@query("SELECT l_returnflag AS part, l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def union_chunks(spark, d):
    """Parts of a result set put together."""
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("part"), "l_orderkey", "l_linenumber")
    return t.where("part = 'A'").unionByName(t.where("part = 'R'"))


@query("SELECT count(*) AS variants, CAST(count(DISTINCT p_partkey // 256) AS BIGINT) AS chunks, count(DISTINCT p_brand) AS chromosomes FROM part")
def run_totals(spark, d):
    """Totals of a run."""
    p = table(spark, d, "part")
    return p.agg(F.count("*").alias("variants"), F.countDistinct(F.floor(F.col("p_partkey") / 256)).alias("chunks"), F.countDistinct("p_brand").alias("chromosomes"))


@query("SELECT n_nationkey, lower(n_name) AS low, upper(n_name) AS up, concat_ws('-', n_name, CAST(n_regionkey AS VARCHAR)) AS joined, translate(n_name, ' ', chr(9)) AS tabbed, len(string_split_regex(n_name, '[, ]+')) AS words, rtrim(regexp_replace(lower(hex(n_name)), '(.{8})', '\\1|', 'g'), '|') AS hexed FROM nation")
def string_functions(spark, d):
    """String helpers."""
    n, c = table(spark, d, "nation"), F.col("n_name")
    return n.select("n_nationkey", F.lower(c).alias("low"), F.upper(c).alias("up"), F.concat_ws("-", c, F.col("n_regionkey").cast("string")).alias("joined"), F.translate(c, " ", "\t").alias("tabbed"), F.size(G.split_list(c)).cast("long").alias("words"), G.hex_groups(c.cast("binary")).alias("hexed"))


@query("""WITH a AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE label END AS x, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE label // 2 END AS y FROM embeddings)
SELECT vec_id, (x IS NULL OR y IS NULL OR x = y) AS same, (x IS NOT DISTINCT FROM y) AS identical FROM a""")
def missing_equality(spark, d):
    """Equality with a missing value that equals everything, and null-safe equality."""
    from allelake.schemas import missing_equal

    t = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 != 0, F.col("label")).alias("x"), F.when(F.col("vec_id") % 4 != 0, F.floor(F.col("label") / 2).cast("int")).alias("y"))
    return t.select("vec_id", missing_equal(F.col("x"), F.col("y")).alias("same"), F.col("x").eqNullSafe(F.col("y")).alias("identical"))


def wide_genotypes(spark: SparkSession, d: str) -> DataFrame:
    """One row per variant with the dosages of all samples in order."""
    g = embedded_genotypes(spark, d).groupBy("variant_index", "chrom").agg(F.sort_array(F.collect_list(F.struct("sample_index", "g"))).alias("x"))
    return g.select("variant_index", "chrom", F.col("x.g").alias("dosages"))


def _vectors(spark, d, *columns):
    rows = embedded_samples(spark, d).orderBy("sample_index").select(*columns).toPandas()
    return tuple(rows[c].to_numpy() for c in columns)


@query()
def firth_logistic(spark, d):
    """Binary trait, approximate Firth below p = 0.5."""
    case, c = _vectors(spark, d, "case", "c")
    return binary.binary_test(wide_genotypes(spark, d), case.astype(float), c[:, None], ["variant_index", "chrom"], "firth_approximate", 0.5)


@query()
def spa_logistic(spark, d):
    """Binary trait, saddlepoint below p = 0.5."""
    case, c = _vectors(spark, d, "case", "c")
    return binary.binary_test(wide_genotypes(spark, d), case.astype(float), c[:, None], ["variant_index", "chrom"], "spa", 0.5)


@query()
def hlm_fit(spark, d):
    """Heteroskedastic linear model of the trait on each variant, with a covariate in the variance."""
    y, c = _vectors(spark, d, "y", "c")
    shared = spark.sparkContext.broadcast((y, np.column_stack([np.ones(len(y)), c])))

    def kernel(g):
        y, v = shared.value
        alpha, beta, value = binary.hlm_fit(np.column_stack([np.ones(len(y)), g]), v, y)
        return {"beta": float(alpha[1]), "log_variance_slope": float(beta[1]), "objective": value}

    return binary.over_variants(wide_genotypes(spark, d), kernel, "beta double, log_variance_slope double, objective double", ["variant_index"])


@query()
def logistic_standard(spark, d):
    """Plain logistic regression of each variant, with its convergence state."""
    case, c = _vectors(spark, d, "case", "c")
    shared = spark.sparkContext.broadcast((case.astype(float), c))

    def kernel(g):
        y, c = shared.value
        b, cov, fine = binary.logistic_fit(np.column_stack([np.ones(len(y)), c, g]), y)
        return {"beta": float(b[2]), "se": float(np.sqrt(cov[2, 2])), "extra_code": binary.NONE if fine else binary.LOGISTIC_FAILED}

    return binary.over_variants(wide_genotypes(spark, d), kernel, "beta double, se double, extra_code int", ["variant_index"])


@query()
def cox_firth(spark, d):
    """Cox regression with Firth's penalty of the trait as time, one variant each."""
    y, case = _vectors(spark, d, "y", "case")
    shared = spark.sparkContext.broadcast((y, case))

    def kernel(g):
        b, value, fine = survival.cox_fit(g[:, None], *shared.value, firth=True)
        return {"beta": float(b[0]), "loglik": value, "converged": bool(fine)}

    return binary.over_variants(wide_genotypes(spark, d), kernel, "beta double, loglik double, converged boolean", ["variant_index"])


@query()
def window_prune(spark, d):
    """LD pruning per chromosome."""
    return ld.prune(wide_genotypes(spark, d), window=8, step=2, r2=0.005)
