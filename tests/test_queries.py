"""Every query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from allelake.queries import ORACLE, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(df, columns):
    value = lambda v: None if v is None or v != v else round(float(v), 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(value(v) for v in r) for r in df[columns].astype(object).itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    got, expected = QUERIES[name](spark, D).toPandas(), duck.execute(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert rows(got, columns) == rows(expected, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, D).count() > 0


def test_exact_sums_whatever_the_partitions(spark):
    """The score test of decimals gives identical bits for any number of shuffle partitions."""
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 7, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(tuple, QUERIES["assoc_items"](spark, "/root/testdata/sf0.01").collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found[0]) == 2000 and found[0] == found[1] == found[2]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 64
    assert set(e.oracle_sql()) <= set(e.queries())
