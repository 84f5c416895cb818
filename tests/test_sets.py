"""Burden genotypes: tasks of the join follow the genotypes' size."""

from allelake.operators import sets
from allelake.queries import QUERIES

D = "/root/testdata/sf0.001"


def planned(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_burden_join_is_cut_by_size(spark, monkeypatch):
    whole = sorted(map(tuple, QUERIES["mask_burden"](spark, D).collect()))
    monkeypatch.setattr(sets, "TASK_BYTES", 4096, raising=False)
    for name in "mask_burden", "burden_assoc":
        assert "REPARTITION_BY_NUM" in planned(QUERIES[name](spark, D))
    assert sorted(map(tuple, QUERIES["mask_burden"](spark, D).collect())) == whole


def test_burden_of_unknown_and_small_size(spark, monkeypatch):
    genotypes = spark.createDataFrame([("v1", "s1", 1), ("v2", "s1", 2), ("v2", "s2", None)], "variant_id string, sample string, g int")
    membership = spark.createDataFrame([("v1", "a"), ("v2", "a"), ("v2", "b")], "variant_id string, set_id string")
    assert sets.tasks_of(spark.read.parquet(f"{D}/lineitem.parquet")) == 1
    for size in 1 << 24, 8:
        monkeypatch.setattr(sets, "TASK_BYTES", size)
        got = sets.burden(genotypes, membership, ["set_id"], "sample")
        assert sorted((r.set_id, r.sample, r.g) for r in got.collect() if r.g) == [("a", "s1", 2), ("b", "s1", 2)] and got.count() == 4
    assert sets.tasks_of(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "v long")) == 0


def test_members_are_not_hashed_by_annotation(spark):
    """There are few annotations: a shuffle by them puts all members into as many tasks."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        lines = planned(QUERIES["mask_burden"](spark, D)).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not any("Exchange hashpartitioning(annotation" in line for line in lines)
