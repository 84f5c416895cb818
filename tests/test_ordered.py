"""Ordered operators on keys that lie in many stretches, against plain Python."""

import random

import pytest

from allelake.operators import ordered


def keyed(seed: int):
    r = random.Random(seed)
    keys = {r.randint(-(1 << 20), 1 << 20) for _ in range(150)} | {r.randint(-(1 << 62), 1 << 62) for _ in range(100)}
    return [(k, r.choice(["a", "b", None]), r.choice([None, 1, 2, 3])) for k in [*sorted(keys), -(1 << 63), (1 << 63) - 1, None]]


def brute(rows, reverse: bool, exclusive: bool):
    found, totals = {}, {}
    for k, b, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=reverse):
        before = totals.get(b)
        totals[b] = before if v is None else v + (before or 0)
        found[k, b] = before if exclusive else totals[b]
    return found


@pytest.mark.parametrize("reverse,exclusive", [(False, False), (False, True), (True, False), (True, True)])
def test_running_sums_over_stretches(spark, reverse, exclusive):
    rows = keyed(1)
    table = spark.createDataFrame(rows, "k long, b string, v long")
    for stretches in ordered.STRETCHES, (3, 5), ():
        got = ordered.running_sums(table, {"total": "v"}, ["k"], ["b"], reverse, exclusive, stretches)
        assert got.columns == ["k", "b", "v", "total"]
        assert {(r.k, r.b): r.total for r in got.collect()} == brute(rows, reverse, exclusive)


def test_sums_from_the_end_are_linear_and_split(spark):
    """A frame that ends at the last row is added up anew for each row; a window over a whole group is one task."""
    table = spark.range(10).selectExpr("id as k", "'a' as b", "id as v", "id as time", "id % 2 as status")
    for frame in ordered.cumulative_sum(table, "v", ["k"], ["b"], reverse=True), ordered.risk_sets(table):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "unboundedfollowing" not in plan and "_stretch" in plan
    assert "_stretch" in ordered.tie_groups(table, "time", "k")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bits", [1, 3, 18])
def test_runs_over_stretches_and_gaps(spark, monkeypatch, bits):
    monkeypatch.setattr(ordered, "STRETCHES", (bits, 23), raising=False)
    r = random.Random(bits)
    keys = sorted(set(range(-20, 40)) | set(range(100, 140, 3)) | {1000, 1001, 5000})
    values = []
    for _ in keys:
        values.append(values[-1] if values and r.random() < 0.8 else r.choice("abc"))
    starts = [i for i in range(len(keys)) if i == 0 or values[i] != values[i - 1]]
    expected = [(keys[i], keys[j] if j is not None else keys[-1] + 1, values[i]) for i, j in zip(starts, [*starts[1:], None])]
    table = spark.createDataFrame(list(zip(keys, values)), "k long, v string").repartition(4)
    found = ordered.run_boundaries(table, "v", "k")
    assert sorted(map(tuple, found.collect())) == expected
    assert found.columns == ["start_index", "stop_index", "v"]


def test_runs_are_found_within_stretches(spark, monkeypatch):
    """No window holds all starts: the largest partition of any is one stretch, or a row for each stretch."""
    monkeypatch.setattr(ordered, "STRETCHES", (6, 23), raising=False)
    table = spark.range(4096).selectExpr("id as k", "id % 2 as v")
    found = ordered.run_boundaries(table, "v", "k")
    plan = found._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window " in line and "lead" in line]
    assert found.count() == 4096 and windows and all("_stretch" in line for line in windows)
