"""Sets of variants, masks over annotations, and burden genotypes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of source files a task joins and aggregates: what it keeps in memory is in proportion to that.
TASK_BYTES = 16 << 20
MOST_TASKS = 1 << 16


def tasks_of(table: DataFrame) -> int:
    """One task for each ``TASK_BYTES`` of what ``table`` is read from; 0 if that isn't known (a frame over an RDD)."""
    leaves = table._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return 0 if size >= 1 << 62 else min(MOST_TASKS, -(-size // TASK_BYTES))


def members(sets: DataFrame, name: str = "set_id", variants: str = "variants") -> DataFrame:
    """(set, variant) for each listed variant, once."""
    return sets.select(name, F.explode(variants).alias("variant_id")).distinct()


def masked(sets: DataFrame, annotations: DataFrame, masks: DataFrame) -> DataFrame:
    """(set, mask, variant): members of a set whose annotation belongs to the mask.

    ``annotations`` (variant_id, set_id, annotation), ``masks`` (mask_id, annotations; the file of a run's masks, which is
    broadcast: hashed by the few annotations, all members would meet in a task for each).
    """
    of_mask = masks.select("mask_id", F.explode("annotations").alias("annotation"))
    return members(sets).join(annotations, ["set_id", "variant_id"]).join(F.broadcast(of_mask), "annotation").select("set_id", "mask_id", "variant_id").distinct()


def burden(genotypes: DataFrame, membership: DataFrame, by: list[str], sample: str, g: str = "g", rule: str = "max", variant: str = "variant_id") -> DataFrame:
    """One genotype for each set and sample: largest, sum, or carrier indicator of the members' dosages.

    Every genotype becomes a row for each set (and mask) of its variant before rows are added up, and few of them share a
    sample, so the join is cut by the genotypes' size: sizes of the shuffle, which compresses well, don't bound a task's memory.
    """
    x = F.col(g)
    value = {"max": F.max(x), "sum": F.sum(x), "carrier": F.max((x > 0).cast("int"))}[rule]
    tasks = tasks_of(genotypes)
    if tasks > 1:
        genotypes, membership = genotypes.repartition(tasks, variant), membership.repartition(tasks, variant)
    return genotypes.join(membership, variant).groupBy(*by, sample).agg(value.alias("g"))


def mask_variant_parts(identifier: str = "variant_id"):
    """Set, mask and frequency bound of a burden variant's identifier (SET.MASK.BOUND)."""
    parts = F.split(identifier, "\\.", 3)
    return parts[0].alias("set_id"), parts[1].alias("mask_id"), parts[2].alias("bound")
