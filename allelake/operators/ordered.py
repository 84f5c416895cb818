"""Ordered operators: cumulative sums, risk sets, ties, chunks and chromosome boundaries.

Global windows would put all rows in one task. Where a total order is needed over rows that may be many, sums are made per
value first (or per partition of the key space) and only those are ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

CHUNK = 8192
#: Bits of an integer key that a window takes at once: stretches of 2^18 keys, and 2^23 stretches.
STRETCHES = (18, 23)


def stretch_of(order: str, bits: int):
    """Stretch of 2^bits keys that an integer key lies in; nulls lie before all others, as they are ordered."""
    return F.coalesce(F.shiftright(F.col(order).cast("long"), bits), F.lit(-(1 << 63)))


def running_sums(table: DataFrame, sums: dict[str, str], order: list[str], by: list[str], reverse: bool = False, exclusive: bool = False, stretches: tuple[int, ...] = STRETCHES) -> DataFrame:
    """``table`` with running sums (name: column) within ``by``; null where nothing has been added.

    Sums from the end go over the rows in descending order: a frame that ends at the last row is added up anew for each row.
    If the first column of ``order`` is an integer, rows are summed within stretches of it and the stretches' totals likewise,
    so no task holds all rows of a group; any other order (and decimals, which sums of sums would widen) takes a task a group.
    """
    ends = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]

    def within(keys: list[str]) -> dict:
        w = W.partitionBy(*(keys or [F.lit(0)])).orderBy(*ends).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
        return {name: F.sum(value).over(w) for name, value in sums.items()}

    plain = table.withColumns(within(by))
    if not stretches or not isinstance(table.schema[order[0]].dataType, IntegralType) or any(isinstance(plain.schema[name].dataType, DecimalType) for name in sums):
        return plain
    stretch = f"_stretch{len(stretches)}"
    cut = table.withColumn(stretch, stretch_of(order[0], stretches[0]))
    totals = cut.groupBy(*by, stretch).agg(*(F.sum(value).alias(f"_total_{name}") for name, value in sums.items()))
    before = running_sums(totals, {f"_before_{name}": f"_total_{name}" for name in sums}, [stretch], by, reverse, True, stretches[1:])
    before = before.select(F.col(stretch).alias("_of"), *(F.col(k).alias(f"_by_{k}") for k in by), *(f"_before_{name}" for name in sums))
    same = F.col(stretch) == F.col("_of")
    for k in by:
        same &= F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    both = cut.withColumns(within([*by, stretch])).join(before, same)
    plus = {name: F.coalesce(F.col(name) + F.col(f"_before_{name}"), F.col(name), F.col(f"_before_{name}")) for name in sums}
    return both.select(*(plus[c].alias(c) if c in plus else c for c in plain.columns))


def cumulative_sum(table: DataFrame, value: str, order: list[str], by: list[str], name: str = "cumulative", reverse: bool = False, exclusive: bool = False) -> DataFrame:
    """Running sum within ``by``, from the first row (or, with ``reverse``, from the last), without the row itself if ``exclusive``."""
    return running_sums(table, {name: value}, order, by, reverse, exclusive).withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def chromosome_offsets(variants: DataFrame, chrom: str = "chrom", pos: str = "genpos") -> DataFrame:
    """Length of each chromosome (its largest position) and the sum of those before it: one row a chromosome."""
    lengths = variants.groupBy(chrom).agg(F.max(pos).alias("chr_len"))
    w = W.orderBy(chrom).rowsBetween(W.unboundedPreceding, -1)
    return lengths.withColumn("tot", F.coalesce(F.sum("chr_len").over(w), F.lit(0)))


def with_cumulative_position(variants: DataFrame, chrom: str = "chrom", pos: str = "genpos") -> DataFrame:
    """Variants with their position on one axis over all chromosomes; the offsets are a row for each chromosome."""
    return variants.join(F.broadcast(chromosome_offsets(variants, chrom, pos).select(chrom, "tot")), chrom, "left").withColumn("cumulative_position", F.col(pos) + F.col("tot"))


def risk_sets(table: DataFrame, time: str = "time", status: str = "status", values: dict[str, str] | None = None, by: list[str] | None = None) -> DataFrame:
    """For each distinct time: members with that time, events, members at risk (time as large or larger), and the sum over
    those at risk of each expression in ``values``. Rows are summed to one for each time before the window."""
    by, values = by or [], values or {}
    at = table.groupBy(*by, time).agg(F.count("*").alias("members"), F.sum(status).alias("events"), *(F.sum(F.expr(e)).alias(f"_{k}") for k, e in values.items()))
    sums = running_sums(at, {"at_risk": "members", **{k: f"_{k}" for k in values}}, [time], by, reverse=True)
    return sums.select(*by, time, "members", "events", "at_risk", *values)


def tie_groups(table: DataFrame, time: str = "time", key: str = "sample_index") -> DataFrame:
    """For each distinct time: place of its first member in order of time, and the number of members."""
    at = table.groupBy(time).agg(F.count("*").alias("size"))
    return running_sums(at, {"first_index": "size"}, [time], [], exclusive=True).select(time, F.coalesce("first_index", F.lit(0)).alias("first_index"), "size")


def chunk_of(index: str = "variant_index", size: int = CHUNK):
    return F.floor(F.col(index) / F.lit(size))


def chunk_plan(variants: DataFrame, index: str = "variant_index", chrom: str = "chrom", size: int = CHUNK) -> DataFrame:
    """Chunks of ``size`` variants, split where the chromosome changes: half-open index ranges."""
    return variants.groupBy(chunk_of(index, size).alias("chunk_identifier"), chrom).agg(F.min(index).alias("variant_start_index"), (F.max(index) + 1).alias("variant_stop_index"), F.count("*").alias("variants"))


def run_boundaries(table: DataFrame, value: str, order: str, bins: int = 1) -> DataFrame:
    """Start (and stop, not included) of each run of equal values in ``order``, an integer index.

    Neighbours are found within stretches of the index, which may have gaps; what comes before and after a stretch, from one
    row for each stretch. Only those rows are ordered as a whole: for a dense index, one of 2^18.
    """
    bits = STRETCHES[0]
    c, w = F.col, W.partitionBy("_stretch").orderBy(order)
    differs = lambda before: ~c(value).eqNullSafe(before) | before.isNull()
    rows = table.select(order, value).withColumn("_stretch", stretch_of(order, bits))
    starts = rows.withColumns({"_edge": F.row_number().over(w) == 1, "_before": F.lag(value).over(w)}).where(c("_edge") | differs(c("_before"))).select(order, value, "_stretch", "_edge")
    ends = rows.groupBy("_stretch").agg(F.max_by(value, order).alias("_last"), F.max(order).alias("_most"))
    firsts = starts.groupBy("_stretch").agg(F.min(order).alias("_edge_at"), F.min_by(value, order).alias(value), F.min(F.when(~c("_edge"), c(order))).alias("_inner"))
    along, back = W.partitionBy(F.lit(0)).orderBy("_stretch"), W.partitionBy(F.lit(0)).orderBy(c("_stretch").desc())
    cuts = ends.join(firsts, "_stretch").withColumn("_before", F.lag("_last").over(along)).withColumn("_kept", differs(c("_before"))).withColumn("_first", F.when(c("_kept"), c("_edge_at")).otherwise(c("_inner")))
    later = back.rowsBetween(W.unboundedPreceding, -1)
    cuts = cuts.select(c("_stretch").alias("_of"), "_kept", F.coalesce(F.min("_first").over(later), F.max(c("_most") + 1).over(W.partitionBy(F.lit(0)))).alias("_next"))
    found = starts.withColumn("_stop", F.lead(order).over(w)).join(cuts, c("_stretch") == c("_of")).where(~c("_edge") | c("_kept"))
    return found.select(c(order).alias("start_index"), F.coalesce("_stop", "_next").alias("stop_index"), value)
