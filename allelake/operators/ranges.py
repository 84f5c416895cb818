"""Positions and regions: range joins by bins, so that each row meets only regions near it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN = 100_000


def _meeting(variants: DataFrame, regions: DataFrame, chrom: str | None, pos: str, width: int) -> tuple[DataFrame, DataFrame, list[str]]:
    on = ([chrom] if chrom else []) + ["_bin"]
    left = variants.withColumn("_bin", F.floor(F.col(pos) / width))
    cover = regions.where("start <= end").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    return left, cover.select(*on, "start", "end"), on


def in_regions(variants: DataFrame, regions: DataFrame, pos: str = "genpos", chrom: str | None = "chrom", width: int = BIN, exclude: bool = False) -> DataFrame:
    """Variants within (or, with ``exclude``, outside of) any region (chrom, start, end), ends included."""
    left, cover, on = _meeting(variants, regions, chrom, pos, width)
    near = [left[c] == cover[c] for c in on] + [left[pos] >= cover["start"], left[pos] <= cover["end"]]
    return left.join(cover, near, "left_anti" if exclude else "left_semi").drop("_bin")


def in_regions_or_listed(variants: DataFrame, regions: DataFrame, names: DataFrame, pos: str = "genpos", chrom: str | None = "chrom", name: str = "variant_id", key: str = "variant_index", width: int = BIN) -> DataFrame:
    """Variants in a region or with a listed identifier, each once."""
    ranged = in_regions(variants, regions, pos, chrom, width).select(key)
    listed = variants.join(names.select(name).distinct(), name, "left_semi").select(key)
    return variants.join(ranged.union(listed).distinct(), key, "left_semi")


def with_regions(variants: DataFrame, regions: DataFrame, pos: str = "genpos", chrom: str | None = "chrom", width: int = BIN) -> DataFrame:
    """Every pair of a variant and a region that holds it."""
    on = ([chrom] if chrom else []) + ["_bin"]
    left = variants.withColumn("_bin", F.floor(F.col(pos) / width))
    cover = regions.where("start <= end").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    return left.join(cover, on).where((F.col(pos) >= F.col("start")) & (F.col(pos) <= F.col("end"))).drop("_bin")
