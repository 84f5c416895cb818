"""PLINK binary genotypes (.bed, .bim, .fam) as a Python data source; dosages count the first allele of the .bim file."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from allelake.schemas import GENOTYPES, SAMPLES
from allelake.sources.bgen import Stretch, _batch, pushed_range, rows_at_once, stretches
from allelake.sources.files import open_file, read_lines

#: Dosage of each 2-bit code (0: two first alleles, 1: missing, 2: one, 3: none).
DOSAGES = [2.0, np.nan, 1.0, 0.0]
MAGIC = b"\x6c\x1b\x01"


class BedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "plink_bed"

    def schema(self):
        return GENOTYPES

    def reader(self, schema) -> DataSourceReader:
        return BedReader(self.options)


class BedReader(DataSourceReader):
    """Variants are of one size each, so a range of them is a range of bytes."""

    def __init__(self, options):
        self.stem, self.chunk = options["path"].removesuffix(".bed"), int(options.get("chunk_size", "8192"))
        self.samples = sum(1 for x in read_lines(self.stem + ".fam") if x.strip())
        self.low, self.high = 0, None
        self.ranges, self.dosages = json.loads(options["ranges"]) if "ranges" in options else None, options.get("dosages", "true").lower() == "true"
        with open_file(self.stem + ".bed") as f:
            if f.read(3) != MAGIC:
                raise ValueError("not a variant-major .bed file")
            self.variants = (f.size() - 3) // max(1, (self.samples + 3) // 4)

    def pushFilters(self, filters):
        self.low, self.high, left = pushed_range(filters, "variant_index")
        yield from left

    def partitions(self):
        high = self.variants if self.high is None else min(self.high, self.variants)
        return [Stretch(a, b, 0) for a, b in stretches(self.ranges, self.low, high, self.chunk)] or [Stretch(0, 0, 0)]

    def read(self, partition):
        width, table = (self.samples + 3) // 4, np.array(DOSAGES, np.float32)
        with open_file(self.stem + ".bim") as f:
            bim = [x.split() for x in f.read().decode().splitlines()[partition.start : partition.stop]]
        columns: list[list] = [[] for _ in range(7)]
        most = rows_at_once(self.samples if self.dosages else 0)
        with open_file(self.stem + ".bed") as f:
            f.seek(3 + partition.start * width)
            for i, (chrom, name, _, pos, a1, a2) in enumerate(bim, partition.start):
                dosage = None
                if self.dosages:
                    codes = np.frombuffer(f.read(width), np.uint8)
                    dosage = table[((codes[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).ravel()[: self.samples]]
                for c, v in zip(columns, (i, chrom, int(pos), name, a2, a1, dosage), strict=True):
                    c.append(v)
                if len(columns[0]) == most:
                    yield _batch(columns)
                    columns = [[] for _ in range(7)]
        yield _batch(columns)


def read_bed(spark: SparkSession, path: str, chunk_size: int = 8192, dosages: bool = True, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """Variants of a .bed file and its side files; ``ranges`` are half-open ranges of variant_index that alone are read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BedSource)
    read = spark.read.format("plink_bed").option("chunk_size", chunk_size).option("dosages", str(dosages).lower())
    return (read if ranges is None else read.option("ranges", json.dumps(ranges))).load(path)


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a .fam file."""
    rows = [x.split() for x in read_lines(path) if x.strip()]
    return spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], SAMPLES)


def encode_bed(dosages: np.ndarray) -> bytes:
    """A .bed file of dosages 0, 1, 2 or nan (variants x samples)."""
    codes = np.select([np.isnan(dosages), dosages == 2, dosages == 1], [1, 0, 2], 3).astype(np.uint8)
    codes = np.pad(codes, ((0, 0), (0, -codes.shape[1] % 4)))
    packed = (codes.reshape(len(codes), -1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(2).astype(np.uint8)
    return MAGIC + packed.tobytes()
