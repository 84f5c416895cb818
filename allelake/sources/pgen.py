"""Fixed-width PGEN genotypes (.pgen, .pvar, .psam) as a Python data source; dosages count the alternative allele.

Of the format's storage modes, 0x02 (hard calls) and 0x03 (hard calls and unphased dosages) have records of one size each,
so a range of variants is a range of bytes; other modes are refused with their number.
"""

from __future__ import annotations

import io
import itertools
import json
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from allelake.schemas import GENOTYPES
from allelake.sources.bgen import Stretch, _batch, pushed_range, rows_at_once, stretches
from allelake.sources.files import open_file

MAGIC, HEAD, CALLS, DOSES = b"\x6c\x1b", 12, 2, 3
#: Dosage of each 2-bit code, the unit of 16-bit dosages and their missing value.
CALL_DOSAGES = [0.0, 1.0, 2.0, np.nan]
DOSAGE_UNIT, DOSAGE_MISSING = 16384, 65535


def read_head(path: str) -> tuple[int, int, int]:
    """(storage mode, variants, samples) of a .pgen file."""
    with open_file(path) as f:
        head = f.read(HEAD)
    if len(head) < HEAD or head[:2] != MAGIC:
        raise ValueError(f"{path}: not a .pgen file")
    if head[2] not in (CALLS, DOSES):
        raise ValueError(f"{path}: storage mode {head[2]:#04x} isn't of fixed width")
    return head[2], *struct.unpack_from("<2I", head, 3)


def _lines(path: str):
    """(line, fields) of a side file but for its ## lines, read piece by piece."""
    with open_file(path) as f:
        for line in io.TextIOWrapper(f, "utf-8"):
            if line.strip() and not line.startswith("##"):
                yield line.split()


class PgenSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pgen"

    def schema(self):
        return GENOTYPES

    def reader(self, schema) -> DataSourceReader:
        return PgenReader(self.options)


class PgenReader(DataSourceReader):
    def __init__(self, options):
        self.stem, self.chunk = options["path"].removesuffix(".pgen"), int(options.get("chunk_size", "8192"))
        self.mode, self.variants, self.samples = read_head(self.stem + ".pgen")
        self.low, self.high = 0, None
        self.ranges, self.dosages = json.loads(options["ranges"]) if "ranges" in options else None, options.get("dosages", "true").lower() == "true"

    def pushFilters(self, filters):
        self.low, self.high, left = pushed_range(filters, "variant_index")
        yield from left

    def partitions(self):
        high = self.variants if self.high is None else min(self.high, self.variants)
        return [Stretch(a, b, 0) for a, b in stretches(self.ranges, self.low, high, self.chunk)] or [Stretch(0, 0, 0)]

    def _decode(self, record: bytes) -> np.ndarray:
        calls = (self.samples + 3) // 4
        if self.mode == DOSES:
            units = np.frombuffer(record, "<u2", self.samples, calls)
            return np.where(units == DOSAGE_MISSING, np.nan, units / DOSAGE_UNIT).astype(np.float32)
        codes = np.frombuffer(record, np.uint8, calls)
        return np.array(CALL_DOSAGES, np.float32)[((codes[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).ravel()[: self.samples]]

    def read(self, partition):
        width = (self.samples + 3) // 4 + (2 * self.samples if self.mode == DOSES else 0)
        most = rows_at_once(self.samples if self.dosages else 0)
        columns: list[list] = [[] for _ in range(7)]
        side = _lines(self.stem + ".pvar")
        names = [x.lstrip("#") for x in next(side)]
        at = [names.index(x) for x in ("CHROM", "POS", "ID", "REF", "ALT")]
        with open_file(self.stem + ".pgen") as f:
            f.seek(HEAD + partition.start * width)
            rows = itertools.islice(side, partition.start, partition.stop)
            for i, fields in enumerate(rows, partition.start):
                chrom, pos, name, ref, alt = (fields[j] for j in at)
                dosage = self._decode(f.read(width)) if self.dosages else None
                for c, v in zip(columns, (i, chrom, int(pos), name, ref, alt, dosage), strict=True):
                    c.append(v)
                if len(columns[0]) == most:
                    yield _batch(columns)
                    columns = [[] for _ in range(7)]
        yield _batch(columns)


def read_pgen(spark: SparkSession, path: str, chunk_size: int = 8192, dosages: bool = True, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """Variants of a .pgen file and its .pvar file; ``ranges`` are half-open ranges of variant_index that alone are read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PgenSource)
    read = spark.read.format("pgen").option("chunk_size", chunk_size).option("dosages", str(dosages).lower())
    return (read if ranges is None else read.option("ranges", json.dumps(ranges))).load(path)


def encode_pgen(dosages: np.ndarray, calls_only: bool = True) -> bytes:
    """A .pgen file of dosages from 0 to 2 or nan (variants x samples), as hard calls or as 16-bit dosages."""
    n, m = dosages.shape
    codes = np.where(np.isnan(dosages), 3, np.floor(np.nan_to_num(dosages) + 0.5)).astype(np.uint8)
    packed = (np.pad(codes, ((0, 0), (0, -m % 4))).reshape(n, -1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(2).astype(np.uint8)
    head = MAGIC + bytes([CALLS if calls_only else DOSES]) + struct.pack("<2I", n, m) + b"\x00"
    if calls_only:
        return head + packed.tobytes()
    units = np.where(np.isnan(dosages), DOSAGE_MISSING, np.round(np.nan_to_num(dosages) * DOSAGE_UNIT)).astype("<u2")
    return head + b"".join(a.tobytes() + b.tobytes() for a, b in zip(packed, units, strict=True))
