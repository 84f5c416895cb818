"""BGEN (layout 2) as a Python data source, partitioned by variant ranges.

``spark.read.format("bgen").load(path)`` gives the columns of ``schemas.GENOTYPES``; dosages count the second allele.
Filters on variant_index reach the reader, and no genotype is decoded if the dosages aren't asked for (option
``dosages=false``). Supported are diploid, biallelic variants, phased or not; others are errors. With option
``trusted=true``, missing and ploidy bytes are not looked at.
"""

from __future__ import annotations

import json
import os
import sqlite3
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from allelake.schemas import GENOTYPES, SAMPLES
from allelake.sources.files import open_file

NO_COMPRESSION, ZLIB, ZSTD = 0, 1, 2


@dataclass
class Header:
    variants: int
    samples: int
    compression: int
    layout: int
    sample_names: list[str] | None
    first_variant: int
    free_data: bytes


def read_header(f) -> Header:
    """Header and sample names; the stream may be anywhere."""
    f.seek(0)
    offset, size, variants, samples = struct.unpack("<4I", f.read(16))
    magic = f.read(4)
    if magic not in (b"bgen", b"\0\0\0\0"):
        raise ValueError("not a BGEN file")
    free = f.read(size - 20)
    flags = struct.unpack("<I", f.read(4))[0]
    names = None
    if flags >> 31:
        _, count = struct.unpack("<2I", f.read(8))
        if count != samples:
            raise ValueError(f"{count} sample names for {samples} samples")
        names = [f.read(struct.unpack("<H", f.read(2))[0]).decode() for _ in range(count)]
    header = Header(variants, samples, flags & 3, (flags >> 2) & 15, names, offset + 4, free)
    if header.layout != 2:
        raise ValueError(f"layout {header.layout} is not supported")
    return header


def read_variant(f) -> tuple[str, str, str, int, list[str], int]:
    """Id, rsid, chromosome, position, alleles, and the size of the genotype data that follows."""
    text = lambda kind, n: f.read(struct.unpack(kind, f.read(n))[0]).decode()
    name, rsid, chrom = text("<H", 2), text("<H", 2), text("<H", 2)
    pos, count = struct.unpack("<IH", f.read(6))
    alleles = [text("<I", 4) for _ in range(count)]
    return name, rsid, chrom, pos, alleles, struct.unpack("<I", f.read(4))[0]


def _unpack_bits(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits == 8:
        return np.frombuffer(data, np.uint8, count).astype(np.float64)
    if bits in (16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.float64)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: bits * count].reshape(count, bits)
    return flat.astype(np.float64) @ (2.0 ** np.arange(bits))


def decode_dosages(data: bytes, compression: int, samples: int, trusted: bool = False) -> tuple[np.ndarray, bool]:
    """Dosages of the second allele (nan: missing) of a genotype block, and whether it is phased."""
    if compression:
        size = struct.unpack("<I", data[:4])[0]
        data = zlib.decompress(data[4:]) if compression == ZLIB else pa.Codec("zstd").decompress(data[4:], decompressed_size=size, asbytes=True)
    n, alleles, least, most = struct.unpack("<IHBB", data[:8])
    if n != samples or alleles != 2 or (least, most) != (2, 2):
        raise ValueError(f"{n} samples, {alleles} alleles and ploidy {least} to {most}: only diploid biallelic variants of {samples} samples are supported")
    ploidy = np.frombuffer(data, np.uint8, n, 8)
    phased, bits = data[8 + n], data[9 + n]
    if not 1 <= bits <= 32:
        raise ValueError(f"{bits} bits a probability")
    p = _unpack_bits(data[10 + n :], bits, 2 * n).reshape(n, 2) / (2.0**bits - 1)
    dosage = (2 - p.sum(1)) if phased else p[:, 1] + 2 * (1 - p.sum(1))
    if not trusted:
        if ((ploidy & 63) != 2).any():
            raise ValueError("a sample isn't diploid")
        dosage = np.where(ploidy & 128, np.nan, dosage)
    return dosage.astype(np.float32), bool(phased)


def encode_variant(name: str, rsid: str, chrom: str, pos: int, alleles: list[str], probabilities: np.ndarray, phased: bool, missing: np.ndarray, compression: int = ZLIB, bits: int = 8) -> bytes:
    """A variant block; ``probabilities`` (samples x 2): P(00), P(01) unphased, or P(allele 0) of each haplotype."""
    p = np.round(np.asarray(probabilities) * (2**bits - 1)).astype(np.uint64)
    flat = ((p.reshape(-1, 1) >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    body = struct.pack("<IHBB", len(p), len(alleles), 2, 2) + (2 | (missing.astype(np.uint8) << 7)).astype(np.uint8).tobytes() + bytes([phased, bits]) + np.packbits(flat, bitorder="little").tobytes()
    if compression:
        packed = zlib.compress(body) if compression == ZLIB else pa.Codec("zstd").compress(body, asbytes=True)
        body = struct.pack("<I", len(body)) + packed
    text = lambda kind, s: struct.pack(kind, len(s.encode())) + s.encode()
    return text("<H", name) + text("<H", rsid) + text("<H", chrom) + struct.pack("<IH", pos, len(alleles)) + b"".join(text("<I", a) for a in alleles) + struct.pack("<I", len(body)) + body


def encode_file(samples: list[str] | int, blocks: list[bytes], compression: int = ZLIB, free_data: bytes = b"") -> bytes:
    """A whole file of variant blocks; a number of samples leaves their names out."""
    names = samples if isinstance(samples, list) else None
    n = len(samples) if names is not None else samples
    block = b""
    if names is not None:
        body = b"".join(struct.pack("<H", len(x.encode())) + x.encode() for x in names)
        block = struct.pack("<2I", len(body) + 8, n) + body
    size = 20 + len(free_data)
    flags = compression | 2 << 2 | (1 << 31 if names is not None else 0)
    head = struct.pack("<3I", size, len(blocks), n) + b"bgen" + free_data + struct.pack("<I", flags)
    return struct.pack("<I", len(head) + len(block)) + head + block + b"".join(blocks)


@dataclass
class Stretch(InputPartition):
    """Variants [start, stop) that begin at a byte."""

    start: int
    stop: int
    offset: int


def variant_offsets(path: str, header: Header) -> np.ndarray:
    """Byte of each variant: from the index beside the file if there is one, else by going through the variants' heads."""
    index = path.removeprefix("file://") + ".bgi"
    if "://" not in index and os.path.exists(index):
        with sqlite3.connect(f"file:{index}?mode=ro", uri=True) as db:
            return np.array([r[0] for r in db.execute("SELECT file_start_position FROM Variant ORDER BY file_start_position")], np.int64)
    out, at = [], header.first_variant
    with open_file(path) as f:
        for _ in range(header.variants):
            f.seek(at)
            out.append(at)
            *_, size = read_variant(f)
            at = f.tell() + size
    return np.array(out, np.int64)


def build_index(path: str, index: str | None = None) -> str:
    """Write the index of a local file: a table of chromosome, position, identifier, alleles and byte range."""
    target = index or path + ".bgi"
    if os.path.exists(target):
        os.remove(target)
    with open_file(path) as f, sqlite3.connect(target) as db:
        header = read_header(f)
        db.execute("CREATE TABLE Variant (chromosome TEXT, position INT, rsid TEXT, number_of_alleles INT, allele1 TEXT, allele2 TEXT, file_start_position INT, size_in_bytes INT)")
        at = header.first_variant
        for _ in range(header.variants):
            f.seek(at)
            _, rsid, chrom, pos, alleles, size = read_variant(f)
            end = f.tell() + size
            db.execute("INSERT INTO Variant VALUES (?, ?, ?, ?, ?, ?, ?, ?)", (chrom, pos, rsid, len(alleles), alleles[0], alleles[1] if len(alleles) > 1 else None, at, end - at))
            at = end
    return target


def pushed_range(filters: list[Filter], column: str) -> tuple[int, int | None, list[Filter]]:
    """Bounds [low, high) on an integer column among the filters, and the filters that are left."""
    low, high, left = 0, None, []
    for x in filters:
        if getattr(x, "attribute", None) != (column,):
            left.append(x)
        elif isinstance(x, GreaterThanOrEqual):
            low = max(low, x.value)
        elif isinstance(x, GreaterThan):
            low = max(low, x.value + 1)
        elif isinstance(x, LessThan):
            high = x.value if high is None else min(high, x.value)
        elif isinstance(x, LessThanOrEqual):
            high = x.value + 1 if high is None else min(high, x.value + 1)
        elif isinstance(x, EqualTo):
            low, high = max(low, x.value), x.value + 1 if high is None else min(high, x.value + 1)
        else:
            left.append(x)
    return low, high, left


class BgenSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bgen"

    def schema(self):
        return GENOTYPES

    def reader(self, schema) -> DataSourceReader:
        return BgenReader(self.options)


class BgenReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.chunk = options["path"], int(options.get("chunk_size", "8192"))
        self.trusted = options.get("trusted", "false").lower() == "true"
        self.dosages = options.get("dosages", "true").lower() == "true"
        self.low, self.high = 0, None
        self.ranges = json.loads(options["ranges"]) if "ranges" in options else None
        with open_file(self.path) as f:
            self.header = read_header(f)

    def pushFilters(self, filters):
        self.low, self.high, left = pushed_range(filters, "variant_index")
        yield from left

    def partitions(self):
        parts = stretches(self.ranges, self.low, self.header.variants if self.high is None else min(self.high, self.header.variants), self.chunk)
        if not parts:
            return [Stretch(0, 0, 0)]
        at = variant_offsets(self.path, self.header)
        return [Stretch(a, b, int(at[a])) for a, b in parts]

    def read(self, partition):
        columns: list[list] = [[] for _ in range(7)]
        most = rows_at_once(self.header.samples if self.dosages else 0)
        with open_file(self.path) as f:
            f.seek(partition.offset)
            for i in range(partition.start, partition.stop):
                name, rsid, chrom, pos, alleles, size = read_variant(f)
                if len(alleles) != 2:
                    raise ValueError(f"variant {i}: {len(alleles)} alleles")
                dosage = None
                if self.dosages:
                    dosage, _ = decode_dosages(f.read(size), self.header.compression, self.header.samples, self.trusted)
                else:
                    f.seek(f.tell() + size)
                for c, v in zip(columns, (i, chrom, pos, rsid or name, alleles[0], alleles[1], dosage), strict=True):
                    c.append(v)
                if len(columns[0]) == most:
                    yield _batch(columns)
                    columns = [[] for _ in range(7)]
        yield _batch(columns)


def rows_at_once(samples: int) -> int:
    """Variants of one batch: 4 MB of dosages, 256 at most."""
    return max(1, min(256, (1 << 20) // max(1, samples)))


def stretches(ranges: list | None, low: int, high: int, size: int) -> list[tuple[int, int]]:
    """Half-open ranges of at most ``size`` variants that cover the given ones (default: all) between ``low`` and ``high``."""
    out = []
    for a, b in [(low, high)] if ranges is None else ranges:
        a, b = max(a, low), min(b, high)
        out += [(i, min(i + size, b)) for i in range(a, b, size)]
    return out


def _batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    rows = columns[6]
    if not rows or rows[0] is None:  # dosages are asked for or not, for all variants alike
        lists = pa.nulls(len(rows), pa.list_(pa.float32()))
    else:
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(rows), pa.float32(), from_pandas=True))
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=False)), lists], [f.name for f in GENOTYPES])


def read_bgen(spark: SparkSession, path: str, chunk_size: int = 8192, trusted: bool = False, dosages: bool = True, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """Variants of a BGEN file; ``ranges`` are half-open ranges of variant_index that alone are read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BgenSource)
    read = spark.read.format("bgen").option("chunk_size", chunk_size).option("trusted", str(trusted).lower()).option("dosages", str(dosages).lower())
    return (read if ranges is None else read.option("ranges", json.dumps(ranges))).load(path)


#: So many chosen variants are read by their own ranges; of more, the ranges are those of whole blocks that hold some.
EXACT_RANGES, BLOCK_VARIANTS = 1 << 17, 1 << 10


def ranges_of(chosen: DataFrame) -> list[tuple[int, int]]:
    """Half-open ranges that hold all of ``chosen`` (variant_index): to the driver go bounded numbers or one for each block."""
    step = 1
    rows = chosen.limit(EXACT_RANGES + 1).collect()
    if len(rows) > EXACT_RANGES:
        step, rows = BLOCK_VARIANTS, chosen.select(F.floor(F.col("variant_index") / BLOCK_VARIANTS).alias("b")).distinct().collect()
    at = np.unique(np.array([r[0] for r in rows], np.int64))
    edge = np.flatnonzero(np.diff(at) > 1)
    return [(int(a) * step, (int(b) + 1) * step) for a, b in zip(at[np.append(0, edge + 1)], at[np.append(edge, len(at) - 1)], strict=True)] if len(at) else []


def embedded_samples(spark: SparkSession, path: str) -> DataFrame | None:
    """Samples named in the file; None if it names none."""
    with open_file(path) as f:
        names = read_header(f).sample_names
    return None if names is None else spark.createDataFrame([(i, x, x) for i, x in enumerate(names)], SAMPLES)


def check_trusted(variants: DataFrame) -> None:
    """Raise if a dosage is missing (a reader that isn't trusted raises for other ploidies itself)."""
    bad = variants.where(F.exists("dosages", lambda x: x.isNull())).select("variant_index").limit(1).collect()
    if bad:
        raise ValueError(f"variant {bad[0][0]} has missing dosages")


def load_indexed(spark: SparkSession, path: str, ranges: DataFrame | None = None, rsids: list[str] | None = None, samples: list[int] | None = None) -> DataFrame:
    """Variants in any of the ranges (chrom, start, end; ends included) or with one of the identifiers, each once, with the
    dosages of the given samples in their order (default: all). Without either, no variant.

    Heads are read first; then only the ranges of variant_index that hold chosen variants are decoded.
    """
    from allelake.operators.align import select_samples
    from allelake.operators.ranges import in_regions

    heads = read_bgen(spark, path, dosages=False).drop("dosages")
    chosen = heads.where("false").select("variant_index")
    if ranges is not None:
        chosen = chosen.union(in_regions(heads, ranges).select("variant_index"))
    if rsids:
        chosen = chosen.union(heads.where(F.col("variant_id").isin(rsids)).select("variant_index"))
    chosen = chosen.distinct()
    out = read_bgen(spark, path, ranges=ranges_of(chosen)).join(chosen, "variant_index", "left_semi")
    if samples is not None:
        out = out.withColumn("dosages", select_samples(F.col("dosages"), F.array(*(F.lit(i) for i in samples))))
    return out.orderBy("chrom", "genpos", "variant_index")
