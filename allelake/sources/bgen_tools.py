"""Making BGEN files from others, and VCF text from variants."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelake.sources.bgen import read_header
from allelake.sources.files import exists, open_file


def concatenate(paths: list[str], out: str, clobber: bool = False, omit_samples: bool = False, free_data: bytes | None = None) -> int:
    """Write the variants of several files with equal samples and compression as one local file; gives their number."""
    if exists(out) and not clobber:
        raise FileExistsError(out)
    headers = []
    for p in paths:
        with open_file(p) as f:
            headers.append(read_header(f))
    first = headers[0]
    for p, h in zip(paths, headers, strict=True):
        if (h.samples, h.compression, h.sample_names) != (first.samples, first.compression, first.sample_names):
            raise ValueError(f"{p}: other samples or compression than {paths[0]}")
    total = sum(h.variants for h in headers)
    with open(out, "wb") as target:
        target.write(_head(total, first.samples, first.compression, None if omit_samples else first.sample_names, first.free_data if free_data is None else free_data))
        for p, h in zip(paths, headers, strict=True):
            with open_file(p) as f:
                f.seek(h.first_variant)
                while data := f.read(1 << 20):
                    target.write(data)
    return total


def _head(variants: int, samples: int, compression: int, names: list[str] | None, free_data: bytes) -> bytes:
    block = b""
    if names is not None:
        body = b"".join(struct.pack("<H", len(x.encode())) + x.encode() for x in names)
        block = struct.pack("<2I", len(body) + 8, samples) + body
    head = struct.pack("<3I", 20 + len(free_data), variants, samples) + b"bgen" + free_data + struct.pack("<I", compression | 8 | (1 << 31 if names is not None else 0))
    return struct.pack("<I", len(head) + len(block)) + head + block


def edit(path: str, out: str, free_data: bytes | None = None, drop_samples: bool = False) -> None:
    """A copy of a file with other free data, or without sample names."""
    concatenate([path], out, clobber=False, omit_samples=drop_samples, free_data=free_data)


def vcf_line(dosages: Column) -> Column:
    """Hard calls of dosages, as VCF genotypes."""
    return F.array_join(F.transform(dosages, lambda d: F.when(d.isNull(), "./.").when(d < 0.5, "0/0").when(d < 1.5, "0/1").otherwise("1/1")), "\t")


#: Header lines of a VCF with hard calls and dosages.
VCF_HEAD = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Hard call">', '##FORMAT=<ID=DS,Number=1,Type=Float,Description="Dosage of the alternative allele">']


def vcf_header(samples: list[str]) -> list[str]:
    """Header lines of a VCF of these samples."""
    return [*VCF_HEAD, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def vcf_dosages(dosages: Column) -> Column:
    """Hard calls and dosages (to six digits), as VCF fields."""
    value = lambda d: F.concat(vcf_line(F.array(d)), F.lit(":"), F.coalesce(F.format_string("%.6g", d.cast("double")), F.lit(".")))
    return F.array_join(F.transform(dosages, lambda d: F.when(d.isNull() | F.isnan(d), "./.:.").otherwise(value(d))), "\t")


def to_vcf(variants: DataFrame, with_dosages: bool = False) -> DataFrame:
    """One VCF line per variant, in order of variant_index within partitions; ``vcf_header`` gives the lines before them."""
    calls = vcf_dosages(F.col("dosages")) if with_dosages else vcf_line(F.col("dosages"))
    return variants.select("variant_index", F.concat_ws("\t", "chrom", F.col("genpos").cast("string"), "variant_id", "allele0", "allele1", F.lit("."), F.lit("."), F.lit("."), F.lit("GT:DS" if with_dosages else "GT"), calls).alias("value"))
