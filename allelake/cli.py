"""Command line: python -m allelake.cli step2-linear --bgen FILE --pheno FILE --pheno-name NAME --out FOLDER ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from allelake.plans.step2 import Inputs, run
from allelake.schemas import BinaryCorrection, Device, TraitType


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="allelake")
    modes = p.add_subparsers(dest="mode", required=True)
    for mode in ("step2-linear", "step2-binary"):
        m = modes.add_parser(mode)
        source = m.add_mutually_exclusive_group(required=True)
        source.add_argument("--bgen")
        source.add_argument("--bed")
        m.add_argument("--sample")
        m.add_argument("--pheno", required=True)
        m.add_argument("--pheno-name", required=True)
        m.add_argument("--covar")
        m.add_argument("--covar-names", default="", help="separated by commas")
        m.add_argument("--pred")
        m.add_argument("--out", required=True)
        m.add_argument("--chunk-size", type=int, default=8192)
        m.add_argument("--trusted-no-missing-diploid", action="store_true")
        m.add_argument("--no-final", action="store_true")
        m.add_argument("--device", choices=[x.value for x in Device], default="cpu", help="accepted, without effect")
        if mode == "step2-binary":
            m.add_argument("--correction", choices=[x.value for x in BinaryCorrection], default="firth_approximate")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("allelake").getOrCreate()
    x = Inputs(a.bgen or a.bed, a.pheno, a.pheno_name, "bgen" if a.bgen else "plink", a.sample, a.covar, [c for c in a.covar_names.split(",") if c], a.pred, a.chunk_size, a.trusted_no_missing_diploid)
    binary = a.mode == "step2-binary"
    made = run(spark, x, a.out, TraitType.BINARY if binary else TraitType.QUANTITATIVE, BinaryCorrection(a.correction) if binary else BinaryCorrection.FIRTH_APPROXIMATE, not a.no_final)
    print(json.dumps(made.__dict__))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
