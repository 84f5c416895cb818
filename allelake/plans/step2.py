"""Whole runs: from genotype files and sample tables to committed result chunks and one final table."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelake.operators import binary, chunks, linear, ordered
from allelake.operators.align import KEY
from allelake.operators.align import align_samples as aligned
from allelake.schemas import BinaryCorrection, GenotypeFormat, TraitType
from allelake.sources import bgen, plink
from allelake.sources.samples import generated_samples, load_samples, read_predictions, read_table, resolve_sample_path


@dataclass
class Inputs:
    """Files and columns of a run."""

    genotypes: str
    pheno: str
    pheno_name: str
    format: str = "bgen"
    sample: str | None = None
    covar: str | None = None
    covar_names: list[str] = field(default_factory=list)
    pred: str | None = None
    chunk_size: int = ordered.CHUNK
    trusted: bool = False


@dataclass
class Artifacts:
    """What a run has written."""

    run_folder: str
    chunks_folder: str
    final: str | None


def read_variants(spark: SparkSession, x: Inputs, dosages: bool = True, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """Wide genotypes, or the variants' heads alone."""
    if GenotypeFormat(x.format) is GenotypeFormat.PLINK:
        return plink.read_bed(spark, x.genotypes, x.chunk_size, dosages, ranges)
    return bgen.read_bgen(spark, x.genotypes, x.chunk_size, x.trusted, dosages, ranges)


def load_genotypes(spark: SparkSession, x: Inputs, ranges: list[tuple[int, int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Wide genotypes and their samples: an explicit or adjacent sample file, else the names in the file, else made-up ones."""
    rows = read_variants(spark, x, ranges=ranges)
    if GenotypeFormat(x.format) is GenotypeFormat.PLINK:
        return rows, plink.read_fam(spark, x.genotypes.removesuffix(".bed") + ".fam")
    path = resolve_sample_path(x.genotypes, x.sample)
    if path is not None:
        return rows, load_samples(spark, path)
    embedded = bgen.embedded_samples(spark, x.genotypes)
    if embedded is not None:
        return rows, embedded
    with bgen.open_file(x.genotypes) as f:
        return rows, generated_samples(spark, bgen.read_header(f).samples)


def load_samples_of(spark: SparkSession, x: Inputs, samples: DataFrame) -> DataFrame:
    """Aligned samples with the trait ``y`` and covariates."""
    pheno = read_table(spark, x.pheno, [x.pheno_name]).withColumnRenamed(x.pheno_name, "y")
    covar = read_table(spark, x.covar, x.covar_names or None) if x.covar else None
    return aligned(samples, pheno, covar)


def _arrays(samples: DataFrame, columns: list[str]) -> dict[str, np.ndarray]:
    """Sample vectors, in sample order; their size is that of one genotype row."""
    rows = samples.select("sample_index", *columns).orderBy("sample_index").toArrow()
    return {c: rows.column(c).to_numpy() for c in ["sample_index", *columns]}


def linear_kernel(x: np.ndarray, residual: np.ndarray, sigma2: float):
    """Test of one variant's dosages (nan: missing) against a trait's residual on an orthonormal basis ``x``."""

    def test(g: np.ndarray) -> dict:
        seen = ~np.isnan(g)
        n = int(seen.sum())
        out: dict = {"n": n, "a1freq": None, "beta": None, "se": None, "chisq": None, "log10p": None, "extra_code": None}
        if not n:
            return out
        g = np.where(seen, g, g[seen].mean())
        out["a1freq"] = float(g.mean() / 2)
        den = float(g @ g - ((x.T @ g) ** 2).sum())
        if den <= 1e-10 * max(1.0, float(g @ g)):
            return out
        num = float(g @ residual)
        chisq = num * num / (sigma2 * den)
        return out | {"beta": num / den, "se": float(np.sqrt(sigma2 / den)), "chisq": chisq, "log10p": binary._log10p(chisq)}

    return test


def run_association(spark: SparkSession, x: Inputs, trait: TraitType = TraitType.QUANTITATIVE, correction: BinaryCorrection = BinaryCorrection.FIRTH_APPROXIMATE, plan: DataFrame | None = None, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """Result rows of all variants (or of ``ranges`` of them), with their chunks (of the ``plan``, by default that of all).

    Genotypes stay wide, are decoded once and never shuffled; what is broadcast are vectors of samples, one trait residual
    for each chromosome that has predictions. A sample without a prediction for one of these is an error.
    """
    wide, samples = load_genotypes(spark, x, ranges)
    plan = chunk_plan(spark, x) if plan is None else plan
    table = load_samples_of(spark, x, samples)
    names = [c for c in table.columns if c not in ("sample_index", "y", *KEY)]
    v = _arrays(table, ["y", *names])
    if not len(v["y"]):
        raise ValueError("no sample has the trait and all covariates")
    design = np.column_stack([np.ones(len(v["y"])), *(v[c] for c in names)]).astype(np.float64)
    keep = ["variant_index", "chrom", "genpos", "variant_id", "allele0", "allele1"]
    index = spark.sparkContext.broadcast(v["sample_index"])
    if trait is TraitType.BINARY:
        null, _, fine = binary.logistic_fit(design, v["y"].astype(np.float64))
        if not fine:
            raise ValueError("the null logistic model does not converge")
        model = spark.sparkContext.broadcast((design, v["y"].astype(np.float64), binary.sigmoid(design @ null)))
        found = binary.over_variants(wide, lambda g: binary.variant_test(g[index.value], *model.value, correction.value), binary.RESULT, keep)
    else:
        q, r = np.linalg.qr(design)
        q = q[:, np.abs(np.diag(r)) > 1e-9 * np.abs(np.diag(r)).max()]
        by_chrom: dict[str | None, np.ndarray] = {None: v["y"].astype(np.float64)}
        if x.pred:
            predictions = read_predictions(spark, x.pred).join(table.select("sample_index", *KEY), KEY).select("chrom", "sample_index", "loco_pred")
            place = {int(s): i for i, s in enumerate(v["sample_index"])}
            for chrom, group in predictions.toPandas().groupby("chrom"):  # a number for each sample and chromosome
                lost = len(v["y"]) - group.dropna().sample_index.nunique()
                if lost:
                    raise ValueError(f"chromosome {chrom}: {lost} samples have no prediction")
                y = v["y"].astype(np.float64).copy()
                y[[place[int(s)] for s in group["sample_index"]]] -= group["loco_pred"].to_numpy()
                by_chrom[str(chrom)] = y
        shared = spark.sparkContext.broadcast((q, {k: y - q @ (q.T @ y) for k, y in by_chrom.items()}))

        def kernel(g: np.ndarray, chrom: str) -> dict:
            basis, residuals = shared.value
            res = residuals.get(chrom, residuals[None])
            return linear_kernel(basis, res, float(res @ res / max(1, len(res) - basis.shape[1])))(g[index.value])

        found = binary.over_variants(wide, kernel, binary.RESULT, keep, given=["chrom"])
    return chunks.with_chunks(found, plan, x.chunk_size)


def chunk_plan(spark: SparkSession, x: Inputs) -> DataFrame:
    """Chunks of all variants, from their heads."""
    return ordered.chunk_plan(read_variants(spark, x, dosages=False), size=x.chunk_size)


def _facts(x: Inputs, trait: TraitType, correction: BinaryCorrection) -> dict:
    """What a run's chunks are made from: its options, and the sizes of its files."""
    names = {"genotypes": x.genotypes.removesuffix(".bed") + ".bed" if GenotypeFormat(x.format) is GenotypeFormat.PLINK else x.genotypes, "pheno": x.pheno, "covar": x.covar, "pred": x.pred, "sample": x.sample}
    facts = asdict(x) | {"trait": str(trait), "correction": str(correction)}
    for k, path in names.items():
        if path:
            with bgen.open_file(path) as f:
                facts[f"{k} bytes"] = f.size()
    return facts


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open ranges, joined where they touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def run(spark: SparkSession, x: Inputs, out: str, trait: TraitType = TraitType.QUANTITATIVE, correction: BinaryCorrection = BinaryCorrection.FIRTH_APPROXIMATE, finalize: bool = True) -> Artifacts:
    """A resumable run: chunks that ``out`` holds already are kept, and their variants neither decoded nor tested again.

    ``out`` records options and sizes of the inputs; a run with others in the same folder is an error.
    """
    chunks.claim(spark, out, _facts(x, trait, correction))
    todo = chunks.remaining(chunk_plan(spark, x), chunks.committed(spark, out)).collect()  # a row for each open chunk
    if todo:
        plan = spark.createDataFrame(todo)
        ranges = merged([(r["variant_start_index"], r["variant_stop_index"]) for r in todo])
        chunks.commit_chunks(run_association(spark, x, trait, correction, plan, ranges), out)
    return Artifacts(out, f"{out}/chunks", chunks.finalize(spark, out) if finalize else None)
