"""File sources on hand-made files, and whole runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelake.operators.chunks import commit_chunks, read_chunks
from allelake.plans import step2
from allelake.plans.step2 import Inputs, run, run_association
from allelake.schemas import RESULTS, BinaryCorrection, TraitType
from allelake.sources import bgen, plink, samples, text
from allelake.streaming.results import commit_stream, read_stream, windowed_counts


def test_sample_files():
    assert samples.parse_samples(["ID missing", "0 0", "alpha 0", "beta 0"]) == [(0, "alpha", "alpha"), (1, "beta", "beta")]
    assert samples.parse_samples(["ID_1 ID_2 missing sex", "0 0 0 D", "fam1 ind1 0 F", "fam2 ind2 0 M"]) == [(0, "fam1", "ind1"), (1, "fam2", "ind2")]
    with pytest.raises(ValueError, match="must mark the first identifier column with type '0'"):
        samples.parse_samples(["ID missing", "D 0", "alpha 0"])
    with pytest.raises(ValueError, match="has 1 values, but the header declares 2 columns"):
        samples.parse_samples(["ID missing", "0 0", "alpha"])


def test_sample_path(tmp_path):
    g = tmp_path / "study.bgen"
    g.touch()
    assert samples.resolve_sample_path(str(g)) is None
    (tmp_path / "study.sample").touch()
    assert samples.resolve_sample_path(str(g)) == str(tmp_path / "study.sample")
    assert samples.resolve_sample_path(str(g), "other") == "other"


def write_bgen(path, g, phased=False, missing=None, compression=bgen.ZLIB, bits=8, names=True):
    blocks = []
    for j in range(g.shape[1]):
        d = g[:, j]
        p = np.column_stack([d < 2, d < 1]).astype(float) if phased else np.column_stack([d == 0, d == 1]).astype(float)
        m = np.zeros(len(d), bool) if missing is None else missing[:, j]
        blocks.append(bgen.encode_variant(f"v{j}", f"rs{j}", str(1 + j // 4), 100 + j, ["A", "G"], p, phased, m, compression, bits))
    path.write_bytes(bgen.encode_file([f"s{i}" for i in range(len(g))] if names else len(g), blocks, compression))
    return str(path)


@pytest.mark.parametrize("phased,compression,bits", [(False, bgen.ZLIB, 8), (True, bgen.ZSTD, 16), (False, bgen.NO_COMPRESSION, 3), (True, bgen.ZLIB, 32)])
def test_bgen(spark, tmp_path, phased, compression, bits):
    g = np.random.default_rng(1).integers(0, 3, (7, 9)).astype(float)
    missing = np.zeros(g.shape, bool)
    missing[2, 3] = True
    path = write_bgen(tmp_path / "x.bgen", g, phased, missing, compression, bits)
    rows = bgen.read_bgen(spark, path, chunk_size=4).orderBy("variant_index").collect()
    assert [r.variant_id for r in rows] == [f"rs{j}" for j in range(9)]
    got = np.array([[np.nan if v is None else v for v in r.dosages] for r in rows]).T
    assert np.allclose(got, np.where(missing, np.nan, g), equal_nan=True, atol=1e-6)
    part = bgen.read_bgen(spark, path).where("variant_index >= 2 and variant_index < 5")
    assert [r.variant_index for r in part.orderBy("variant_index").collect()] == [2, 3, 4]
    with pytest.raises(ValueError, match="variant 3"):
        bgen.check_trusted(bgen.read_bgen(spark, path))
    assert [r.individual_identifier for r in bgen.embedded_samples(spark, path).orderBy("sample_index").collect()][:2] == ["s0", "s1"]
    # An index gives the same variants; subsets equal the whole, then selected.
    bgen.build_index(path)
    ranges = spark.createDataFrame([("1", 101, 102)], "chrom string, start long, end long")
    some = bgen.load_indexed(spark, path, ranges, ["rs2", "rs8"], [5, 0]).collect()
    assert [r.variant_id for r in some] == ["rs1", "rs2", "rs8"]
    assert np.allclose([r.dosages for r in some], got[[5, 0]][:, [1, 2, 8]].T, atol=1e-6)
    assert bgen.load_indexed(spark, path).count() == 0


def test_bgen_rejects(tmp_path):
    (tmp_path / "bad").write_bytes(b"x" * 64)
    with pytest.raises(ValueError, match="not a BGEN"), bgen.open_file(str(tmp_path / "bad")) as f:
        bgen.read_header(f)


def test_plink(spark, tmp_path):
    g = np.random.default_rng(2).integers(0, 3, (6, 5)).astype(float)  # variants x samples
    g[1, 2] = np.nan
    (tmp_path / "p.bed").write_bytes(plink.encode_bed(g))
    (tmp_path / "p.bim").write_text("".join(f"1 rs{i} 0 {i + 10} A G\n" for i in range(6)))
    (tmp_path / "p.fam").write_text("".join(f"f{i} i{i} 0 0 1 -9\n" for i in range(5)))
    rows = plink.read_bed(spark, str(tmp_path / "p.bed"), 2).orderBy("variant_index").collect()
    assert np.allclose([[np.nan if v is None else v for v in r.dosages] for r in rows], g, equal_nan=True)
    assert (rows[0].allele0, rows[0].allele1) == ("G", "A")


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n01\t1\tV1\tA\tG\t.\t.\t.\tGT:GP\t0/1:0,1,0\t0:1,0\n01\t1\tV2,V2.1\tA\tG,T\t.\t.\t.\tGT:HP\t0|1:1,0,0,0,1,0\t.:.\n".replace("\t.:.", "\t1|1:0,1,0,0,1,0"))
    calls = text.read_vcf(spark, str(tmp_path / "a.vcf")).orderBy("variant_key", "sample").collect()
    assert [(r.variant_id, r.sample, r.ploidy, len(r.probabilities)) for r in calls] == [("V1", "s1", 2, 3), ("V1", "s2", 1, 2), ("V2,V2.1", "s1", 2, 6), ("V2,V2.1", "s2", 2, 6)]
    (tmp_path / "h").write_text("1 SNP1 rs1 10 A G 0 1 1 1\n")
    assert text.read_haps(spark, str(tmp_path / "h")).first().dosages == [1.0, 2.0]
    (tmp_path / "s").write_text("SET1 1 1 a,b,c\nSET2 2 5 d\n")
    assert [r.variants for r in text.read_sets(spark, str(tmp_path / "s")).orderBy("set_id").collect()] == [["a", "b", "c"], ["d"]]
    (tmp_path / "j").write_text("S1,S2,S3\nS4 S5\n")
    assert sorted(r.sets for r in text.read_joint_sets(spark, str(tmp_path / "j")).collect()) == [["S1", "S2", "S3"], ["S4", "S5"]]
    (tmp_path / "m").write_text("M2  pLof,missense\n")
    assert text.read_masks(spark, str(tmp_path / "m")).first() == ("M2", ["pLof", "missense"])
    r2 = np.array([[1, 0.5, 0.25], [0.5, 1, 0.1], [0.25, 0.1, 1]])
    (tmp_path / "ld").write_bytes(text.encode_ld(r2, 10))
    (tmp_path / "ld.snplist").write_text("a\nb\nc\n")
    got = {(r.i, r.j): r.r2 for r in text.read_ld(spark, str(tmp_path / "ld")).collect()}
    assert {k: round(v, 3) for k, v in got.items()} == {(0, 1): 0.5, (0, 2): 0.25, (1, 2): 0.1}
    (tmp_path / "ld.snplist").write_text("a\n")
    with pytest.raises(Exception, match="3 variants, but 1 names"):
        text.read_ld(spark, str(tmp_path / "ld")).collect()


def study(tmp_path, n=60, m=10):
    rng = np.random.default_rng(4)
    g = rng.integers(0, 3, (n, m)).astype(float)
    age = rng.normal(size=n).round(4)
    y = (g[:, 2] * 1.5 + age + rng.normal(size=n)).round(4)
    path = write_bgen(tmp_path / "study.bgen", g)
    (tmp_path / "pheno").write_text("FID IID y b\n" + "".join(f"s{i} s{i} {'NA' if i == 5 else y[i]} {int(y[i] > 1)}\n" for i in range(n)))
    (tmp_path / "covar").write_text("FID IID age\n" + "".join(f"s{i} s{i} {age[i]}\n" for i in range(n)))
    return g, age, y, path


def test_linear_run_and_restart(spark, tmp_path, monkeypatch):
    original = step2.run_association
    g, age, y, path = study(tmp_path)
    x = Inputs(path, str(tmp_path / "pheno"), "y", covar=str(tmp_path / "covar"), covar_names=["age"], chunk_size=3)
    made = run(spark, x, str(tmp_path / "out"))
    final = spark.read.parquet(made.final)
    assert [(f.name, f.dataType) for f in final.schema] == [(f.name, f.dataType) for f in RESULTS]
    rows = final.toPandas().sort_values("genpos")
    assert len(rows) == 10 and (rows.n == 59).all()
    keep = np.arange(60) != 5
    q, _ = np.linalg.qr(np.column_stack([np.ones(59), age[keep]]))
    r = y[keep] - q @ (q.T @ y[keep])
    for j, row in enumerate(rows.itertuples()):
        v = g[keep, j]
        den = v @ v - ((q.T @ v) ** 2).sum()
        assert np.isclose(row.beta, v @ r / den, rtol=1e-5) and np.isclose(row.chisq, (v @ r) ** 2 / (r @ r / 57 * den), rtol=1e-4)
    assert rows.log10p.idxmax() == rows.index[2]
    # A lost chunk is made again, the others stay; another chunk size gives the same tests.
    import shutil

    shutil.rmtree(next((tmp_path / "out/chunks").glob("chunk_identifier=1")))
    again = spark.read.parquet(run(spark, x, str(tmp_path / "out")).final).toPandas().sort_values("genpos")
    assert np.allclose(again.beta, rows.beta)
    x.chunk_size = 100
    other = spark.read.parquet(run(spark, x, str(tmp_path / "out2")).final).toPandas().sort_values("genpos")
    assert np.allclose(other.chisq, rows.chisq)
    assert run(spark, x, str(tmp_path / "out3"), finalize=False).final is None
    with pytest.raises(ValueError, match="chunk_size"):  # its chunk numbers mean other variants
        run(spark, x, str(tmp_path / "out"))
    # A finished run decodes and tests nothing when it is started again; a broken one only the open ranges.
    asked = []
    monkeypatch.setattr(step2, "run_association", lambda *a: asked.append(a[-1]) or original(*a))
    run(spark, x, str(tmp_path / "out2"))
    assert not asked
    x.chunk_size = 3
    for i in (1, 3):
        shutil.rmtree(next((tmp_path / "out/chunks").glob(f"chunk_identifier={i}")))
    again = spark.read.parquet(run(spark, x, str(tmp_path / "out")).final).toPandas().sort_values("genpos")
    assert np.allclose(again.beta, rows.beta) and asked == [[(3, 6), (9, 10)]]


def test_predictions_and_binary(spark, tmp_path):
    g, age, y, path = study(tmp_path)
    (tmp_path / "loco").write_text("FID_IID " + " ".join(f"s{i}_s{i}" for i in range(60)) + "\n1 " + " ".join(["0.5"] * 60) + "\n2 " + " ".join(str(v) for v in age) + "\n")
    (tmp_path / "pred.list").write_text(f"y {tmp_path / 'loco'}\n")
    plain = run(spark, Inputs(path, str(tmp_path / "pheno"), "y"), str(tmp_path / "o1"))
    loco = run(spark, Inputs(path, str(tmp_path / "pheno"), "y", pred=str(tmp_path / "pred.list")), str(tmp_path / "o2"))
    a, b = (spark.read.parquet(m.final).toPandas().sort_values("genpos", ignore_index=True) for m in (plain, loco))
    one = a.chrom == "1"
    assert np.allclose(a.beta[one], b.beta[one], rtol=1e-4)  # a constant changes nothing
    v = g[np.arange(60) != 5]
    r = (y - age)[np.arange(60) != 5]
    assert np.isclose(b.beta[4], np.cov(v[:, 4], r)[0, 1] / v[:, 4].var(ddof=1), rtol=1e-4)
    table = run_association(spark, Inputs(path, str(tmp_path / "pheno"), "y", pred=str(tmp_path / "pred.list")))
    assert table._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # all chromosomes in one scan
    (tmp_path / "few").write_text("FID_IID s0_s0 s1_s1\n1 0.5 0.5\n")
    (tmp_path / "few.list").write_text(f"y {tmp_path / 'few'}\n")
    with pytest.raises(ValueError, match="57 samples have no prediction"):
        run_association(spark, Inputs(path, str(tmp_path / "pheno"), "y", pred=str(tmp_path / "few.list")))
    for c in BinaryCorrection:
        made = run(spark, Inputs(path, str(tmp_path / "pheno"), "b"), str(tmp_path / f"o{c}"), TraitType.BINARY, c)
        assert spark.read.parquet(made.final).where("log10p is not null").count() == 10


def test_streams(spark, tmp_path):
    rows = spark.range(20).select(F.floor(F.col("id") / 5).alias("chunk_identifier"), F.col("id").alias("genpos"))
    from allelake.schemas import to_schema

    to_schema(rows, RESULTS).repartition(4).write.parquet(str(tmp_path / "in"))
    for files in (1, 4):  # each file holds rows of every chunk
        for _ in range(2):  # a second start finds nothing new
            commit_stream(read_stream(spark, str(tmp_path / "in"), files_at_once=files), str(tmp_path / f"out{files}"), str(tmp_path / f"cp{files}")).awaitTermination()
            got = read_chunks(spark, str(tmp_path / f"out{files}"))
            assert sorted(r.genpos for r in got.collect()) == list(range(20))
            assert {r[0] for r in got.select("chunk_identifier").distinct().collect()} == {0, 1, 2, 3}
    commit_chunks(rows.where("genpos < 3"), str(tmp_path / "out1"), part=0)  # a batch again: its own part alone
    assert read_chunks(spark, str(tmp_path / "out1")).where("genpos >= 3").count() >= 12
    events = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(events).schema
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev/e.parquet").symlink_to(events)
    q = windowed_counts(read_stream(spark, str(tmp_path / "ev"), schema)).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    whole = spark.read.parquet(events)
    assert spark.sql("select sum(n) from w").first()[0] == whole.count()


def test_cli_arguments():
    from allelake.cli import parser

    a = parser().parse_args(["step2-binary", "--bed", "x", "--pheno", "p", "--pheno-name", "y", "--out", "o", "--correction", "spa"])
    assert a.correction == "spa" and a.mode == "step2-binary"
