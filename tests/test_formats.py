"""Fixed-width PGEN, block gzip, named LD, VCF with dosages, quality control by probability, console reports."""

import gzip
import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelake import runtime
from allelake.operators.variant_stats import autosomal, quality_control
from allelake.sources import bgen_tools, blocks, pgen, text


def test_pgen(spark, tmp_path):
    rng = np.random.default_rng(5)
    calls = rng.integers(0, 3, (9, 7)).astype(float)
    calls[2, 3] = np.nan
    doses = np.where(np.isnan(calls), np.nan, np.clip(np.round((calls + 0.25) * 16384) / 16384, 0, 2))
    (tmp_path / "p.pvar").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\n" + "".join(f"1\t{100 + i}\trs{i}\tA\tG\n" for i in range(9)))
    for g, only in ((calls, True), (doses, False)):
        (tmp_path / "p.pgen").write_bytes(pgen.encode_pgen(g, only))
        rows = pgen.read_pgen(spark, str(tmp_path / "p.pgen"), 4).orderBy("variant_index").collect()
        assert [(r.variant_id, r.genpos, r.allele0, r.allele1) for r in rows] == [(f"rs{i}", 100 + i, "A", "G") for i in range(9)]
        np.testing.assert_allclose(np.array([[np.nan if x is None else x for x in r.dosages] for r in rows]), g)
    some = pgen.read_pgen(spark, str(tmp_path / "p.pgen"), 4, ranges=[(1, 3), (8, 9)])
    assert sorted(r.variant_index for r in some.collect()) == [1, 2, 8]
    assert [r.variant_index for r in pgen.read_pgen(spark, str(tmp_path / "p.pgen")).where("variant_index = 5").collect()] == [5]
    (tmp_path / "q.pgen").write_bytes(b"\x6c\x1b\x10" + bytes(9))
    with pytest.raises(ValueError, match="0x10"):
        pgen.read_head(str(tmp_path / "q.pgen"))


def test_block_gzip(spark, tmp_path):
    path = str(tmp_path / "x.gz")
    noise = np.random.default_rng(1).bytes(200_000)
    out = blocks.BlockWriter(path)
    out.write("head\n")
    out.write(noise)
    place = out.tell()
    out.pack("iH", -2, 7)
    out.close()
    with pytest.raises(ValueError, match="closed"):
        out.write("x")
    tail = b"\xfe\xff\xff\xff\x07\x00"
    assert gzip.decompress((tmp_path / "x.gz").read_bytes()) == b"head\n" + noise + tail
    assert b"".join(blocks.read_from(path, place)) == tail
    with blocks.BlockWriter(path, "a") as more:
        more.write(b"end")
    assert gzip.decompress((tmp_path / "x.gz").read_bytes()) == b"head\n" + noise + tail + b"end"
    for mode in ("wu", "au"):
        with blocks.BlockWriter(str(tmp_path / "plain"), mode) as f:
            f.write("ab")
            assert f.tell() == (2 if mode == "wu" else 4)
    assert (tmp_path / "plain").read_bytes() == b"abab"
    with pytest.raises(ValueError, match="mode r"):
        blocks.BlockWriter(path, "r")
    files = blocks.write_lines(spark.range(1000).select(F.col("id").cast("string")), str(tmp_path / "lines")).collect()
    assert sum(r.lines for r in files) == 1000
    assert sorted(int(r.value) for r in spark.read.text([r.path for r in files]).collect()) == list(range(1000))


def test_named_ld(spark, tmp_path):
    r2 = np.array([[1, 0.5, 0.25], [0.5, 1, 0.1], [0.25, 0.1, 1]])
    (tmp_path / "ld").write_bytes(text.encode_ld(r2, 10))
    (tmp_path / "ld.snplist").write_text("a\nb\nc\n")
    got = {(r.variant_i, r.variant_j): round(r.r2, 3) for r in text.read_ld(spark, str(tmp_path / "ld")).collect()}
    assert got == {("a", "b"): 0.5, ("a", "c"): 0.25, ("b", "c"): 0.1}


def test_vcf_dosages(spark):
    rows = spark.createDataFrame([(0, "1", 5, "v", "A", "G", [0.25, None, 1.5, 2.0])], "variant_index long, chrom string, genpos long, variant_id string, allele0 string, allele1 string, dosages array<float>")
    line = bgen_tools.to_vcf(rows, True).first().value.split("\t")
    assert line[8:] == ["GT:DS", "0/0:0.250000", "./.:.", "1/1:1.50000", "1/1:2.00000"]
    assert bgen_tools.vcf_header(["s", "t"])[-1].split("\t")[8:] == ["FORMAT", "s", "t"]


def test_quality_control_by_probability(spark):
    rows = [("ok", "chr1", i, [0, 1, 1, 2][i % 4]) for i in range(400)] + [("off", "1", i, [0, 2][i % 2]) for i in range(400)] + [("x", "X", i, [0, 1, 1, 2][i % 4]) for i in range(400)]
    g = spark.createDataFrame(rows, "variant string, chrom string, sample int, g int")
    kept = lambda **k: {r.variant for r in quality_control(g, ["variant"], "sample", **k).select("variant").distinct().collect()}
    assert kept() == {"ok", "off", "x"}
    assert kept(hwe_p=1e-15) == {"ok", "x"} and kept(hwe_p=1e-15, chrom="chrom") == {"ok"}
    names = spark.createDataFrame([(x,) for x in ("1", "22", "chr9", "Chr10", "23", "X", "chrM", "0", "")], "c string")
    assert {r.c for r in names.where(autosomal(F.col("c"))).collect()} == {"1", "22", "chr9", "Chr10"}


def test_reports(spark, caplog):
    assert runtime.progress_bar(4, 0.5) == "[**  ]" and runtime.progress_bar(4, 7) == "[****]"
    assert runtime.progress_bar(4, float("nan")) == runtime.progress_bar(4, -1) == "[    ]"
    assert runtime.wrap("aa bb cc dd", 7, 2, 1) == "aa bb\n cc dd"
    with pytest.raises(ValueError, match="left"):
        runtime.wrap("a", 3, 0, 3)
    assert json.loads(runtime.report(spark))["master"] == "local[4]"
    with pytest.raises(sqlite3.Error) as e:
        sqlite3.connect(":memory:").execute("select absent")
    assert runtime.index_error(e.value, "select absent") == 'SQLITE_ERROR: no such column: absent, in statement "select absent"'
    with caplog.at_level("INFO", "allelake"), runtime.timed("work"):
        pass
    assert caplog.messages[0].startswith("work: ")
    rows, seen = runtime.profiled(spark.createDataFrame([([0.0, None, float("nan")],), ([1.0, 2.0, 0.0],)], "dosages array<float>"))
    assert rows.count() == 2 and seen.get == {"rows": 2, "values": 6, "missing": 2}
