import pytest
from pyspark.sql import functions as F

from strandloom.functions import alleles as A
from strandloom.operators.infer import classify_build, classify_sex, strand_lock
from strandloom.sources.text import detect_format


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, codes", [("AA", ["B:A", "B:A"]), ("A-", ["B:A", "MIS"]), ("A/AG", ["B:A", "B:AG"]), ("--", ["MIS", "MIS"]), ("00", ["MIS", "MIS"]), ("??", ["MIS", "MIS"]), ("DI", ["DEL", "INS"]), ("ACT", ["B:ACT"]), ("Z", ["MIS"]), ("", [])])
def test_parse_genotype(spark, raw, codes):
    assert one(spark, A.parse_genotype(F.lit(raw))) == codes


@pytest.mark.parametrize("codes, ref, alts, gt", [(["B:A", "B:C"], "A", ["C"], "0/1"), (["B:T", "B:T"], "A", ["T"], "1/1"), (["MIS", "MIS"], "A", ["T"], "./."), (["B:G", "DEL"], "G", ["DEL"], "0/1"), (["B:A", "B:G"], "A", ["C"], None), (["B:a", "B:A"], "A", ["C"], None)])
def test_gt_format(spark, codes, ref, alts, gt):
    assert one(spark, A.gt_format(F.lit(codes), F.lit(ref), F.lit(alts))) == gt


@pytest.mark.parametrize("gt, out", [("0/1", "1/0"), ("1|2", "0|2"), ("./0", "./1"), ("0", "1"), ("12/0", "12/1")])
def test_gt_remap(spark, gt, out):
    assert one(spark, A.gt_remap(F.lit(gt), F.expr("map(0, 1, 1, 0, 2, 2)"))) == out


@pytest.mark.parametrize("name, key", [("23", "X"), ("24", "Y"), ("25", "X"), ("26", "MT"), ("chrM", "MT"), ("Chr1", "CHR1"), (" chr7 ", "7")])
def test_canonical_contig(spark, name, key):
    assert one(spark, A.canonical_contig(F.lit(name))) == key


@pytest.mark.parametrize("name, kind", [("23", "X"), ("25", "X"), ("24", "Y"), ("26", "autosome"), ("chrM", "autosome")])
def test_chrom_class(spark, name, kind):
    assert one(spark, A.chrom_class(F.lit(name))) == kind


@pytest.mark.parametrize("build, contig, pos, inside", [("GRCh38", "X", 10_001, True), ("GRCh38", "X", 2_781_480, False), ("GRCh37", "Y", 59_363_566, True), ("GRCh37", "1", 60_001, False)])
def test_par(spark, build, contig, pos, inside):
    assert one(spark, A.is_par(F.lit(contig), F.lit(pos), build)) is inside


def test_reverse_complement_twice_is_identity(spark):
    for s in ("ACGT", "acgtNN", "", "GATTACA"):
        assert one(spark, A.revcomp(A.revcomp(F.lit(s)))) == s


def test_driver_decisions():
    assert classify_build({"GRCh37": 90.0, "GRCh38": 80.0}) == "GRCh37"
    assert classify_build({"GRCh37": 80.0, "GRCh38": 80.0}) == "GRCh38"
    assert classify_build({}) == "GRCh38"
    assert strand_lock(60, 0) == "forward" and strand_lock(0, 60) == "reverse"
    with pytest.raises(ValueError):
        strand_lock(10, 0)
    with pytest.raises(ValueError):
        strand_lock(40, 40)
    base = {"autosome": 100, "autosome_called": 100, "autosome_het": 30}
    assert classify_sex(base | {"x": 50, "x_het": 0, "y": 20, "y_called": 19}) == "male"
    assert classify_sex(base | {"x": 50, "x_het": 15, "y": 20, "y_called": 0}) == "female"
    assert classify_sex(base | {"x": 0, "x_het": 0, "y": 0, "y_called": 0}) == "unknown"
    assert detect_format(b"##fileformat=VCFv4.2", "x.txt") == "vcf" and detect_format(b"rs1", "x.txt") == "dtc"
