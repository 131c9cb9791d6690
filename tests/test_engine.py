import gzip
import io
import zipfile
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.operators import lift
from strandloom.plans.engine import Config, convert_file
from strandloom.sinks import plink
from strandloom.sources import bcf, fasta, layered, text


def put(folder: Path, name: str, data: str | bytes) -> str:
    path = folder / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def zipped(data: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", data)
    return out.getvalue()


def body(path: str) -> list[str]:
    lines = [x for p in sorted(Path(path).glob("part-*")) for x in p.read_text().splitlines()]
    return [x for x in lines if not x.startswith("##")]


@pytest.mark.parametrize("name, wrap", [("a.txt", lambda b: b), ("a.gz", gzip.compress), ("b.txt", gzip.compress), ("a.zip", zipped), ("b.gz", zipped), ("c.gz", lambda b: gzip.compress(gzip.compress(b))), ("d.zip", lambda b: zipped(gzip.compress(b))), ("e.gz", lambda b: gzip.compress(b[:9]) + gzip.compress(b[9:]))])
def test_layers(name, wrap):
    assert text.peel(wrap(b"rs1 1 42 AG\nrs2 1 43 CC\n")) == b"rs1 1 42 AG\nrs2 1 43 CC\n"


def test_small_conversion(spark, tmp_path):
    fasta = put(tmp_path, "r.fa", ">1\nACGT\nACGT\n>2\nTTTTCCCC\n")
    calls = put(tmp_path, "c.txt", "# a comment\nrsid\tchromosome\tposition\tgenotype\nrs1\t1\t2\tCC\nrs2\t1\t3\tAG\nrs3\t2\t4\tTT\nrs4\tUn\t1\tAA\nbad line\n")
    got = convert_file(spark, Config(calls, fasta, str(tmp_path / "out"), sex="female"))
    assert got == {"reference_records": 2, "variant_records": 1, "unknown_chromosomes": 1, "parse_errors": 1}
    lines = body(str(tmp_path / "out"))
    assert lines[0].startswith("#CHROM") and [x.split("\t")[:5] + [x.split("\t")[-1]] for x in lines[1:]] == [["1", "2", "rs1", "C", ".", "0/0"], ["1", "3", "rs2", "G", "A", "1/0"], ["2", "4", "rs3", "T", ".", "0/0"]]


def test_more_than_one_sample_raises(spark, tmp_path):
    fasta = put(tmp_path, "r.fa", ">1\nACGT\n")
    for n in (1, 2):
        names, gts = "\t".join(f"s{i}" for i in range(n)), "\t".join(["0/1"] * n)
        vcf = put(tmp_path, f"c{n}.vcf", f"##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{names}\n1\t2\t.\tC\tA\t.\t.\t.\tGT\t{gts}\n")
        if n == 1:
            assert convert_file(spark, Config(vcf, fasta, str(tmp_path / "o1"))) == {"variant_records": 1}
        else:
            with pytest.raises(ValueError, match="more than one sample"):
                convert_file(spark, Config(vcf, fasta, str(tmp_path / "o2")))


def test_empty_input(spark, tmp_path):
    got = convert_file(spark, Config(put(tmp_path, "c.txt", ""), put(tmp_path, "r.fa", ">1\nACGT\n"), str(tmp_path / "out"), sex="female"))
    assert got == {} and len(body(str(tmp_path / "out"))) == 1


def test_panel_run(spark, tmp_path):
    fasta = put(tmp_path, "r.fa", ">1\n" + "T" * 2000 + "\n")
    calls = put(tmp_path, "c.txt", "".join(f"rs{i}\t1\t{i}\t{'AG' if i == 1500 else 'TT'}\n" for i in range(1490, 1510)))
    for alt, alts in (("A", "A,G"), ("TA", "A,G")):
        site = put(tmp_path, f"p{alt}.vcf", f"##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n1\t1500\t.\tT\t{alt}\t.\t.\t.\n")
        convert_file(spark, Config(calls, fasta, str(tmp_path / f"o{alt}"), sex="female", panel=site))
        assert [x.split("\t")[4] for x in body(str(tmp_path / f"o{alt}")) if "\t1500\t" in x] == [alts]
        panel = [x.split("\t") for x in body(str(tmp_path / f"o{alt}_panel"))[1:]]
        assert [(x[1], x[4]) for x in panel if x[1] == "1500"] == [("1500", ",".join(dict.fromkeys([alt, "A", "G"])))] and [int(x[1]) for x in panel] == sorted(int(x[1]) for x in panel)


def test_panel_keeps_its_records_and_samples(spark, tmp_path):
    """The grown panel is the panel's own lines with added ALTs, and new sites with missing samples; the same from a BCF panel."""
    fasta = put(tmp_path, "r.fa", ">1\n" + "T" * 40 + "\n")
    calls = put(tmp_path, "c.txt", "rs1 1 5 AG\nrs2 1 9 TT\nrs3 1 20 TC\n")
    head = '##fileformat=VCFv4.2\n##INFO=<ID=AF,Number=A,Type=Float,Description="x">\n##FILTER=<ID=q10,Description="y">\n##FORMAT=<ID=DP,Number=1,Type=Integer,Description="d">\n##FORMAT=<ID=GT,Number=1,Type=String,Description="g">\n##contig=<ID=1,length=40>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n'
    site = put(tmp_path, "p.vcf", head + "1\t5\trsA\tT\tA\t30\tPASS\tAF=0.5\tGT:DP\t0|1:3\t1|1:4\n1\t20\trsB\tT\tC\t.\tq10\t.\tGT\t0|0\t0|1\n1\t30\trsC\tT\tG\t.\t.\t.\n")
    convert_file(spark, Config(calls, fasta, str(tmp_path / "out"), sex="female", panel=site))
    text_of = lambda p: "".join(x.read_text() for x in sorted(Path(p).glob("part-*")))
    assert text_of(tmp_path / "out_panel").startswith(head)
    missing = "GT:DP\t./.:.\t./.:."
    assert body(str(tmp_path / "out_panel"))[1:] == ["1\t5\trsA\tT\tA,G\t30\tPASS\tAF=0.5\tGT:DP\t0|1:3\t1|1:4", f"1\t9\t1:9:T:.\tT\t.\t.\t.\t.\t{missing}", "1\t20\trsB\tT\tC\t.\tq10\t.\tGT\t0|0\t0|1", f"1\t30\trsC\tT\tG\t.\t.\t.\t{missing}"]
    import json

    facts = json.loads("".join(p.read_text() for p in (tmp_path / "out_report").glob("part-*")))
    assert facts["panel"] == {"modified": 1, "novel": 1, "total": 4}
    lines = [(x, c) for x, c in ((5, "0|1"), (20, "0|0"))]
    records = spark.createDataFrame([("1", p, f"rs{p}", "T", ["A" if p == 5 else "C"], [gt, "1|1"], {"SVTYPE": "X"}) for p, gt in lines], "chrom string, pos long, id string, ref string, alts array<string>, gts array<string>, info map<string,string>").coalesce(1)
    from strandloom.sinks import files, vcf

    top = [x.replace("\tme", "\ts1\ts2") for x in vcf.header([("1", 40)], "me")]
    files.write_parts(bcf.blocks(records, top), [("data", str(tmp_path / "bcf"), bcf.bgzf(bcf.header_bytes(top)), bcf.END_BLOCK)])
    path = put(tmp_path, "p.bcf", b"".join(x.read_bytes() for x in sorted((tmp_path / "bcf").glob("part-*"))))
    assert bcf.header_lines(spark, path) == top
    convert_file(spark, Config(calls, fasta, str(tmp_path / "from_bcf"), sex="female", panel=path))
    got = body(str(tmp_path / "from_bcf_panel"))[1:]
    assert got[0] == "1\t5\trs5\tT\tA,G\t.\t.\tSVTYPE=X\tGT\t0|1\t1|1" and [x.split("\t")[1:5] for x in got[1:]] == [["9", "1:9:T:.", "T", "."], ["20", "rs20", "T", "C"]]


def test_vcf_with_lift(spark, tmp_path):
    vcf = put(tmp_path, "a.vcf", "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\nchr1\t3\t.\tG\tA\t.\t.\t.\tGT\t0/1\nchr1\t900\t.\tG\tA\t.\t.\t.\tGT\t0/1\n")
    src, dst = put(tmp_path, "s.fa", ">chr1\n" + "ACGT" * 300 + "\n"), put(tmp_path, "d.fa", ">chr1\n" + "T" * 100 + "ACAT" * 300 + "\n")
    chain = put(tmp_path, "x.chain", "chain 100 chr1 1200 + 0 100 chr1 1300 + 100 200 1\n100\n\n")
    got = convert_file(spark, Config(vcf, src, str(tmp_path / "out"), sex="female", chain=chain, lift_reference=dst))
    assert got == {"variant_records": 1, "liftover_unmapped": 1}
    assert [x.split("\t")[1:5] + [x.split("\t")[-1]] for x in body(str(tmp_path / "out"))[1:]] == [["103", "chr1:103:A:G", "A", "G", "1/0"]]  # polarised, and named, on the output's reference
    got = convert_file(spark, Config(vcf, src, str(tmp_path / "kept"), sex="female", chain=chain, lift_reference=dst, standardize=False))
    assert got == {"variant_records": 1, "liftover_unmapped": 1}
    assert [x.split("\t")[:5] + [x.split("\t")[-1]] for x in body(str(tmp_path / "kept"))[1:]] == [["chr1", "103", ".", "A", "G", "1/0"]]


def test_calls_are_lifted_before_the_reference_is_asked(spark, tmp_path):
    """REF is the base of the output's reference; a call at a place the input's reference lacks is lifted all the same."""
    calls = put(tmp_path, "c.txt", "rs1 1 1 AG\nrs2 1 2 CC\nrs3 1 3 GT\nrs4 1 4 DI\nrs5 1 50 AA\nrs6 1 900 AA\nrs7 1 5 --\nbad\n")
    src, dst = put(tmp_path, "s.fa", ">1\n" + "TTTT" * 5 + "\n"), put(tmp_path, "d.fa", ">chr1\n" + "T" * 10 + "GCAT" * 30 + "\n")
    chain = put(tmp_path, "x.chain", "chain 100 chr1 1200 + 0 100 chr1 1300 + 10 110 1\n100\n\n")
    got = convert_file(spark, Config(calls, src, str(tmp_path / "out"), sex="female", chain=chain, lift_reference=dst))
    assert got == {"variant_records": 3, "reference_records": 2, "liftover_straddled": 1, "liftover_unmapped": 1, "parse_errors": 1}
    lines = [x.split("\t") for x in body(str(tmp_path / "out"))[1:]]
    assert [[x[0], *x[1:5], x[-1]] for x in lines] == [["chr1", "11", "rs1", "G", "A", "1/0"], ["chr1", "12", "rs2", "C", ".", "0/0"], ["chr1", "13", "rs3", "A", "G,T", "1/2"], ["chr1", "15", "rs7", "G", ".", "./."], ["chr1", "60", "rs5", "C", "A", "1/1"]]


def test_lift_vectors(spark):
    def run(pos, blocks):
        df = spark.createDataFrame(blocks, "t_chrom string, t_start long, t_end long, chain_id int, score long, q_chrom string, q_start long, q_size long, q_strand string")
        r = lift.lift_point(spark.createDataFrame([(1, "chr1", pos)], "rid long, chrom string, pos long"), df).first()
        return r["status"], r["q_pos"]

    plus = ("1", 100, 200, 1, 100, "1", 200, 1000, "+")
    assert run(100, [plus]) == ("lifted", 200) and run(150, [plus]) == ("lifted", 250) and run(50, [plus])[0] == "unmapped"
    minus = ("1", 100, 200, 1, 100, "1", 100, 1000, "-")
    assert run(100, [minus]) == ("lifted", 899) and run(199, [minus]) == ("lifted", 800)
    assert run(150, [plus, ("1", 100, 200, 2, 90, "1", 500, 1000, "+")]) == ("lifted", 250)
    assert run(150, [plus, ("1", 100, 200, 2, 100, "1", 500, 1000, "+")])[0] == "ambiguous"


def test_fasta_layouts_agree(spark):
    def blocks(lines):
        df = spark.createDataFrame(list(enumerate(lines)), "ord long, line string")
        return sorted(tuple(r) for r in text.fasta_blocks(df, 5).collect())

    assert blocks([">1 x", "ACGTACGTACGT", ">2", "TT"]) == blocks([">1 x", "ACG", "TACGT", "A", "CGT", ">2", "T", "T"])


def test_plink_bytes(spark):
    gts = [["0/0", "1/1", "./.", "1/1", "1/1", "1/1"], ["1/1", "./.", "0/1", "1/1", "1/1", "1/1"], ["1/1", "0/1", "0/1", "./.", "./.", "0/0"]]
    df = spark.createDataFrame([(i, ["G"], g) for i, g in enumerate(gts)], "ord long, alts array<string>, gts array<string>")
    assert [bytes(r["data"]).hex().upper() for r in plink.bed_rows(df).select("ord", plink.as_binary(F.col("b")).alias("data")).orderBy("ord").collect()] == ["DC0F", "E70F", "6B01"]


def test_stream_of_calls(spark, tmp_path):
    from strandloom.streaming.calls import call_stream

    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "a.txt", "rs1 1 42 AG\n# c\nrs2 1 x AA\n")
    q = call_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("calls_in").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["genotype"] or "", r["error"] or "") for r in spark.table("calls_in").collect()) == [("", "position"), ("AG", "")]


def test_bcf_round_trip(spark, tmp_path):
    """VCF to BCF with our writer, the file read back, and again as the input of a conversion."""
    fasta = put(tmp_path, "r.fa", ">1\n" + "ACGT" * 30 + "\n")
    vcf_in = put(tmp_path, "a.vcf", "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n1\t1\t.\tA\tC,G\t.\t.\t.\tGT\t1|2\n1\t6\t.\tC\tT\t.\t.\t.\tGT\t./.\n1\t9\t.\tA\t<DEL>\t.\t.\t.\tGT\t0\n")
    convert_file(spark, Config(vcf_in, fasta, str(tmp_path / "out"), sex="female", output_format="bcf"))
    path = put(tmp_path, "b.bin", b"".join(x.read_bytes() for x in sorted((tmp_path / "out").glob("part-*"))))
    got = [(r["pos"], r["ref"], r["alts"], r["samples"][0]["GT"]) for r in bcf.read(spark, path).orderBy("pos").collect()]
    assert got == [(1, "A", ["C", "G"], "1|2"), (6, "C", ["T"], "./."), (9, "A", ["<DEL>"], "0")]
    assert convert_file(spark, Config(path, fasta, str(tmp_path / "again"), sex="female")) == {"variant_records": 3}
    assert [x.split("\t")[-1] for x in body(str(tmp_path / "again"))[1:]] == ["1|2", "./.", "0"]


def test_panel_samples_and_order(spark):
    from strandloom.sinks.panel import panel_lines, sample_fields

    assert sample_fields(2, ["DP", "GT"]) == "GT:DP\t./.:.\t./.:." and sample_fields(0, []) == ""
    with pytest.raises(ValueError):
        sample_fields(1, [])
    df = spark.createDataFrame([("chr2", 5, "A", ["C"], "original"), ("1", 9, "A", ["C"], "original"), ("1", 3, "T", ["G"], "novel"), ("zz", 1, "A", [], "novel")], "chrom string, pos long, ref string, alts array<string>, kind string")
    got = [r["line"].split("\t")[:5] for r in panel_lines(df, ["1", "2"]).orderBy("rank", "tail", "pos").collect()]
    assert got == [["1", "3", "1:3:T:G", "T", "G"], ["1", "9", ".", "A", "C"], ["chr2", "5", ".", "A", "C"], ["zz", "1", "zz:1:A:.", "A", "."]]


def test_command_line():
    from strandloom.plans.cli import config, sample_name, summary_lines

    c = config(["a.b.txt", "out", "--reference", "r.fa", "--sex", "male", "--format", "plink", "--infer-strand"])
    assert (c.sample, c.sex, c.output_format, c.strand) == ("a_b", "male", "plink", None) and sample_name("x://h/q.vcf") == "q"
    assert summary_lines({"b": 2, "a": 1}) == ["total_records: 3", "a: 1", "b: 2"]
    with pytest.raises(SystemExit):
        config(["a", "o", "--reference", "r", "--input-build", "GRCh37"])


def test_vcf_keeps_its_fields_without_standardizing(spark, tmp_path):
    fasta = put(tmp_path, "r.fa", ">2\nACGT\n>chr1\n" + "ACGT" * 10 + "\n")
    head = '##fileformat=VCFv4.2\n##INFO=<ID=AC,Number=A,Type=Integer,Description="x">\n##FILTER=<ID=q10,Description="y">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n'
    rows = "1\t3\trs1;rs2\tC\tA,T\t30\tq10\tAC=1,2;DB;AC=9;MQ=3\tGT:DP:XX:GQ\t1|2:7:z:8\n1\t5\t.\tA\tC\t.\tPASS\t.\tGT\t0/1:9\nUn\t1\t.\tA\tG\t1.5\t.\t.\tGT:DP\t0/1\n2\t1\t.\tA\tG\t.\t.\tX\tGT:GT\t0/1:1/1\n"
    got = convert_file(spark, Config(put(tmp_path, "a.vcf", head + rows), fasta, str(tmp_path / "out"), standardize=False))
    assert got == {"variant_records": 3, "parse_errors": 1}
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert '##INFO=<ID=AC,Number=A,Type=Integer,Description="x">' in text and "##FILTER=<ID=q10" in text
    assert body(str(tmp_path / "out"))[1:] == ["2\t1\t.\tA\tG\t.\t.\tX\tGT\t0/1", "chr1\t3\trs1;rs2\tC\tA,T\t30\tq10\tAC=1,2;DB;MQ=3.0\tGT:GQ:DP\t1|2:8:7", "Un\t1\t.\tA\tG\t1.5\t.\t.\tGT\t0/1"]


def test_plink_files(spark, tmp_path):
    fasta = put(tmp_path, "r.fa", ">1\nACGTACGT\n")
    calls = put(tmp_path, "c.txt", "rs1 1 2 CC\nrs2 1 3 AG\nrs3 1 4 AA\nrs4 1 5 CG\n")
    convert_file(spark, Config(calls, fasta, str(tmp_path / "out"), output_format="plink", sample="me", sex="male"))
    cat = lambda kind: b"".join(p.read_bytes() for p in sorted((tmp_path / f"out.{kind}").glob("part-*")))
    assert cat("bed").hex().upper() == "6C1B01" + "02" + "03" + "02" + "02"
    assert cat("bim").decode().splitlines() == ["1\trs2\t0\t3\tG\tA", "1\trs3\t0\t4\tT\tA", "1\trs4_ALT1\t0\t5\tA\tC", "1\trs4_ALT2\t0\t5\tA\tG"]
    assert cat("fam") == b"me\tme\t0\t0\t1\t-9\n"


def test_names_that_belie_and_mixed_folders(spark, tmp_path):
    line = "rs1 1 42 AG\n"
    (tmp_path / "mixed").mkdir()
    for name, data in (("a.txt", line.encode()), ("b.txt", gzip.compress(line.encode())), ("c.gz", line.encode()), ("d.gz", gzip.compress(line.encode()))):
        put(tmp_path / "mixed", name, data)
    assert [r["line"] for r in text.read_lines(spark, str(tmp_path / "mixed")).collect()] == ["rs1 1 42 AG"] * 4
    assert [r["line"] for r in text.read_lines(spark, str(tmp_path / "mixed" / "c.gz")).collect()] == ["rs1 1 42 AG"]
    assert text.peek(spark, str(tmp_path / "mixed" / "b.txt")) == line.encode()


def test_build_sex_and_names(spark, tmp_path):
    from strandloom.operators import infer

    assert infer.builds_match("hg19", "GRCh37") and infer.builds_match("GRCh38", "hg38") and not infer.builds_match("hg19", "hg38") and not infer.builds_match("x", "y")
    mine, other = put(tmp_path, "a.fa", ">1\n" + "ACGT" * 20 + "\n"), put(tmp_path, "b.fa", ">1\n" + "CATG" * 20 + "\n")
    calls = put(tmp_path, "c.txt", "".join(f"rs{i} 1 {i} {'ACGT'[(i - 1) % 4] * 2}\n" for i in range(1, 70)) + "bad\n")
    got = convert_file(spark, Config(calls, mine, str(tmp_path / "out"), sex="female", other_reference=other, limit=60))
    assert got == {"reference_records": 60, "parse_errors": 1}
    import json

    facts = json.loads("".join(p.read_text() for p in (tmp_path / "out_report").glob("part-*")))
    assert facts["detected_build"] == "GRCh38" and facts["match_rate_GRCh38"] == 100.0
    rows = spark.createDataFrame([("1", i, "0/1" if i % 3 else "1/1") for i in range(90)] + [("X", 5_000_000 + i, "1/1") for i in range(30)] + [("Y", 5_000_000 + i, "1") for i in range(30)], "chrom string, pos long, gt string")
    assert infer.classify_sex(infer.site_sex_counts(rows, "GRCh38").first().asDict()) == "male"


def test_unknown_strand_of_a_chain_lifts_nothing(spark):
    df = spark.createDataFrame([("1", 100, 200, 1, 100, "1", 200, 1000, "?")], "t_chrom string, t_start long, t_end long, chain_id int, score long, q_chrom string, q_start long, q_size long, q_strand string")
    assert lift.lift_point(spark.createDataFrame([(1, "chr1", 150)], "rid long, chrom string, pos long"), df).first()["status"] == "unmapped"


def test_fasta_and_chains_over_many_parts(spark):
    """Lines dealt over parts, with contigs and chains that go on from one to the next."""
    fasta = [">a x", "ACGTA", "", "CG", ">b", "TTTTT", "GGGGG", "C", "AAAAA", ">c", "N"]
    chain = ["chain 9 a 99 + 10 90 q 99 + 0 80 1", "5 1 2", "7 3 4", "6", "chain 8 b 99 + 0 9 q 99 - 0 9 2", "9"]
    where = [(p << 33) + i for p, n in ((0, 2), (1, 3), (3, 1), (4, 9)) for i in range(n)]

    def made(lines, spread):
        return spark.createDataFrame([(where[i] if spread else i, x) for i, x in enumerate(lines)], "ord long, line string")

    assert sorted(map(tuple, text.fasta_blocks(made(fasta, True), 4).collect())) == sorted(map(tuple, text.fasta_blocks(made(fasta, False), 4).collect()))
    got = [sorted(map(tuple, text.chain_blocks(made(chain, s)).collect())) for s in (True, False)]
    assert got[0] == got[1] and [r[1:3] for r in got[0]] == [(10, 15), (16, 23), (26, 32), (0, 9)]


def bgzf_file(path: Path, data: bytes, sizes) -> str:
    """data in BGZF members of the given sizes, again and again, and the empty one at the end."""
    out, at, k = [], 0, 0
    while at < len(data):
        n = sizes[k % len(sizes)]
        out.append(bcf.bgzf(data[at : at + n]))
        at, k = at + n, k + 1
    path.write_bytes(b"".join(out) + bcf.END_BLOCK)
    return str(path)


@pytest.mark.parametrize("sizes", [(7,), (1, 3000, 20), (60_000,)])
def test_bgzf_lines_are_read_once_wherever_they_are_cut(spark, tmp_path, sizes):
    lines = [f"{i}\t" + "x" * (i * 37 % 211) + ("\r" if i % 9 == 0 else "") for i in range(400)] + ["", "y" * 5000, "", "last without an end"]
    data = "\n".join(lines).encode()
    want = [x.removesuffix("\r") for x in lines]
    path = bgzf_file(tmp_path / "a.vcf.gz", data, sizes)
    for most in (1, 40, 333, 5000, 1 << 25) if sizes[0] > 7 else (333, 1 << 25):
        source = layered.LineScan({"files": path, "bytes": str(most)})
        got = [x for part in source.partitions()[:] for b in source.read(part) for x in b.column(0).to_pylist()] if most > 1 or Path(path).stat().st_size < 3000 else want
        assert got == want
    frame = text.read_lines(spark, path, split_bytes=Path(path).stat().st_size // 3)
    assert frame.rdd.getNumPartitions() > 1 and [r["line"] for r in frame.orderBy("ord").collect()] == want


def test_layers_of_many_kinds_as_a_conversion(spark, tmp_path):
    """Plain, gzip, zip, zip in gzip, gzip in zip, gzip twice, names that belie: one variant each."""
    fasta = put(tmp_path, "r.fa", ">1\nACGTACGT\n")
    vcf = b"##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n1\t1\t.\tA\tC\t.\t.\t.\tGT\t0/1\n"
    wraps = {"a.vcf": bytes, "b.vcf.gz": gzip.compress, "c.vcf.zip": zipped, "d.vcf.gz.zip": lambda b: zipped(gzip.compress(b)), "e.txt": gzip.compress, "f.gz": zipped, "g.gz": lambda b: gzip.compress(gzip.compress(b)), "h.vcf.gz": lambda b: bcf.bgzf(b) + bcf.END_BLOCK, "i.gz": lambda b: gzip.compress(bcf.bgzf(b))}
    for name, wrap in wraps.items():
        assert convert_file(spark, Config(put(tmp_path, name, wrap(vcf)), fasta, str(tmp_path / f"o_{name}"), sex="female")) == {"variant_records": 1}, name
    calls = put(tmp_path, "k.txt.gz.zip", zipped(gzip.compress(b"rs1\t1\t1\tAC\n")))
    assert convert_file(spark, Config(calls, fasta, str(tmp_path / "o_k"), sex="female")) == {"variant_records": 1}


def test_streams_are_inflated_in_bounded_pieces():
    data = b"0123456789\n" * 2_000_000
    for packed in (gzip.compress(data, 1), zipped(data), gzip.compress(zipped(data), 1)):
        sizes = [len(x) for x in layered.streamed(packed)]
        assert sum(sizes) == len(data) and max(sizes) <= 2 * layered.PIECE
    stored = io.BytesIO()
    with zipfile.ZipFile(stored, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a", data[:1000])
        z.writestr("b", "other")
    assert b"".join(layered.streamed(stored.getvalue())) == data[:1000]


def test_parts_of_a_bcf_give_its_rows(spark, tmp_path):
    """Ranges of every size, with cuts inside records and inside members, give the rows of the whole file."""
    head = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="g">', "##contig=<ID=1>", "##contig=<ID=2>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\tt"]
    rows = [{"chrom": "1" if i < 200 else "2", "pos": i + 1, "id": f"rs{i}", "ref": "A" * (1 + i % 40), "alts": ["C", "<DEL>"][: i % 3], "gts": ["0|1", "./."], "info": {}} for i in range(400)]
    names, strings = bcf.dictionaries("\n".join(head))
    data = bcf.header_bytes(head) + b"".join(bcf.record(r, {c: i for i, c in enumerate(names)}, {c: i for i, c in enumerate(strings)}) for r in rows)
    for sizes in ((50,), (997,), (60_000,)):
        path = bgzf_file(tmp_path / f"{sizes[0]}.bcf", data, sizes)
        for most in (60, 300, 4000, 1 << 25):
            source = bcf.BcfScan({"files": path, "bytes": str(most)})
            got = [r for part in source.partitions() for b in source.read(part) for r in b.to_pylist()]
            assert [(r["chrom"], r["pos"], r["ref"], r["alts"]) for r in got] == [(r["chrom"], r["pos"], r["ref"], r["alts"]) for r in rows]
    frame = bcf.read(spark, path, split_bytes=500)
    assert frame.rdd.getNumPartitions() > 1 and [r["pos"] for r in frame.orderBy("ord").collect()] == [r["pos"] for r in rows]
    plain = put(tmp_path, "plain.bcf", data)
    assert bcf.read(spark, plain).count() == 400


ALL_FIELDS = """##fileformat=VCFv4.2
##FILTER=<ID=q10,Description="low">
##INFO=<ID=AF,Number=A,Type=Float,Description="f">
##INFO=<ID=NS,Number=1,Type=Integer,Description="n">
##INFO=<ID=DB,Number=0,Type=Flag,Description="d">
##INFO=<ID=NAME,Number=1,Type=String,Description="s">
##FORMAT=<ID=GT,Number=1,Type=String,Description="g">
##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="q">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="d">
#CHROM	POS	ID	REF	ALT	QUAL	FILTER	INFO	FORMAT	s
"""


def test_bcf_keeps_every_field(spark, tmp_path):
    """VCF to BCF to VCF: QUAL, FILTER, typed INFO, keys without a definition, FORMAT values."""
    fasta = put(tmp_path, "r.fa", ">1\n" + "ACGT" * 3000 + "\n")
    rows = ["1\t1\trs1\tA\tC,G\t29.5\tq10\tAF=0.5,.;NS=3;DB;NAME=x;XX=3\tGT:GQ:DP\t1|2:99:300", "1\t5\t.\tA\tT\t.\tPASS\tNS=-70000\tGT\t./.", "1\t9\ta;b\tA\t.\t100\t.\t.\tGT:DP\t0:.", "1\t13\t.\tA\t<DEL>\t.\tq10;mine\tNS=200\tGT:MIN_DP\t0/1:40000"]
    vcf_in = put(tmp_path, "a.vcf", ALL_FIELDS + "\n".join(rows) + "\n")
    keep = dict(sex="female", standardize=False)
    assert convert_file(spark, Config(vcf_in, fasta, str(tmp_path / "bcf"), output_format="bcf", **keep)) == {"variant_records": 3, "reference_records": 1}
    path = put(tmp_path, "b.bcf", b"".join(x.read_bytes() for x in sorted((tmp_path / "bcf").glob("part-*"))))
    convert_file(spark, Config(vcf_in, fasta, str(tmp_path / "direct"), **keep))
    convert_file(spark, Config(path, fasta, str(tmp_path / "back"), **keep))
    assert body(str(tmp_path / "back"))[1:] == body(str(tmp_path / "direct"))[1:] == rows
    r = {x["pos"]: x for x in bcf.read(spark, path).collect()}
    assert r[1]["info"] == {"AF": "0.5,.", "NS": "3", "DB": "", "NAME": "x", "XX": "3"} and r[1]["filters"] == ["q10"] and r[13]["filters"] == ["q10", "mine"] and r[1]["samples"][0] == {"GT": "1|2", "GQ": "99", "DP": "300"}


def test_typed_vectors():
    head = [*ALL_FIELDS.strip().split("\n")[:-1], '##FORMAT=<ID=AD,Number=1,Type=String,Description="a">', "##contig=<ID=1>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\tt"]
    names, strings = bcf.dictionaries("\n".join(head))
    numbers = {c: i for i, c in enumerate(names)}, {c: i for i, c in enumerate(strings)}
    for values in ("0", "127", "-120", "128", "-121", "32767", "-32760", "32768", "-32761", "2147483647", "-2147483640", ".", "1,.,300"):
        row = {"chrom": "1", "pos": 7, "ref": "A", "alts": ["C"] * 20, "qual": 1.5, "info": {"NS": values, "NAME": "y" * 40, "AF": "0.25,."}, "format": ["GT", "DP", "AD"], "samples": [{"GT": "0|20", "DP": "5", "AD": "q"}, {"GT": ".", "DP": ".", "AD": "long"}]}
        data = bcf.header_bytes(head) + bcf.record(row, *numbers, bcf.types(head))
        got = bcf.record_row(data, bcf.head_of(data).size, bcf.head_of(data))
        assert dict(got["info"]) == row["info"] and got["qual"] == 1.5 and [dict(c) for c in got["samples"]] == row["samples"] and len(got["alts"]) == 20


def test_bad_rows_are_counted_never_fatal(spark, tmp_path):
    """By the header's types, GT and position; contigs that the reference lacks."""
    fasta = put(tmp_path, "r.fa", ">1\n" + "ACGT" * 30 + "\n")
    bad = ["1\t0\t.\tA\tC\t.\t.\t.\tGT\t0/1", "1\t2\t.\tC\tA\t.\t.\t.\tGT\t0/x", "1\t2\t.\tC\tA\t.\t.\t.\tGT\t0/5", "1\t2\t.\tC\tA\t.\t.\tNS=1.5\tGT\t0/1", "1\t2\t.\tC\tA\t.\t.\tNS=1,2\tGT\t0/1", "1\t2\t.\tC\tA\t.\t.\tDB=1\tGT\t0/1", "1\t2\t.\tC\tA\t.\t.\tAF=a\tGT\t0/1", "1\t2\t.\tC\tA\t.\t.\tNS=99999999999\tGT\t0/1", "1\t2\t.\tC\tA\t.\t.\t.\tGT:DP\t0/1:x", "1\t2\t.\tC\tA\t.\t.\t.\tGT\t0/1\t0/1"]
    good = ["Un9\t2\t.\tC\tA\t.\t.\t.\tGT\t0/1", "1\t2\t.\tC\tA\t.\t.\tAF=1e-3;NS=+4\tGT\t0/1"]
    vcf_in = put(tmp_path, "a.vcf", ALL_FIELDS + "\n".join(bad + good) + "\n")
    for form, want in (("vcf", {"parse_errors": 10, "variant_records": 2}), ("plink", {"parse_errors": 10, "variant_records": 2}), ("bcf", {"parse_errors": 10, "variant_records": 1, "unknown_chromosomes": 1})):
        assert convert_file(spark, Config(vcf_in, fasta, str(tmp_path / f"o_{form}"), sex="female", standardize=False, output_format=form)) == want
    assert [x.split("\t")[0] for x in body(str(tmp_path / "o_vcf"))[1:]] == ["1", "Un9"]  # unknown contigs last
    assert convert_file(spark, Config(vcf_in, fasta, str(tmp_path / "o_std"), sex="female")) == {"parse_errors": 10, "variant_records": 1, "unknown_chromosomes": 1}


@pytest.mark.parametrize("form", ["vcf", "bcf", "plink"])
def test_input_is_read_once(spark, tmp_path, form, monkeypatch):
    """Lines that tasks read of the input, sex and build inferred, counted and written."""
    fasta = put(tmp_path, "r.fa", ">1\n" + "ACGT" * 300 + "\n")
    vcf_in = put(tmp_path, "a.vcf", ALL_FIELDS + "".join(f"1\t{i}\t.\t{'TACG'[i % 4]}\t{'GTAC'[i % 4]}\t.\t.\t.\tGT\t0/1\n" for i in range(1, 201)))
    seen, plain = spark.sparkContext.accumulator(0), text.read_lines

    def counted(session, path, *args):
        lines = plain(session, path, *args)
        if path != vcf_in:
            return lines

        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return lines.mapInArrow(run, "ord long, line string")

    monkeypatch.setattr(text, "read_lines", counted)
    assert convert_file(spark, Config(vcf_in, fasta, str(tmp_path / "out"), other_reference=fasta, assembly="GRCh38", output_format=form)) == {"variant_records": 200}
    assert 200 <= seen.value <= 2 * 210


def test_a_lost_attempt_leaves_nothing(spark, tmp_path):
    """Attempts write under their own names; a job that fails leaves no file, the next one takes the place of what was there."""
    from strandloom.sinks import files

    target = [("data", str(tmp_path / "x"), b"<", b">")]
    rows = spark.range(0, 100, 1, 4).selectExpr("cast(cast(id as string) as binary) as data")
    with pytest.raises(Exception, match="lost"):
        files.write_parts(rows.withColumn("data", F.when(F.col("data") == b"77", F.raise_error(F.lit("lost"))).otherwise(F.col("data"))), target)
    assert not [p for p in (tmp_path / "x").rglob("*") if p.is_file()]
    for _ in range(2):
        files.write_parts(rows, target)
        assert b"".join(p.read_bytes() for p in sorted((tmp_path / "x").iterdir())) == ("<" + "".join(map(str, range(100))) + ">").encode()


def test_segments_against_every_block(spark):
    """Disjoint segments of overlapping blocks give what all blocks give, at every position."""
    import random

    rng = random.Random(4)
    kind = "t_chrom string, t_start long, t_end long, chain_id int, score long, q_chrom string, q_start long, q_size long, q_strand string"
    big = 1 << lift.SWEEP_BITS
    blocks = [(rng.choice(["chr1", "1", "2"]), s, s + rng.choice([1, 3, 20, 60]), rng.randint(1, 3), rng.randint(1, 3), rng.choice("ab"), rng.randint(0, 900), 1000, rng.choice("+-+?")) for s in (rng.randint(0, 120) + rng.choice([0, big - 60]) for _ in range(90))]
    asked = [(i, c, p) for i, (c, p) in enumerate((c, p) for c in ("1", "chr2", "3") for p in (*range(0, 190), *range(big - 62, big + 70)))]
    got = {r["rid"]: r for r in lift.lift_point(spark.createDataFrame(asked, "rid long, chrom string, pos long"), spark.createDataFrame(blocks, kind)).collect()}
    assert len(got) == len(asked)
    for i, c, p in asked:
        hits = [b for b in blocks if b[0].removeprefix("chr") == c.removeprefix("chr") and b[1] <= p < b[2] and b[8] in "+-"]
        best = [b for b in hits if b[4] == max(h[4] for h in hits)]
        if not hits:
            want = ("unmapped", None, None, None)
        elif len({b[3] for b in best}) > 1:
            want = ("ambiguous", None, None, None)
        else:
            shift = lambda b: b[6] - b[1] if b[8] == "+" else b[7] - 1 - b[6] + b[1]
            b = min(best, key=lambda b: (b[1], b[2], b[5], shift(b), b[8]))
            q = p + shift(b) if b[8] == "+" else shift(b) - p
            want = ("lifted", b[5], q, b[8]) if q >= 0 else ("unmapped", None, None, None)
        assert tuple(got[i][1:]) == want


def test_fasta_index(spark, tmp_path):
    """Built, used, rebuilt when older than the FASTA; the blocks of lines; contigs that nobody asks for aren't read."""
    import os

    seqs = {"1": "ACGT" * 1500, "2": "", "chrX": "TTGCA" * 900 + "GG", "Un7": "N"}
    for end, width in (("\n", 60), ("\r\n", 61), ("\n", 10_000)):
        folder = tmp_path / f"{len(end)}{width}"
        folder.mkdir()
        path = put(folder, "r.fa", "".join(f">{k} about it{end}" + "".join(v[i : i + width] + end for i in range(0, len(v), width)) for k, v in seqs.items()))
        blocks, contigs = fasta.load(spark, path)
        index = (folder / "r.fa.fai").read_text().splitlines()
        assert [x.split("\t")[:2] for x in index] == [[k, str(len(v))] for k, v in seqs.items()]
        at = [int(x.split("\t")[2]) for x in index]
        raw = Path(path).read_bytes()
        assert all(raw[o : o + 1].decode() == v[0] for o, v in zip(at, seqs.values()) if v)
        want = {(i, k, b): v[b * 1024 : b * 1024 + 1024] for i, (k, v) in enumerate(seqs.items()) for b in range(-(-len(v) // 1024))}
        assert {(r["contig_idx"], r["contig"], r["block"]): r["seq"] for r in blocks.collect()} == want
        assert sorted(tuple(r) for r in contigs.collect()) == [(i, k, len(v)) for i, (k, v) in enumerate(seqs.items())]
        some, all_contigs = fasta.load(spark, path, None, spark.createDataFrame([("X",), ("nowhere",)], "c string"))
        assert {r["contig"] for r in some.collect()} == {"chrX"} and all_contigs.count() == 4
    other = str(folder / "elsewhere.fai")
    Path(other).write_text("1\t5\t3\t5\t6\n")
    os.utime(other, (1, 1))  # stale
    assert fasta.load(spark, path, other)[1].count() == 4 and len(Path(other).read_text().splitlines()) == 4
    Path(other).write_text("no index\n")
    os.utime(other, (4e9, 4e9))
    assert fasta.load(spark, path, other)[1].count() == 4
    uneven = put(tmp_path, "u.fa", ">1\nACG\nACGTA\nA\n>2\nTT\n")
    assert fasta.index(spark, uneven) is None and {(r["contig"], r["seq"]) for r in fasta.load(spark, uneven)[0].collect()} == {("1", "ACGACGTAA"), ("2", "TT")}
    packed = put(tmp_path, "g.fa.gz", gzip.compress(b">1\nACGT\n"))
    assert fasta.index(spark, packed) is None and fasta.load(spark, packed)[1].collect()[0]["length"] == 4


def test_reference_index_of_a_run(spark, tmp_path):
    """The given index is used: output order and lengths are those it says, and a run leaves one beside a FASTA without."""
    path = put(tmp_path, "r.fa", ">2\nTTTTCCCC\n>1\nACGTACGT\n")
    calls = put(tmp_path, "c.txt", "rs1 1 2 CC\nrs2 2 3 AG\n")
    convert_file(spark, Config(calls, path, str(tmp_path / "out"), sex="female", reference_fai=str(tmp_path / "mine.fai")))
    assert (tmp_path / "mine.fai").read_text() == "2\t8\t3\t8\t9\n1\t8\t15\t8\t9\n" and not (tmp_path / "r.fa.fai").exists()
    assert [x.split("\t")[0] for x in body(str(tmp_path / "out"))[1:]] == ["2", "1"]


def test_numbers_of_a_total_order(spark):
    from strandloom.operators.number import numbered

    rows = spark.range(0, 3000, 1, 7).selectExpr("id", "pmod(hash(id), 5) as g", "if(id % 3 = 0, null, pmod(hash(id), 40)) as k")
    got = numbered(rows, [F.col("k"), F.col("id")], "place", ranges=16).collect()
    want = sorted(((r["k"] is not None, r["k"] or 0, r["id"]) for r in got))
    assert [(r["k"] is not None, r["k"] or 0, r["id"]) for r in sorted(got, key=lambda r: r["place"])] == want and sorted(r["place"] for r in got) == list(range(1, 3001))
    by = numbered(rows, [F.col("id")], "place", [F.col("g")]).collect()
    for g in range(5):
        assert [r["place"] for r in sorted((r for r in by if r["g"] == g), key=lambda r: r["id"])] == list(range(1, sum(r["g"] == g for r in by) + 1))
    assert numbered(rows.where("id < 0"), [F.col("id")], "place").count() == 0


def test_panel_indices_of_many_rows_at_one_site(spark):
    """100,000 rows of one site in seconds; the lists are those of a plain run over the rows."""
    import time

    from strandloom.operators import panel

    began = time.time()
    rows = spark.range(100_000).selectExpr("id as ord", "'1' as chrom", "5L as pos", "'A' as ref", "cast(null as string) as panel_chrom", "if(id % 2 = 0, 'A', null) as panel_ref", "if(id < 0, array('x'), null) as panel_alts", "array('A', element_at(array('C','G','T','CA','CC'), cast(pmod(hash(id), 5) + 1 as int))) as alleles")
    got = panel.panel_alt_index(rows, [F.col("ord")]).select("ord", "alleles", "merged_alts", "indices", "site_ref").orderBy("ord").collect()
    assert time.time() - began < 60
    seen = []
    for r in got:
        if r["alleles"][1] not in seen:
            seen.append(r["alleles"][1])
        assert r["merged_alts"] == seen and r["indices"] == [0, seen.index(r["alleles"][1]) + 1] and r["site_ref"] == "A"


def test_chain_and_reference_by_build_names(spark, tmp_path):
    """The folder's files are chosen by the input's build, given or detected; no lifting where builds agree; a missing chain is an error."""
    refs = tmp_path / "refs"
    refs.mkdir()
    put(refs, "hg19.fa", ">chr1\n" + "ACGTTGCA" * 40 + "\n")
    (refs / "hg19ToHg38.over.chain.gz").write_bytes(gzip.compress(b"chain 100 chr1 320 + 0 300 chr1 330 + 10 310 1\n300\n\n"))
    new = put(tmp_path, "new.fa", ">chr1\n" + "T" * 10 + "ACGTTGCA" * 40 + "\n")
    calls = put(tmp_path, "c.txt", "# we use human assembly build 37\n# Build 37\n" + "".join(f"rs{i} 1 {i} {'ACGTTGCA'[(i - 1) % 8] * 2}\n" for i in range(1, 200)))
    base = dict(sex="female", refs=str(refs))
    with pytest.warns(UserWarning, match="GRCh37"):
        got = convert_file(spark, Config(calls, new, str(tmp_path / "o1"), **base))
    assert got == {"reference_records": 199} and [x.split("\t")[1] for x in body(str(tmp_path / "o1"))[1:3]] == ["11", "12"]
    import json

    facts = json.loads("".join(p.read_text() for p in (tmp_path / "o1_report").glob("part-*")))
    assert facts["detected_build"] == "GRCh37" and facts["match_rate_GRCh37"] == 100.0 and facts["comment_build"] == "GRCh37"
    assert convert_file(spark, Config(calls, new, str(tmp_path / "o2"), input_build="hg19", **base)) == got
    same = convert_file(spark, Config(calls, new, str(tmp_path / "o3"), input_build="GRCh38", **base))
    assert [x.split("\t")[1] for x in body(str(tmp_path / "o3"))[1:3]] == ["1", "2"] and sum(same.values()) == 199
    with pytest.raises(FileNotFoundError, match="no chain"):
        convert_file(spark, Config(calls, str(refs / "hg19.fa"), str(tmp_path / "o4"), input_build="hg38", assembly="GRCh37", **base))


def test_bcf_numbers_beyond_their_type():
    """Integers that 32 bits or the reserved values leave no room for, and floats beyond single precision, come back whole, beside others."""
    head = ['##INFO=<ID=DP,Number=.,Type=Integer,Description="d">', '##INFO=<ID=AF,Number=.,Type=Float,Description="f">', '##FORMAT=<ID=DP,Number=.,Type=Integer,Description="d">', "##contig=<ID=1>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb"]
    names, strings = bcf.dictionaries("\n".join(head))
    numbers = {c: i for i, c in enumerate(names)}, {s: i for i, s in enumerate(strings)}
    for dp, af in [("2147483647", "0.5"), ("2147483648", "0.5"), ("8999999000,.,-3", "1e39"), ("-2147483640", "."), ("-2147483641", ".,-1e300"), ("-2147483648", "nan"), ("-2147483647,1", "inf,.,0.25")]:
        row = {"chrom": "1", "pos": 5, "ref": "A", "alts": ["C"], "info": [("DP", dp), ("AF", af)], "format": ["DP"], "samples": [[("DP", dp)], [("DP", ".")]]}
        data = bcf.header_bytes(head) + bcf.record(row, *numbers, bcf.types(head))
        got = bcf.record_row(data, bcf.head_of(data).size, bcf.head_of(data))
        assert (got["info"], got["samples"]) == (row["info"], row["samples"])


def test_bcf_columns_are_those_of_arrow():
    """Columns taken apart and put together by their flat entries, cut anywhere, with nulls, empty lists and maps."""
    rows = [{"ids": [], "info": [], "samples": [[("GT", "0/1"), ("DP", ".")], []]}, {"ids": ["a", "b"], "info": [("DP", "1")], "samples": []}, {"ids": ["c"], "info": [("AF", ""), ("DB", "x")], "samples": [[("GT", "0")]]}]
    kinds = {f.name: f.type for f in bcf.ARROW}
    for name in rows[0]:
        column = pa.array([r[name] for r in rows], kinds[name])
        assert bcf._column([r[name] for r in rows], kinds[name]).equals(column)
        holed = pa.array([rows[0][name], None, rows[1][name], rows[2][name]], kinds[name])
        for a in range(4):
            for b in range(a, 5):
                assert bcf._values(holed[a:b]) == holed[a:b].to_pylist()
    assert bcf._values(pa.array([1.5, None], pa.float32())) == [1.5, None] and bcf._values(pa.array([3, 4])) == [3, 4]


def test_fasta_lines_numbered_through(spark):
    """A file in one piece is ordered in stretches, with contigs that end inside, at and far beyond a stretch's bounds."""
    lines = [">a x" if i == 0 else ">b" if i == 8192 else ">c" if i == 8200 else "" if i % 50 == 7 else " ACGTN"[: i % 6 + 1] for i in range(20_000)]
    df = spark.createDataFrame(list(enumerate(lines)), "ord long, line string").repartition(3)
    marked = text.with_head(df, F.col("line").startswith(">"))
    assert marked.groupBy("part").count().agg(F.max("count")).first()[0] <= 8192
    assert {r["head"]: r["n"] for r in marked.groupBy("head").agg(F.count("*").alias("n")).collect()} == {0: 8192, 8192: 8, 8200: 11_800}
    want, name = {}, None
    for x in lines:
        if x.startswith(">"):
            name = x[1:2]
        else:
            want[name] = want.get(name, "") + x.strip()
    got = {(r["contig_idx"], r["contig"], r["block"]): r["seq"] for r in text.fasta_blocks(df, 64).collect()}
    assert got == {(i, c, k // 64): want[c][k : k + 64] for i, c in enumerate("abc") for k in range(0, len(want[c]), 64)}


def test_numbers_read_rows_once_and_halve_bounds(spark):
    """Sample, counts and numbers come from one run of the rows, and a row's range from as many steps as the number of bounds has bits."""
    from bisect import bisect_right

    from strandloom.operators.number import last_upto, numbered

    run = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            run.add(batch.num_rows)
            yield batch

    rows = spark.range(3000).select("id", (F.col("id") * 7919 % 1000).alias("k"), F.create_map("id", F.lit("m")).alias("m"), F.when(F.col("id") % 2 == 0, "a").alias("g")).repartition(5).mapInArrow(through, "id long, k long, m map<long,string>, g string")
    got = numbered(rows, [F.col("k"), F.col("id")], "place", [F.col("g")]).collect()
    assert run.value == 3000
    want = {r["id"]: i for g in ("a", None) for i, r in enumerate(sorted((r for r in got if r["g"] == g), key=lambda r: (r["k"], r["id"])), 1)}
    assert {r["id"]: r["place"] for r in got} == want and all(r["m"] == {r["id"]: "m"} for r in got)
    for n in (0, 1, 2, 3, 7, 8, 200):
        bounds = [3 * i for i in range(n)]
        found = spark.range(-2, 3 * n + 3).select("id", last_upto(F.lit(bounds) if n else F.array().cast("array<int>"), F.col("id"), max(n, 2)).alias("n")).collect()
        assert all(r["n"] == bisect_right(bounds, r["id"]) for r in found)
