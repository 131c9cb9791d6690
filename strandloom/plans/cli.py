"""Command line: python -m strandloom.plans.cli INPUT OUTPUT --reference FASTA [...]"""

from __future__ import annotations

import argparse
from pathlib import PurePosixPath

from strandloom.operators.infer import builds_match
from strandloom.plans.engine import Config, convert_file


def sample_name(path: str) -> str:
    """The file's stem, dots as underscores."""
    return PurePosixPath(path.rstrip("/").rsplit("/", 1)[-1]).stem.replace(".", "_") or "sample"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandloom", description="Convert genotype calls on Spark.")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--reference", required=True)
    p.add_argument("--input-format", choices=["auto", "dtc", "vcf", "bcf"], default="auto")
    p.add_argument("--format", choices=["vcf", "bcf", "plink"], default="vcf")
    p.add_argument("--output-build", default="GRCh38")
    p.add_argument("--input-build")
    p.add_argument("--chain", help="chain file from the input's build to the output's")
    p.add_argument("--lift-reference", help="FASTA of the output's build")
    p.add_argument("--panel")
    p.add_argument("--sample")
    p.add_argument("--sex", choices=["male", "female", "unknown"])
    p.add_argument("--infer-strand", action="store_true")
    p.add_argument("--variants-only", action="store_true")
    p.add_argument("--limit", type=int)
    p.add_argument("--standardize", action="store_true", help="polarise variant rows against the reference")
    p.add_argument("--other-reference", help="FASTA of the other build, to detect the input's")
    p.add_argument("--output-dir", help="folder of OUTPUT and what is written beside it")
    p.add_argument("--reference-fai", help="index of the reference; the file beside it by default, built where it is missing or older")
    p.add_argument("--refs", help="folder of references and chains by build names; lifting follows from the input's build")
    p.add_argument("--log-level", default="WARN")
    return p


def config(argv: list[str] | None = None) -> Config:
    a = parser().parse_args(argv)
    if a.input_build and not builds_match(a.input_build, a.output_build) and not (a.chain and a.lift_reference) and not a.refs:
        raise SystemExit("the builds differ: --chain and --lift-reference, or --refs, are needed")
    output = f"{a.output_dir.rstrip('/')}/{a.output}" if a.output_dir else a.output
    return Config(a.input, a.reference, output, a.input_format, a.format, a.sample or sample_name(a.input), a.output_build, a.sex, None if a.infer_strand else "forward", a.variants_only, a.chain, a.lift_reference, a.panel, a.limit, a.standardize, a.input_build, a.other_reference, a.reference_fai, a.refs)


def summary_lines(counters: dict[str, int]) -> list[str]:
    return [f"total_records: {sum(counters.values())}", *(f"{k}: {n}" for k, n in sorted(counters.items()) if n)]


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("strandloom").getOrCreate()
    spark.sparkContext.setLogLevel(parser().parse_args(argv).log_level)
    print("\n".join(summary_lines(convert_file(spark, config(argv)))))


if __name__ == "__main__":
    main()
