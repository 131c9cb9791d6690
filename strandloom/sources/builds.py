"""Chains and references in a folder by the names of builds."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Short names of builds, and chain files by (from, to).
SHORT = {"NCBI36": "hg18", "GRCh37": "hg19", "GRCh38": "hg38"}
CHAINS = {("GRCh37", "GRCh38"): "hg19ToHg38.over.chain", ("GRCh38", "GRCh37"): "hg38ToHg19.over.chain", ("NCBI36", "GRCh38"): "hg18ToHg38.over.chain"}
#: What a comment says of a file's build.
COMMENTS = {"NCBI36": ("Build 36", "NCBI36"), "GRCh37": ("Build 37", "GRCh37")}


def full_name(name: str) -> str | None:
    """NCBI36, GRCh37 or GRCh38 for any name that contains its number or short name."""
    low = name.lower()
    return next((full for full, short in SHORT.items() if full[-2:] in low or short in low), None)


def commented(lines: list[str]) -> str | None:
    """The build that the first comment with one names."""
    for line in lines:
        for build, words in COMMENTS.items():
            if line.startswith("#") and any(w in line for w in words):
                return build
    return None


def found(spark: SparkSession, folder: str, names: list[str]) -> str | None:
    """The first of some files that is in a folder, wherever Spark can look."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return f"{folder.rstrip('/')}/{name}"
    return None


def chain(spark: SparkSession, folder: str, source: str, target: str) -> str:
    """The chain file from one build to another."""
    name = CHAINS.get((full_name(source), full_name(target)))
    path = found(spark, folder, [name, name + ".gz"]) if name else None
    if path is None:
        raise FileNotFoundError(f"no chain from {source} to {target} in {folder}")
    return path


def reference(spark: SparkSession, folder: str, build: str) -> str | None:
    """The FASTA of a build, by its short or full name."""
    full = full_name(build)
    return found(spark, folder, [f"{n}.{end}" for n in (SHORT[full], full) for end in ("fa", "fa.gz", "fasta", "fasta.gz")]) if full else None
