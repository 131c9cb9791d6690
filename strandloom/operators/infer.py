"""What is inferred from aggregates: build, sex, strand. The formulas of build and sex are this package's own, see each docstring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import alleles as A
from strandloom.functions.alleles import bound, computed
from strandloom.operators.reference import reference_base, resolve_contig

BUILD_ROWS, FIRST_CALLS, STRAND_ROWS, STRAND_LEAST, STRAND_SHARE = 1000, 5000, 2000, 50, 0.90


def first_rows(rows: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """The first n rows in input order (a top-k, not a full sort)."""
    return rows.orderBy(order).limit(n)


def build_rates(rows: DataFrame, references: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """build, matches, looked_up, rate: how often `base` (chrom, pos, base) is the reference base, in per cent of the positions found."""
    out = None
    for build, (contigs, blocks) in references.items():
        met = reference_base(resolve_contig(rows, contigs), blocks)
        one = met.agg(F.count_if(F.col("base") == F.col("ref_base")).alias("matches"), F.count("ref_base").alias("looked_up")).select(F.lit(build).alias("build"), "matches", "looked_up", F.try_divide(100.0 * F.col("matches"), F.col("looked_up")).alias("rate"))
        out = one if out is None else out.unionByName(one)
    return out


def build_calls(calls: DataFrame) -> DataFrame:
    """The calls that tell the build: of the first FIRST_CALLS rows the homozygous single bases outside X, Y and mitochondria, BUILD_ROWS at most; with `base`."""
    first = first_rows(calls, FIRST_CALLS)
    base = bound(A.parse_genotype(F.col("genotype")), lambda a: F.when((F.size(a) > 0) & (F.size(F.array_distinct(F.transform(a, F.upper))) == 1) & F.get(a, F.lit(0)).rlike("^B:[ACGTacgt]$"), F.upper(F.substring(F.get(a, F.lit(0)), 3, 1))))
    return first_rows(computed(first.where(autosomal(F.col("chrom"))), base=base).where("base is not null"), BUILD_ROWS)


def build_sites(sites: DataFrame) -> DataFrame:
    """The same of variant rows: single-base REFs at a real position; with `base`."""
    good = sites.where(autosomal(F.col("chrom")) & F.upper("ref").isin("A", "C", "G", "T") & (F.col("pos") > 0))
    return first_rows(good, BUILD_ROWS).withColumn("base", F.upper("ref"))


def autosomal(chrom: Column) -> Column:
    return ~F.upper(chrom).isin("X", "Y", "CHRX", "CHRY", "MT", "CHRM")


def builds_match(a: str, b: str) -> bool:
    """Whether two names mean one build: GRCh37 and hg19, or GRCh38 and hg38."""
    return build_name(a) is not None and build_name(a) == build_name(b)


def build_name(name: str) -> str | None:
    """GRCh37 or GRCh38 for any name that contains 37 or hg19, 38 or hg38."""
    for build, parts in (("GRCh37", ("37", "hg19")), ("GRCh38", ("38", "hg38"))):
        if any(p in name.lower() for p in parts):
            return build
    return None


def classify_build(rates: dict[str, float | None]) -> str:
    """The build of the better rate; GRCh38 where they tie or neither is known."""
    a, b = rates.get("GRCh37"), rates.get("GRCh38")
    return "GRCh37" if a is not None and (b is None or a > b) else "GRCh38"


def site_sex_counts(sites: DataFrame, build: str, by: list[str] = ()) -> DataFrame:
    """sex_counts of variant rows (chrom, pos, gt)."""
    return _sex_counts(sites, build, by, ~F.col("gt").rlike(r"^[./|]*$"), A.het_flag_vcf(F.col("gt")))


def sex_counts(calls: DataFrame, build: str, by: list[str] = ()) -> DataFrame:
    """Attempts, calls and heterozygotes on autosomes, X and Y outside the pseudo-autosomal ranges, of all rows or by sample columns."""
    return _sex_counts(calls, build, by, ~A.is_missing_call(F.col("genotype")), A.het_flag(F.col("genotype")))


def _sex_counts(calls: DataFrame, build: str, by: list[str], called: Column, het: Column) -> DataFrame:
    kind = A.chrom_class(F.col("chrom"))
    y = (kind == "Y") & ~A.is_par(F.lit("Y"), F.col("pos"), build)
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return calls.groupBy(*by).agg(n(kind == "autosome").alias("autosome"), n((kind == "autosome") & called).alias("autosome_called"), n((kind == "autosome") & het).alias("autosome_het"), n(kind == "X").alias("x"), n((kind == "X") & het).alias("x_het"), n(y).alias("y"), n(y & called).alias("y_called"))


def classify_sex(c: dict[str, int], y_density: float = 0.5, x_ratio: float = 0.5) -> str:
    """male if Y outside its shared ranges is called nearly as often as autosomes and X is seldom heterozygous; female for the reverse; else unknown."""
    if not c["autosome"] or not (c["x"] or c["y"]):
        return "unknown"
    density = (c["y_called"] / max(c["y"], 1)) / max(c["autosome_called"] / c["autosome"], 1e-9)
    ratio = (c["x_het"] / max(c["x"], 1)) / max(c["autosome_het"] / c["autosome"], 1e-9)
    if density >= y_density and ratio < x_ratio:
        return "male"
    return "female" if density < y_density and ratio >= x_ratio else "unknown"


def sex_of() -> Column:
    """classify_sex as a column over rows of sex_counts."""
    share = lambda a, b, least: F.col(a) / F.greatest(F.col(b), F.lit(1)) / F.greatest(F.col(least) / F.col("autosome"), F.lit(1e-9))
    density, ratio = share("y_called", "y", "autosome_called"), share("x_het", "x", "autosome_het")
    told = F.when((density >= 0.5) & (ratio < 0.5), "male").when((density < 0.5) & (ratio >= 0.5), "female").otherwise("unknown")
    return F.when((F.col("autosome") == 0) | (F.col("x") + F.col("y") == 0), "unknown").otherwise(told)


def strand_votes(calls: DataFrame, contigs: DataFrame, blocks: DataFrame, limit: int = STRAND_ROWS) -> DataFrame:
    """plus, minus: votes of the first decisive informative calls."""
    rows = calls.where(A.informative_snp(F.col("genotype"))).withColumn("__name", A.strand_contig(F.col("chrom")))
    rows = reference_base(resolve_contig(rows, contigs, "__name"), blocks).where("ref_base is not null")
    firsts = F.transform(F.filter(A.parse_genotype(F.col("genotype")), lambda a: a.startswith("B:")), lambda a: F.upper(F.substring(a, 3, 1)))
    plus, minus = F.array_contains(firsts, F.col("ref_base")), F.array_contains(firsts, F.translate("ref_base", "ACGT", "TGCA"))
    decisive = rows.withColumn("plus", plus & ~minus).withColumn("minus", minus & ~plus).where("plus or minus")
    return first_rows(decisive, limit).agg(F.count_if("plus").alias("plus"), F.count_if("minus").alias("minus"))


def strand_lock(plus: int, minus: int) -> str:
    """forward or reverse; raises if there are too few votes or they disagree."""
    n = plus + minus
    if n < STRAND_LEAST:
        raise ValueError(f"too few informative calls ({n}) to infer the strand")
    if plus / n > STRAND_SHARE:
        return "forward"
    if minus / n > STRAND_SHARE:
        return "reverse"
    raise ValueError(f"strands disagree: {plus} forward, {minus} reverse")
