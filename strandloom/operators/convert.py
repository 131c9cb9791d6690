"""Calls to variant rows. Every input row stays, with `reason` null if it is emitted or the counter that dropped it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import alleles as A
from strandloom.operators.reference import reference_base, resolve_contig


def dtc_to_variant(calls: DataFrame, contigs: DataFrame | None, blocks: DataFrame | None, sex: str = "unknown", build: str | None = "GRCh38", reverse: bool = False, variants_only: bool = False) -> DataFrame:
    """Columns of calls (chrom, pos, genotype among them), contig, contig_idx, ref, alts, symbolic, info, gt, reason.

    Rules in order: contig, reference base, alleles, strand, ploidy, ALT list, variants only, GT. Without a reference, as for
    calls that are still to be lifted, contigs are those of the calls and REF is N.
    """
    if contigs is None:
        rows = calls.withColumn("contig", F.col("chrom")).withColumn("contig_idx", F.lit(None).cast("long")).withColumn("ref", F.lit("N"))
    else:
        rows = reference_base(resolve_contig(calls, contigs), blocks, out="ref")
    parsed = A.parse_genotype(F.col("genotype"))
    rows = A.computed(rows, __a=A.flip_bases(parsed) if reverse else parsed, __p=A.ploidy(F.col("contig"), F.col("pos"), sex, build))
    rows = A.computed(rows, __called=F.when(F.col("__p") == "haploid", A.haploid_collapse(F.col("__a"))).otherwise(F.col("__a")))
    rows = A.computed(rows, alts=A.alt_alleles(F.col("__called"), F.col("ref")))
    rows = A.computed(rows, gt=A.gt_format(F.col("__called"), F.col("ref"), F.col("alts")))
    reason = F.when(F.col("contig").isNull(), "unknown_chromosomes").when(F.col("ref").isNull(), "reference_failures").when(F.col("__p") == "zero", "missing_genotype_records")
    if variants_only:
        reason = reason.when(F.size("alts") == 0, "skipped_reference_sites")
    reason = reason.when(F.col("gt").isNull(), "invalid_genotypes")
    return rows.select(*calls.columns, "contig", "contig_idx", "ref", "alts", A.symbolic_alts(F.col("alts")).alias("symbolic"), A.symbolic_info(F.col("alts")).alias("info"), "gt", reason.alias("reason"))


def summary(rows: DataFrame) -> DataFrame:
    """reason, n: the run's counters, emitted rows split into variant and reference records."""
    kind = F.when(F.size("alts") > 0, "variant_records").otherwise("reference_records")
    return rows.groupBy(F.coalesce("reason", kind).alias("reason")).agg(F.count("*").alias("n"))


def swap_map(n_alts: Column, k: Column) -> Column:
    """map<int,int> of allele numbers when the k-th ALT becomes the reference: 0 to 1, k to 0, the other ALTs in order from 2."""
    number = F.sequence(F.lit(0), n_alts)
    return F.map_from_arrays(number, F.transform(number, lambda i: F.when(i == 0, 1).when(i == k, 0).when(i < k, i + 1).otherwise(i).cast("int")))


def polarize(rows: DataFrame, build: str | None = "GRCh38", sex: str = "unknown") -> DataFrame:
    """Variant rows (chrom, pos, ref, alts, gt, contig, ref_base) held against the reference; adds id and reason.

    A single-base REF that differs gives place to the reference base if that is among the ALTs; then GT indices are mapped
    on. A longer REF must start with the reference base. INFO and FILTER are not kept.
    """
    swap = (F.length("ref") == 1) & (F.col("ref") != F.col("ref_base")) & F.array_contains("alts", F.col("ref_base"))
    others = F.filter("alts", lambda a: a != F.col("ref_base"))
    reason = (F.when(F.col("contig").isNull(), "unknown_chromosomes").when(F.col("ref_base").isNull(), "reference_failures").when((F.length("ref") > 1) & (F.upper(F.substring("ref", 1, 1)) != F.col("ref_base")), "anchor_mismatch").when(A.ploidy(F.col("contig"), F.col("pos"), sex, build) == "zero", "ploidy_zero"))
    out = A.computed(rows, __swap=F.coalesce(swap, F.lit(False)), __k=F.array_position("alts", F.col("ref_base")), reason=reason)
    new_ref = F.when(F.col("__swap"), F.col("ref_base")).otherwise(F.col("ref"))
    new_alts = F.when(F.col("__swap"), F.concat(F.array("ref"), others)).otherwise(F.col("alts"))
    new_gt = F.when(F.col("__swap"), A.gt_remap(F.col("gt"), swap_map(F.size("alts"), F.col("__k")))).otherwise(F.col("gt"))
    keep = [c for c in rows.columns if c not in ("ref", "alts", "gt")]
    out = A.computed(out.select(*keep, "reason", new_ref.alias("ref"), F.struct(new_alts.alias("alts"), new_gt.alias("gt")).alias("__new")), __made=F.col("__new"))
    out = out.select(*keep, "ref", F.col("__made.alts").alias("alts"), F.col("__made.gt").alias("gt"), "reason")
    return out.withColumn("id", A.synthetic_id(F.col("contig"), F.col("pos"), F.col("ref"), F.col("alts")))


def order_keys(name: str = "chrom", pos: str = "pos", tie: str = "ord") -> list[Column]:
    """Sort keys of output rows by natural order of contigs; the last makes the order total."""
    n = A.natural_order(F.col(name))
    return [n["rank"], n["tail"], F.col(pos), F.col(tie)]


def reference_order(rows: DataFrame, name: str = "chrom") -> list[Column]:
    """(rank, tail) keys by the order of the reference's contigs where rows have contig_idx, those it lacks after them in natural order."""
    n = A.natural_order(F.col(name))
    if "contig_idx" not in rows.columns:
        return [n["rank"], n["tail"]]
    known = F.col("contig_idx").isNotNull()
    return [F.when(known, F.col("contig_idx").cast("long")).otherwise(n["rank"] + (1 << 40)), F.when(known, "").otherwise(n["tail"])]
