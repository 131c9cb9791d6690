"""Contig names and reference bases by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.alleles import canonical_contig

BLOCK, BROADCAST_BYTES = 1024, 64 << 20


def small(side: DataFrame, source: DataFrame) -> DataFrame:
    """side marked for broadcast if the table it comes from has at most BROADCAST_BYTES by the optimizer's statistics."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(side) if size <= BROADCAST_BYTES else side


def resolve_contig(rows: DataFrame, contigs: DataFrame, name: str = "chrom") -> DataFrame:
    """rows with `contig` and `contig_idx` of the reference (null if unknown); of contigs with one key the first counts.

    The contig table of a genome is a few hundred rows; it is broadcast where Spark can tell that it has at most BROADCAST_BYTES.
    """
    keys = contigs.groupBy(canonical_contig(F.col("contig")).alias("__key")).agg(F.min(F.struct("contig_idx", "contig")).alias("__c"))
    met = rows.withColumn("__key", canonical_contig(F.col(name))).join(small(keys, contigs), "__key", "left")
    return met.select(*rows.columns, F.col("__c.contig").alias("contig"), F.col("__c.contig_idx").alias("contig_idx"))


def reference_base(rows: DataFrame, blocks: DataFrame, pos: str = "pos", out: str = "ref_base", width: int = BLOCK) -> DataFrame:
    """rows (with contig_idx) and the upper-case base at a 1-based position, null out of range.

    An equi-join on (contig, block): each position meets one block of the sequence, and positions beyond the contig none.
    """
    seq = blocks.select(F.col("contig_idx").alias("__c"), F.col("block").alias("__b"), F.col("seq").alias("__seq"))
    at = F.col(pos) - 1
    met = rows.withColumn("__at", at).join(seq, (F.col("contig_idx") == F.col("__c")) & (F.expr(f"__at div {width}") == F.col("__b")) & (F.col("__at") >= 0), "left")
    base = F.upper(F.expr(f"substring(__seq, cast(__at % {width} + 1 as int), 1)"))
    return met.select(*rows.columns, F.when(base != "", base).alias(out))


def complement_base(base: Column) -> Column:
    return F.translate(base, "ACGT", "TGCA")
