"""PLINK 1.9 rows: variants are split by ALT, genotypes packed two bits each inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.alleles import computed
from strandloom.sinks import files

#: Fixed value: first bytes of a SNP-major .bed file.
BED_MAGIC = bytes([0x6C, 0x1B, 0x01])


def split_alts(rows: DataFrame) -> DataFrame:
    """One row for each ALT, with alt_no from 1 and one_alt; rows without ALT go."""
    return rows.select("*", F.posexplode("alts").alias("__k", "one_alt")).withColumn("alt_no", F.col("__k") + 1).drop("__k")


def bim_id() -> Column:
    """Name of a split row (chrom, pos, ids, alts, alt_no)."""
    suffix = F.when(F.size("alts") > 1, F.concat(F.lit("_ALT"), F.col("alt_no").cast("string"))).otherwise("")
    name = F.when(F.size("ids") == 0, F.when(F.size("alts") > 1, F.concat_ws(":", "chrom", F.col("pos").cast("string"))).otherwise(".")).otherwise(F.array_join("ids", ";"))
    return F.concat(name, suffix)


def bim(rows: DataFrame) -> DataFrame:
    """chrom, id, cm, pos, allele1, allele2 of rows (chrom, pos, ids, ref, alts), with ord and alt_no."""
    return split_alts(rows).select("ord", "alt_no", "chrom", bim_id().alias("id"), F.lit(0).alias("cm"), "pos", F.col("ref").alias("allele1"), F.col("one_alt").alias("allele2"))


def called(rows: DataFrame) -> DataFrame:
    """rows (alts, gts among them) with the two allele numbers of each sample, __one and __two: one allele counts twice, more than two or one that is no number are null."""
    parts = F.transform("gts", lambda g: F.split(F.translate(g, "|", "/"), "/", -1))
    one = F.transform("__p", lambda a: F.when(F.size(a) <= 2, F.get(a, F.lit(0)).try_cast("int")))
    two = F.transform("__p", lambda a: F.get(a, F.size(a) - 1).try_cast("int"))
    return computed(computed(rows, __p=parts), __one=one, __two=two).drop("__p")


def packed(rows: DataFrame) -> DataFrame:
    """rows (alts, gts among them), one for each ALT with alt_no and one_alt, and b: the bytes of that variant and ALT as array<int>, four samples each, low bits first, from the row's own genotypes.

    A sample's two bits: 0 copies of the ALT 0, 1 copy 2, 2 copies 3, missing 1.
    """
    k = F.col("alt_no")
    code = lambda x, y: F.when(x.isNull() | y.isNull(), 1).when((x == k) & (y == k), 3).when((x == k) | (y == k), 2).otherwise(0)
    coded = computed(split_alts(called(rows)), __c=F.zip_with("__one", "__two", code))
    at = lambda i, j: F.coalesce(F.get("__c", 4 * i + j), F.lit(0)) * (1 << 2 * j)
    made = F.transform(F.expr("sequence(0, cast((size(__c) - 1) div 4 as int))"), lambda i: at(i, 0) + at(i, 1) + at(i, 2) + at(i, 3))
    return computed(coded, b=F.when(F.size("__c") > 0, made).otherwise(F.array().cast("array<int>"))).drop("__c", "__one", "__two")


def bed_rows(rows: DataFrame) -> DataFrame:
    """ord, alt_no, b of rows (ord, alts, gts)."""
    return packed(rows.select("ord", "alts", "gts")).select("ord", "alt_no", "b")


def bed(rows: DataFrame) -> DataFrame:
    """ord, alt_no, byte_no, byte of rows (ord, alts, gts)."""
    return bed_rows(rows).select("ord", "alt_no", F.posexplode("b").alias("byte_no", "byte"))


def fam(samples: DataFrame) -> DataFrame:
    """fid, iid, father, mother, sex, phenotype of rows (sample, sex)."""
    code = F.when(F.col("sex") == "male", 1).when(F.col("sex") == "female", 2).otherwise(0)
    return samples.select(F.col("sample").alias("fid"), F.col("sample").alias("iid"), F.lit("0").alias("father"), F.lit("0").alias("mother"), code.cast("int").alias("sex"), F.lit(-9).alias("phenotype"))


def as_binary(b: Column) -> Column:
    """array<int> of bytes as binary."""
    return F.unhex(F.array_join(F.transform(b, lambda x: F.lpad(F.hex(x), 2, "0")), ""))


def write(rows: DataFrame, order: list, family: DataFrame, path: str) -> None:
    """<path>.bed, .bim and .fam as folders of part files: `cat` of the parts of each is the file.

    The bytes and the line of a variant and ALT stand in one row, which is sorted once; each task writes its rows to both files, so
    a variant has the same place in .bed and .bim.
    """
    sites = rows.select("ord", "chrom", "pos", "ids", "ref", "alts", "gts", *(F.col(k).alias(f"__k{i}") if isinstance(k, str) else k.alias(f"__k{i}") for i, k in enumerate(order)))
    line = F.concat_ws("\t", "chrom", bim_id(), F.lit("0"), F.col("pos").cast("string"), "ref", "one_alt")
    ready = packed(sites).select(*(f"__k{i}" for i in range(len(order))), "alt_no", as_binary(F.col("b")).alias("data"), F.concat(line, F.lit("\n")).cast("binary").alias("line"))
    files.write_parts(ready.orderBy(*(f"__k{i}" for i in range(len(order))), "alt_no"), [("data", path + ".bed", BED_MAGIC, b""), ("line", path + ".bim", b"", b"")])
    family.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in family.columns)).alias("line")).write.mode("overwrite").text(path + ".fam")
