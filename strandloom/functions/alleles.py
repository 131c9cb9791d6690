"""Column expressions on alleles, genotypes and contig names. All stay in built-in functions.

An allele is a code: "B:" and its bases, "DEL", "INS" or "MIS" (missing), so arrays of alleles never hold nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pseudo-autosomal ranges, 1-based and inclusive, by build and contig.
PAR = {
    "GRCh38": {"X": [(10_001, 2_781_479), (155_701_383, 156_030_895)], "Y": [(10_001, 2_781_479), (56_887_903, 57_217_415)]},
    "GRCh37": {"X": [(60_001, 2_699_520), (154_931_044, 155_260_560)], "Y": [(10_001, 2_649_520), (59_034_050, 59_363_566)]},
}


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with more columns, each computed once for a row, however often later steps refer to it.

    A projection would be merged into every later reference, and a filter on it pushed below with a copy of the expression;
    a generator of one row is not.
    """
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends (trim() takes blanks only)."""
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))


def without_chr(c: Column) -> Column:
    return F.when(c.startswith("chr"), F.substring(c, 4, 1 << 30)).otherwise(c)


def complement(c: Column) -> Column:
    """Complement without reversal, case kept."""
    return F.translate(c, "ACGTacgt", "TGCAtgca")


def revcomp(c: Column) -> Column:
    """Reverse complement, case kept."""
    return F.reverse(complement(c))


def revcomp_upper(c: Column) -> Column:
    """Reverse complement in upper case (coordinate lifting)."""
    return F.reverse(F.translate(c, "ACGTacgtn", "TGCATGCAN"))


def complement_upper(c: Column) -> Column:
    """Complement, A C G T in upper case, no reversal (panel harmonisation)."""
    return F.translate(c, "ACGTacgt", "TGCATGCA")


def canonical_contig(c: Column) -> Column:
    """Key under which contig names are the same: no chr, upper case, M and numbers by name."""
    name = lambda up: F.when(up.isin("M", "26"), "MT").when(up.isin("23", "25"), "X").when(up == "24", "Y").otherwise(up)
    return bound(F.upper(without_chr(trimmed(c))), name)


def strand_contig(c: Column) -> Column:
    """Contig names as strand inference reads them; here 25 is mitochondrial."""
    return F.when(c == "23", "X").when(c == "24", "Y").when(c == "25", "MT").otherwise(c)


def chrom_class(c: Column) -> Column:
    """X, Y or autosome (all else, mitochondrial too)."""
    up = F.regexp_replace(F.upper(c), "^CHR", "")
    return F.when(up.isin("X", "23", "25", "PAR", "PSEUDOAUTOSOMAL"), "X").when(up.isin("Y", "24"), "Y").otherwise("autosome")


def natural_order(c: Column) -> Column:
    """struct<rank, tail>: 1 to 22 by number, X, Y, M, then all others by name."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^(chr)+", ""), "^(Chr)+", ""), "^(CHR)+", "")
    rank = F.when(bare.rlike("^[0-9]+$"), bare.try_cast("bigint")).when(bare == "X", 23).when(bare == "Y", 24).when(bare.isin("M", "MT"), 25)
    return F.struct(F.coalesce(rank, F.lit(1000)).cast("bigint").alias("rank"), F.when(rank.isNull(), bare).otherwise("").alias("tail"))


def parse_genotype(raw: Column) -> Column:
    """Allele codes of a raw call."""
    piece = lambda s: F.when(s == "D", "DEL").when(s == "I", "INS").when(s.isin("-", "0", "?"), "MIS").otherwise(F.concat(F.lit("B:"), s))
    char = lambda s: F.when(s.isin(*"ACGTNacgtn"), F.concat(F.lit("B:"), s)).when(s.isin("D", "d"), "DEL").when(s.isin("I", "i"), "INS").otherwise("MIS")

    def parsed(g: Column) -> Column:
        return (
            F.when(g.contains("/"), F.transform(F.transform(F.split(g, "/", -1), trimmed), piece))
            .when((F.length(g) > 2) & g.rlike("^[ACGTNacgtn]+$"), F.array(F.concat(F.lit("B:"), F.upper(g))))
            .when(g == "", F.array().cast("array<string>"))
            .otherwise(F.transform(F.transform(F.sequence(F.lit(1), F.greatest(F.length(g), F.lit(1))), lambda i: F.substr(g, i, F.lit(1))), char))
        )

    return bound(trimmed(raw), parsed)


def flip_bases(alleles: Column) -> Column:
    """Reverse complement of every base allele."""
    return F.transform(alleles, lambda a: F.when(a.startswith("B:"), F.concat(F.lit("B:"), revcomp(F.substring(a, 3, 1 << 30)))).otherwise(a))


def allele_text(a: Column) -> Column:
    """The bases of a base allele, or its code."""
    return F.when(a.startswith("B:"), F.substring(a, 3, 1 << 30)).otherwise(a)


def alt_alleles(alleles: Column, ref: Column) -> Column:
    """ALT list: first seen first, upper case, without the reference; DEL and INS as they are."""
    return F.filter(F.array_distinct(F.transform(F.filter(alleles, lambda a: a != "MIS"), lambda a: F.when(a.startswith("B:"), F.upper(allele_text(a))).otherwise(a))), lambda x: x != F.upper(ref))


def symbolic_alts(alts: Column) -> Column:
    return F.transform(alts, lambda a: F.when(a.isin("DEL", "INS"), F.concat(F.lit("<"), a, F.lit(">"))).otherwise(a))


def symbolic_info(alts: Column) -> Column:
    """INFO text of an ALT list with DEL or INS, else "."."""
    has = lambda k: F.array_contains(alts, k)
    kind = F.when(has("DEL") & has("INS"), "COMPLEX").when(has("DEL"), "DEL").when(has("INS"), "INS")
    return F.when(kind.isNotNull(), F.concat(F.lit("IMPRECISE;SVTYPE="), kind)).otherwise(".")


def gt_format(alleles: Column, ref: Column, alts: Column) -> Column:
    """GT of allele codes; null if there is no allele or one that is neither the reference nor an ALT (case matters)."""

    def code(a: Column) -> Column:
        at = F.array_position(alts, allele_text(a))
        return F.when(a == "MIS", ".").when(a == F.concat(F.lit("B:"), ref), "0").when(at > 0, at.cast("string")).otherwise("!")

    codes = F.transform(alleles, code)
    return F.when((F.size(alleles) > 0) & ~F.array_contains(codes, "!"), F.array_join(codes, "/"))


def gt_remap(gt: Column, mapping: Column) -> Column:
    """GT with every index replaced by map<int,int>; separators, dots and unmapped indices stay."""
    tokens = F.regexp_extract_all(gt, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(mapping, t.try_cast("int")).cast("string"), t)), "")


def haploid_collapse(alleles: Column) -> Column:
    """One allele: the only one that is called, else missing."""
    return bound(F.array_distinct(F.filter(alleles, lambda a: a != "MIS")), lambda seen: F.when(F.size(seen) == 1, seen).otherwise(F.array(F.lit("MIS"))))


def is_par(contig: Column, pos: Column, build: str) -> Column:
    out = F.lit(False)
    for name, ranges in PAR[build].items():
        for a, b in ranges:
            out = out | ((contig == name) & pos.between(a, b))
    return F.coalesce(out, F.lit(False))


def ploidy(contig: Column, pos: Column, sex: Column | str, build: str | None) -> Column:
    """haploid, diploid or zero, by canonical contig, position, sex (male, female, unknown) and pseudo-autosomal ranges."""
    sex = F.lit(sex) if isinstance(sex, str) else sex

    def of(name: Column) -> Column:
        male = F.when(is_par(name, pos, build) if build else F.lit(False), "diploid").otherwise("haploid")
        other = F.when((name == "X") & (sex != "male"), "diploid").when((name == "Y") & (sex == "female"), "zero").when((name == "Y") & (sex == "unknown"), "haploid").otherwise(male)
        return F.when(name == "MT", "haploid").when(~name.isin("X", "Y"), "diploid").otherwise(other)

    return bound(canonical_contig(contig), of)


def allele_index(allele: Column, ref: Column, alts: Column) -> Column:
    """0 for the reference, k for the k-th ALT, without regard to case; null if it is neither."""
    at = F.array_position(F.transform(alts, F.upper), F.upper(allele))
    return F.when(F.upper(allele) == F.upper(ref), F.lit(0).cast("bigint")).when(at > 0, at)


def informative_snp(genotype: Column) -> Column:
    """Whether a call tells the strand: only bases, no N, and not both of a complementary pair."""
    up = F.upper(genotype)
    both = lambda a, b: up.contains(a) & up.contains(b)
    return ~up.rlike("[ID\\-<>.N]") & up.rlike("[ACGT]") & ~both("A", "T") & ~both("C", "G")


def is_missing_call(genotype: Column) -> Column:
    return (trimmed(genotype) == "") | (trimmed(genotype) == "--")


def het_flag(genotype: Column) -> Column:
    """Exactly two alleles, both called, and different."""
    return bound(F.transform(parse_genotype(genotype), F.upper), lambda a: (F.size(a) == 2) & ~F.array_contains(a, "MIS") & (F.get(a, F.lit(0)) != F.get(a, F.lit(1))))


def het_flag_vcf(gt: Column) -> Column:
    """Of a GT: null if any allele is missing, else whether two alleles differ."""
    a = F.split(gt, "[/|]", -1)
    return F.when(~F.exists(a, lambda x: x.isin(".", "")), (F.size(a) == 2) & (F.get(a, F.lit(0)) != F.get(a, F.lit(1))))


def ambiguous_snp(a: Column, b: Column) -> Column:
    """A/T or C/G."""
    return F.concat(F.upper(a), F.upper(b)).isin("AT", "TA", "CG", "GC")


def lift_class(ref: Column, alts: Column) -> Column:
    """snp, indel or other, as coordinate lifting treats a site."""
    symbolic = F.exists(alts, lambda a: a.rlike(r"[<>\[\]*]"))
    one = (F.length(ref) == 1) & ~F.exists(alts, lambda a: F.length(a) != 1)
    full = (F.length(ref) > 0) & ~F.exists(alts, lambda a: F.length(a) == 0)
    return F.when(symbolic, "other").when(one, "snp").when(full, "indel").otherwise("other")


def synthetic_id(chrom: Column, pos: Column, ref: Column, alts: Column) -> Column:
    return F.concat_ws(":", chrom, pos.cast("string"), ref, F.when(F.size(alts) > 0, F.array_join(alts, ",")).otherwise("."))


def prune_format(fields: Column) -> Column:
    """FORMAT map with GT, GQ, DP and MIN_DP only."""
    return F.map_filter(fields, lambda k, _: k.isin("GT", "GQ", "DP", "MIN_DP"))


def normalise_info(info: Column) -> Column:
    """INFO map whose MQ is a float."""
    return F.transform_values(info, lambda k, v: F.when(k == "MQ", F.coalesce(v.try_cast("float").cast("string"), v)).otherwise(v))


def normalise_format(fields: Column) -> Column:
    """FORMAT map whose MQ is an integer (truncated) and whose empty values are missing."""
    return F.transform_values(fields, lambda k, v: F.when(v == "", ".").when(k == "MQ", F.coalesce(v.try_cast("double").cast("bigint").cast("string"), v)).otherwise(v))
