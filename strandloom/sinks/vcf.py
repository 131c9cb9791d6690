"""VCF 4.5 text: header lines, body lines in order, one part file after another."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.convert import reference_order

#: Header definitions of every output.
FORMATS = [("GT", "1", "String", "Genotype"), ("GQ", "1", "Integer", "Genotype quality"), ("DP", "1", "Integer", "Read depth"), ("MIN_DP", "1", "Integer", "Minimum depth"), ("MQ", "1", "Integer", "Mapping quality")]
INFOS = [("IMPRECISE", "0", "Flag", "Imprecise structural variation"), ("SVTYPE", "1", "String", "Type of structural variant"), ("MQ", "1", "Float", "Mapping quality")]
#: FORMAT keys that are written besides GT.
KEPT_FIELDS = ("GQ", "DP", "MIN_DP")
ALTS = [("DEL", "Deletion"), ("INS", "Insertion")]


def header(contigs: list[tuple[str, int]], sample: str, assembly: str | None = None, reference: str | None = None, more: list[str] = (), date: datetime.date | None = None) -> list[str]:
    """Header lines; `more` are definitions of the input that are not here yet."""
    lines = ["##fileformat=VCFv4.5", f"##fileDate={(date or datetime.date.today()):%Y%m%d}", "##source=strandloom"]
    lines += [f"##assembly={assembly}"] if assembly else []
    lines += [f"##reference={reference}"] if reference else []
    lines += [f"##contig=<ID={n},length={k}>" for n, k in contigs]
    lines += [f'##INFO=<ID={i},Number={n},Type={t},Description="{d}">' for i, n, t, d in INFOS]
    lines += [f'##FORMAT=<ID={i},Number={n},Type={t},Description="{d}">' for i, n, t, d in FORMATS]
    lines += [f'##ALT=<ID={i},Description="{d}">' for i, d in ALTS]
    have = {x.split(",")[0] for x in lines}
    lines += [x for x in more if x.split(",")[0] not in have]
    return [*lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])]


def body(rows: DataFrame) -> DataFrame:
    """rows (chrom, pos, id, ref, symbolic, info, gt; qual, filters and the map `fields` of more FORMAT values where they are there) with `line`."""
    alt = F.when(F.size("symbolic") > 0, F.array_join("symbolic", ",")).otherwise(".")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(".")) if c in rows.columns else F.lit(".")
    filters = F.when(F.size("filters") > 0, F.array_join("filters", ";")).otherwise(".") if "filters" in rows.columns else F.lit(".")
    names, values = F.lit("GT"), F.col("gt")
    if "fields" in rows.columns:
        more = F.filter(F.array(*map(F.lit, KEPT_FIELDS)), lambda k: F.coalesce(F.map_contains_key("fields", k), F.lit(False)))
        names = F.array_join(F.concat(F.array(F.lit("GT")), more), ":")
        values = F.array_join(F.concat(F.array("gt"), F.transform(more, lambda k: F.coalesce(F.try_element_at("fields", k), F.lit(".")))), ":")
    qual = F.regexp_replace(text("qual"), r"\.0$", "")
    return rows.withColumn("line", F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.coalesce("id", F.lit(".")), "ref", alt, qual, filters, "info", names, values))


def write(rows: DataFrame, head: list[str], path: str) -> None:
    """A folder of part files in order: the header is part of the first, so `cat` of the parts is the file.

    The sort is a range partitioning, every task writes its own range.
    """
    spark = rows.sparkSession
    top = spark.createDataFrame([(-1, "", -1, i, x) for i, x in enumerate(head)], "rank long, tail string, pos long, ord long, line string")
    rank, tail = reference_order(rows)
    lines = body(rows).select(rank.alias("rank"), tail.alias("tail"), F.col("pos").cast("long"), F.col("ord").cast("long"), "line")
    top.unionByName(lines).orderBy("rank", "tail", "pos", "ord").select("line").write.mode("overwrite").text(path)
