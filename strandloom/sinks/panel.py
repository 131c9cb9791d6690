"""The grown panel as VCF text: old and new sites in panel order, missing genotypes for new ones."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.alleles import natural_order, synthetic_id


def sample_fields(samples: int, formats: list[str]) -> str:
    """FORMAT and sample columns of a new site: GT first, all missing. Samples without any FORMAT are an error."""
    if samples and not formats:
        raise ValueError("a panel with samples needs FORMAT definitions")
    keys = ["GT", *(f for f in formats if f != "GT")] if samples else []
    missing = ":".join(["./." if k == "GT" else "." for k in keys])
    return "\t".join([":".join(keys), *[missing] * samples])


def _ranked(contigs: list[str]) -> tuple[Column, Column]:
    """(rank, tail) of `chrom`: contigs in header order, with or without chr, then by name."""
    bare = F.regexp_replace("chrom", "^chr", "")
    place = F.array_position(F.array(*(F.lit(c.removeprefix("chr")) for c in contigs)) if contigs else F.array().cast("array<string>"), bare)
    n = natural_order(F.col("chrom"))
    return F.when(place > 0, place).otherwise(F.lit(1_000_000) + n["rank"]), n["tail"]


def panel_lines(padded: DataFrame, contigs: list[str], samples: int = 0, formats: list[str] = ()) -> DataFrame:
    """rank, tail, pos, line of a padded panel (chrom, pos, ref, alts, kind) from its sites alone."""
    rank, tail = _ranked(contigs)
    extra = sample_fields(samples, list(formats))
    name = F.when(F.col("kind") == "novel", synthetic_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alts"))).otherwise(".")
    alt = F.when(F.size("alts") > 0, F.array_join("alts", ",")).otherwise(".")
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), name, "ref", alt, F.lit("."), F.lit("."), F.lit("."), *([F.lit(extra)] if samples else []))
    return padded.select(rank.alias("rank"), tail.alias("tail"), "pos", line.alias("line"))


def grown_lines(lines: DataFrame, padded: DataFrame, contigs: list[str], samples: int = 0, formats: list[str] = ()) -> DataFrame:
    """rank, tail, pos, ord, line: the panel's own records as they are, but for added ALTs, and the new sites.

    lines: (ord, line) of the panel. A record without sample columns gets missing ones where the panel has samples; every record
    of a repeated site gets the ALTs that were added there.
    """
    extra = sample_fields(samples, list(formats))
    own = lines.where((F.col("line") != "") & ~F.col("line").startswith("#")).withColumn("f", F.split("line", "\t", -1))
    own = own.select("ord", "f", F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).try_cast("bigint").alias("pos"))
    met = own.join(padded.where("kind = 'modified'").select("chrom", F.col("pos").cast("bigint").alias("pos"), "added"), ["chrom", "pos"], "left")
    old, more = F.get("f", F.lit(4)), F.array_join("added", ",")
    alt = F.when(F.coalesce(F.size("added"), F.lit(0)) < 1, old).when(old == ".", more).otherwise(F.concat_ws(",", old, more))
    cells = F.concat(F.slice("f", 1, 4), F.array(alt), F.slice("f", 6, 1_000_000))
    if samples:
        cells = F.when(F.size("f") < 10, F.concat(F.slice(cells, 1, 8), F.array(F.lit(extra)))).otherwise(cells)
    rank, tail = _ranked(contigs)
    kept = met.select(rank.alias("rank"), tail.alias("tail"), "pos", "ord", F.array_join(cells, "\t").alias("line"))
    new = panel_lines(padded.where("kind = 'novel'"), contigs, samples, formats).withColumn("ord", F.lit(-1).cast("long"))
    return kept.unionByName(new.withColumn("pos", F.col("pos").cast("long")))


def header_facts(head: list[str]) -> tuple[list[str], int, list[str]]:
    """(contigs, number of samples, FORMAT keys) of a panel's header."""
    of = lambda kind: [m[1] for x in head if (m := re.match(rf"##{kind}=<(?:.*?,)?ID=([^,>]*)", x))]
    columns = next((x.split("\t") for x in head if x.startswith("#CHROM")), [])
    return of("contig"), max(0, len(columns) - 9), of("FORMAT")


def write(rows: DataFrame, head: list[str], path: str) -> None:
    """Rows of grown_lines as part files in order, the header first; gzip if the path says so."""
    top = rows.sparkSession.createDataFrame([(-1, "", -1, i, x) for i, x in enumerate(head)], "rank long, tail string, pos long, ord long, line string")
    packed = path.endswith((".gz", ".bgz", ".bgzf"))
    top.unionByName(rows).orderBy("rank", "tail", "pos", "ord", "line").select("line").write.mode("overwrite").option("compression", "gzip" if packed else "none").text(path)
