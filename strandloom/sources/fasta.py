"""FASTA by its offset index: contigs are byte ranges, ranges are partitions, and contigs that nobody asks for are never read.

The index is the usual table of five columns beside the file (`.fai`). One that is missing, older than the FASTA or not readable is built
by Spark from the lines' running byte offsets and written, where the folder can be written. Packed files, and files whose lines
differ in length inside a contig, have no such index: they are read line by line (text.fasta_blocks).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandloom.functions.alleles import canonical_contig
from strandloom.sources import layered, text

#: Bases of a block, and of a partition of the scan.
WIDTH, RANGE_BASES = 1024, 1 << 22
INDEX = "contig_idx long, contig string, length long, offset long, line_bases long, line_bytes long"


def built(lines: DataFrame, line_end: int) -> DataFrame:
    """INDEX columns and `even` (whether byte ranges can be told from them) of (ord, line) of a plain file whose lines end in line_end bytes.

    A line's byte offset is a running sum inside its part of the file and the bytes of the parts before.
    """
    sized = lines.withColumn("__n", F.octet_length("line") + line_end).withColumn("__part", F.shiftright("ord", text.PART_BITS))
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sized.groupBy("__part").agg(F.sum("__n").alias("n")).select("__part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("__before"))  # a row for each part
    inside = F.coalesce(F.sum("__n").over(Window.partitionBy("__part").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumn("__in", inside).join(parts, "__part").select("ord", "line", "__n", (F.col("__in") + F.col("__before")).alias("__at"))
    marked = text.with_head(placed.where("line <> ''"), F.col("line").startswith(">"))
    heads = marked.where("ord = head").select("head", F.regexp_extract("line", r"^>(\S+)", 1).alias("contig"), (F.col("__at") + F.col("__n")).alias("offset"))
    bases = F.octet_length("line")
    body = marked.where("ord <> head").groupBy("head").agg(F.sum(bases).alias("length"), F.min_by(bases, "ord").alias("line_bases"), F.max(bases).alias("most"), F.max_by(bases, "ord").alias("last"), F.count("*").alias("lines"), F.count_if(~F.col("line").rlike("^[A-Za-z*-]+$")).alias("odd"), F.max(F.col("__at") + F.col("__n")).alias("end"), F.min("__at").alias("start"))
    met = heads.join(body, "head", "left")
    full = (F.col("lines") - 1) * F.col("line_bases") + F.col("last") == F.col("length")
    even = F.col("length").isNull() | (full & (F.col("most") == F.col("line_bases")) & (F.col("start") == F.col("offset")) & (F.col("end") - F.col("start") == F.col("length") + F.col("lines") * line_end) & (F.col("odd") == 0))
    rank = (F.row_number().over(Window.orderBy("head")) - 1).cast("long")  # a row for each contig
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return met.select(rank.alias("contig_idx"), "contig", zero("length").alias("length"), F.col("offset").cast("long"), zero("line_bases").alias("line_bases"), F.when(zero("line_bases") > 0, zero("line_bases") + line_end).otherwise(0).cast("long").alias("line_bytes"), even.alias("even"))


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def stored(spark: SparkSession, path: str, fai: str) -> list[tuple] | None:
    """Rows of an index file that is there, not older than the FASTA and whole; else None."""
    store, at = _store(spark, fai)
    if not store.exists(at):
        return None
    own, fasta = store.getFileStatus(at), _store(spark, path)
    whole = fasta[0].getFileStatus(fasta[1])
    if own.getModificationTime() < whole.getModificationTime():
        return None
    lines = text.heads(spark, fai, int(own.getLen()))[0][1].decode("utf-8", "replace").splitlines()
    rows = []
    for i, line in enumerate(x for x in lines if x):
        f = line.split("\t")
        if len(f) != 5 or not all(x.isdigit() for x in f[1:]):
            return None
        length, offset, bases, size = map(int, f[1:])
        if length and (bases < 1 or size < bases or offset + (length - 1) // bases * size + (length - 1) % bases >= whole.getLen()):
            return None
        rows.append((i, f[0], length, offset, bases, size))
    return rows


def index(spark: SparkSession, path: str, fai: str | None = None) -> list[tuple] | None:
    """Rows of INDEX (one for each contig), from the index file or built and written there; None where the file can't be indexed."""
    found = text.heads(spark, path, 1 << 16)
    if len(found) != 1 or not found[0][1] or text.is_layer(found[0][1]) or found[0][0].lower().endswith(text.PACKED_NAMES) or not layered.reachable(found[0][0]):
        return None
    fai = fai or f"{path}.fai"
    if (rows := stored(spark, path, fai)) is not None:
        return rows
    head = found[0][1]
    first = head.find(b"\n")
    if first < 0:
        return None
    table = built(text.read_lines(spark, path), 2 if head[first - 1 : first] == b"\r" else 1).collect()
    if not table or not all(r["even"] for r in table):
        return None
    rows = [tuple(r)[:6] for r in sorted(table)]
    try:
        store, at = layered.opened(fai)
        with store.open_output_stream(at) as out:
            out.write("".join("\t".join(map(str, r[1:])) + "\n" for r in rows).encode())
    except OSError:  # a folder that can't be written: the rows at hand are as good
        pass
    return rows


class Bases(InputPartition):
    """Stretches (contig_idx, contig, first base, end, offset, line_bases, line_bytes) of one file."""

    def __init__(self, stretches: list[tuple]) -> None:
        self.stretches = stretches


class BaseScan(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.file, self.contigs = options["file"], json.loads(options["contigs"])

    def partitions(self) -> list[Bases]:
        """Stretches of RANGE_BASES; short contigs share a partition."""
        out, held, size = [], [], 0
        for i, name, length, offset, bases, width in self.contigs:
            for a in range(0, length, RANGE_BASES):
                b = min(a + RANGE_BASES, length)
                held.append((i, name, a, b, offset, bases, width))
                size += b - a
                if size >= RANGE_BASES:
                    out.append(Bases(held))
                    held, size = [], 0
        return [*out, Bases(held)] if held or not out else out

    def read(self, partition: Bases) -> Iterator[pa.RecordBatch]:
        store, at = layered.opened(self.file)
        with store.open_input_file(at) as source:
            for i, name, a, b, offset, bases, width in partition.stretches:
                place = lambda k, o=offset, n=bases, w=width: o + k // n * w + k % n
                source.seek(place(a))
                raw = source.read(place(b - 1) + 1 - place(a))
                seq = raw.replace(b"\r", b"").replace(b"\n", b"").decode("ascii", "replace")
                if len(seq) != b - a:
                    raise ValueError(f"the index of {self.file} doesn't fit contig {name}")
                n = -(-(b - a) // WIDTH)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * n, pa.int64()), pa.array([name] * n), pa.array(range(a // WIDTH, a // WIDTH + n), pa.int64()), pa.array([seq[k * WIDTH : (k + 1) * WIDTH] for k in range(n)])],
                    names=["contig_idx", "contig", "block", "seq"],
                )


class BaseSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_ranges"

    def schema(self) -> str:
        return "contig_idx long, contig string, block long, seq string"

    def reader(self, schema) -> BaseScan:
        return BaseScan(self.options)


def load(spark: SparkSession, path: str, fai: str | None = None, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks: contig_idx, contig, block, seq of WIDTH bases; contigs: contig_idx, contig, length) of a FASTA.

    wanted: one column of contig names in any spelling. Where the file has an index, other contigs are not read.
    """
    rows = index(spark, path, fai)
    if rows is None:
        blocks = text.fasta_blocks(text.read_lines(spark, path), WIDTH)
        return blocks, blocks.groupBy("contig_idx", "contig").agg(F.sum(F.length("seq")).alias("length"))
    contigs = spark.createDataFrame([r[:3] for r in rows], "contig_idx long, contig string, length long")
    if wanted is not None:
        asked = wanted.select(canonical_contig(F.col(wanted.columns[0])).alias("__key")).distinct()
        known = {r[0] for r in contigs.join(asked, canonical_contig(F.col("contig")) == F.col("__key"), "left_semi").select("contig_idx").collect()}
        rows = [r for r in rows if r[0] in known]
    spark.dataSource.register(BaseSource)
    name = text.heads(spark, path, 1)[0][0]
    return spark.read.format("fasta_ranges").option("file", name).option("contigs", json.dumps(rows)).load(), contigs
