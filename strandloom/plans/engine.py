"""The conversion as one plan: sources, inference of sex and strand, conversion, lifting, panel, sinks."""

from __future__ import annotations

import re
import warnings
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import alleles as A
from strandloom.operators import convert, infer, lift, panel
from strandloom.operators.reference import reference_base, resolve_contig
from strandloom.sinks import panel as panel_sink
from strandloom.sinks import files, plink, report, vcf
from strandloom.sources import bcf, builds, fasta, text


@dataclass(frozen=True)
class Config:
    """A run. Paths are read by Spark; `chain` and `lift_reference` turn lifting on, `panel` harmonisation, `other_reference` (the
    FASTA of the other of GRCh37 and GRCh38) the detection of the input's build, which must be that of `reference`.

    `refs` is a folder of references and chains by build names; then `reference` is that of the output's build `assembly`, and where
    the input's build, given or detected, is another one, rows are lifted and standardised by what the folder holds.

    `standardize` polarises variant rows against the reference; without it they keep QUAL, FILTER, INFO and the FORMAT values GQ, DP and MIN_DP.
    """

    input: str
    reference: str
    output: str
    input_format: str = "auto"
    output_format: str = "vcf"
    sample: str = "sample"
    assembly: str = "GRCh38"
    sex: str | None = None
    strand: str | None = "forward"
    variants_only: bool = False
    chain: str | None = None
    lift_reference: str | None = None
    panel: str | None = None
    limit: int | None = None
    standardize: bool = True
    input_build: str | None = None
    other_reference: str | None = None
    reference_fai: str | None = None
    refs: str | None = None


#: Lines of an input header that go on to the output.
DEFINITION = re.compile("^##(INFO|FORMAT|FILTER)=<")


def input_header(spark: SparkSession, cfg: Config, kind: str) -> list[str]:
    """Header lines of the input, from the start of its file alone; more than one sample is an error."""
    head = text.header_lines(spark, cfg.input) if kind == "vcf" else bcf.header_lines(spark, cfg.input)
    if any(x.startswith("#CHROM") and len(x.split("\t")) > 10 for x in head):
        raise ValueError(f"{cfg.input} has more than one sample")
    return head


def per_allele(definitions: list[str]) -> list[str]:
    """INFO keys with a value for each allele: Number A or R."""
    return [m[1] for x in definitions if (m := re.match(r"##INFO=<ID=([^,>]+),.*?Number=[AR]\b", x))]


def info_text(info: Column) -> Column:
    one = F.transform(F.map_entries(info), lambda e: F.when(e["value"] == "", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"])))
    return F.when(F.size(info) > 0, F.array_join(one, ";")).otherwise(".")


def detected_build(spark: SparkSession, cfg: Config, rows: DataFrame, contigs: DataFrame, blocks: DataFrame) -> dict:
    """The input's build by the bases of both references."""
    other, other_contigs = fasta.load(spark, cfg.other_reference, None, asked_contigs(rows))
    here = cfg.input_build or cfg.assembly
    names = ("GRCh37", "GRCh38") if infer.builds_match(here, "GRCh37") else ("GRCh38", "GRCh37")
    rates = {r["build"]: r["rate"] for r in infer.build_rates(rows, {names[0]: (contigs, blocks), names[1]: (other_contigs, other)}).collect()}
    return {"detected_build": infer.classify_build(rates), **{f"match_rate_{k}": v for k, v in rates.items()}}


def asked_contigs(rows: DataFrame) -> DataFrame:
    """Names under which rows (chrom) look up a reference."""
    return rows.select("chrom").distinct().select(F.explode(F.array("chrom", A.strand_contig(F.col("chrom")))).alias("chrom"))


def contig_table(blocks: DataFrame) -> DataFrame:
    """contig_idx, contig, length of a reference in blocks."""
    return blocks.groupBy("contig_idx", "contig").agg(F.sum(F.length("seq")).alias("length"))


def lifted(rows: DataFrame, chain: DataFrame, contigs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows at their places in the output's build, with `lost`: why a row has none. Columns but place, alleles and GT stay."""
    moved = lift.liftover(rows.select("ord", "chrom", "pos", "ref", "alts", "gt"), chain, contigs, blocks, "ord").withColumnRenamed("reason", "lost")
    return rows.drop("chrom", "pos", "ref", "alts", "gt", "contig", "contig_idx", "reason").join(moved, "ord")


def parsed_input(spark: SparkSession, cfg: Config) -> tuple[DataFrame, dict]:
    """(rows of the input with `error`, kept in memory and on disk; facts of its header and format)."""
    kind = cfg.input_format
    if kind == "auto":
        kind = text.detect_format(text.peek(spark, cfg.input), cfg.input)
    facts: dict = {"input_format": kind}
    if kind == "dtc":
        parsed = text.dtc_parse(text.dtc_scan(text.read_lines(spark, cfg.input))).withColumnRenamed("chromosome", "chrom").withColumnRenamed("position", "pos")
        if said := builds.commented(text.header_lines(spark, cfg.input)):
            facts["comment_build"] = said
            if not infer.builds_match(said, cfg.input_build or cfg.assembly):
                warnings.warn(f"{cfg.input} says that it is of {said}; positions are read as those of {cfg.input_build or cfg.assembly}", stacklevel=2)
        return parsed.persist(), facts
    if kind not in ("vcf", "bcf"):
        raise ValueError(f"no reader for {kind}")
    head = input_header(spark, cfg, kind)
    facts["definitions"] = [x for x in head if DEFINITION.match(x)]
    if kind == "vcf":
        parsed = text.vcf_scan(text.read_lines(spark, cfg.input), head)
    else:
        parsed = bcf.read(spark, cfg.input).withColumn("error", F.when(F.col("pos") < 1, "position"))
    wrong = F.when(F.size("samples") > 1, "sample").when(text.beyond_alts(F.col("samples"), F.size("alts")), "genotype")
    return parsed.withColumn("error", F.coalesce("error", wrong)).persist(), facts


def by_build(spark: SparkSession, cfg: Config, parsed: DataFrame, kind: str) -> tuple[Config, dict]:
    """(the run with chain and references of `refs` where the input's build differs from the output's, facts of the detection)."""
    if not cfg.refs or cfg.chain:
        return cfg, {}
    build, facts = cfg.input_build, {}
    if build is None:
        rows = infer.build_calls(parsed.where("error is null")) if kind == "dtc" else infer.build_sites(parsed.where("error is null"))
        loaded = {}
        for name in ("GRCh37", "GRCh38"):
            path = cfg.reference if infer.builds_match(name, cfg.assembly) else builds.reference(spark, cfg.refs, name)
            if path is None:
                raise FileNotFoundError(f"no reference of {name} in {cfg.refs}, to detect the input's build")
            blocks, contigs = fasta.load(spark, path, None, asked_contigs(rows))
            loaded[name] = (contigs, blocks)
        rates = {r["build"]: r["rate"] for r in infer.build_rates(rows, loaded).collect()}
        if all(v is None for v in rates.values()):  # nothing tells: the input is taken to be of the output's build
            return cfg, {f"match_rate_{k}": None for k in rates}
        build = infer.classify_build(rates)
        facts = {"detected_build": build, **{f"match_rate_{k}": v for k, v in rates.items()}}
    if infer.builds_match(build, cfg.assembly):
        return replace(cfg, input_build=build), facts
    chain = builds.chain(spark, cfg.refs, build, cfg.assembly)
    source = builds.reference(spark, cfg.refs, build)
    if source is None:
        raise FileNotFoundError(f"no reference of {build} in {cfg.refs}")
    return replace(cfg, chain=chain, lift_reference=cfg.reference, reference=source, reference_fai=None, input_build=build, standardize=True), facts


def variants(spark: SparkSession, cfg: Config) -> tuple[DataFrame, DataFrame, dict, Config, list[DataFrame]]:
    """(tagged variant rows, contig table, inferred facts, the run as resolved by build, tables that are kept meanwhile).

    The input is read once: its parsed rows are kept, in memory and on disk, for inference and conversion.

    With a chain, `reference` is that of the input: it tells strand and build. Rows are lifted before anything is looked up in
    the output's reference, calls with a REF of N, so contigs, bases and polarising are those of the output.
    """
    parsed, facts = parsed_input(spark, cfg)
    kind, kept = facts["input_format"], [parsed]
    cfg, told = by_build(spark, cfg, parsed, kind)
    facts |= told
    blocks, contigs = (t.cache() for t in fasta.load(spark, cfg.reference, cfg.reference_fai, asked_contigs(parsed)))
    kept += [blocks, contigs]
    lifts = bool(cfg.chain and cfg.lift_reference)
    if lifts:
        new_blocks, new_contigs = (t.cache() for t in fasta.load(spark, cfg.lift_reference))
        chain = text.chain_blocks(text.read_lines(spark, cfg.chain))
        kept += [new_blocks, new_contigs]
    if kind == "dtc":
        good = parsed.where("error is null")
        if cfg.limit:  # counts good rows
            good = infer.first_rows(good, cfg.limit)
        if cfg.other_reference:
            facts |= detected_build(spark, cfg, infer.build_calls(good), contigs, blocks)
        facts["sex"] = cfg.sex or infer.classify_sex(infer.sex_counts(good, cfg.assembly).first().asDict())
        strand = cfg.strand
        if strand is None:
            votes = infer.strand_votes(good, contigs, blocks).first()
            strand = infer.strand_lock(votes["plus"], votes["minus"])
        facts["strand"] = strand
        # Pseudo-autosomal ranges are those of the output's build, so they tell nothing of positions that are still to be lifted.
        rows = convert.dtc_to_variant(good, None if lifts else contigs, blocks, facts["sex"], None if lifts else cfg.assembly, strand == "reverse", cfg.variants_only)
        if lifts:
            dropped = rows.where("reason is not null")
            rows = lifted(rows.where("reason is null").withColumn("alts", F.col("symbolic")), chain, new_contigs, new_blocks)
            rows = resolve_contig(rows.withColumnRenamed("lost", "reason"), new_contigs).withColumn("symbolic", F.col("alts"))
            rows = rows.unionByName(dropped.select("ord", "reason"), allowMissingColumns=True)
        bad = parsed.where("error is not null").select("ord", F.lit("parse_errors").alias("reason"))
        rows = rows.unionByName(bad, allowMissingColumns=True)
    else:
        rows = parsed.where("error is null")
        rows = infer.first_rows(rows, cfg.limit) if cfg.limit else rows
        rows = A.computed(rows, __cell=F.coalesce(F.get("samples", F.lit(0)), F.create_map().cast("map<string,string>")))
        rows = rows.withColumn("gt", F.coalesce(F.try_element_at("__cell", F.lit("GT")), F.lit("."))).withColumn("fields", A.prune_format(A.normalise_format(F.col("__cell")))).drop("__cell")
        if cfg.other_reference:
            facts |= detected_build(spark, cfg, infer.build_sites(rows), contigs, blocks)
        facts["sex"] = cfg.sex or infer.classify_sex(infer.site_sex_counts(rows, cfg.assembly).first().asDict())
        if lifts:
            rows, contigs, blocks = lifted(rows, chain, new_contigs, new_blocks), new_contigs, new_blocks
        else:
            rows = rows.withColumn("lost", F.lit(None).cast("string"))
        rows = resolve_contig(rows, contigs)
        if cfg.standardize:
            rows = convert.polarize(reference_base(rows, blocks), cfg.assembly, facts["sex"]).withColumn("reason", F.coalesce("lost", "reason"))
            rows = rows.withColumn("info", F.lit(".")).drop("filters", "qual", "fields")
        else:
            rows = rows.withColumn("id", F.when(F.size("ids") > 0, F.array_join("ids", ";"))).withColumn("reason", F.col("lost"))
            rows = rows.withColumn("info_map", A.normalise_info(F.col("info"))).withColumn("info", info_text(F.col("info_map")))
        rows = rows.withColumn("symbolic", F.col("alts"))
        rows = rows.unionByName(parsed.where("error is not null").select("ord", F.lit("parse_errors").alias("reason")), allowMissingColumns=True)
    return rows, new_contigs if lifts else contigs, facts, cfg, kept


def bcf_rows(out: DataFrame) -> DataFrame:
    """Output rows as bcf.blocks takes them: what their VCF line says, field by field, with sort keys."""
    info = F.expr("map_from_entries(transform(filter(split(info, ';'), x -> x not in ('.', '')), x -> struct(substring_index(x, '=', 1) as k, case when contains(x, '=') then substring(x, instr(x, '=') + 1) else '' end as v)))")
    more = F.array().cast("array<string>")
    cell = F.create_map(F.lit("GT"), F.col("gt"))
    if "fields" in out.columns:
        more = F.filter(F.array(*map(F.lit, vcf.KEPT_FIELDS)), lambda k: F.coalesce(F.map_contains_key("fields", k), F.lit(False)))
        cell = F.map_concat(cell, F.map_filter(F.coalesce("fields", F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*vcf.KEPT_FIELDS)))
    rank, tail = convert.reference_order(out)
    extra = [c for c in ("qual", "filters") if c in out.columns]
    return out.select(rank.alias("__rank"), tail.alias("__tail"), "ord", "chrom", "pos", "id", "ref", F.col("symbolic").alias("alts"), *extra, info.alias("info"), F.concat(F.array(F.lit("GT")), more).alias("format"), F.array(cell).alias("samples"))


def panel_text(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """(header lines, (ord, line)) of a panel, VCF or BCF."""
    if text.detect_format(text.peek(spark, path), path) == "bcf":
        return bcf.header_lines(spark, path), bcf.text_lines(bcf.read(spark, path))
    lines = text.read_lines(spark, path)
    return [r["line"] for r in lines.where(F.col("line").startswith("#")).orderBy("ord").collect()], lines


def convert_file(spark: SparkSession, cfg: Config) -> dict[str, int]:
    """Run a conversion; returns the counters, which are also in <output>_report as JSON."""
    rows, contigs, facts, cfg, kept = variants(spark, cfg)
    if cfg.output_format == "bcf":  # its records name contigs by their number in the header; the other formats write an unknown one as it is, last
        rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("contig").isNull(), "unknown_chromosomes")))
    rows = rows.persist()  # counted, sorted and written; made once
    counters = {r["reason"]: r["n"] for r in convert.summary(rows).collect()}
    out = rows.where("reason is null").withColumn("chrom", F.coalesce("contig", "chrom"))
    if cfg.panel:
        panel_head, panel_lines = panel_text(spark, cfg.panel)
        sites = text.panel_sites(text.vcf_scan(panel_lines).where("error is null"))
        indexed = panel.panel_alt_index(panel.harmonize(panel.panel_join(out, sites)), [F.col("ord")])
        out = panel.inject(indexed).withColumn("symbolic", F.col("alts"))
        if "info_map" in out.columns:  # values for each allele are void where ALTs changed
            out = out.withColumn("info", info_text(panel.prune_info(F.col("info_map"), per_allele(facts["definitions"]), F.col("injected"))))
        grown = panel.padded(sites, indexed).cache()  # written and counted
        facts["panel"] = panel.panel_counts(grown).first().asDict()
        known, samples, formats = panel_sink.header_facts(panel_head)
        panel_sink.write(panel_sink.grown_lines(panel_lines, grown, known, samples, formats), panel_head, cfg.output + "_panel")
    names = [(r["contig"], r["length"]) for r in contigs.orderBy("contig_idx").collect()]
    head = vcf.header(names, cfg.sample, cfg.assembly, cfg.lift_reference or cfg.reference, [re.sub(r",IDX=\d+", "", x) for x in facts.pop("definitions", [])])
    facts |= {"sex_source": "given" if cfg.sex else "inferred", "build": infer.build_name(cfg.assembly) or cfg.assembly}
    order = [*convert.reference_order(out), "pos", "ord"]
    if cfg.output_format == "vcf":
        vcf.write(out, head, cfg.output)
    elif cfg.output_format == "bcf":
        records = bcf_rows(out).persist()
        head = [*head[:-1], *bcf.missing_definitions(records, head), head[-1]]
        ordered = records.orderBy("__rank", "__tail", "pos", "ord")
        files.write_parts(bcf.blocks(ordered, head), [("data", cfg.output, bcf.bgzf(bcf.header_bytes(head)), bcf.END_BLOCK)])
        kept.append(records)
    else:
        site = out.withColumn("ids", F.when(F.col("id").isNull(), F.array().cast("array<string>")).otherwise(F.array("id"))).withColumn("gts", F.array("gt"))
        plink.write(site, order, plink.fam(spark.createDataFrame([(cfg.sample, facts["sex"])], "sample string, sex string")), cfg.output)
    spark.createDataFrame([(report.report(asdict(cfg), counters, facts),)], "value string").coalesce(1).write.mode("overwrite").text(cfg.output + "_report")
    for table in [rows, *kept]:
        table.unpersist()
    return counters
