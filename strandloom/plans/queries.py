"""Queries of the genotype engine over views that are derived from the tables by SQL both engines read, and their oracle SQL.

The queries use this package's operators; the oracles are written apart from them, as plain SQL over the same views: theta
joins instead of bins, CASE lists instead of translate(), row numbers instead of ordered arrays.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import alleles as A
from strandloom.operators import convert, infer, lift, panel
from strandloom.operators.number import numbered
from strandloom.operators.reference import reference_base, resolve_contig
from strandloom.plans.engine import contig_table
from strandloom.sinks import panel as panel_sink
from strandloom.sinks import plink, vcf
from strandloom.sources import bcf, fasta, layered, text

LENGTH = 16384
_CHROM = "case when o_orderkey%5=0 then 'chr' else '' end || case when o_orderkey%26<22 then cast(o_orderkey%26+1 as string) when o_orderkey%26=22 then 'X' when o_orderkey%26=23 then 'Y' when o_orderkey%26=24 then 'MT' else 'Un1' end"
_BASE = "substr('ACGT',cast({}%4+1 as int),1)"

#: Views by name; table names are words of the SQL and become files in Spark.
VIEWS = {
    "calls": f"""select o_orderkey as rid, o_orderkey as ord, 'rs'||cast(o_orderkey as string) as id, {_CHROM} as chrom,
      (o_custkey*37+o_orderkey*11)%17000+1 as pos,
      case o_orderkey%19 when 0 then '--' when 1 then 'DI' when 2 then 'A/AG' when 3 then 'ACT' when 4 then 'ac' when 5 then 'G' when 6 then 'Z' when 7 then 'DD' when 8 then 'A/-' when 9 then 'I/T'
      else {_BASE.format("o_custkey")}||{_BASE.format("(o_custkey+o_orderkey)")} end as genotype from orders""",
    "sites": f"""select o_orderkey as rid, o_orderkey as ord, {_CHROM} as chrom, (o_custkey*37+o_orderkey*11)%17000+1 as pos,
      {_BASE.format("o_custkey")}||case when o_orderkey%11=0 then 'T' else '' end as ref,
      {_BASE.format("(o_custkey+1)")}||case when o_orderkey%13=0 then 'C' else '' end||case when o_orderkey%3=0 then ','||{_BASE.format("(o_custkey+2)")} else '' end as alt,
      case o_orderkey%6 when 0 then '0/1' when 1 then '1|1' when 2 then './.' when 3 then '0' when 4 then '1/2' else '0|0' end as gt from orders""",
    "lines": f"""select o_orderkey as ord, case o_orderkey%8 when 0 then 'rs'||cast(o_orderkey as string)||'  '||{_CHROM}||' '||cast(o_custkey+1 as string)||' AG'
      when 1 then '"rs'||cast(o_orderkey as string)||'","1","'||cast(o_custkey as string)||'","CT"' when 2 then '.'||' 7 '||cast(o_custkey as string)||' A G'
      when 3 then 'rs3 var 9 '||cast(o_custkey as string)||case when o_orderkey%16=3 then ' - ' else ' + ' end||'AC' when 4 then '# a comment' when 5 then 'rsid chromosome position genotype'
      when 6 then '' else 'rs7 1 x AA' end as line from orders""",
    "chain": """select p_partkey as block_id, cast(p_partkey%3+1 as int) as chain_id, 100+(p_partkey%3)*(p_partkey%2) as score,
      case when p_partkey%26<22 then cast(p_partkey%26+1 as string) else 'X' end as t_chrom, (p_partkey*53)%16000 as t_start, (p_partkey*53)%16000+200+p_size as t_end,
      cast(p_partkey%22+1 as string) as q_chrom, (p_partkey*29)%15000 as q_start, 20000 as q_size, case when p_partkey%4=0 then '-' else '+' end as q_strand from part""",
    "chain_text": """select p_partkey as ord, case when p_partkey%10=0 then 'chain '||cast(1000+p_partkey as string)||' c'||cast(p_partkey%7 as string)||' 90000 + '||cast(p_partkey*3 as string)||' 80000 q'||cast(p_partkey%5 as string)||' 95000 '||case when p_partkey%20=0 then '+' else '-' end||' '||cast(p_partkey*2 as string)||' 80000 '||cast(p_partkey+1 as string)
      when p_partkey%10=9 then cast(p_size+1 as string) else cast(p_size+1 as string)||' '||cast(p_partkey%6 as string)||' '||cast(p_partkey%4 as string) end as line from part""",
    "fasta": """select p_partkey as ord, case when p_partkey%100=0 then '>c'||cast(p_partkey as string)||' about' else repeat('ACGTN', cast(p_partkey%700+1 as int)) end as line from part""",
    "panel": f"""select p_partkey as ord, case when p_partkey%9=0 then 'chr' else '' end||cast(p_partkey%22+1 as string) as chrom, (p_partkey*41)%1000+1 as pos,
      {_BASE.format("p_partkey")} as ref, {_BASE.format("(p_partkey+1)")}||case when p_partkey%4=0 then ','||{_BASE.format("(p_partkey+2)")} when p_partkey%15=0 then 'A' else '' end as alt from part""",
    "asked": f"""select o_orderkey as rid, o_orderkey as ord, cast(o_orderkey%22+1 as string) as chrom, (o_custkey*7)%1000+1 as pos, {_BASE.format("o_custkey")} as ref,
      {_BASE.format("(o_custkey+1+o_orderkey%3)")} as alt, '0/1' as gt from orders""",
    "names": """select distinct case p_partkey%14 when 0 then 'chr1' when 1 then '23' when 2 then 'chr25' when 3 then '24' when 4 then '26' when 5 then 'chrM' when 6 then 'm' when 7 then 'Chr7' when 8 then ' 8 ' when 9 then 'PAR' when 10 then 'chrUn_'||cast(p_size as string) when 11 then 'X' when 12 then 'CHRY' else 'chrchr'||cast(p_size as string) end as chrom from part""",
}
TABLES = ("orders", "part")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = re.sub(rf"\bfrom ({'|'.join(TABLES)})\b", lambda m: f"from parquet.`{sf_dir}/{m[1]}.parquet`", VIEWS[name])
    out = spark.sql(sql)
    return out.withColumn("alts", F.split("alt", ",")) if name in ("sites", "panel", "asked") else out


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt out to all cores where their scan has fewer tasks, as a file of one row group has: for steps that compute much on each row."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def genome(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(contigs, blocks) of the reference of the queries: 1 to 22, X, Y, MT, each 16,384 bases of ACGT repeated."""
    contigs = spark.range(25).select(F.col("id").cast("int").alias("contig_idx"), F.when(F.col("id") < 22, (F.col("id") + 1).cast("string")).when(F.col("id") == 22, "X").when(F.col("id") == 23, "Y").otherwise("MT").alias("contig"))
    blocks = contigs.select("*", F.explode(F.expr(f"sequence(0L, {LENGTH // 1024 - 1}L)")).alias("block"))
    return contigs, blocks.select("contig_idx", "contig", "block", F.expr("repeat('ACGT', 256)").alias("seq"))


def joined(c: str, sep: str = ",") -> F.Column:
    return F.array_join(c, sep)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
            ORACLES[f.__name__] = "with " + ", ".join(f"{n} as ({VIEWS[n]})" for n in used) + " " + sql if used else sql
        return f

    return add


# --- oracle fragments (DuckDB) -----------------------------------------------------------------------------------------

_KEY = "case upper(regexp_replace(trim({0}), '^chr', '')) when 'M' then 'MT' when '23' then 'X' when '25' then 'X' when '24' then 'Y' when '26' then 'MT' else upper(regexp_replace(trim({0}), '^chr', '')) end"
_KNOWN = f"({_KEY} in ('1','2','3','4','5','6','7','8','9','10','11','12','13','14','15','16','17','18','19','20','21','22','X','Y','MT'))"
_REF = "case when {0} between 1 and 16384 then substr('ACGT', cast(({0}-1)%4+1 as int), 1) end"
_PARSE = """case when contains({0},'/') then list_transform(string_split({0},'/'), lambda s: case when trim(s)='D' then 'DEL' when trim(s)='I' then 'INS' when trim(s) in ('-','0','?') then 'MIS' else 'B:'||trim(s) end)
 when length({0})>2 and regexp_full_match(upper({0}),'[ACGTN]+') then ['B:'||upper({0})]
 else list_transform(string_split({0},''), lambda s: case when upper(s) in ('A','C','G','T','N') then 'B:'||s when upper(s)='D' then 'DEL' when upper(s)='I' then 'INS' else 'MIS' end) end"""
_PAR38 = "(({0}='X' and ({1} between 10001 and 2781479 or {1} between 155701383 and 156030895)) or ({0}='Y' and ({1} between 10001 and 2781479 or {1} between 56887903 and 57217415)))"
_COMP = "case {0} when 'A' then 'T' when 'C' then 'G' when 'G' then 'C' when 'T' then 'A' else {0} end"
_PLOIDY = "case when k='MT' then 'haploid' when k not in ('X','Y') then 'diploid' when sex='male' then case when par then 'diploid' else 'haploid' end when k='X' then 'diploid' when sex='female' then 'zero' else 'haploid' end"


def _variants(sex: str) -> str:
    """CTE chain from calls to v(rid, ..., al, alts, gt, reason) for one sex."""
    return f"""a as (select *, {_KEY.format("chrom")} as k, {_KNOWN.format("chrom")} as known, {_REF.format("pos")} as ref, {_PARSE.format("genotype")} as al, '{sex}' as sex from calls),
    b as (select *, {_PAR38.format("k", "pos")} as par from a), c as (select *, {_PLOIDY} as pl, list_filter(al, lambda x: x<>'MIS') as called from b),
    d as (select * exclude (al), case when pl='haploid' then case when len(called)>0 and len(list_filter(called, lambda x: x<>called[1]))=0 then [called[1]] else ['MIS'] end else al end as al from c),
    e as (select *, case when al[1]='MIS' then null when al[1] in ('DEL','INS') then al[1] else upper(substr(al[1],3)) end as x1, case when len(al)<2 or al[2]='MIS' then null when al[2] in ('DEL','INS') then al[2] else upper(substr(al[2],3)) end as x2 from d),
    f as (select *, case when x1 is not null and x1<>ref and x2 is not null and x2<>ref and x2<>x1 then [x1,x2] when x1 is not null and x1<>ref then [x1] when x2 is not null and x2<>ref then [x2] else [] end as alts from e),
    g as (select *, list_transform(al, lambda s: case when s='MIS' then '.' when s='B:'||ref then '0' when list_position(alts, case when s like 'B:%' then substr(s,3) else s end)>0 then cast(list_position(alts, case when s like 'B:%' then substr(s,3) else s end) as string) else '!' end) as codes from f),
    v as (select *, case when len(al)>0 and not list_contains(codes,'!') then array_to_string(codes,'/') end as gt0 from g),
    w as (select *, case when not known then 'unknown_chromosomes' when ref is null then 'reference_failures' when pl='zero' then 'missing_genotype_records' when gt0 is null then 'invalid_genotypes' end as reason from v)"""


def dtc(spark: SparkSession, sf_dir: str, sex: str = "female", **more) -> DataFrame:
    contigs, blocks = genome(spark)
    return convert.dtc_to_variant(spread(view(spark, sf_dir, "calls")), contigs, blocks, sex, "GRCh38", **more)


# --- sources -----------------------------------------------------------------------------------------------------------


@query("select ord, line from lines where line <> '' and line not like '#%' and lower(substr(line,1,4)) not in ('rsid','loid')")
def dtc_scan(spark, sf_dir):
    return text.dtc_scan(view(spark, sf_dir, "lines"))


@query("""select ord, case ord%8 when 0 then 'rs'||cast(ord as string) when 1 then 'rs'||cast(ord as string) when 3 then 'rs3' end as id,
  case ord%8 when 0 then split_part(line,' ',3) when 1 then '1' when 2 then '7' when 3 then '9' end as chromosome,
  case ord%8 when 0 then cast(split_part(line,' ',4) as bigint) when 1 then cast(replace(split_part(line,',',3),'"','') as bigint) when 2 then cast(split_part(line,' ',3) as bigint) when 3 then cast(split_part(line,' ',4) as bigint) end as position,
  case ord%8 when 0 then 'AG' when 1 then 'CT' when 2 then 'A/G' when 3 then case when ord%16=3 then 'TG' else 'AC' end end as genotype, case ord%8 when 7 then 'position' end as error
  from lines where ord%8 not in (4,5,6)""")
def dtc_parse(spark, sf_dir):
    return text.dtc_parse(text.dtc_scan(view(spark, sf_dir, "lines"))).select("ord", "id", "chromosome", "position", "genotype", "error")


@query("select cast(ord as bigint) as ord, coalesce(id,'.')||chr(9)||chrom||chr(9)||cast(pos as string)||chr(9)||genotype as line from calls")
def dtc_line(spark, sf_dir):
    return view(spark, sf_dir, "calls").select(F.col("ord").cast("bigint").alias("ord"), F.concat_ws("\t", F.coalesce("id", F.lit(".")), "chrom", F.col("pos").cast("string"), "genotype").alias("line"))


@query("""select ord, chrom, pos, 'rs'||cast(ord as string) as id, ref, alt, cast(len(string_split(alt,',')) as bigint) as n_alts, gt from sites""")
def vcf_scan(spark, sf_dir):
    rows = view(spark, sf_dir, "sites")
    lines = rows.select("ord", F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.concat(F.lit("rs"), F.col("ord").cast("string")), "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("DP=3;IMPRECISE"), F.lit("GT:DP"), F.concat("gt", F.lit(":9"))).alias("line"))
    got = text.vcf_scan(lines).where("error is null")
    return got.select("ord", "chrom", "pos", joined("ids", ";").alias("id"), "ref", joined("alts").alias("alt"), F.size("alts").cast("bigint").alias("n_alts"), F.get("samples", F.lit(0))["GT"].alias("gt"))


#: Header of the rows of vcf_errors.
_TYPED = ['##INFO=<ID=DP,Number=1,Type=Integer,Description="d">', '##INFO=<ID=AF,Number=A,Type=Float,Description="f">', '##INFO=<ID=DB,Number=0,Type=Flag,Description="b">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="g">', '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="d">']


@query("""select ord, case ord%12 when 0 then 'position' when 1 then 'genotype' when 2 then 'info' when 3 then 'info' when 4 then 'info' when 5 then 'info' when 6 then 'format' when 7 then 'ref' when 8 then 'sample' when 9 then 'position' end as error from sites""")
def vcf_errors(spark, sf_dir):
    """Rows with a planted fault in ten of twelve: position 0 or no number, GT, INFO and FORMAT of another type than the header's, REF, too many fields."""
    k = F.col("ord") % 12
    rows = view(spark, sf_dir, "sites")
    info = F.when(k == 2, "DP=1.5").when(k == 3, "DP=1,2").when(k == 4, "AF=0.1,x").when(k == 5, "DB=1;DP=3").otherwise("DP=.;AF=1e-3,.;DB;XX=y")
    cells = F.when(k == 1, "0/x:9").when(k == 6, "0/1:9x").when(k == 8, "0/1:9:9").otherwise(F.concat("gt", F.lit(":-9")))
    lines = rows.select("ord", F.concat_ws("\t", "chrom", F.when(k == 0, "0").when(k == 9, "x").otherwise(F.col("pos").cast("string")), F.lit("."), F.when(k == 7, "1").otherwise(F.col("ref")), "alt", F.lit("."), F.lit("PASS"), info, F.lit("GT:DP"), cells).alias("line"))
    return text.vcf_scan(lines, _TYPED).select("ord", "error")


#: Header of the records of bcf_fields.
_BCF_HEAD = [*_TYPED, '##FILTER=<ID=q10,Description="q">', *(f"##contig=<ID={p}{c}>" for c in [*range(1, 23), "X", "Y", "MT", "Un1"] for p in ("", "chr")), "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb"]


@query("""select 'rs'||cast(ord as string) as id, chrom, pos, ref, alt, cast(ord%400 as double)/4 as qual, case when ord%2=0 then 'q10' else '' end as filter, cast(ord*1000 as string) as dp, case when ord%3=0 then '0.5,.' else '-0.25' end as af, ord%5=0 as db, gt as gt_a, cast(ord%300 as string) as dp_b from sites""")
def bcf_fields(spark, sf_dir):
    """Rows encoded as BCF records by the header's types, packed in BGZF members, and decoded again."""
    rows = spread(view(spark, sf_dir, "sites"))
    k = F.col("ord")
    info = F.map_concat(F.create_map(F.lit("DP"), (k * 1000).cast("string"), F.lit("AF"), F.when(k % 3 == 0, "0.5,.").otherwise("-0.25")), F.when(k % 5 == 0, F.create_map(F.lit("DB"), F.lit(""))).otherwise(F.create_map().cast("map<string,string>")))
    cell = lambda gt, dp: F.create_map(F.lit("GT"), gt, F.lit("DP"), dp)
    full = rows.select("chrom", "pos", F.concat(F.lit("rs"), k.cast("string")).alias("id"), "ref", "alts", ((k % 400) / 4).alias("qual"), F.when(k % 2 == 0, F.array(F.lit("q10"))).otherwise(F.array().cast("array<string>")).alias("filters"), info.alias("info"), F.array(F.lit("GT"), F.lit("DP")).alias("format"), F.array(cell(F.col("gt"), F.lit(".")), cell(F.lit("./."), (k % 300).cast("string"))).alias("samples"))
    data = bcf.blocks(full, _BCF_HEAD)
    head = bcf.Head(*bcf.dictionaries("\n".join(_BCF_HEAD)), 2, 0)

    def decode(batches):
        for batch in batches:
            for value in batch.column(0):
                yield from bcf.rows_of(((True, piece) for piece in layered.streamed(value.as_py())), head, True)

    back = data.select("data").mapInArrow(decode, bcf.SCHEMA)
    at = lambda i, key: F.get("samples", F.lit(i))[key]
    return back.select(joined("ids", ";").alias("id"), "chrom", "pos", "ref", joined("alts").alias("alt"), F.col("qual").cast("double").alias("qual"), joined("filters", ";").alias("filter"), F.col("info")["DP"].alias("dp"), F.col("info")["AF"].alias("af"), F.map_contains_key("info", F.lit("DB")).alias("db"), at(0, "GT").alias("gt_a"), at(1, "DP").alias("dp_b"))


@query("select cast(ord as string)||' '||line as line from lines")
def bgzf_ranges(spark, sf_dir):
    """Lines packed in BGZF members of 997 bytes and read by ranges of 3,000 packed bytes, cut anywhere."""

    def through(batches):
        for batch in batches:
            raw = "".join(x + "\n" for x in batch.column(0).to_pylist()).encode()
            packed = b"".join(bcf.bgzf(raw[i : i + 997]) for i in range(0, len(raw), 997)) + bcf.END_BLOCK
            for at in range(0, len(packed), 3000):
                yield from layered.batches(layered.whole_lines(layered.line_bytes(pa.BufferReader(packed), at, min(at + 3000, len(packed)), len(packed))))

    return view(spark, sf_dir, "lines").select(F.concat(F.col("ord").cast("string"), F.lit(" "), "line").alias("line")).mapInArrow(through, "line string")


@query("""select cast(row_number() over (order by h.ord)-1 as bigint) as contig_idx, 'c'||cast(h.ord as string) as contig, cast(coalesce(n,0) as bigint) as length, cast(start as bigint) as start, cast(coalesce(k,0) as bigint) as line_bases, coalesce(n is null or (most=k and (lines-1)*k+last=n), true) as even
  from (select ord, upto as start from (select ord, sum(length(line)+1) over (order by ord rows unbounded preceding) as upto from fasta) where ord%100=0) h
  left join (select ord-ord%100 as head, sum(length(line)) as n, arg_min(length(line), ord) as k, max(length(line)) as most, arg_max(length(line), ord) as last, count(*) as lines from fasta where ord%100<>0 group by 1) b on b.head=h.ord""")
def fasta_index(spark, sf_dir):
    """The offset index of a FASTA whose lines come in parts of 500."""
    lines = view(spark, sf_dir, "fasta").withColumn("ord", F.shiftleft(F.expr("ord div 500"), text.PART_BITS) + F.col("ord") % 500)
    return fasta.built(lines, 1).select("contig_idx", "contig", "length", F.col("offset").alias("start"), "line_bases", "even")


@query("""select cast(row_number() over (order by h.ord)-1 as bigint) as contig_idx, 'c'||cast(h.ord as string) as contig, cast(sum(length(f.line)) as bigint) as length
  from fasta h join fasta f on f.ord>h.ord and f.ord<h.ord+100 where h.ord%100=0 group by h.ord""")
def fasta_contigs(spark, sf_dir):
    return contig_table(text.fasta_blocks(view(spark, sf_dir, "fasta"))).select(F.col("contig_idx").cast("bigint").alias("contig_idx"), "contig", "length")


@query("""select 'c'||cast(h%7 as string) as t_chrom, cast(h*3+o as bigint) as t_start, cast(h*3+o+size as bigint) as t_end, cast(h+1 as bigint) as chain_id, cast(1000+h as bigint) as score, 'q'||cast(h%5 as string) as q_chrom, cast(h*2+oq as bigint) as q_start, cast(h*2+oq+size as bigint) as q_end, cast(95000 as bigint) as q_size, case when h%20=0 then '+' else '-' end as q_strand from (
  select x.ord, x.ord-x.ord%10 as h, any_value(cast(split_part(x.line,' ',1) as bigint)) as size, coalesce(sum(cast(split_part(y.line,' ',1) as bigint)+y.ord%6),0) as o, coalesce(sum(cast(split_part(y.line,' ',1) as bigint)+y.ord%4),0) as oq
  from chain_text x left join chain_text y on y.ord<x.ord and y.ord>x.ord-x.ord%10 where x.ord%10<>0 group by x.ord)""")
def chain_blocks(spark, sf_dir):
    out = text.chain_blocks(view(spark, sf_dir, "chain_text"))
    return out.withColumn("chain_id", F.col("chain_id").cast("bigint"))


@query("select chrom, pos, ref, alt from (select *, row_number() over (partition by chrom, pos order by ord desc) as r from panel) where r=1")
def panel_sites(spark, sf_dir):
    return text.panel_sites(view(spark, sf_dir, "panel")).select("chrom", "pos", "ref", joined("alts").alias("alt"))


@query("select rid, chrom, pos from calls where rid < 100")
def limit_records(spark, sf_dir):
    return infer.first_rows(view(spark, sf_dir, "calls"), 100).select("rid", "chrom", "pos")


# --- scalar functions --------------------------------------------------------------------------------------------------


@query(f"select rid, array_to_string({_PARSE.format('genotype')}, ',') as alleles from calls")
def parse_genotype(spark, sf_dir):
    return view(spark, sf_dir, "calls").select("rid", joined(A.parse_genotype(F.col("genotype"))).alias("alleles"))


@query("select rid, " + "||".join("case substr(ref||alt,{0},1) when 'A' then 'T' when 'C' then 'G' when 'G' then 'C' when 'T' then 'A' else substr(ref||alt,{0},1) end".format(i) for i in range(1, 8)) + " as comp from sites")
def complement(spark, sf_dir):
    return view(spark, sf_dir, "sites").select("rid", A.complement(F.concat("ref", "alt")).alias("comp"))


@query("select rid, " + "||".join("case substr(ref||alt,{0},1) when 'A' then 'T' when 'C' then 'G' when 'G' then 'C' when 'T' then 'A' else substr(ref||alt,{0},1) end".format(i) for i in range(7, 0, -1)) + " as rc from sites")
def revcomp(spark, sf_dir):
    return view(spark, sf_dir, "sites").select("rid", A.revcomp(F.concat("ref", "alt")).alias("rc"))


@query(f"select chrom, {_KEY.format('chrom')} as key from names")
def canonical_contig(spark, sf_dir):
    return view(spark, sf_dir, "names").select("chrom", A.canonical_contig(F.col("chrom")).alias("key"))


@query("select chrom, case when regexp_replace(upper(chrom),'^CHR','') in ('X','23','25','PAR','PSEUDOAUTOSOMAL') then 'X' when regexp_replace(upper(chrom),'^CHR','') in ('Y','24') then 'Y' else 'autosome' end as class from names")
def chrom_class(spark, sf_dir):
    return view(spark, sf_dir, "names").select("chrom", A.chrom_class(F.col("chrom")).alias("class"))


@query()
def natural_order(spark, sf_dir):
    n = A.natural_order(F.col("chrom"))
    return numbered(view(spark, sf_dir, "names").select("chrom"), [n["rank"], n["tail"], F.col("chrom")], "place")


ORACLES["natural_order"] = f"""with names as ({VIEWS["names"]}), n as (select chrom, regexp_replace(regexp_replace(regexp_replace(chrom,'^(chr)+',''),'^(Chr)+',''),'^(CHR)+','') as b from names),
  k as (select chrom, b, coalesce(case when regexp_full_match(b,'[0-9]+') then cast(b as bigint) end, case b when 'X' then 23 when 'Y' then 24 when 'M' then 25 when 'MT' then 25 end) as r from n)
  select chrom, cast(row_number() over (order by coalesce(r,1000), case when r is null then b else '' end, chrom) as bigint) as place from k"""


@query("select rid, cast(case when 'A'=upper(ref) then 0 when upper(split_part(alt,',',1))='A' then 1 when upper(split_part(alt,',',2))='A' then 2 end as bigint) as idx from sites")
def allele_index(spark, sf_dir):
    return view(spark, sf_dir, "sites").select("rid", A.allele_index(F.lit("a"), F.col("ref"), F.col("alts")).alias("idx"))


@query(f"select rid, {_PAR38.format('k', 'p')} as par from (select rid, {_KEY.format('chrom')} as k, pos*170 as p from calls)")
def is_par(spark, sf_dir):
    return view(spark, sf_dir, "calls").select("rid", A.is_par(A.canonical_contig(F.col("chrom")), F.col("pos") * 170, "GRCh38").alias("par"))


@query(f"select rid, {_PLOIDY} as ploidy from (select *, {_PAR38.format('k', 'p')} as par from (select rid, {_KEY.format('chrom')} as k, pos*170 as p, case rid%3 when 0 then 'male' when 1 then 'female' else 'unknown' end as sex from calls))")
def ploidy(spark, sf_dir):
    sex = F.when(F.col("rid") % 3 == 0, "male").when(F.col("rid") % 3 == 1, "female").otherwise("unknown")
    return view(spark, sf_dir, "calls").select("rid", A.ploidy(F.col("chrom"), F.col("pos") * 170, sex, "GRCh38").alias("ploidy"))


@query(f"select rid, case when len(c)>0 and len(list_filter(c, lambda x: x<>c[1]))=0 then c[1] else 'MIS' end as allele from (select rid, list_filter({_PARSE.format('genotype')}, lambda x: x<>'MIS') as c from calls)")
def haploid_collapse(spark, sf_dir):
    return view(spark, sf_dir, "calls").select("rid", F.get(A.haploid_collapse(A.parse_genotype(F.col("genotype"))), F.lit(0)).alias("allele"))


@query("""select rid, not regexp_matches(u,'[-IDN<>.]') and regexp_matches(u,'[ACGT]') and not (contains(u,'A') and contains(u,'T')) and not (contains(u,'C') and contains(u,'G')) as informative from (select rid, upper(genotype) as u from calls)""")
def informative_snp(spark, sf_dir):
    return view(spark, sf_dir, "calls").select("rid", A.informative_snp(F.col("genotype")).alias("informative"))


@query(f"select rid, len(a)=2 and not list_contains(a,'MIS') and upper(a[1])<>upper(a[2]) as het from (select rid, {_PARSE.format('genotype')} as a from calls)")
def het_flag(spark, sf_dir):
    return view(spark, sf_dir, "calls").select("rid", A.het_flag(F.col("genotype")).alias("het"))


@query("select rid, case gt when '0/1' then true when '1/2' then true when './.' then null else false end as het from sites")
def het_flag_vcf(spark, sf_dir):
    return view(spark, sf_dir, "sites").select("rid", A.het_flag_vcf(F.col("gt")).alias("het"))


@query("select rid, (substr(ref,1,1)='A' and substr(alt,1,1)='T') or (substr(ref,1,1)='T' and substr(alt,1,1)='A') or (substr(ref,1,1)='C' and substr(alt,1,1)='G') or (substr(ref,1,1)='G' and substr(alt,1,1)='C') as ambiguous from sites")
def ambiguous_snp(spark, sf_dir):
    return view(spark, sf_dir, "sites").select("rid", A.ambiguous_snp(F.substring("ref", 1, 1), F.substring("alt", 1, 1)).alias("ambiguous"))


@query("select rid, case when length(ref)=1 and length(split_part(alt,',',1))=1 then 'snp' else 'indel' end as class from sites")
def lift_class(spark, sf_dir):
    return view(spark, sf_dir, "sites").select("rid", A.lift_class(F.col("ref"), F.col("alts")).alias("class"))


@query("select rid, chrom||':'||cast(pos as string)||':'||ref||':'||alt as id from sites")
def synthetic_id(spark, sf_dir):
    return view(spark, sf_dir, "sites").select("rid", A.synthetic_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alts")).alias("id"))


@query("select rid, case gt when '0/1' then '1/0' when '1|1' then '0|0' when '0' then '1' when '1/2' then '0/12' when '0|0' then '1|1' else gt end as gt from sites")
def gt_remap(spark, sf_dir):
    return view(spark, sf_dir, "sites").select("rid", A.gt_remap(F.col("gt"), F.expr("map(0, 1, 1, 0, 2, 12)")).alias("gt"))


@query("select rid, 'GT='||gt||';DP=7' as fields from sites")
def format_prune(spark, sf_dir):
    kept = A.prune_format(F.create_map(F.lit("GT"), F.col("gt"), F.lit("PL"), F.lit("1,2"), F.lit("DP"), F.lit("7")))
    return view(spark, sf_dir, "sites").select("rid", F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("fields"))


@query("select rid, cast(cast(pos as bigint) as string) as mq, case when rid%2=0 then '.' else 'x' end as other from sites")
def normalize_fields(spark, sf_dir):
    done = A.normalise_format(F.create_map(F.lit("MQ"), F.concat(F.col("pos").cast("string"), F.lit(".75")), F.lit("XX"), F.when(F.col("rid") % 2 == 0, "").otherwise("x")))
    return view(spark, sf_dir, "sites").select("rid", done["MQ"].alias("mq"), done["XX"].alias("other"))


# --- conversion --------------------------------------------------------------------------------------------------------


def _chain_sql(sex: str, tail: str) -> str:
    return f"with calls as ({VIEWS['calls']}), {_variants(sex)} {tail}"


@query()
def contig_resolve(spark, sf_dir):
    contigs, _ = genome(spark)
    return resolve_contig(view(spark, sf_dir, "calls"), contigs).select("rid", "contig")


ORACLES["contig_resolve"] = f"with calls as ({VIEWS['calls']}) select rid, case when {_KNOWN.format('chrom')} then {_KEY.format('chrom')} end as contig from calls"


@query()
def ref_base(spark, sf_dir):
    contigs, blocks = genome(spark)
    return reference_base(resolve_contig(view(spark, sf_dir, "calls"), contigs), blocks).select("rid", "ref_base")


ORACLES["ref_base"] = f"with calls as ({VIEWS['calls']}) select rid, case when {_KNOWN.format('chrom')} then {_REF.format('pos')} end as ref_base from calls"


@query()
def dtc_to_variant(spark, sf_dir):
    return dtc(spark, sf_dir, "male").where("reason is null").select("rid", "contig", "pos", "ref", joined("alts").alias("alt"), "gt")


ORACLES["dtc_to_variant"] = _chain_sql("male", "select rid, k as contig, pos, ref, array_to_string(alts,',') as alt, gt0 as gt from w where reason is null")


@query()
def alt_alleles(spark, sf_dir):
    return dtc(spark, sf_dir).where("ref is not null and contig is not null").select("rid", joined("alts").alias("alt"))


ORACLES["alt_alleles"] = _chain_sql("female", "select rid, array_to_string(alts,',') as alt from w where known and ref is not null")


@query()
def symbolic_info(spark, sf_dir):
    return dtc(spark, sf_dir).where("reason is null").select("rid", joined("symbolic").alias("alt"), "info")


ORACLES["symbolic_info"] = _chain_sql("female", "select rid, array_to_string(list_transform(alts, lambda x: case x when 'DEL' then '<DEL>' when 'INS' then '<INS>' else x end),',') as alt, case when list_contains(alts,'DEL') and list_contains(alts,'INS') then 'IMPRECISE;SVTYPE=COMPLEX' when list_contains(alts,'DEL') then 'IMPRECISE;SVTYPE=DEL' when list_contains(alts,'INS') then 'IMPRECISE;SVTYPE=INS' else '.' end as info from w where reason is null")


@query()
def gt_format(spark, sf_dir):
    return dtc(spark, sf_dir).where("contig is not null and ref is not null").select("rid", "gt")


ORACLES["gt_format"] = _chain_sql("female", "select rid, gt0 as gt from w where known and ref is not null")


@query()
def unknown_contig(spark, sf_dir):
    return dtc(spark, sf_dir).where("reason = 'unknown_chromosomes'").select("rid", "chrom")


ORACLES["unknown_contig"] = f"with calls as ({VIEWS['calls']}) select rid, chrom from calls where not {_KNOWN.format('chrom')}"


@query()
def variants_only(spark, sf_dir):
    return dtc(spark, sf_dir, variants_only=True).where("reason is null").select("rid", joined("alts").alias("alt"))


ORACLES["variants_only"] = _chain_sql("female", "select rid, array_to_string(alts,',') as alt from w where reason is null and len(alts)>0")


@query()
def drop_reasons(spark, sf_dir):
    return dtc(spark, sf_dir).where("reason is not null").select("rid", "reason")


ORACLES["drop_reasons"] = _chain_sql("female", "select rid, reason from w where reason is not null")


@query()
def summary(spark, sf_dir):
    return convert.summary(dtc(spark, sf_dir))


ORACLES["summary"] = _chain_sql("female", "select coalesce(reason, case when len(alts)>0 then 'variant_records' else 'reference_records' end) as reason, count(*) as n from w group by 1")


@query()
def vcf_lines(spark, sf_dir):
    rows = dtc(spark, sf_dir).where("reason is null").withColumn("chrom", F.col("contig"))
    keys = convert.order_keys()
    return numbered(vcf.body(rows).select("chrom", "pos", "ord", "line"), keys, "place", [F.col("chrom")]).select("place", "line")


ORACLES["vcf_lines"] = _chain_sql("female", """select cast(row_number() over (partition by k order by pos, rid) as bigint) as place, k||chr(9)||cast(pos as string)||chr(9)||id||chr(9)||ref||chr(9)||case when len(alts)=0 then '.' else array_to_string(list_transform(alts, lambda x: case x when 'DEL' then '<DEL>' when 'INS' then '<INS>' else x end),',') end||chr(9)||'.'||chr(9)||'.'||chr(9)||
  case when list_contains(alts,'DEL') and list_contains(alts,'INS') then 'IMPRECISE;SVTYPE=COMPLEX' when list_contains(alts,'DEL') then 'IMPRECISE;SVTYPE=DEL' when list_contains(alts,'INS') then 'IMPRECISE;SVTYPE=INS' else '.' end||chr(9)||'GT'||chr(9)||gt0 as line from w where reason is null""")


@query()
def sort_variants(spark, sf_dir):
    rows = view(spark, sf_dir, "sites").where("chrom not like '%Un1'")
    return numbered(rows.select("rid", "chrom", "pos", "ord"), convert.order_keys(), "place").select("rid", "place")


ORACLES["sort_variants"] = f"with sites as ({VIEWS['sites']}) select rid, cast(row_number() over (order by case replace(chrom,'chr','') when 'X' then 23 when 'Y' then 24 when 'MT' then 25 else try_cast(replace(chrom,'chr','') as int) end, pos, ord) as bigint) as place from sites where chrom not like '%Un1'"


def _polarized(spark, sf_dir):
    contigs, blocks = genome(spark)
    return convert.polarize(reference_base(resolve_contig(view(spark, sf_dir, "sites"), contigs), blocks), sex="female")


_POLAR = f"""a as (select *, {_KEY.format("chrom")} as k, {_KNOWN.format("chrom")} as known, {_REF.format("pos")} as b, split_part(alt,',',1) as a1, split_part(alt,',',2) as a2 from sites),
  p as (select *, case when not known then 'unknown_chromosomes' when b is null then 'reference_failures' when length(ref)>1 and substr(ref,1,1)<>b then 'anchor_mismatch' when k='Y' then 'ploidy_zero' end as reason, case when length(ref)=1 and ref<>b and a1=b then 1 when length(ref)=1 and ref<>b and a2=b then 2 else 0 end as s from a)"""


@query()
def polarize(spark, sf_dir):
    return _polarized(spark, sf_dir).where("reason is null").select("rid", "ref", joined("alts").alias("alt"), "gt", "id")


ORACLES["polarize"] = f"""with sites as ({VIEWS["sites"]}), {_POLAR}, q as (select rid, k, pos, case when s>0 then b else ref end as ref,
  case s when 1 then ref||case when a2<>'' then ','||a2 else '' end when 2 then ref||','||a1 else alt end as alt,
  case s when 1 then case gt when '0/1' then '1/0' when '1|1' then '0|0' when '0' then '1' when '1/2' then '0/2' when '0|0' then '1|1' else gt end
         when 2 then case gt when '0/1' then '1/2' when '1|1' then '2|2' when '0' then '1' when '1/2' then '2/0' when '0|0' then '1|1' else gt end else gt end as gt from p where reason is null)
  select rid, ref, alt, gt, k||':'||cast(pos as string)||':'||ref||':'||alt as id from q"""


@query()
def indel_anchor(spark, sf_dir):
    return _polarized(spark, sf_dir).where("reason = 'anchor_mismatch'").select("rid", "ref", "ref_base")


ORACLES["indel_anchor"] = f"with sites as ({VIEWS['sites']}), {_POLAR} select rid, ref, b as ref_base from p where reason='anchor_mismatch'"


# --- lifting -----------------------------------------------------------------------------------------------------------

_LIFT = """(select {q}.rid as rid, coalesce(case when count(c.block_id)=0 then 'unmapped' when count(distinct case when c.score=m.score then c.chain_id end)>1 then 'ambiguous' end, 'lifted') as status,
  arg_min(c.q_chrom, row(c.t_start,c.t_end,c.q_chrom)) filter (c.score=m.score) as q_chrom, arg_min(case when c.q_strand='+' then c.q_start+{q}.p-c.t_start else c.q_size-1-(c.q_start+{q}.p-c.t_start) end, row(c.t_start,c.t_end,c.q_chrom)) filter (c.score=m.score) as q_pos, arg_min(c.q_strand, row(c.t_start,c.t_end,c.q_chrom)) filter (c.score=m.score) as q_strand
  from {q} left join chain c on {q}.c=c.t_chrom and {q}.p>=c.t_start and {q}.p<c.t_end left join (select {q}.rid as rid, max(score) as score from {q} join chain c on {q}.c=c.t_chrom and {q}.p>=c.t_start and {q}.p<c.t_end group by {q}.rid) m on m.rid={q}.rid group by {q}.rid)"""


@query()
def lift_point(spark, sf_dir):
    calls = view(spark, sf_dir, "calls").select("rid", "chrom", (F.col("pos") - 1).alias("pos"))
    return lift.lift_point(calls, view(spark, sf_dir, "chain"))


ORACLES["lift_point"] = f"""with calls as ({VIEWS["calls"]}), chain as ({VIEWS["chain"]}), asks as (select rid, replace(chrom,'chr','') as c, pos-1 as p from calls), l as {_LIFT.format(q="asks")}
  select rid, status, case when status='lifted' then q_chrom end as q_chrom, case when status='lifted' then q_pos end as q_pos, case when status='lifted' then q_strand end as q_strand from l"""


@query()
def lift_indel(spark, sf_dir):
    rows = view(spark, sf_dir, "sites").select("rid", "chrom", (F.col("pos") - 1).alias("pos"), (F.col("rid") % 40 + 1).alias("length"))
    return lift.lift_span(rows, view(spark, sf_dir, "chain")).select("rid", "status", "q_chrom", "q_pos")


ORACLES["lift_indel"] = f"""with sites as ({VIEWS["sites"]}), chain as ({VIEWS["chain"]}), s1 as (select rid, replace(chrom,'chr','') as c, pos-1 as p from sites), s2 as (select rid, replace(chrom,'chr','') as c, pos-1+rid%40 as p from sites),
  l1 as {_LIFT.format(q="s1")}, l2 as {_LIFT.format(q="s2")},
  j as (select l1.rid, case when l1.status<>'lifted' then l1.status when l2.status='lifted' and l1.q_chrom=l2.q_chrom and l1.q_strand=l2.q_strand and abs(l1.q_pos-l2.q_pos)=l1.rid%40 then 'lifted' else 'straddled' end as status, l1.q_chrom as c, case when l1.q_strand='+' then l1.q_pos else l2.q_pos end as p from l1 join l2 on l1.rid=l2.rid)
  select rid, status, case when status='lifted' then c end as q_chrom, case when status='lifted' then p end as q_pos from j"""


@query()
def liftover(spark, sf_dir):
    contigs, blocks = genome(spark)
    rows = view(spark, sf_dir, "sites").where("length(ref) = 1 and length(alt) = 1").select("rid", "chrom", "pos", F.when(F.col("rid") % 7 == 0, "N").otherwise(F.col("ref")).alias("ref"), "alts", "gt")
    return lift.liftover(rows, view(spark, sf_dir, "chain"), contigs, blocks).select("rid", "chrom", "pos", "ref", joined("alts").alias("alt"), "gt", "reason")


ORACLES["liftover"] = f"""with sites as ({VIEWS["sites"]}), chain as ({VIEWS["chain"]}), s as (select rid, chrom, pos, case when rid%7=0 then 'N' else ref end as ref, alt, gt from sites where length(ref)=1 and length(alt)=1), asks as (select rid, replace(chrom,'chr','') as c, pos-1 as p from s), l as {_LIFT.format(q="asks")},
  t as (select s.rid, l.status, l.q_chrom as c, l.q_pos+1 as p, case when l.q_strand='-' then {_COMP.format("s.ref")} else s.ref end as r, case when l.q_strand='-' then {_COMP.format("s.alt")} else s.alt end as a, s.gt, {_REF.format("(l.q_pos+1)")} as b from s join l on s.rid=l.rid),
  u as (select *, case when status<>'lifted' then 'liftover_'||status when b is null then 'reference_failures' when r<>'N' and r<>b and a<>b then 'liftover_incompatible' end as reason from t)
  select rid, case when reason is null then c end as chrom, case when reason is null then p end as pos, case when reason is null then b end as ref,
  case when reason is null then case when r='N' then case when a=b then '' else a end when r=b then a else r end end as alt,
  case when reason is null then case when r='N' and a=b then replace(gt,'1','0') when r='N' or r=b then gt else translate(gt,'01','10') end end as gt, reason from u"""


@query()
def liftover_alts(spark, sf_dir):
    """Sites of two one-base ALTs: any of them can be the base of the other build."""
    contigs, blocks = genome(spark)
    rows = view(spark, sf_dir, "sites").where("length(ref) = 1 and alt rlike '^[ACGT],[ACGT]$'").select("rid", "chrom", "pos", F.when(F.col("rid") % 5 == 0, "N").otherwise(F.col("ref")).alias("ref"), "alts", "gt")
    return lift.liftover(rows, view(spark, sf_dir, "chain"), contigs, blocks).select("rid", "chrom", "pos", "ref", joined("alts").alias("alt"), "gt", "reason")


ORACLES["liftover_alts"] = f"""with sites as ({VIEWS["sites"]}), chain as ({VIEWS["chain"]}), s as (select rid, chrom, pos, case when rid%5=0 then 'N' else ref end as ref, split_part(alt,',',1) as x, split_part(alt,',',2) as y, gt from sites where length(ref)=1 and regexp_full_match(alt,'[ACGT],[ACGT]')),
  asks as (select rid, replace(chrom,'chr','') as c, pos-1 as p from s), l as {_LIFT.format(q="asks")},
  t as (select s.rid, l.status, l.q_chrom as c, l.q_pos+1 as p, s.gt, {_REF.format("(l.q_pos+1)")} as b, {", ".join(f"case when l.q_strand='-' then {_COMP.format('s.' + k)} else s.{k} end as {k}" for k in ("ref", "x", "y"))} from s join l on s.rid=l.rid),
  u as (select *, case when status<>'lifted' then 'liftover_'||status when b is null then 'reference_failures' when ref<>'N' and ref<>b and x<>b and y<>b then 'liftover_incompatible' end as reason,
    case when ref='N' then case when x=b then '001' when y=b then '010' else '012' end when ref=b then '012' when x=b then '102' else '120' end as places,
    case when ref='N' then case when x=b then y when y=b then x else x||','||y end when ref=b then x||','||y when x=b then ref||','||y else ref||','||x end as made from t)
  select rid, case when reason is null then c end as chrom, case when reason is null then p end as pos, case when reason is null then b end as ref, case when reason is null then made end as alt,
  case when reason is null then translate(gt,'012',places) end as gt, reason from u"""


# --- panel -------------------------------------------------------------------------------------------------------------


def _asked(spark, sf_dir):
    sites = text.panel_sites(view(spark, sf_dir, "panel"))
    return panel.harmonize(panel.panel_join(view(spark, sf_dir, "asked"), sites)), sites


_PANEL = f"""pn as (select chrom, pos, ref, alt from (select *, row_number() over (partition by chrom, pos order by ord desc) as r from panel) where r=1),
  hj as (select s.*, coalesce(e.chrom,o.chrom) as pc, coalesce(e.ref,o.ref) as pr, coalesce(e.alt,o.alt) as pa from asked s left join pn e on e.chrom=s.chrom and e.pos=s.pos left join pn o on o.chrom='chr'||s.chrom and o.pos=s.pos),
  h as (select *, case when pa is null or list_contains(string_split(pa,','),alt) then alt when list_contains(string_split(pa,','),{_COMP.format("alt")}) and {_COMP.format("alt")}<>pr then {_COMP.format("alt")} else alt end as a2 from hj),
  fr as (select *, coalesce(pc,chrom) as sc, coalesce(pr, first_value(ref) over (partition by coalesce(pc,chrom), pos order by ord)) as sr from h)"""


@query()
def panel_join(spark, sf_dir):
    return panel.panel_join(view(spark, sf_dir, "asked"), text.panel_sites(view(spark, sf_dir, "panel"))).select("rid", "panel_chrom", "panel_ref", joined("panel_alts").alias("panel_alt"))


ORACLES["panel_join"] = f"with asked as ({VIEWS['asked']}), panel as ({VIEWS['panel']}), {_PANEL} select rid, pc as panel_chrom, pr as panel_ref, pa as panel_alt from hj"


@query()
def harmonize(spark, sf_dir):
    return _asked(spark, sf_dir)[0].select("rid", joined("alleles").alias("alleles"))


ORACLES["harmonize"] = f"with asked as ({VIEWS['asked']}), panel as ({VIEWS['panel']}), {_PANEL} select rid, ref||','||a2 as alleles from h"


def _indexed(spark, sf_dir):
    rows, sites = _asked(spark, sf_dir)
    return panel.panel_alt_index(rows, [F.col("ord")]), sites


#: Novel alleles of a site in the order of their first row, REF before ALT within a row.
_NOVEL = f"""{_PANEL}, al as (select rid, ord, sc, pos, sr, pa, 0 as i, ref as a from fr union all select rid, ord, sc, pos, sr, pa, 1, a2 from fr),
  nv as (select sc, pos, a, min(ord*2+i) as place from al where a<>sr and (pa is null or not list_contains(string_split(pa,','),a)) group by sc, pos, a),
  rk as (select *, row_number() over (partition by sc, pos order by place) as r from nv)"""


@query()
def panel_alt_index(spark, sf_dir):
    return _indexed(spark, sf_dir)[0].select("rid", F.get("indices", F.lit(0)).cast("bigint").alias("ref_index"), F.get("indices", F.lit(1)).cast("bigint").alias("alt_index"))


_INDEX = "case when {0}=fr.sr then 0 when fr.pa is not null and list_contains(string_split(fr.pa,','),{0}) then list_position(string_split(fr.pa,','),{0}) else coalesce(len(string_split(fr.pa,',')),0)+{1}.r end"
ORACLES["panel_alt_index"] = f"""with asked as ({VIEWS["asked"]}), panel as ({VIEWS["panel"]}), {_NOVEL} select fr.rid, cast({_INDEX.format("fr.ref", "k0")} as bigint) as ref_index, cast({_INDEX.format("fr.a2", "k1")} as bigint) as alt_index
  from fr left join rk k0 on k0.sc=fr.sc and k0.pos=fr.pos and k0.a=fr.ref left join rk k1 on k1.sc=fr.sc and k1.pos=fr.pos and k1.a=fr.a2"""


@query()
def panel_inject(spark, sf_dir):
    return panel.inject(_indexed(spark, sf_dir)[0]).where("injected").select("rid", joined("alts").alias("alt"), "gt")


ORACLES["panel_inject"] = f"""with asked as ({VIEWS["asked"]}), panel as ({VIEWS["panel"]}), {_NOVEL} select fr.rid, fr.pa||coalesce((select string_agg(','||k.a, '' order by k.place) from rk k where k.sc=fr.sc and k.pos=fr.pos and k.place<=fr.ord*2+1),'') as alt,
  cast({_INDEX.format("fr.ref", "k0")} as string)||'/'||cast({_INDEX.format("fr.a2", "k1")} as string) as gt from fr left join rk k0 on k0.sc=fr.sc and k0.pos=fr.pos and k0.a=fr.ref left join rk k1 on k1.sc=fr.sc and k1.pos=fr.pos and k1.a=fr.a2 where length(fr.pr)=length(fr.ref) and not regexp_matches(fr.pa,'[ACGT][ACGT]')"""


def _padded(spark, sf_dir):
    indexed, sites = _indexed(spark, sf_dir)
    return panel.padded(sites, indexed)


_PADDED = f"""{_NOVEL}, add as (select sc, pos, string_agg(a, ',' order by place) as more from rk group by sc, pos),
  pp as (select pn.chrom, pn.pos, pn.ref, pn.alt||coalesce(','||add.more,'') as alt, case when add.more is null then 'original' else 'modified' end as kind from pn left join add on add.sc=pn.chrom and add.pos=pn.pos
  union all select distinct fr.sc, fr.pos, fr.sr, coalesce(add.more,''), 'novel' from fr left join add on add.sc=fr.sc and add.pos=fr.pos where fr.pc is null)"""


@query()
def panel_padded(spark, sf_dir):
    return _padded(spark, sf_dir).select("chrom", "pos", "ref", joined("alts").alias("alt"), "kind")


ORACLES["panel_padded"] = f"with asked as ({VIEWS['asked']}), panel as ({VIEWS['panel']}), {_PADDED} select chrom, pos, ref, alt, kind from pp"


@query()
def panel_counts(spark, sf_dir):
    return panel.panel_counts(_padded(spark, sf_dir))


ORACLES["panel_counts"] = f"with asked as ({VIEWS['asked']}), panel as ({VIEWS['panel']}), {_PADDED} select count(*) filter (kind='modified') as modified, count(*) filter (kind='novel') as novel, count(*) as total from pp"


@query()
def panel_records(spark, sf_dir):
    """The grown panel as lines: its own records with added ALTs, and new sites."""
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.concat(F.lit("rs"), F.col("ord").cast("string")), "ref", "alt", F.lit("30"), F.lit("PASS"), F.lit("AF=0.5"))
    return panel_sink.grown_lines(view(spark, sf_dir, "panel").select("ord", line.alias("line")), _padded(spark, sf_dir), []).select("ord", "line")


ORACLES["panel_records"] = f"""with asked as ({VIEWS["asked"]}), panel as ({VIEWS["panel"]}), {_PADDED}
  select ord, concat_ws(chr(9), panel.chrom, panel.pos, 'rs'||ord, panel.ref, panel.alt||coalesce(','||add.more,''), '30', 'PASS', 'AF=0.5') as line from panel left join add on add.sc=panel.chrom and add.pos=panel.pos
  union all select -1, concat_ws(chr(9), chrom, pos, chrom||':'||pos||':'||ref||':'||case when alt='' then '.' else alt end, ref, case when alt='' then '.' else alt end, '.', '.', '.') from pp where kind='novel'"""


# --- inference ---------------------------------------------------------------------------------------------------------


@query()
def build_detect(spark, sf_dir):
    contigs, blocks = genome(spark)
    other = blocks.withColumn("seq", F.expr("repeat('CGTA', 256)"))
    rows = infer.first_rows(view(spark, sf_dir, "calls").where(F.col("chrom").rlike("^(chr)?[0-9]+$") & F.col("genotype").rlike("^(AA|CC|GG|TT)$")), infer.BUILD_ROWS)
    rates = infer.build_rates(rows.withColumn("base", F.substring("genotype", 1, 1)), {"GRCh37": (contigs, blocks), "GRCh38": (contigs, other)})
    return rates.select("build", "matches", "looked_up", F.round("rate", 6).alias("rate"))


_FIRST = "r as (select chrom, pos, substr(genotype,1,1) as g from calls where regexp_full_match(chrom,'(chr)?[0-9]+') and genotype in ('AA','CC','GG','TT') order by ord limit 1000)"
ORACLES["build_detect"] = f"""with calls as ({VIEWS["calls"]}), {_FIRST}, x as (select 'GRCh37' as build, g, {_REF.format("pos")} as b from r union all select 'GRCh38', g, {_REF.format("pos")[:-4].replace("'ACGT'", "'CGTA'")} end from r)
  select build, count(*) filter (g=b) as matches, count(b) as looked_up, round(100.0*count(*) filter (g=b)/nullif(count(b),0),6) as rate from x group by build"""


@query()
def build_calls(spark, sf_dir):
    return infer.build_calls(view(spark, sf_dir, "calls")).select("rid", "base")


ORACLES["build_calls"] = f"""with calls as ({VIEWS["calls"]}), f as (select * from calls order by ord limit 5000)
  select rid, upper(substr(genotype,1,1)) as base from f where regexp_full_match(upper(genotype),'AA?|CC?|GG?|TT?') and upper(chrom) not in ('X','Y','CHRX','CHRY','MT','CHRM') order by ord limit 1000"""


@query()
def build_sites(spark, sf_dir):
    return infer.build_sites(view(spark, sf_dir, "sites")).select("rid", "base")


ORACLES["build_sites"] = f"with sites as ({VIEWS['sites']}) select rid, ref as base from sites where ref in ('A','C','G','T') and pos>0 and upper(chrom) not in ('X','Y','CHRX','CHRY','MT','CHRM') order by ord limit 1000"


@query()
def sex_counts(spark, sf_dir):
    return infer.sex_counts(view(spark, sf_dir, "calls"), "GRCh38")


ORACLES["sex_counts"] = f"""with calls as ({VIEWS["calls"]}), x as (select case when replace(chrom,'chr','')='X' then 'X' when replace(chrom,'chr','')='Y' then 'Y' else 'autosome' end as c, genotype<>'--' as called, pos between 10001 and 2781479 as par, coalesce(len(a)=2 and not list_contains(a,'MIS') and upper(a[1])<>upper(a[2]),false) as het from (select *, {_PARSE.format("genotype")} as a from calls))
  select count(*) filter (c='autosome') as autosome, count(*) filter (c='autosome' and called) as autosome_called, count(*) filter (c='autosome' and het) as autosome_het, count(*) filter (c='X') as x, count(*) filter (c='X' and het) as x_het, count(*) filter (c='Y' and not par) as y, count(*) filter (c='Y' and not par and called) as y_called from x"""


@query()
def strand_lock(spark, sf_dir):
    contigs, blocks = genome(spark)
    return infer.strand_votes(view(spark, sf_dir, "calls"), contigs, blocks)


ORACLES["strand_lock"] = f"""with calls as ({VIEWS["calls"]}), i as (select ord, {_REF.format("pos")} as b, list_transform(list_filter({_PARSE.format("genotype")}, lambda x: x like 'B:%'), lambda x: upper(substr(x,3,1))) as f from calls where {_KNOWN.format("chrom")} and not regexp_matches(upper(genotype),'[-IDN<>.]') and regexp_matches(upper(genotype),'[ACGT]') and not (contains(upper(genotype),'A') and contains(upper(genotype),'T')) and not (contains(upper(genotype),'C') and contains(upper(genotype),'G'))),
  d as (select ord, list_contains(f,b) as p, list_contains(f,{_COMP.format("b")}) as m from i where b is not null), e as (select * from d where p<>m order by ord limit 2000) select count(*) filter (p) as plus, count(*) filter (m) as minus from e"""


# --- PLINK -------------------------------------------------------------------------------------------------------------


def _plink_rows(spark, sf_dir):
    ids = F.when(F.col("rid") % 2 == 0, F.array(F.concat(F.lit("rs"), F.col("rid").cast("string")))).otherwise(F.array().cast("array<string>"))
    return spread(view(spark, sf_dir, "sites")).withColumn("ids", ids).withColumn("gts", F.array("gt", F.lit("0/1"), F.lit("1/1"), F.lit("."), F.lit("2/1"), F.lit("0")))


@query()
def plink_bim(spark, sf_dir):
    return plink.bim(_plink_rows(spark, sf_dir)).select("ord", "chrom", "id", F.col("cm").cast("bigint").alias("cm"), "pos", "allele1", "allele2")


_SPLIT = "x as (select *, case when contains(alt,',') then '_ALT1' else '' end as sfx, split_part(alt,',',1) as a, 1 as n from sites union all select *, '_ALT2', split_part(alt,',',2), 2 from sites where contains(alt,','))"
ORACLES["plink_bim"] = f"with sites as ({VIEWS['sites']}), {_SPLIT} select ord, chrom, case when rid%2=0 then 'rs'||cast(rid as string) when sfx='' then '.' else chrom||':'||cast(pos as string) end||sfx as id, cast(0 as bigint) as cm, pos, ref as allele1, a as allele2 from x"


@query()
def plink_bed(spark, sf_dir):
    return plink.bed(_plink_rows(spark, sf_dir)).select("ord", F.col("alt_no").cast("bigint").alias("alt_no"), F.col("byte_no").cast("bigint").alias("byte_no"), F.col("byte").cast("bigint").alias("byte"))


ORACLES["plink_bed"] = f"""with sites as ({VIEWS["sites"]}), {_SPLIT}, c as (select ord, n, case gt when './.' then 1 when '0' then 0 when '0|0' then 0 when '0/1' then case n when 1 then 2 else 0 end when '1|1' then case n when 1 then 3 else 0 end else 2 end as g from x)
  select ord, cast(n as bigint) as alt_no, cast(0 as bigint) as byte_no, cast(g + case n when 1 then 8+48+64 else 0+0+64 end as bigint) as byte from c union all select ord, cast(n as bigint), cast(1 as bigint), cast(case n when 1 then 2 else 2 end as bigint) from c"""


@query()
def plink_fam(spark, sf_dir):
    """The .fam rows of 40 samples, sex inferred from their calls."""
    calls = view(spark, sf_dir, "calls").withColumn("sample", F.concat(F.lit("s"), (F.col("rid") % 40).cast("string")))
    counts = infer.sex_counts(calls, "GRCh38", ["sample"])
    return plink.fam(counts.select("sample", infer.sex_of().alias("sex")))


ORACLES["plink_fam"] = f"""with calls as ({VIEWS["calls"]}), x as (select 's'||cast(rid%40 as varchar) as sample, case when replace(chrom,'chr','')='X' then 'X' when replace(chrom,'chr','')='Y' then 'Y' else 'autosome' end as c, genotype<>'--' as called, pos between 10001 and 2781479 as par, coalesce(len(a)=2 and not list_contains(a,'MIS') and upper(a[1])<>upper(a[2]),false) as het from (select *, {_PARSE.format("genotype")} as a from calls)),
  n as (select sample, count(*) filter (c='autosome') as a, count(*) filter (c='autosome' and called) as ac, count(*) filter (c='autosome' and het) as ah, count(*) filter (c='X') as x, count(*) filter (c='X' and het) as xh, count(*) filter (c='Y' and not par) as y, count(*) filter (c='Y' and not par and called) as yc from x group by 1),
  r as (select *, yc/greatest(y,1)/greatest(ac/a,1e-9) as dy, xh/greatest(x,1)/greatest(ah/a,1e-9) as rx from n)
  select sample as fid, sample as iid, '0' as father, '0' as mother, case when a=0 or x+y=0 then 0 when dy>=0.5 and rx<0.5 then 1 when dy<0.5 and rx>=0.5 then 2 else 0 end as sex, -9 as phenotype from r"""
