"""Harmonisation with a panel of known sites, and the panel grown by what it lacked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import alleles as A


def bare(name: str) -> F.Column:
    return A.without_chr(F.col(name))


def panel_join(rows: DataFrame, panel: DataFrame) -> DataFrame:
    """rows with panel_chrom, panel_ref, panel_alts: the site of the same name, else the one with or without chr."""
    sites = panel.select(F.col("chrom").alias("panel_chrom"), F.col("pos").alias("__pos"), F.col("ref").alias("panel_ref"), F.col("alts").alias("panel_alts"), bare("chrom").alias("__bare"))
    both = sites.groupBy("__bare", "__pos").agg(F.collect_list(F.struct("panel_chrom", "panel_ref", "panel_alts")).alias("__sites"))  # at most two spellings
    met = rows.withColumn("__b", bare("chrom")).join(both, (F.col("__b") == F.col("__bare")) & (F.col("pos") == F.col("__pos")), "left")
    chosen = F.coalesce(F.get(F.filter("__sites", lambda s: s["panel_chrom"] == F.col("chrom")), F.lit(0)), F.get("__sites", F.lit(0)))
    return met.withColumn("__s", chosen).select(*rows.columns, "__s.panel_chrom", "__s.panel_ref", "__s.panel_alts")


def harmonize(rows: DataFrame) -> DataFrame:
    """rows of panel_join with `alleles`: REF, then each ALT as it is, or complemented if only that is an ALT of the panel."""

    def rescued(a: F.Column) -> F.Column:
        up, comp = F.upper(a), A.complement_upper(F.upper(a))
        known = F.transform("panel_alts", F.upper)
        return F.when(F.col("panel_alts").isNull() | F.array_contains(known, up), up).when(F.array_contains(known, comp) & (comp != F.upper("panel_ref")), comp).otherwise(up)

    return rows.withColumn("alleles", F.concat(F.array(F.upper("ref")), F.transform("alts", rescued)))


def panel_alt_index(rows: DataFrame, order: list) -> DataFrame:
    """Rows of harmonize with merged_alts (panel ALTs and those added up to this row) and indices of its alleles among them.

    Alleles are added in row order. The first row of each (site, allele) is an aggregate, and so is the site's list of new alleles in
    that order; a row sees those whose first row isn't after it. No task needs the rows of a site together, and the work is rows
    times the different alleles of their site.
    """
    start = rows.withColumn("site_chrom", F.coalesce("panel_chrom", "chrom")).withColumn("__at", F.struct(*(F.col(c) if isinstance(c, str) else c for c in order)))
    up = lambda c: F.coalesce(F.transform(c, F.upper), F.array().cast("array<string>"))
    each = start.select("site_chrom", "pos", "__at", F.posexplode("alleles").alias("__i", "allele"))
    firsts = each.groupBy("site_chrom", "pos", "allele").agg(F.min(F.struct("__at", "__i")).alias("first"))
    new = firsts.groupBy("site_chrom", "pos").agg(F.array_sort(F.collect_list(F.struct("first", "allele"))).alias("__new"))
    heads = start.groupBy("site_chrom", "pos").agg(F.min_by("ref", "__at").alias("__first_ref"))
    sites = new.join(heads, new["site_chrom"].eqNullSafe(heads["site_chrom"]) & new["pos"].eqNullSafe(heads["pos"])).select(new["site_chrom"].alias("__c"), new["pos"].alias("__p"), "__new", "__first_ref")
    seen = start.join(sites, F.col("site_chrom").eqNullSafe(F.col("__c")) & F.col("pos").eqNullSafe(F.col("__p"))).withColumn("__ref", F.upper(F.coalesce(F.col("panel_ref"), F.col("__first_ref"))))
    sofar = F.transform(F.filter("__new", lambda n: n["first"]["__at"] <= F.col("__at")), lambda n: n["allele"])
    merged = F.filter(F.array_distinct(F.concat(up("panel_alts"), sofar)), lambda a: a != F.col("__ref"))
    seen = A.computed(seen, merged_alts=merged)
    index = F.transform("alleles", lambda a: F.when(a == F.col("__ref"), 0).otherwise(F.array_position("merged_alts", a)).cast("int"))
    return seen.withColumn("indices", index).withColumn("site_ref", F.col("__ref")).drop("__ref", "__at", "__new", "__first_ref", "__c", "__p")


def inject(rows: DataFrame) -> DataFrame:
    """Rows of panel_alt_index whose ALTs become the merged ones and whose GT follows, where the panel has the site, REFs are of one length and all alleles are as long as theirs."""
    n = F.length("ref")
    same = F.col("panel_ref").isNotNull() & (F.length("panel_ref") == n) & ~F.exists("alts", lambda a: F.length(a) != n) & ~F.exists("panel_alts", lambda a: F.length(a) != F.length("panel_ref"))
    mapping = F.map_from_arrays(F.sequence(F.lit(0), F.size("alts")), "indices")
    out = rows.withColumn("injected", F.coalesce(same, F.lit(False))).withColumn("__map", mapping)
    return out.withColumn("gt", F.when(F.col("injected"), A.gt_remap(F.col("gt"), F.col("__map"))).otherwise(F.col("gt"))).withColumn("alts", F.when(F.col("injected"), F.col("merged_alts")).otherwise(F.col("alts"))).drop("__map")


def prune_info(info: F.Column, per_allele: list[str], changed: F.Column) -> F.Column:
    """INFO map without the keys that have a value for each allele, where the ALTs changed."""
    return F.when(changed, F.map_filter(info, lambda k, _: ~k.isin(*per_allele) if per_allele else F.lit(True))).otherwise(info)


def padded(panel: DataFrame, indexed: DataFrame) -> DataFrame:
    """chrom, pos, ref, alts, kind, added: the panel with added ALTs (modified), unchanged sites (original) and new ones (novel)."""
    last = indexed.groupBy("site_chrom", "pos").agg(F.max_by("merged_alts", F.size("merged_alts")).alias("merged"), F.first("site_ref").alias("site_ref"))
    met = panel.join(last, (panel["chrom"] == last["site_chrom"]) & (panel["pos"] == last["pos"]), "full").select(panel["chrom"], "site_chrom", F.coalesce(panel["pos"], last["pos"]).alias("pos"), "ref", "alts", "merged", "site_ref")
    added = F.array_except(F.coalesce("merged", F.array().cast("array<string>")), F.transform(F.coalesce("alts", F.array().cast("array<string>")), F.upper))
    kind = F.when(F.col("chrom").isNull(), "novel").when(F.size(added) > 0, "modified").otherwise("original")
    return met.select(F.coalesce("chrom", "site_chrom").alias("chrom"), "pos", F.coalesce("ref", "site_ref").alias("ref"), F.concat(F.coalesce("alts", F.array().cast("array<string>")), added).alias("alts"), kind.alias("kind"), added.alias("added"))


def panel_counts(panel: DataFrame) -> DataFrame:
    """modified, novel, total of a padded panel."""
    return panel.agg(F.count_if(F.col("kind") == "modified").alias("modified"), F.count_if(F.col("kind") == "novel").alias("novel"), F.count("*").alias("total"))
