"""Connected components by alternating large-star and small-star steps; each round ends in a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import written


#: A node of more links than this (16 MB of them), and of more than a 1,000th of all, is heavy: at most 2,000 nodes are.
HEAVY = 1_000_000


def _with_least(e: DataFrame, least: DataFrame, links: int) -> DataFrame:
    """e (u, v) with m of least (u, m, n). Heavy nodes, of which there are few by their definition, are broadcast, so that no task gets all links of one. Where there are no more links in all than make a node heavy, none is."""
    if 2 * links <= HEAVY:  # each link counts at both ends
        return e.join(least.select("u", "m"), "u").select("u", "v", "m")
    heavy = F.broadcast(least.where(F.col("n") > max(HEAVY, links // 1000)).select("u", F.col("m").alias("heavy_m")))
    met = e.join(heavy, "u", "left")
    light = met.where("heavy_m is null").select("u", "v").join(least.select("u", "m"), "u")
    return light.select("u", "v", "m").union(met.where("heavy_m is not null").select("u", "v", F.col("heavy_m").alias("m")))


def _large_star(e: DataFrame, links: int) -> DataFrame:
    both = e.union(e.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("m", "u").alias("m"), "n")
    return _with_least(both.where("v > u"), least, links).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame, links: int) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(down, least, links).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node reachable.

    Minima are aggregated before the shuffle and joined back; a node with very many links is never one task's group.
    """
    e = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen, e = state, written(_small_star(_large_star(e, state["n"]), state["n"]))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
