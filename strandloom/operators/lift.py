"""Coordinate lifting: the blocks of all chains are cut into disjoint segments first, so a position meets one row at most.

The sweep that cuts them knows, for every segment, the best score, whether chains share it, and the block that counts. A lookup is
an equi-join on (contig, bin) with the segment's range as its residual; nothing is aggregated after it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import alleles as A
from strandloom.operators.reference import reference_base, resolve_contig

#: Bits of a position inside a bin of the lookup, and inside a stretch that is swept on its own.
BIN_BITS, SWEEP_BITS = 10, 17


def swept(blocks: Iterator[tuple]) -> Iterator[tuple]:
    """Disjoint (contig, lo, hi, q_chrom, q_strand, shift, ambiguous) of blocks (contig, stretch, lo, hi, score, chain_id, place), sorted by contig, stretch and lo.

    place is (t_start, t_end, q_chrom, shift, q_strand): of blocks that share the best score the smallest counts. Only blocks that
    are open at one position are held.
    """
    best: list[tuple] = []  # (-score, place, hi) of open blocks, those that have ended among them
    ends: list[tuple] = []  # (hi, score, chain_id) of open blocks
    chains: dict[int, dict[int, int]] = {}  # how many open blocks each chain has, by score
    where, at, held = None, 0, None

    def upto(to: int | None) -> Iterator[tuple]:
        """Segments from `at` to a position, or to the end of the last open block."""
        nonlocal at, held
        while ends and (to is None or at < to):
            hi = ends[0][0] if to is None else min(ends[0][0], to)
            if hi > at:
                while best[0][2] <= at:
                    heapq.heappop(best)
                score, place, _ = best[0]
                now = (where[0], place[2], place[4], place[3], len(chains[-score]) > 1)
                if held and held[1] == at and held[2] == now:
                    held = (held[0], hi, now)
                else:
                    if held:
                        yield held
                    held = (at, hi, now)
                at = hi
            while ends and ends[0][0] <= at:
                _, s, c = heapq.heappop(ends)
                chains[s][c] -= 1
                if not chains[s][c]:
                    del chains[s][c]
        if to is not None:
            at = to

    def shown(segments: Iterator[tuple]) -> Iterator[tuple]:
        for lo, hi, (contig, q_chrom, strand, shift, ambiguous) in segments:
            yield contig, lo, hi, q_chrom, strand, shift, ambiguous

    for contig, stretch, lo, hi, score, chain, place in blocks:
        if (contig, stretch) != where:
            yield from shown(upto(None))
            if held:
                yield from shown(iter([held]))
            where, at, held, best = (contig, stretch), lo, None, []
            chains.clear()
        yield from shown(upto(lo))
        heapq.heappush(best, (-score, place, hi))
        heapq.heappush(ends, (hi, score, chain))
        by = chains.setdefault(score, {})
        by[chain] = by.get(chain, 0) + 1
    yield from shown(upto(None))
    if held:
        yield from shown(iter([held]))


def segments(blocks: DataFrame, bits: int = BIN_BITS) -> DataFrame:
    """__t, __bin, __lo, __hi, q_chrom, q_strand, __shift, __ambiguous: disjoint segments of chain blocks, a row for each bin they overlap.

    Blocks are cut at the borders of stretches, which are swept apart. On + a position p lies at p + shift, on - at shift - p.
    """
    plus = F.col("q_strand") == "+"
    good = blocks.where(F.col("q_strand").isin("+", "-") & (F.col("t_end") > F.col("t_start")))
    shift = F.when(plus, F.col("q_start") - F.col("t_start")).otherwise(F.col("q_size") - 1 - F.col("q_start") + F.col("t_start"))
    long = good.select(A.without_chr(F.col("t_chrom")).alias("t"), F.explode(F.sequence(F.shiftright(F.col("t_start").cast("long"), SWEEP_BITS), F.shiftright(F.col("t_end").cast("long") - 1, SWEEP_BITS))).alias("stretch"), F.col("t_start").cast("long"), F.col("t_end").cast("long"), F.coalesce(F.col("score").cast("long"), F.lit(0)).alias("score"), F.coalesce(F.col("chain_id").cast("long"), F.lit(0)).alias("chain_id"), F.coalesce("q_chrom", F.lit("")).alias("q_chrom"), shift.cast("long").alias("shift"), "q_strand")
    cut = long.where("t is not null and shift is not null").select("t", "stretch", F.greatest("t_start", F.shiftleft("stretch", SWEEP_BITS)).alias("lo"), F.least("t_end", F.shiftleft(F.col("stretch") + 1, SWEEP_BITS)).alias("hi"), "score", "chain_id", "t_start", "t_end", "q_chrom", "shift", "q_strand")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((*r[:6], r[6:]) for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        names, held = ["t", "lo", "hi", "q_chrom", "q_strand", "shift", "ambiguous"], []
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
        for segment in swept(rows):
            held.append(segment)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    flat = cut.repartition("t", "stretch").sortWithinPartitions("t", "stretch", "lo").mapInArrow(sweep, "t string, lo long, hi long, q_chrom string, q_strand string, shift long, ambiguous boolean")
    return flat.select(F.col("t").alias("__t"), F.explode(F.sequence(F.shiftright("lo", bits), F.shiftright(F.col("hi") - 1, bits))).alias("__bin"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), "q_chrom", "q_strand", F.col("shift").alias("__shift"), F.col("ambiguous").alias("__ambiguous"))


def looked_up(rows: DataFrame, found: DataFrame, chrom: str, pos: str, out: str, bits: int = BIN_BITS) -> DataFrame:
    """rows with the struct `out` (status, q_chrom, q_pos, q_strand) of their 0-based positions in segments; contig names match with or without chr."""
    asked = rows.withColumn("__chrom", A.without_chr(F.col(chrom)))
    side = found.select("__t", "__bin", "__lo", "__hi", F.struct("q_chrom", "q_strand", "__shift", "__ambiguous").alias("__seg"))
    met = asked.join(side, (F.col("__chrom") == F.col("__t")) & (F.shiftright(pos, bits) == F.col("__bin")) & (F.col(pos) >= F.col("__lo")) & (F.col(pos) < F.col("__hi")), "left")
    place = F.when(F.col("__seg.q_strand") == "+", F.col(pos) + F.col("__seg.__shift")).otherwise(F.col("__seg.__shift") - F.col(pos))
    met = met.withColumn("__place", place)
    status = F.when(F.col("__seg").isNull(), "unmapped").when(F.col("__seg.__ambiguous"), "ambiguous").when(F.col("__place") < 0, "unmapped").otherwise("lifted")
    met = met.withColumn("__status", status)
    good = lambda c: F.when(F.col("__status") == "lifted", c)
    told = F.struct(F.col("__status").alias("status"), good(F.col("__seg.q_chrom")).alias("q_chrom"), good(F.col("__place")).alias("q_pos"), good(F.col("__seg.q_strand")).alias("q_strand"))
    return met.select(*(F.col(f"`{c}`") for c in rows.columns), told.alias(out))


def lift_point(points: DataFrame, blocks: DataFrame, key: str = "rid", bits: int = BIN_BITS) -> DataFrame:
    """key, status (lifted, unmapped, ambiguous), q_chrom, q_pos, q_strand of 0-based positions (key, chrom, pos).

    The highest score wins; if chains with different ids share it the position is ambiguous, else the first block counts.
    """
    return looked_up(points.select(key, "chrom", "pos"), segments(blocks, bits), "chrom", "pos", "__a", bits).select(key, "__a.*")


def both_ends(rows: DataFrame, blocks: DataFrame, chrom: str, first: str, last: str) -> DataFrame:
    """rows with status, q_chrom, q_pos, q_strand of spans from `first` to `last` (0-based): both ends must agree on contig, strand and distance, else the span is straddled.

    Rows carry their columns through one lookup for each end; the segments are made once for both.
    """
    found = segments(blocks)
    met = looked_up(looked_up(rows, found, chrom, first, "__a"), found, chrom, last, "__b")
    a, b = (lambda c: F.col(f"__a.{c}")), (lambda c: F.col(f"__b.{c}"))
    agree = (b("status") == "lifted") & (a("q_chrom") == b("q_chrom")) & (a("q_strand") == b("q_strand")) & (F.abs(b("q_pos") - a("q_pos")) == F.col(last) - F.col(first))
    met = met.withColumn("__s", F.when(a("status") != "lifted", a("status")).when(F.coalesce(agree, F.lit(False)), "lifted").otherwise("straddled"))
    good = lambda c: F.when(F.col("__s") == "lifted", c)
    return met.select(*(F.col(f"`{c}`") for c in rows.columns), F.col("__s").alias("status"), good(a("q_chrom")).alias("q_chrom"), good(F.when(a("q_strand") == "+", a("q_pos")).otherwise(b("q_pos"))).alias("q_pos"), good(a("q_strand")).alias("q_strand"))


def lift_span(spans: DataFrame, blocks: DataFrame, key: str = "rid") -> DataFrame:
    """key, status, q_chrom, q_pos, q_strand of indels (key, chrom, pos, length)."""
    rows = spans.select(key, "chrom", "pos", (F.col("pos") + F.col("length") - 1).alias("__last"))
    return both_ends(rows, blocks, "chrom", "pos", "__last").select(key, "status", "q_chrom", "q_pos", "q_strand")


def liftover(rows: DataFrame, blocks: DataFrame, contigs: DataFrame, sequence: DataFrame, key: str = "rid") -> DataFrame:
    """Variant rows (key, chrom, 1-based pos, ref, alts, gt) in the coordinates and against the bases of another build, with reason.

    On the other strand REF and ALTs are reverse-complemented. A REF of N takes the target base; a one-base REF that differs
    from it is swapped with the ALT that equals it, or the row is incompatible; a longer REF must start with it. Case does not
    matter; with a REF of N ALTs are upper case and distinct.
    """
    typed = rows.withColumn("__class", A.lift_class(F.col("ref"), F.col("alts")))
    asked = F.col("__class").isin("snp", "indel") & (F.col("pos") > 0)
    first = F.when(asked, F.col("pos") - 1).otherwise(F.lit(-1) - F.pmod(F.hash(key), F.lit(1 << 20)))  # rows that aren't asked for meet no bin, nor each other
    typed = typed.withColumn("__first", first.cast("long")).withColumn("__last", F.when(asked & (F.col("__class") == "indel"), F.col("__first") + F.length("ref") - 1).otherwise(F.col("__first")).cast("long"))
    met = both_ends(typed, blocks, "chrom", "__first", "__last").withColumn("pos_old", F.col("pos"))
    reason = F.when(F.col("pos") <= 0, "parse_errors").when(F.col("__class") == "other", "liftover_straddled").when(F.col("status") != "lifted", F.concat(F.lit("liftover_"), F.col("status")))
    met = met.withColumn("reason", reason).withColumn("new_pos", F.col("q_pos") + 1)
    met = resolve_contig(met, contigs, "q_chrom")
    met = met.withColumn("reason", F.when(F.col("reason").isNull() & F.col("contig").isNull(), "liftover_contig_missing").otherwise(F.col("reason")))
    turn = lambda c: F.when((F.col("q_strand") == "-") & ~c.rlike(r"[<>\[\]*]"), A.revcomp_upper(c)).otherwise(c)
    met = met.withColumn("ref", turn(F.col("ref"))).withColumn("alts", F.transform("alts", turn))
    met = reference_base(met, sequence, "new_pos", "base")
    met = met.withColumn("reason", F.when(F.col("reason").isNull() & F.col("base").isNull(), "reference_failures").otherwise(F.col("reason")))
    up = F.transform("alts", F.upper)
    plain, n_ref, one = F.upper("ref") == F.col("base"), F.upper("ref") == "N", F.length("ref") == 1
    k = F.array_position(up, F.col("base"))
    number = F.sequence(F.lit(0), F.size("alts"))
    rest = F.when(n_ref, F.filter(F.array_distinct(up), lambda a: a != F.col("base"))).otherwise(F.filter("alts", lambda a, i: i + 1 != k))
    swapped = F.transform(number, lambda i: F.when(i == 0, 1).when(i == k, 0).when(i < k, i + 1).otherwise(i).cast("int"))
    # REF N: an ALT that equals the target base becomes 0, the others their place in the rest
    filled = F.transform(number, lambda i: F.when(i == 0, 0).otherwise(F.array_position(rest, F.get(up, i - 1))).cast("int"))
    how = F.when(n_ref, "fill").when(plain | (~one & (F.upper(F.substring("ref", 1, 1)) == F.col("base"))), "keep").when(one & (k > 0), "swap").otherwise("bad")
    met = met.withColumn("__how", how).withColumn("__swapped", F.map_from_arrays(number, swapped)).withColumn("__filled", F.map_from_arrays(number, filled)).withColumn("__rest", rest)
    met = met.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("__how") == "bad"), "liftover_incompatible").otherwise(F.col("reason")))
    good = lambda c: F.when(F.col("reason").isNull(), c)
    return met.select(
        key,
        good(F.col("contig")).alias("chrom"),
        good(F.col("new_pos")).alias("pos"),
        good(F.when(F.col("__how").isin("fill", "swap"), F.col("base")).otherwise(F.col("ref"))).alias("ref"),
        good(F.when(F.col("__how") == "fill", F.col("__rest")).when(F.col("__how") == "swap", F.concat(F.array("ref"), "__rest")).otherwise(F.col("alts"))).alias("alts"),
        good(F.when(F.col("__how") == "fill", A.gt_remap(F.col("gt"), F.col("__filled"))).when(F.col("__how") == "swap", A.gt_remap(F.col("gt"), F.col("__swapped"))).otherwise(F.col("gt"))).alias("gt"),
        "reason",
    )
