"""Self-join of documents on the Jaccard similarity of their word n-grams, exact, with rare-first prefix filtering.

1. Each text becomes a sorted set of 64-bit n-gram hashes and a 128-bit digest of it; equal sets form a class, which is one
   node of the link graph, and only one text of each goes on.
2. Texts are dealt into blocks by id and digest. A block sends its distinct n-grams, shortened to 48 bits, to buckets; a
   bucket counts them over all blocks and answers with one byte each, in the same order: a logarithmic document frequency. It
   orders n-grams rare first (ties by hash) alike everywhere; a shortened hash can only raise a count, never hide a partner.
3. The prefix of a set of n is its n - ceil(t n) + 1 rarest n-grams; those that no other document has are left out. Of two
   sets the one with fewer n-grams must hold their first common n-gram among its n - ceil(2t / (1 + t) n) + 1 rarest ones,
   so only these are indexed: n-grams of a template that come later in all its documents are looked up by many and found in
   none. Candidates share an n-gram so, and lengths and the positions of that n-gram allow the threshold.
4. First the document of lowest position in each n-gram's list (the one with the fewest n-grams of its own) is held against
   the others. Documents that this links need no further check against each other, for they are in one component already;
   the second round checks all candidates that lie in different components, by n-gram and size class. So a group of near
   copies takes as many checks as it has members, and no link between components is lost.
5. A pair is verified once: the suffix filter bounds the difference of halves and quarters, then the sets are intersected.

Defined results: null and empty texts have no n-gram and are linked with nothing; fewer than n words are one n-gram; rows
that share a doc_id are one document, which joins the classes of its texts; a null doc_id has a null component; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import bucket_cuts, expanded, given_back, joined, pack_u64, runs, scan_parts, squeezed, unpack_u64, word_hashes, written
from strandloom.llm.graph import components

SHORT = np.uint64(16)
SLICE = 256


def ngram_sets(data: np.ndarray, bounds: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the n-word n-grams of each of the joined rows."""
    h, count = word_hashes(data, bounds)
    grams = runs(h, n)
    for k, end in zip(count.tolist(), np.cumsum(count).tolist(), strict=True):
        yield np.unique(grams[end - k : end - n + 1] if k >= n else runs(h[end - k : end], k)) if k else np.empty(0, np.uint64)


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, version (hash of the text), n_shingles, digest (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                size, digest = [], []
                for s in ngram_sets(*joined(part.column("text")), n):
                    size.append(len(s))
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("version"), pa.array(size, pa.int64()), pa.array(digest, pa.binary())], names=["doc_id", "version", "n_shingles", "digest"])
        given_back()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("version")).mapInArrow(run, "doc_id long, version long, n_shingles long, digest binary")


def _chosen(texts: pa.Table, keep: dict[bytes, int], n: int) -> list[tuple[int, np.ndarray]]:
    """(node, set) of a block's texts that stand for a class, by node."""
    out, left = {}, set(keep)
    for i in range(0, texts.num_rows, SLICE):
        for s in ngram_sets(*expanded(texts.column("text")[i : i + SLICE].to_pylist()), n):
            digest = xxhash.xxh3_128_digest(s.tobytes())
            if digest in left:  # once, also where rows are repeated
                left.remove(digest)
                out[keep[digest]] = s
    return [(k, out[k]) for k in sorted(out)]


def candidates(docs: DataFrame, reps: DataFrame, n: int, percent: int) -> DataFrame:
    """node, n, grams and positions (the shared n-grams of its prefix), packed: a row for each class that shares a prefix n-gram."""
    parts = 4 * scan_parts(docs)
    block = F.pmod(F.xxhash64("doc_id", "version"), F.lit(parts)).cast("int").alias("block")
    blocked = squeezed(docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("version"))).select("text", block)
    chosen = reps.select("node", "digest", block)

    def keys(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = [s for _, s in _chosen(left, dict(zip(right.column("digest").to_pylist(), right.column("node").to_pylist(), strict=True)), n)]
        short, count = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]) >> SHORT, return_counts=True)
        cuts = bucket_cuts(short << SHORT, parts)
        filled = np.flatnonzero(np.diff(cuts)).tolist()
        at = [(cuts[b], cuts[b + 1]) for b in filled]
        block_no = (left if left.num_rows else right).column("block")[0].as_py()
        out = pa.table({"block": pa.array([block_no] * len(filled), pa.int32()), "bucket": pa.array(filled, pa.int32()), "keys": pa.array([pack_u64(short[a:b]) for a, b in at], pa.binary()), "counts": pa.array([count[a:b].clip(0, 255).astype(np.uint8).tobytes() for a, b in at], pa.binary())})
        del sets, short, count
        given_back()
        return out

    def totals(rows: pa.Table) -> pa.Table:
        got = [unpack_u64(b) for b in rows.column("keys").to_pylist()]
        count = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.uint8)
        distinct, where = np.unique(np.concatenate(got), return_inverse=True)
        level = np.rint(8 * np.log2(np.bincount(where, count, len(distinct)))).clip(0, 255).astype(np.uint8)
        split = np.split(where, np.cumsum([len(g) for g in got])[:-1])
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "levels": pa.array([level[w].tobytes() for w in split], pa.binary())})

    sent = blocked.groupBy("block").cogroup(chosen.groupBy("block")).applyInArrow(keys, "block int, bucket int, keys binary, counts binary")
    answered = sent.groupBy("bucket").applyInArrow(totals, "block int, bucket int, levels binary")
    told = chosen.select("block", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("levels"), "node", "digest")
    told = told.union(answered.select("block", "bucket", "levels", F.lit(None).cast("long"), F.lit(None).cast("binary")))

    def prefixes(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        keep = {d: k for d, k in zip(right.column("digest").to_pylist(), right.column("node").to_pylist(), strict=True) if d is not None}
        level = np.frombuffer(b"".join(x for x in right.column("levels").to_pylist() if x is not None), np.uint8)
        sets = _chosen(left, keep, n)
        short = np.unique(np.concatenate([np.empty(0, np.uint64), *(s for _, s in sets)]) >> SHORT)
        out: dict[str, list] = {"node": [], "n": [], "grams": [], "at": [], "packed": []}
        for node, s in sets:
            mine = level[np.searchsorted(short, s >> SHORT)]
            size = len(s) - (-(-percent * len(s) // 100)) + 1
            if size < len(s):
                able = np.flatnonzero(mine <= np.partition(mine, size - 1)[size - 1])
                first = able[np.lexsort((s[able], mine[able]))[:size]]
            else:
                first = np.lexsort((s, mine))
            at = np.flatnonzero(mine[first])
            if len(at):
                for k, v in zip(out, (node, len(s), s[first[at]].view(np.int64), at.astype(np.int32), pack_u64(s)), strict=True):
                    out[k].append(v)
        types = {"node": pa.int64(), "n": pa.int64(), "grams": pa.list_(pa.int64()), "at": pa.list_(pa.int32()), "packed": pa.binary()}
        made = pa.table({k: pa.array(v, types[k]) for k, v in out.items()})
        del sets, short, level, out
        given_back()
        return made

    return blocked.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(prefixes, "node long, n long, grams array<long>, at array<int>, packed binary")


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 2) -> int:
    """A lower bound of the Hamming distance of two sorted sets: sizes on both sides of a pivot must differ at least so much."""
    if not depth or not len(x) or not len(y):
        return abs(len(x) - len(y))
    pivot = y[len(y) // 2]
    i, j = np.searchsorted(x, pivot), len(y) // 2
    return suffix_bound(x[:i], y[:j], depth - 1) + suffix_bound(x[i:], y[j:], depth - 1)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 |x & y| >= percent |x | y|."""
    least = Fraction(percent * (len(x) + len(y)), 100 + percent)
    if suffix_bound(x, y) > len(x) + len(y) - 2 * least:
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that hold, each checked once."""
    left = sets.select(F.col("node").alias("a"), F.col("packed").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("packed").alias("sb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, known, last = [], None, None
            for i in range(batch.num_rows):
                sa, sb = batch.column("sa")[i].as_py(), batch.column("sb")[i].as_py()
                if sb != last:  # rows come sorted by b
                    last, known = sb, unpack_u64(sb)
                keep.append(linked(unpack_u64(sa), known, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        given_back()

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def links(cand: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of nodes that give the same components as all pairs at or above the threshold."""
    sets = cand.select("node", "packed")
    index = cand.select("node", "n", F.explode(F.arrays_zip("grams", "at")).alias("g")).select(F.col("g.grams").alias("gram"), "node", "n", F.col("g.at").alias("at"))

    def allowed(a: str, b: str) -> F.Column:
        """Length filter, and positional filter: what stands before the first shared n-gram is not shared in at least one set."""
        e = f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and {100 + percent} * least({a}.n - {a}.at, {b}.n - {b}.at) >= {percent} * ({a}.n + {b}.n)"
        return F.expr(e)

    hubs = index.groupBy("gram").agg(F.min(F.struct("at", "node", "n")).alias("hub"), F.count("*").alias("many")).where("many > 1").select("gram", "hub.at", "hub.node", "hub.n")
    near = index.alias("x").join(hubs.alias("h"), F.expr("x.gram = h.gram and x.node <> h.node") & allowed("x", "h"))
    first = written(near.select(F.greatest("x.node", "h.node").alias("a"), F.least("x.node", "h.node").alias("b")).distinct())
    found = written(verified(first, sets, percent))
    comp = components(found)

    placed = written(index.join(comp.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node")))
    # Only n-grams whose documents lie in several components; the main one's documents never need each other.
    mixed = placed.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by("component", F.struct("at", "node")).alias("main")).where("lo <> hi").select("gram", "main")
    several = placed.join(mixed, "gram").withColumn("minor", F.expr("component <> main")).withColumn("size", F.length(F.bin("n")))
    # A smaller set is found by those up to twice as large: of its own size class and of the next.
    small = several.where(f"{100 + percent} * (n - at) >= {2 * percent} * n").withColumn("size", F.explode(F.array(F.col("size"), F.col("size") + 1)))
    both = F.expr("x.gram = y.gram and x.size = y.size and x.component <> y.component and (x.n > y.n or x.n = y.n and x.node > y.node)") & allowed("x", "y")
    ends = [F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")]
    rest = several.where("minor").alias("x").join(small.alias("y"), both).select(*ends)
    rest = rest.union(several.where("not minor").alias("x").join(small.where("minor").alias("y"), both).select(*ends)).distinct()
    return found.union(verified(rest.join(first, ["a", "b"], "left_anti"), sets, percent))


def classes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, version, n_shingles, component_id of each row; version is xxhash64(text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(sets_of(docs, n))
    named = sets.where("digest is not null and doc_id is not null")
    reps = named.groupBy("digest").agg(F.min(F.struct("doc_id", "version")).alias("r"))
    reps = written(reps.select(F.monotonically_increasing_id().alias("node"), "digest", "r.doc_id", "r.version"))
    cand = written(candidates(docs, reps, n, percent))
    # A document that has several texts joins their classes.
    several = named.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    doubles = named.join(several, "doc_id").select("doc_id", "digest").distinct().join(reps.select("digest", "node"), "digest")
    one = doubles.groupBy("doc_id").agg(F.min("node").alias("b"))
    same = doubles.join(one, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")
    comp = components(links(cand, percent).union(same))
    of_node = reps.join(comp, "node", "left").select("digest", F.coalesce("component", "node").alias("component"), "doc_id")
    least = of_node.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = of_node.join(least, "component").select("digest", "component_id")
    met = sets.join(of_class, "digest", "left")
    return met.select("doc_id", "version", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links of at least `percent` per cent Jaccard similarity."""
    return classes(docs, n, percent).select("doc_id", "n_shingles", "component_id")
