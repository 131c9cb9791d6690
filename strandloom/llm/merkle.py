"""Document fingerprints: a Merkle tree over sections, paragraphs and word groups, in DataFrame functions alone.

Sections are cut at blank lines, paragraphs at line ends, leaves are groups of eight words with the white space after them,
so the leaves in order are the whole text and equal roots mean equal texts. A fingerprint is
`root:leaves`, leaves being eight hexadecimal digits each, "," between paragraphs and "/" between sections: roots test
equality, and the first differing branch from the root down locates an edit. The likeness of two fingerprints is the Dice
coefficient of their distinct leaves, 1 for equal roots.

Defined results: a null text is empty (one empty paragraph); repeated rows get the same values; a table of one document has
itself as the next; an empty table gives no rows. Documents with the same doc_id share their place in the order, and the
one with the smallest digest (sha256 of the text) stands for them as "next"; a null doc_id comes last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import written

GROUP_WORDS = 8
LEAF_HEX = 8


def tree(text: Column) -> Column:
    """array<array<array<string>>>: leaf digests by section and paragraph."""
    piece = F.lit(r"\s*(?:\S+\s*){1,%d}|\s+" % GROUP_WORDS)
    leaves = lambda p: F.transform(F.regexp_extract_all(p, piece, F.lit(0)), lambda w: F.md5(w.cast("binary")))
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), leaves))


def fingerprint(tree: Column) -> Column:
    """root:leaves of a tree; each inner digest is of its children's digests in order, separated by level."""
    sections = F.transform(tree, lambda s: F.sha2(F.array_join(F.transform(s, lambda p: F.md5(F.array_join(p, "").cast("binary"))), ",").cast("binary"), 256))
    root = F.sha2(F.array_join(sections, "/").cast("binary"), 256)
    shown = F.array_join(F.transform(tree, lambda s: F.array_join(F.transform(s, lambda p: F.array_join(F.transform(p, lambda w: F.substring(w, 1, LEAF_HEX)), "")), ",")), "/")
    return F.concat(F.substring(root, 1, 32), F.lit(":"), shown)


def leaves(tree: Column) -> Column:
    return F.array_distinct(F.transform(F.flatten(F.flatten(tree)), lambda w: F.substring(w, 1, LEAF_HEX)))


def likeness(fp_a: Column, leaves_a: Column, fp_b: Column, leaves_b: Column) -> Column:
    both = F.size(F.array_intersect(leaves_a, leaves_b))
    return F.when(F.substring(fp_a, 1, 32) == F.substring(fp_b, 1, 32), 1.0).otherwise(F.coalesce(F.try_divide(2.0 * both, F.size(leaves_a) + F.size(leaves_b)), F.lit(0.0)))


def edited_places(fp_a: Column, fp_b: Column) -> Column:
    """array<struct<section, paragraph>>: the places, from 0, whose branches differ between two fingerprints; empty for equal roots."""
    cut = lambda fp: F.split(F.substring_index(fp, ":", -1), "/")
    paragraphs = lambda s: F.split(F.coalesce(s, F.lit("")), ",")

    def of_section(a: Column, b: Column, i: Column) -> Column:
        hit = F.zip_with(paragraphs(a), paragraphs(b), lambda x, y: ~x.eqNullSafe(y))
        at = F.transform(hit, lambda h, j: F.when(h, F.struct(i.alias("section"), j.alias("paragraph"))))
        return F.filter(at, lambda x: x.isNotNull())

    pairs = F.zip_with(cut(fp_a), cut(fp_b), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    found = F.flatten(F.transform(pairs, lambda p, i: of_section(p["a"], p["b"], i)))
    return F.when(F.substring(fp_a, 1, 32) == F.substring(fp_b, 1, 32), F.filter(found, lambda x: F.lit(False))).otherwise(found)


def next_ids(ids: DataFrame) -> DataFrame:
    """(k, next_k) for distinct keys k: the next one in descending order, the first after the last.

    Spark cuts the keys into ranges by quantiles of a sample, whatever their values; only each range's largest key meets the
    others in one task, which is a row for each partition.
    """
    ranged = written(ids.select("k").distinct().repartitionByRange("k").select("k", F.spark_partition_id().alias("range")))
    inner = ranged.withColumn("next_k", F.lead("k").over(Window.partitionBy("range").orderBy(F.desc("k"))))
    ends = ranged.groupBy("range").agg(F.max("k").alias("top"))
    order = Window.orderBy(F.desc("range"))
    ends = ends.select("range", F.coalesce(F.lead("top").over(order), F.max("top").over(Window.partitionBy())).alias("after"))
    return inner.join(ends, "range").select("k", F.coalesce("next_k", "after").alias("next_k"))


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The text is shuffled once, by id; it meets its predecessor's id there, and only the piece that the predecessor takes
    over and the leaves go on to the second join.
    """
    kind, none = docs.schema["doc_id"].dataType, -(2**63)
    # Both joins take the same two columns by the same key, so that Spark shuffles the texts once.
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(none)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    need = base.groupBy("k").agg(F.max(F.length("text")).alias("most"))
    order = next_ids(base).join(need, "k").select(F.col("k").alias("of"), F.col("next_k").alias("k"), F.expr("most div 3").alias("most"))
    stands = base.join(order, "k").select("of", F.expr("substring(text, 1, cast(most as int))").alias("head"), F.sha2("text", 256).alias("digest"), tree(F.col("text")).alias("next_tree"))
    stands = stands.select("of", "digest", "head", leaves(F.col("next_tree")).alias("next_leaves"), F.substring(fingerprint(F.col("next_tree")), 1, 32).alias("next_root"))
    stands = stands.groupBy("of").agg(F.min_by(F.struct("head", "next_leaves", "next_root"), "digest").alias("next"))
    met = base.join(stands, F.col("k") == F.col("of")).select(F.when(F.col("k") != none, F.col("k")).cast(kind).alias("doc_id"), "text", "next", F.length("text").alias("n_chars"))
    cut = F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 3 as int)), substring(next.head, 1, cast(n_chars div 3 as int)))")
    grown = met.select("doc_id", "n_chars", "next", tree(F.col("text")).alias("t"), cut.alias("edited"))
    grown = grown.select("doc_id", "n_chars", "next", "t", F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("edited")).alias("e"))
    told = grown.select("doc_id", "n_chars", "edited_sha256", "next", fingerprint(F.col("t")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"), leaves(F.col("t")).alias("lt"), leaves(F.col("e")).alias("le"))
    return told.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("lt"), F.col("edited_fingerprint"), F.col("le")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("lt"), F.col("next.next_root"), F.col("next.next_leaves")).alias("near_next"),
    )
