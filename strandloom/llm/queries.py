"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bitplane, bpe, elkan, html, langid, lm, media, merkle, ngram_join, packing, secrets, substring, whitening
from strandloom.llm.common import crc_mod, scan_parts, shared_dir, table
from strandloom.llm.oracles import ORACLES


def tokenizer(name: str) -> str:
    """Where a public tokenizer file lies on this machine and on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = langid.fit(docs, folds=4, held_out=2)
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return langid.identify(docs.select("doc_id", "text", held_out), net, ["doc_id", "held_out"])


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), window=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "boundary")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), n=5, percent=80)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited(table(spark, sf_dir, "documents"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan.report(table(spark, sf_dir, "embeddings"), "vec_id", column="embedding", width=64, k=16, rounds=3)


def op12_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), shared_dir(spark)
    parts = max(scan_parts(docs), int(spark.conf.get("spark.sql.shuffle.partitions")))
    bitplane.write(packing.tokenized(bitplane.ordered(docs, parts), tokenizer("word_bpe_49k.json"), end_id=2), path)
    back = bitplane.read(spark, path, docs.schema["doc_id"].dataType.simpleString())
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", scale=64, shift=1_000_000, most=16)
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm, op2_langid, op3_packing, op4_ngram_join, op5_substring, op6_bpe, op7_media, op8_html, op9_secrets, op10_fingerprints, op11_clusters, op12_bitplanes, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return ORACLES
