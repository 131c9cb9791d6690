"""The corpus pipeline: language ID, near-duplicate removal, substring dedup, secret redaction, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.

- language_id drops documents without any letter and those whose language stays in doubt (score under LEAST_SCORE); a null
  lang becomes the predicted one.
- ngram_join keeps the smallest doc_id of each group of documents linked at a Jaccard similarity of 0.8 over five words.
- substring takes out passages that a document with a smaller doc_id keeps; no document is dropped.
- secrets replaces secrets in the texts; no document is dropped.
- packing returns the pieces of the packed sequences.

Rows with a null doc_id pass the joins unchanged. Rows that share a doc_id are one document, which stays or goes with all its
texts; of its rows with equal texts one stays, the one whose other columns come first as JSON. Extra columns, whatever their
names, pass through; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import langid, ngram_join, packing, secrets, substring
from strandloom.llm.common import free_name, table, written
from strandloom.llm.queries import tokenizer

LEAST_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    told = langid.identify(docs, langid.fit(docs), docs.columns, lang, score)
    kept = told.where((F.col(lang) != langid.UND) & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", lang)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    version, row = free_name(docs, "version"), free_name(docs, "row")
    kept = ngram_join.classes(docs, n=5, percent=80).where("component_id = doc_id").select("doc_id", F.col("version").alias(version)).distinct()
    named = docs.where("doc_id is not null").withColumn(version, F.xxhash64("text")).join(kept, ["doc_id", version], "left_semi")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    # A row for each text of a document; the join has dealt the rows by these keys already.
    one = named.groupBy("doc_id", version).agg(F.min_by(F.struct("text", *rest), F.to_json(F.struct(*rest)) if rest else F.lit("")).alias(row))
    flat = one.select("doc_id", f"`{row}`.*")
    return flat.select(*(f"`{c}`" for c in docs.columns)).union(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.dedup(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, tokenizer("byte_bpe_50k.tiktoken"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, tokenizer("word_bpe_49k.json"), window=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "boundary")


STAGES = [("language_id", language_id), ("ngram_join", near_duplicates), ("substring", repeated_passages), ("secrets", secret_scan), ("packing", pack)]

#: SQL can't express the trained network, the chunking or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
