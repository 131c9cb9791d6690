"""Calls that arrive as files: the row-level plan unchanged on a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.sources.text import dtc_parse, dtc_scan


def call_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed calls of every file that lands in a folder; file tells the source."""
    lines = spark.readStream.text(folder).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"))
    return dtc_parse(dtc_scan(lines))
