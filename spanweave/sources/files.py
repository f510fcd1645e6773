"""Documents from files: each file one row (path, payload), payload as bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, *paths: str, pattern: str | None = None) -> DataFrame:
    """(path, payload) of all files below ``paths``; ``pattern``: a glob of names, as ``*.json``.

    Any store that Spark reads will do.  A file is a row, so that its size is bounded by what a row may hold.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(list(paths)).select("path", F.col("content").alias("payload"))


def read_grammars(spark: SparkSession, *paths: str) -> DataFrame:
    """(grammar, source) of all ``.peg`` files below ``paths``, named after their files."""
    found = read_documents(spark, *paths, pattern="*.peg")
    return found.select(F.regexp_extract("path", r"([^/]+)\.peg$", 1).alias("grammar"), F.col("payload").cast("string").alias("source"))
