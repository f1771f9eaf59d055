"""Where documents come from: image files, directories, lists of parts, line tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slips.operators.files import basename


def image_files(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """Files of a directory that match a pattern: doc_id (the path), filename, size, modified, content."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return raw.select(F.col("path").alias("doc_id"), "path", basename(F.col("path")).alias("filename"), "length", F.col("modificationTime").alias("modified"), "content")


def decoded_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Images decoded in the JVM; what cannot be decoded has height -1."""
    raw = spark.read.format("image").option("pathGlobFilter", pattern).load(path)
    return raw.select(F.col("image.origin").alias("doc_id"), "image")


def parts(spark: SparkSession, listed: Iterable[tuple]) -> DataFrame:
    """(doc_id, part_no, path) rows of receipts photographed in several parts."""
    return spark.createDataFrame(list(listed), "doc_id string, part_no int, path string")


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and its lines, from a text column."""
    return docs.select("doc_id", F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("lines"))


def from_line_table(lines: DataFrame) -> DataFrame:
    """Documents from one row per line (doc_id, line_no, text)."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy("doc_id").agg(F.transform(ordered, lambda x: x["text"]).alias("lines"))


def to_line_table(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("line_no", "text"))
