"""The stateless receipt plan over arriving documents, and counts of arrivals by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slips.operators import files as checks
from slips.operators.ocr import Backend
from slips.plans import batch, receipts


def arriving(spark: SparkSession, path: str, schema: str = "doc_id long, lines array<string>", files: int = 100) -> DataFrame:
    """Documents from Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def start(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Extract receipts as documents arrive; every file is written exactly once."""
    return receipts.extract(docs).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What Spark's source of whole files gives.
FILE = "path string, modificationTime timestamp, length long, content binary"


#: Bytes of files that a trigger takes: each trigger lists the folder and plans the query anew, however little it reads.
TRIGGER = 512 << 20


def uploads(spark: SparkSession, path: str, files: int | None = None, stream: bool = True) -> DataFrame:
    """Files that land in a folder, each once: doc_id (the path), filename with a lower-case type, content, and ``refused``,
    why an upload is not taken (its name, its type, its size or its first bytes). Refused files lose their content. A
    trigger takes ``files`` files, or, if that is None, ``TRIGGER`` bytes of them."""
    limit = ("maxBytesPerTrigger", TRIGGER) if files is None else ("maxFilesPerTrigger", files)
    reader = spark.readStream.option(*limit) if stream else spark.read
    raw = reader.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").load(path)
    name = checks.basename(F.col("path"))
    dot = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    filename = F.concat(F.expr("substring(name, 1, length(name) - length(dot))"), F.lower("dot"))
    named = raw.select(F.col("path").alias("doc_id"), "path", name.alias("name"), dot.alias("dot"), "length", "content").withColumn("filename", filename)
    check = checks.validate_image_file(F.col("path"), F.col("content"))
    why = F.coalesce(checks.validate_upload(F.col("filename")), F.when(~checks.fits_upload(F.col("length")), "File too large"), F.when(~check["is_valid"], check["message"]))
    told = named.select("doc_id", "path", "filename", "length", why.alias("refused"), "content")
    return told.withColumn("content", F.when(F.col("refused").isNull(), F.col("content")))


def read_uploads(arrived: DataFrame, backend: Backend) -> DataFrame:
    """Receipts of uploads with one record for each file, refused and unreadable ones included."""
    carried = arrived.select(F.struct("doc_id", "filename", "length").alias("doc_id"), "content", "refused")
    read = batch.ocr.recognise(carried, backend).withColumn("processing_time_ms", F.lit(None).cast("long"))
    return batch.scan_with_metadata(read).select("doc_id.*", F.col("status"), "text", "lines_detected", "average_confidence", "error", "metadata")


def keep(results: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of results to Parquet; what has arrived by now is worked off in triggers, every file exactly once."""
    return results.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def throughput(results: DataFrame, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Results per time window and status, closed when they can get no later ones."""
    return results.withWatermark(time, late).groupBy(F.window(time, window), "status").agg(F.count(F.lit(1)).alias("n"), F.sum("processing_time_ms").alias("ms"))
