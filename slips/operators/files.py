"""File checks and small scalar utilities, as column expressions over ``binaryFile`` or image rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slips.functions.text import amount

IMAGE_TYPES, UPLOAD_TYPES = ("jpg", "jpeg", "png", "webp", "bmp", "tiff"), ("jpg", "jpeg", "png", "pdf")
MAX_UPLOAD, MAX_SIDE, MIN_SIDE = 10 * 1024 * 1024, 4096, 100
#: First bytes of image files, in hex.
MAGIC = r"^(?:FFD8FF|89504E470D0A1A0A|52494646.{8}57454250|424D|49492A00|4D4D002A|474946383)"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def validate_image_file(path: Column, content: Column | None = None) -> Column:
    """struct<is_valid, message>: the type by name and, where the bytes are at hand, by their start."""
    kind = extension(path)
    known = kind.isin(*IMAGE_TYPES)
    is_image = F.lit(True) if content is None else F.coalesce(F.hex(F.substring(content, 1, 12)).rlike(MAGIC), F.lit(False))
    message = (
        F.when(path.isNull(), "File does not exist")
        .when(~known, F.concat(F.lit("Invalid file extension: "), kind))
        .when(~is_image, "File is not an image")
        .otherwise("Valid image file")
    )
    return F.struct((path.isNotNull() & known & is_image).alias("is_valid"), message.alias("message"))


def validate_upload(filename: Column) -> Column:
    """Null if an upload's name is acceptable, or the reason why not."""
    return F.when(F.coalesce(filename, F.lit("")) == "", "No filename provided").when(
        ~extension(filename).isin(*UPLOAD_TYPES), F.concat(F.lit("Unsupported file type: "), extension(filename))
    )


def validate_size(width: Column, height: Column, most: int = MAX_SIDE, least: int = MIN_SIDE) -> Column:
    """struct<is_valid, message>; images that cannot be decoded have height -1."""
    message = (
        F.when(F.coalesce(height, F.lit(-1)) < 0, "Cannot decode image")
        .when((width > most) | (height > most), "Image too large")
        .when((width < least) | (height < least), "Image too small")
        .otherwise("OK")
    )
    return F.struct((message == "OK").alias("is_valid"), message.alias("message"))


def is_long_receipt(width: Column, height: Column, ratio: float = 3.0) -> Column:
    return height / width > ratio


def fits_upload(size: Column) -> Column:
    return size <= MAX_UPLOAD


def check_arity(parts: DataFrame, least: int, most: int, key: str = "doc_id") -> DataFrame:
    """Per document: number of parts and an error if it is out of bounds."""
    n = F.col("parts")
    problem = F.when(n < least, F.format_string("at least %d parts needed", F.lit(least))).when(n > most, F.format_string("at most %d parts allowed", F.lit(most)))
    return parts.groupBy(key).agg(F.count(F.lit(1)).alias("parts")).select(key, "parts", problem.alias("error"))


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def size_mb(length: Column) -> Column:
    return F.round(length / 1048576, 2)


def sanitize_filename(name: Column) -> Column:
    """Base name with safe characters; long ones keep 95 of their stem and the ending."""
    safe = F.regexp_replace(basename(name), r"[^a-zA-Z0-9._-]", "_")
    ending = F.regexp_extract(safe, r"^\.*[^.].*?(\.[^.]*)$", 1)
    stem = F.substring(safe, F.lit(1), F.length(safe) - F.length(ending))
    return F.when(F.length(safe) > 100, F.concat(F.substring(stem, 1, 95), ending)).otherwise(safe)


def format_processing_time(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.format_string("%.2fs", ms / 1000))


def processing_summary(path: Column, ms: Column, lines: Column, confidence: Column, length: Column) -> Column:
    return F.struct(
        basename(path).alias("image"), format_processing_time(ms).alias("processing_time"), lines.alias("lines_detected"),
        F.format_string("%.1f%%", confidence * 100).alias("average_confidence"), F.concat(size_mb(length).cast("string"), F.lit(" MB")).alias("file_size"),
    )


def confidence_badge(confidence: Column) -> Column:
    rounded = F.floor(confidence * 100 + 0.5)
    return F.when(rounded >= 90, "high").when(rounded >= 70, "medium").otherwise("low")


def display_total(total_amount: Column, items: Column) -> Column:
    """The total as a number, or what the items add up to if there is none above zero."""
    told = amount(F.regexp_replace(total_amount, "[^0-9.]", ""))
    return F.when(told > 0, told).otherwise(F.aggregate(F.transform(items, lambda x: x["price"]), F.lit(0.0), lambda a, p: a + p))


def display_units(item_count: Column, items: Column) -> Column:
    told = F.nullif(item_count, F.lit(0))
    return F.coalesce(told, F.aggregate(F.transform(items, lambda x: F.coalesce(F.nullif(x["qty"], F.lit(0)), F.lit(1))), F.lit(0), lambda a, q: a + q))


def expired(modified: Column, now: Column, hours: float) -> Column:
    """Files older than ``hours``, for cleanup."""
    return modified < now - F.make_dt_interval(hours=F.lit(int(hours)))
