"""The relational part of text recognition: parse, retry choice, assembly, merging. The model itself is pluggable."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slips.functions.text import let

from .correct import correct_ocr_lines
from .geometry import has_box, height, position

LINE = "struct<text:string,confidence:double,bbox:array<array<double>>>"
#: Model confidence below which lines are dropped, for the plain and the small-text pass; height that calls for the latter.
DROP_SCORE, SMALL_DROP_SCORE, SMALL_TEXT = 0.30, 0.20, 15.0


Backend = Callable[[bytes], list[tuple[list, str, float]]]


def is_small(found: list[tuple[list, str, float]]) -> bool:
    """Whether the mean height of the boxes calls for the small-text pass."""
    tall = [max(p[1] for p in box) - min(p[1] for p in box) for box, _, _ in found if box]
    return bool(tall) and 0 < sum(tall) / len(tall) < SMALL_TEXT


ARROW_LINES = pa.list_(pa.struct([("text", pa.string()), ("confidence", pa.float64()), ("bbox", pa.list_(pa.list_(pa.float64())))]))


def reader(backend: Backend, small_backend: Backend | None = None) -> Callable[[bytes], tuple[list[dict] | None, str | None]]:
    """A function from an image's bytes to its lines, or to what went wrong. ``backend`` gives (box, text, confidence);
    where its lines are small, ``small_backend`` reads the image again, and what finds more lines counts."""

    def read(content: bytes) -> tuple[list[dict] | None, str | None]:
        try:
            found = backend(content)
            if small_backend is not None and is_small(found):
                found = max(found, small_backend(content), key=len)
            return [{"text": t, "confidence": c, "bbox": b} for b, t, c in found], None
        except Exception as e:  # noqa: BLE001 - reported in the row
            return None, str(e) or type(e).__name__

    return read


def recognise(images: DataFrame, backend: Backend, small_backend: Backend | None = None) -> DataFrame:
    """doc_id, lines and error from doc_id and content, each image read once, in the task that has it.

    A failing image gives an error row; it never fails the batch. Images with a text in ``refused`` (if there is such a
    column) are not read: that text is their error.
    """
    kind = images.schema["doc_id"].dataType.simpleString()
    refused = F.col("refused") if "refused" in images.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader(backend, small_backend)
        for batch in batches:
            found = [(None, why) if why is not None else read(content) for content, why in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            lines, errors = ([f[k] for f in found] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, ARROW_LINES), pa.array(errors, pa.string())], names=["doc_id", "lines", "error"])

    return images.select("doc_id", "content", refused.alias("refused")).mapInArrow(run, f"doc_id {kind}, lines array<{LINE}>, error string")


def parse(lines: Column, positions: bool = True) -> Column:
    """Raw lines with confidence rounded to three places and the pixel position of their box."""
    def one(x):
        out = x.withField("confidence", F.round(x["confidence"], 3))
        return out.withField("position", F.when(has_box(x), position(x))) if positions else out

    return F.transform(lines, one)


def confident(lines: Column, least: float = DROP_SCORE) -> Column:
    return F.filter(lines, lambda x: x["confidence"] >= least)


def mean_height(lines: Column) -> Column:
    mean = lambda tall: F.when(F.size(tall) > 0, F.aggregate(tall, F.lit(0.0), lambda a, h: a + h) / F.size(tall)).otherwise(0.0)
    return let(F.transform(F.filter(lines, has_box), height), mean)


def wants_retry(lines: Column) -> Column:
    return let(mean_height(lines), lambda h: (h > 0) & (h < SMALL_TEXT))


def better_pass(plain: Column, small: Column) -> Column:
    """The small-text pass if it was called for and found more lines."""
    return let(plain, lambda own: F.when(wants_retry(own) & (F.size(small) > F.size(own)), small).otherwise(own))


def mean_confidence(lines: Column) -> Column:
    n = F.size(lines)
    total = F.aggregate(lines, F.lit(0.0), lambda a, x: a + F.coalesce(x["confidence"], F.lit(0.0)))
    return F.when(n > 0, F.round(total / n, 3)).otherwise(0.0)


def texts(lines: Column) -> Column:
    return F.coalesce(F.transform(lines, lambda x: x["text"]), F.array().cast("array<string>"))


def assemble(docs: DataFrame) -> DataFrame:
    """The result record of recognised documents (doc_id, lines, error, processing_time_ms), lines corrected."""
    fixed = docs.withColumn("lines", F.when(F.col("error").isNull(), correct_ocr_lines(parse(F.col("lines")))))
    n = F.coalesce(F.size("lines"), F.lit(0))
    return fixed.select(
        "doc_id",
        F.when(F.col("error").isNotNull(), "error").when(n == 0, "no_text_found").otherwise("success").alias("status"),
        F.array_join(texts(F.col("lines")), "\n").alias("text"),
        "lines", n.alias("lines_detected"),
        F.when(n > 0, mean_confidence(F.col("lines"))).otherwise(0.0).alias("average_confidence"),
        "processing_time_ms", F.lit(True).alias("text_enhanced"), "error",
    )


def merge_results(parts: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """One result per document from its parts (doc_id, part_no, status, lines, processing_time_ms).

    One part passes through whatever its status; of several, only successes contribute, in part order. ``extra`` holds
    further aggregates by name.
    """
    extra = extra or {}
    good = F.col("status") == "success"
    grouped = parts.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("merged_from"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(good, F.struct("part_no", "lines")))), lambda x: x["lines"])).alias("good_lines"),
        F.coalesce(F.sum(F.when(good, F.col("processing_time_ms"))), F.lit(0)).alias("good_ms"),
        F.first("status").alias("only_status"), F.first("processing_time_ms").alias("only_ms"),
        # Lines are carried once: those of successes are among the good ones.
        F.first(F.when(good, None).otherwise(F.col("lines"))).alias("only_lines"),
        *(column.alias(name) for name, column in extra.items()),
    )
    one = F.col("merged_from") == 1
    lines = F.when(one & F.coalesce(F.col("only_status") != "success", F.lit(True)), F.col("only_lines")).otherwise(F.col("good_lines"))
    return grouped.select(
        "doc_id",
        F.when(one, F.col("only_status")).otherwise("success").alias("status"),
        F.coalesce(F.size(lines), F.lit(0)).alias("lines_detected"),
        F.when(one, F.col("only_ms")).otherwise(F.col("good_ms")).alias("processing_time_ms"),
        mean_confidence(lines).alias("average_confidence"),
        lines.alias("lines"),
        F.when(~one, F.col("merged_from")).alias("merged_from"),
        *extra,
    )


def engine_status(spark, enhancement: bool = True) -> DataFrame:
    rules = 21
    return spark.range(1).select(F.lit(enhancement).alias("enabled"), F.lit("pattern_based").alias("method"), F.lit(rules).alias("rules"))
