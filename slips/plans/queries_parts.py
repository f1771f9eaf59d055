"""Queries over the other tables: files, images, batches, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slips.functions.text import clean_lines
from slips.operators import files, geometry, images, ocr
from slips.plans import batch, receipts
from slips.session import spread, table
from slips.sources.readers import from_line_table, lines_of, to_line_table
from slips.streaming.ingest import throughput

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


# --- Files and utilities ------------------------------------------------------------------------------


@query("utl1_file_hash", "SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents")
def utl1_file_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.coalesce("text", F.lit("")).cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", files.file_hash(content).alias("hash"))


@query("utl3_size_mb", "SELECT page_id, round(octet_length(encode(html)) / 1048576.0::DOUBLE, 2)::DOUBLE AS mb, octet_length(encode(html)) <= 10485760 AS fits FROM pages")
def utl3_size_mb(spark, sf_dir):
    n = F.octet_length("html")
    return table(spark, sf_dir, "pages").select("page_id", files.size_mb(n).alias("mb"), files.fits_upload(n).alias("fits"))


@query("utl4_sanitize_filename", r"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url || '&page=' || page_id, '([^/]*)$', 1), '[^a-zA-Z0-9._-]', '_', 'g') AS s FROM pages)
    SELECT page_id, s AS filename FROM p""")
def utl4_sanitize_filename(spark, sf_dir):
    name = F.concat("url", F.lit("&page="), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", files.sanitize_filename(name).alias("filename"))


@query("utl5_processing_time", "SELECT event_id, CASE WHEN ms < 1000 THEN ms || 'ms' ELSE printf('%.2fs', ms / 1000.0::DOUBLE) END AS took FROM (SELECT event_id, floor(value * 100)::BIGINT // 10 * 10 AS ms FROM events)")
def utl5_processing_time(spark, sf_dir):
    ms = F.floor(F.floor(F.col("value") * 100) / 10) * 10
    return table(spark, sf_dir, "events").select("event_id", files.format_processing_time(ms).alias("took"))


@query("utl6_summary", """SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS image, '250ms' AS processing_time, 7 AS lines_detected, printf('%.1f%%', (page_id % 100)::DOUBLE) AS average_confidence,
    round(page_id / 1.0::DOUBLE, 2)::VARCHAR || ' MB' AS file_size FROM pages""")
def utl6_summary(spark, sf_dir):
    c = F.col
    one = files.processing_summary(c("url"), F.lit(250), F.lit(7), (c("page_id") % 100) / 100, c("page_id") * 1048576)
    return table(spark, sf_dir, "pages").select("page_id", one.alias("s")).select("page_id", "s.*")


@query("utl10_badge", "SELECT event_id, CASE WHEN floor(c + 0.5) >= 90 THEN 'high' WHEN floor(c + 0.5) >= 70 THEN 'medium' ELSE 'low' END AS badge FROM (SELECT event_id, (event_id % 101)::DOUBLE AS c FROM events)")
def utl10_badge(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", files.confidence_badge((F.col("event_id") % 101) / 100).alias("badge"))


@query("scn1_validate_image", """SELECT event_id, event_id % 3 = 1 AS is_valid, CASE event_id % 3 WHEN 0 THEN 'Invalid file extension: txt' WHEN 1 THEN 'Valid image file' ELSE 'File is not an image' END AS message FROM events""")
def scn1_validate_image(spark, sf_dir):
    k = F.col("event_id") % 3
    path = F.concat(F.lit("/in/scan_"), F.col("event_id").cast("string"), F.when(k == 0, ".txt").when(k == 1, ".PNG").otherwise(".jpg"))
    start = F.when(k == 1, F.unhex(F.lit("89504E470D0A1A0A"))).otherwise(F.encode(F.lit("plain text"), "UTF-8"))
    return table(spark, sf_dir, "events").select("event_id", files.validate_image_file(path, start).alias("v")).select("event_id", "v.*")


@query("scn2_validate_upload", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'No filename provided' WHEN 1 THEN 'Unsupported file type: gif' END AS problem FROM events""")
def scn2_validate_upload(spark, sf_dir):
    k = F.col("event_id") % 4
    name = F.when(k == 1, "a.gif").when(k == 2, "a.PDF").when(k == 3, "b.jpeg")
    return table(spark, sf_dir, "events").select("event_id", files.validate_upload(name).alias("problem"))


@query("scn3_validate_size", """SELECT event_id, w BETWEEN 100 AND 4096 AS is_valid, CASE WHEN w > 4096 THEN 'Image too large' WHEN w < 100 THEN 'Image too small' ELSE 'OK' END AS message,
    800.0 / w > 3.0 AS long_receipt FROM (SELECT event_id, event_id % 5000 + 1 AS w FROM events)""")
def scn3_validate_size(spark, sf_dir):
    w, h = F.col("event_id") % 5000 + 1, F.lit(800)
    seen = table(spark, sf_dir, "events").select("event_id", files.validate_size(w, h).alias("v"), files.is_long_receipt(w, h).alias("long_receipt"))
    return seen.select("event_id", "v.*", "long_receipt")


@query("scn4_arity", """SELECT conv_id AS doc_id, count(*) AS parts, CASE WHEN count(*) < 2 THEN 'at least 2 parts needed' WHEN count(*) > 4 THEN 'at most 4 parts allowed' END AS error FROM conversations GROUP BY conv_id""")
def scn4_arity(spark, sf_dir):
    parts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"))
    return files.check_arity(parts, 2, 4)


@query("scn5_clean_lines", r"""SELECT doc_id, len(l) AS n, array_to_string(l, '|') AS joined FROM (SELECT doc_id, list_filter([regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN string_split(coalesce(text, ''), chr(10))], lambda x: x <> '') AS l FROM documents)""")
def scn5_clean_lines(spark, sf_dir):
    cleaned = lines_of(table(spark, sf_dir, "documents")).select("doc_id", clean_lines(F.col("lines")).alias("l"))
    return cleaned.select("doc_id", F.size("l").cast("long").alias("n"), F.array_join("l", "|").alias("joined"))


@query("src_lines_round_trip", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def src_lines_round_trip(spark, sf_dir):
    """Lines exploded into a relation and gathered again by their numbers."""
    lines = to_line_table(lines_of(table(spark, sf_dir, "documents")))
    return from_line_table(lines).select("doc_id", F.array_join("lines", "\n").alias("text"))


@query("doc_text_extract")
def doc_text_extract(spark, sf_dir):
    """The text entry point over all documents; tests compare it with a slow version."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return receipts.extract(lines_of(spread(spark, docs, "doc_id", docs, 2)), ["doc_id", "receipt_type", "receipt_type_confidence", "store_name", "item_count"])


# --- Recognised lines ---------------------------------------------------------------------------------


def _lines(spark, sf_dir) -> DataFrame:
    """Conversations as recognised pages: one line per turn."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "text")
    y = F.col("turn") * 30.0
    box = F.array(F.array(F.lit(10.0), y), F.array(F.lit(210.0), y), F.array(F.lit(210.0), y + 20), F.array(F.lit(10.0), y + 20))
    line = F.struct("turn", F.col("text"), (F.col("turn") % 10 / 10 + 0.00049).alias("confidence"), box.alias("bbox"))
    return turns.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"), x["bbox"].alias("bbox"))).alias("lines"))


@query("ocr3_parse", "SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text)::INT AS line_no, text, round(turn % 10 / 10.0, 3)::DOUBLE AS confidence, (turn * 30)::INT AS top, 200 AS width FROM conversations")
def ocr3_parse(spark, sf_dir):
    seen = _lines(spark, sf_dir).select("doc_id", F.posexplode(ocr.parse(F.col("lines"))).alias("i", "x"))
    return seen.select("doc_id", (F.col("i") + 1).alias("line_no"), "x.text", "x.confidence", "x.position.top", "x.position.width")


@query("scn7_confident", "SELECT conv_id AS doc_id, count(*) FILTER (turn % 10 >= 3) AS n FROM conversations GROUP BY conv_id")
def scn7_confident(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", F.size(ocr.confident(F.col("lines"))).cast("long").alias("n"))


@query("ocr6_mean_confidence", "SELECT conv_id AS doc_id, round(sum(round(turn % 10 / 10.0 + 0.00049, 5)) / count(*), 3)::DOUBLE AS confidence, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def ocr6_mean_confidence(spark, sf_dir):
    c = F.col("lines")
    return _lines(spark, sf_dir).select("doc_id", ocr.mean_confidence(c).alias("confidence"), F.array_join(ocr.texts(c), "\n").alias("text"))


@query("geo1_tolerance", "SELECT conv_id AS doc_id, 15 AS tolerance FROM conversations GROUP BY conv_id")
def geo1_tolerance(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", geometry.tolerance(F.col("lines")).alias("tolerance"))


# --- Batches ------------------------------------------------------------------------------------------


def _results(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "error").otherwise("success")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts", "user_id", status.alias("status"), F.floor(F.col("value") * 10).alias("processing_time_ms"))


@query("api4_batch_summary", """SELECT count(*) AS total_images, count(*) FILTER (event_type <> 'error') AS successful, count(*) FILTER (event_type = 'error') AS failed,
    coalesce(sum(floor(value * 10)::BIGINT) FILTER (event_type <> 'error'), 0)::BIGINT AS total_processing_time_ms FROM events""")
def api4_batch_summary(spark, sf_dir):
    return batch.batch_summary(_results(spark, sf_dir))


@query("snk2_batch_by_user", """SELECT user_id, count(*) AS total_images, count(*) FILTER (event_type <> 'error') AS successful, count(*) FILTER (event_type = 'error') AS failed,
    coalesce(sum(floor(value * 10)::BIGINT) FILTER (event_type <> 'error'), 0)::BIGINT AS total_processing_time_ms FROM events GROUP BY user_id""")
def snk2_batch_by_user(spark, sf_dir):
    return batch.batch_summary(_results(spark, sf_dir), "user_id")


@query("str1_throughput", """SELECT time_bucket(INTERVAL 5 MINUTE, ts)::TIMESTAMP AS start, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, count(*) AS n, sum(floor(value * 10)::BIGINT)::BIGINT AS ms FROM events GROUP BY 1, 2""")
def str1_throughput(spark, sf_dir):
    counted = throughput(_results(spark, sf_dir))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "status", "n", "ms")


# --- Images: embeddings seen as eight-by-eight grey patches -------------------------------------------


def _patches(spark, sf_dir) -> DataFrame:
    """Key and 64 grey values in row order, derived from the vector's own values."""
    grey = F.transform("embedding", lambda x: F.pmod(F.floor(x.cast("double") * 1000).cast("int"), F.lit(256)).cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), grey.alias("pixels"))


GREY = "SELECT vec_id AS key, [(((floor(x::DOUBLE * 1000)::INT % 256) + 256) % 256)::DOUBLE FOR x IN embedding] AS pixels FROM embeddings"
LONG = f"SELECT key, unnest(pixels) AS value, unnest(range(0, 64)) AS pos FROM ({GREY})"


@query("img1_brightness", f"SELECT key, round(list_avg(pixels), 4)::DOUBLE AS mean, round(list_var_pop(pixels) + 0.00001, 4)::DOUBLE AS variance FROM ({GREY})")
def img1_brightness(spark, sf_dir):
    return _patches(spark, sf_dir).select("key", F.round(images.mean(F.col("pixels")), 4).alias("mean"), F.round(images.variance(F.col("pixels")) + 0.00001, 4).alias("variance"))


def _long(spark, sf_dir) -> DataFrame:
    return _patches(spark, sf_dir).select("key", F.posexplode("pixels").alias("pos", "value"))


@query("img2_shadow_variance", f"SELECT key, round(var_pop(m) + 0.00001, 4)::DOUBLE AS shadow_variance FROM (SELECT key, pos // 16 AS r, pos % 8 // 2 AS c, avg(value) AS m FROM ({LONG}) GROUP BY ALL) GROUP BY key")
def img2_shadow_variance(spark, sf_dir):
    return images.shadow_variance(_long(spark, sf_dir), 8).select("key", F.round(F.col("shadow_variance") + 0.00001, 4).alias("shadow_variance"))


@query("img4_noise_level", f"SELECT label AS key, round(sqrt(quantile_cont(v, 0.1)), 4)::DOUBLE AS noise_level FROM (SELECT e.label, list_var_pop(pixels) AS v FROM ({GREY}) g JOIN embeddings e ON e.vec_id = g.key) GROUP BY label")
def img4_noise_level(spark, sf_dir):
    """Each vector is a patch of the image that its label names."""
    label = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vec"), F.col("label"))
    patches = _patches(spark, sf_dir).join(label, F.col("key") == F.col("vec"))
    variances = patches.select(F.col("label").alias("key"), images.variance(F.col("pixels")).alias("variance"))
    return images.noise_level(variances).select("key", F.round("noise_level", 4).alias("noise_level"))


@query("img7_recommend", """SELECT event_id, list_filter([CASE WHEN h / 50.0 * 0.7 < 20 AND side <= 4096 THEN 'upscale_small_text(' || printf('%.0f', h / 50.0 * 0.7) || 'px)' END, CASE WHEN side > 4096 THEN 'resize_down' END,
    CASE WHEN side < 600 AND NOT (h / 50.0 * 0.7 < 20) THEN 'resize_up' END, CASE WHEN b < 50 THEN 'gamma_strong(0.45)' WHEN b < 80 THEN 'gamma_gentle(0.65)' WHEN b > 200 THEN 'gamma_darken' ELSE 'clahe_gentle' END], lambda x: x IS NOT NULL) AS fixes
    FROM (SELECT event_id, (event_id % 90 + 10) * 50 AS h, greatest((event_id % 90 + 10) * 50, 500) AS side, event_id % 256 AS b FROM events)""".replace("WHEN b > 200 THEN 'gamma_darken' ELSE 'clahe_gentle' END]", "WHEN b > 200 THEN 'gamma_darken' END, CASE WHEN b >= 80 THEN 'clahe_gentle' END]"))
def img7_recommend(spark, sf_dir):
    h, b = ((F.col("event_id") % 90 + 10) * 50).cast("int"), (F.col("event_id") % 256).cast("int")
    none = F.lit(0.0)
    f = images.flags(F.lit(500), h, b, F.lit(20.0), none, none, none, F.lit(False))
    return table(spark, sf_dir, "events").select("event_id", f.alias("f")).select("event_id", images.recommend(F.col("f"), none, none).alias("fixes"))


@query("img10_gamma", f"SELECT key, [floor(power(x / 255.0, 1.0 / 0.65) * 255)::INT FOR x IN pixels] AS pixels FROM ({GREY})")
def img10_gamma(spark, sf_dir):
    return _patches(spark, sf_dir).select("key", images.gamma(F.col("pixels"), F.lit(0.65)).alias("pixels"))


@query("img18_contrast", f"SELECT key, [greatest(0, least(255, round(x * 1.2::DOUBLE + 128 * (1 - 1.2::DOUBLE))::INT)) FOR x IN pixels] AS pixels FROM ({GREY})")
def img18_contrast(spark, sf_dir):
    return _patches(spark, sf_dir).select("key", images.contrast(F.col("pixels")).alias("pixels"))


@query("img19_crop", """SELECT event_id, CASE WHEN w >= 50 AND 400 >= 50 THEN l END AS "left", CASE WHEN w >= 50 THEN w END AS width, CASE WHEN w >= 50 THEN 400::BIGINT END AS height
    FROM (SELECT event_id, floor(event_id % 100 / 100.0::DOUBLE * 1000)::BIGINT AS l, 1000 - floor(event_id % 100 / 100.0::DOUBLE * 1000)::BIGINT AS w FROM events)""")
def img19_crop(spark, sf_dir):
    x = F.col("event_id") % 100 / 100
    point = lambda a, b: F.struct(a.alias("x"), F.lit(b).alias("y"))
    box = images.crop_box(F.array(point(x, 0.0), point(F.lit(1.5), 0.0), point(x, 0.5), point(F.lit(1.0), 0.5)), F.lit(1000), F.lit(800))
    return table(spark, sf_dir, "events").select("event_id", box.alias("b")).select("event_id", "b.left", "b.width", "b.height")


@query("img21_nearest_corner", """SELECT event_id, CASE WHEN x < 0.08 THEN 'topLeft' WHEN 1.0::DOUBLE - x < 0.08 THEN 'topRight' END AS corner FROM (SELECT event_id, event_id % 100 / 100.0::DOUBLE AS x FROM events)""")
def img21_nearest_corner(spark, sf_dir):
    corner = lambda n, x, y: F.struct(F.lit(n).alias("name"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    corners = F.array(corner("topLeft", 0.0, 0.0), corner("topRight", 1.0, 0.0), corner("bottomLeft", 0.0, 1.0), corner("bottomRight", 1.0, 1.0))
    x = F.col("event_id") % 100 / 100
    return table(spark, sf_dir, "events").select("event_id", images.nearest_corner(corners, x, F.lit(0.0)).alias("corner"))
