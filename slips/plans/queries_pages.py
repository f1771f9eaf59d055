"""Queries over painted pages: each conversation is a page, whose faults depend on its key. The SQL knows from the table
what a kernel has to find in the pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slips.operators import features, images, pages, stitching
from slips.plans import batch, painting
from slips.session import scratch, spread, table
from slips.sources.writers import write_images
from slips.streaming import ingest

QUERIES: dict = {}
ORACLE: dict = {}

#: Characters of a painted row.
WIDE = 120
#: The same pages in SQL: key, number of rows, width and height in pixels.
PAGES = f"""WITH pieces AS (SELECT conv_id, [x FOR x IN [substr(coalesce(text, ''), {WIDE} * i + 1, {WIDE}) FOR i IN range((length(coalesce(text, '')) + {WIDE - 1}) // {WIDE})] IF trim(x) <> ''] AS p FROM conversations),
    page AS (SELECT conv_id AS doc_id, sum(len(p))::INT AS n, max(list_max([4 * length(x) + (length(x) - length(replace(x, 'e', ''))) % 13 FOR x IN p]))::INT AS most FROM pieces GROUP BY conv_id),
    sized AS (SELECT doc_id, n, CASE WHEN n > 0 THEN 40 + most ELSE 60 END::INT AS width, CASE WHEN n > 0 THEN 31 + 20 * n ELSE 60 END::INT AS height FROM page)"""


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and lines: all texts of a conversation in rows of ``WIDE`` characters, blank rows left out. Rows are set in by
    how many e they have, so that their glyphs don't stand in columns."""
    text = F.coalesce("text", F.lit(""))
    whole = F.floor((F.char_length(text) + WIDE - 1) / WIDE).cast("int")
    starts = F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>"))
    cut = F.filter(F.transform(starts, lambda k: F.substring(text, k * WIDE + 1, F.lit(WIDE))), lambda x: F.trim(x) != "")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.struct("turn", "text", cut.alias("cut")).alias("t"))
    rows = spread(spark, turns, "doc_id").groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["cut"])).alias("rows"))
    line = lambda x, k: F.struct((F.lit(20) + (F.char_length(x) - F.char_length(F.replace(x, F.lit("e"), F.lit("")))) % 13).alias("x"), (k * 20 + 20).alias("y"), (F.char_length(x) * 4).alias("width"), F.lit(11).alias("height"), x.alias("text"))
    return rows.select("doc_id", F.transform("rows", line).cast(painting.LINES).alias("lines"))


def angle_of(key: int) -> int:
    """Tilt of a page, clockwise: from -10 to 10 degrees."""
    return key % 21 - 10


def tilted(key: int, page: np.ndarray, border: int = 80) -> np.ndarray:
    return pages.turned(np.pad(page, border, constant_values=painting.PAPER), -angle_of(key))


def bent(key: int, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The page on a desk in perspective, by its key, and its corners there."""
    desk, low = painting.on_desk(page, painting.desk_around(page)), painting.desk_around(page)
    h, w = desk.shape
    far, right = h - low - 1, w - low - 1
    flat = np.array([[low, low], [right, low], [right, far], [low, far]], float)
    inset = 0.06 + key % 5 * 0.02
    moved = flat + np.array([[inset * w, 0], [-inset * w / 2, key % 7], [0, -(key % 4)], [0, 0]])
    return pages.projected(desk, pages.homography(flat, moved), w, h, painting.DESK), moved


@query("img3_skew", f"{PAGES} SELECT doc_id, sign(doc_id % 21 - 10)::INT AS leans, true AS within_half_a_degree FROM sized")
def img3_skew(spark, sf_dir):
    """Tilt found in the pixels of turned pages: edges, straight lines, their median."""

    def work(key: int, page: np.ndarray) -> tuple:
        found = pages.skew(tilted(key, page))
        return int(np.sign(found)), abs(found - angle_of(key)) <= 0.5

    return painting.on_pages(conversation_pages(spark, sf_dir), work, "leans int, within_half_a_degree boolean")


@query("img5_perspective", f"{PAGES} SELECT doc_id, doc_id % 3 <> 0 AS bent, CASE WHEN doc_id % 3 <> 0 THEN true END AS within_two_pixels FROM sized")
def img5_perspective(spark, sf_dir):
    """Corners of pages in perspective; two keys of three are bent, the others lie flat. Null where no page is found."""

    def work(key: int, page: np.ndarray) -> tuple:
        image, corners = bent(key, page) if key % 3 else (painting.on_desk(page, painting.desk_around(page)), None)
        try:
            quad = pages.page_corners(image)
        except pages.NoPage:
            return None, None
        return pages.in_perspective(quad), None if corners is None else bool(np.hypot(*(quad - corners).T).max() <= 2.0)

    return painting.on_pages(conversation_pages(spark, sf_dir), work, "bent boolean, within_two_pixels boolean")


@query("img14_warp", f"{PAGES} SELECT doc_id, n AS text_rows, true AS upright FROM sized")
def img14_warp(spark, sf_dir):
    """Bent pages found, made flat again, and their rows of text counted. Null where no page is found."""

    def work(key: int, page: np.ndarray) -> tuple:
        image, _ = bent(key, page)
        try:
            inner = pages.flattened(image, pages.page_corners(image))[6:-6, 6:-6]
        except pages.NoPage:
            return None, None
        return len(pages.text_rows(inner)), bool(abs(pages.skew(inner)) <= 1.0)

    return painting.on_pages(conversation_pages(spark, sf_dir), work, "text_rows int, upright boolean")


@query("img13_denoise", f"{PAGES} SELECT doc_id, doc_id % 2 = 0 AS noisy, CASE WHEN doc_id % 2 = 0 THEN n END AS text_rows, CASE WHEN doc_id % 2 = 0 THEN true END AS noise_falls FROM sized")
def img13_denoise(spark, sf_dir):
    """Grain on pages of even keys is measured, smoothed by non-local means, and the rows of text stay."""

    def work(key: int, page: np.ndarray) -> tuple:
        image = painting.noisy(page, 12.0 + key % 3 * 4, key) if key % 2 == 0 else page
        level = images.noise_floor(image)
        if level <= images.NOISE:
            return False, None, None
        fixed = pages.denoised(image, pages.strength_for(level))
        return True, len(pages.text_rows(fixed)), bool(images.noise_floor(fixed) < level)

    return painting.on_pages(conversation_pages(spark, sf_dir), work, "noisy boolean, text_rows int, noise_falls boolean")


@query("img11_local_contrast", f"{PAGES} SELECT doc_id, true AS low_contrast, n AS text_rows FROM sized")
def img11_local_contrast(spark, sf_dir):
    """Faded pages (in colour) through local equalisation of their lightness."""

    def work(key: int, page: np.ndarray) -> tuple:
        faded = (200 - (painting.PAPER - np.arange(256.0)) * (24 + key % 5) / 215).astype(np.uint8).take(page)
        fixed = images.grey(pages.on_lightness(np.broadcast_to(faded[..., None], (*faded.shape, 3)), pages.local_contrast))
        return bool(faded.std() < images.LOW_CONTRAST), len(pages.text_rows(fixed, pages.otsu(fixed) + 1))

    return painting.on_pages(conversation_pages(spark, sf_dir), work, "low_contrast boolean, text_rows int")


@query("img17_premium", f"""{PAGES} SELECT doc_id, n AS text_rows, list_filter([CASE WHEN w < 400 THEN 'upscale' END, CASE WHEN doc_id % 21 <> 10 THEN printf('deskew(%.1f)', (doc_id % 21 - 10)::DOUBLE) END, 'denoise', 'close', 'sharpen'], lambda x: x IS NOT NULL) AS applied
    FROM (SELECT *, width + 160 AS w FROM sized)""")
def img17_premium(spark, sf_dir):
    """All repairs on turned pages, at a smaller width and with a search window of five, for speed. Whether contrast is low
    depends on how much ink a page has; that step is left out of the list."""

    def work(key: int, page: np.ndarray) -> tuple:
        fixed, done = pages.premium(tilted(key, page), width=600, narrow=400, wide=1200, lines=200, search=5)
        return len(pages.text_rows(fixed)), [x for x in done if x != "clahe"]

    return painting.on_pages(conversation_pages(spark, sf_dir), work, "text_rows int, applied array<string>")


#: Brightness of paper and ink of pages that are fine, dark, overexposed or faded.
LIGHT = [(199, 1), (75, 10), (255, 60), (150, 120)]


@query("img15_repair", f"""{PAGES} SELECT doc_id, list_filter([CASE WHEN greatest(width, height) > 4096 THEN 'resize_down' WHEN height / 50.0 * 0.7 < 20 THEN 'upscale_small_text' END,
    CASE doc_id % 4 WHEN 1 THEN 'gamma_gentle' WHEN 2 THEN 'gamma_darken' WHEN 3 THEN 'clahe' END], lambda x: x IS NOT NULL) AS applied FROM sized""")
def img15_repair(spark, sf_dir):
    """What the adaptive repairs do to pages that are fine, dark, overexposed or faded, by their keys."""

    def work(key: int, page: np.ndarray) -> tuple:
        paper, ink = LIGHT[key % 4]
        _, p = images.repair(np.where(page > 128, paper, ink).astype(np.uint8))
        return ([x.split("(")[0] for x in p.applied],)

    return painting.on_pages(conversation_pages(spark, sf_dir), work, "applied array<string>")


@query("sti3_offset", f"{PAGES} SELECT doc_id, (height // 4)::INT AS \"offset\", true AS enough FROM sized")
def sti3_offset(spark, sf_dir):
    """Pages cut in two parts that share their middle half: features tell where the second one begins."""

    def work(_: int, page: np.ndarray) -> tuple:
        h = page.shape[0]
        try:
            offset, found = features.vertical_offset(page[: h - h // 4], page[h // 4 :])
        except features.TooFewMatches:
            return None, False
        return offset, found >= features.FEWEST

    return painting.on_pages(conversation_pages(spark, sf_dir), work, "offset int, enough boolean")


SHARED = 25


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Painted pages in parts: most in two that share 25 rows of pixels. By key, a part has a wrong type or cannot be
    decoded, or the page comes in one part or in eleven and more."""

    def work(key: int, page: np.ndarray) -> tuple:
        cuts = [0, page.shape[0]] if key % 7 == 3 else [0, 30, page.shape[0]]
        parts = [np.repeat(page[a : b + (SHARED if b < page.shape[0] else 0), :, None], 3, axis=2) for a, b in zip(cuts, cuts[1:], strict=False)]
        parts = parts + parts[:1] * 10 if key % 11 == 5 else parts
        return ([painting.png.encode(p) for p in parts], [p.tobytes() for p in parts], [p.shape[0] for p in parts], page.shape[1])

    raw = painting.on_pages(conversation_pages(spark, sf_dir), work, "content array<binary>, data array<binary>, height array<int>, width int")
    each = raw.select("doc_id", "width", F.posexplode(F.arrays_zip("content", "data", "height")).alias("k", "p"))
    key, first = F.col("doc_id"), F.col("k") == 0
    name = F.concat(F.lit("/in/"), key.cast("string"), F.lit("_"), F.col("k").cast("string"), F.when((key % 5 == 2) & first, ".txt").otherwise(".png"))
    unread = (key % 3 == 1) & first
    image = F.struct(F.when(unread, -1).otherwise(F.col("p.height")).alias("height"), "width", F.when(~unread, F.col("p.data")).alias("data"))
    return each.select("doc_id", (F.col("k") + 1).alias("part_no"), name.alias("path"), "p.content", image.alias("image"))


@query("api6_process_multiple", f"""{PAGES} SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN 'error' ELSE 'success' END AS status,
    CASE WHEN doc_id % 5 = 2 THEN 'Invalid image /in/' || doc_id || '_0.txt: Invalid file extension: txt' END AS error,
    CASE WHEN doc_id % 5 = 2 OR many OR one OR doc_id % 3 = 1 THEN NULL ELSE 'simple_vertical_aligned' END AS method,
    CASE WHEN doc_id % 5 <> 2 AND NOT many AND NOT one AND doc_id % 3 = 1 THEN 'Could not read image' END AS stitch_error,
    CASE WHEN doc_id % 5 = 2 OR (one AND NOT many) THEN NULL WHEN many THEN CASE WHEN doc_id % 7 = 3 THEN 11 ELSE 12 END WHEN doc_id % 3 = 1 THEN 2 END AS merged_from
    FROM (SELECT doc_id, doc_id % 11 = 5 AS many, doc_id % 7 = 3 AND doc_id % 11 <> 5 AS one FROM sized)""")
def api6_process_multiple(spark, sf_dir):
    """Receipts in parts, routed by outcome: invalid, stitched, read apart because a part cannot be decoded, alone, or in too
    many parts. Tests compare the texts."""
    done = batch.process_multiple(_parts(spark, sf_dir), painting.PageReader(), method="concat")
    return done.select("doc_id", "status", "error", "method", "stitch_error", F.col("merged_from").cast("int").alias("merged_from"))


@query("snk3_image_files", f"{PAGES} SELECT doc_id, width, height FROM sized")
def snk3_image_files(spark, sf_dir):
    """Painted pages written as PNG files, one a page, and decoded again by Spark's own reader of images."""
    path = scratch(spark, "images")
    shots = painting.photographs(conversation_pages(spark, sf_dir))
    write_images(shots.select(F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("name"), "content"), path)
    read = spark.read.format("image").option("recursiveFileLookup", "true").load(path).select("image.origin", "image.width", "image.height")
    return read.select(F.regexp_extract("origin", r"([^/]*)[.]png$", 1).cast("long").alias("doc_id"), "width", "height")


@query("src3_upload_stream", f"""{PAGES} SELECT doc_id || CASE WHEN doc_id % 4 = 1 THEN '.gif' ELSE '.png' END AS filename, CASE WHEN doc_id % 4 IN (1, 2) THEN 'error' WHEN n > 0 THEN 'success' ELSE 'no_text_found' END AS status,
    CASE doc_id % 4 WHEN 1 THEN 'Unsupported file type: gif' WHEN 2 THEN 'File is not an image' END AS error, CASE WHEN doc_id % 4 IN (1, 2) THEN 0 ELSE n END AS lines_detected FROM sized""")
def src3_upload_stream(spark, sf_dir):
    """Painted pages land as files, of which some have a wrong type or wrong bytes, and are read as a stream."""
    landing, out, state = (scratch(spark, name) for name in ("landing", "read", "state"))
    key = F.col("doc_id")
    shots = painting.photographs(conversation_pages(spark, sf_dir))
    name = F.concat(key.cast("string"), F.when(key % 4 == 1, ".GIF").otherwise(".PNG"))
    write_images(shots.select(name.alias("name"), F.when(key % 4 == 2, F.encode(F.lit("no picture"), "UTF-8")).otherwise(F.col("content")).alias("content")), landing)
    arrived = ingest.uploads(spark, landing)
    ingest.keep(ingest.read_uploads(arrived, painting.PageReader()), out, state).awaitTermination()
    return spark.read.parquet(out).select("filename", "status", "error", "lines_detected")
