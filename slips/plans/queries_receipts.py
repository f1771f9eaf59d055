"""Queries over receipts rendered from the star schema, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slips.functions import patterns
from slips.functions.text import clean_lines
from slips.operators import classify, correct, fields, files, geometry, ocr, orientation
from slips.plans import batch, painting, receipts, render
from slips.sources.readers import to_line_table
from slips.sources.writers import as_json

QUERIES: dict = {}
ORACLE: dict = {}
WITH = f"WITH {render.RENDER_SQL}"
KIND = "CASE WHEN kind = 0 THEN 'pharmacy_column' WHEN kind = 1 THEN 'supermarket' WHEN kind = 2 THEN 'fast_food' WHEN kind = 3 THEN 'department_store' WHEN kind = 4 AND n / (n + 5.0) >= 0.18 THEN 'inline_price' ELSE 'generic' END"
SURE = "CASE WHEN kind < 4 THEN 'high' WHEN kind = 4 AND n / (n + 5.0) >= 0.18 THEN 'medium' ELSE 'low' END"
MONEY = "'₱' || regexp_replace(owed, '^([0-9]+)([0-9]{3}[.].*)$', '\\1,\\2')"
ITEMS = "SELECT doc_id, kind, n, unnest(range(1, n + 1)) AS item_no, unnest(xs) AS x FROM rendered"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.receipts(spark, sf_dir)


def lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", clean_lines(F.col("lines")).alias("lines"))


@query("api2_receipts", f"""{WITH} SELECT doc_id, lines[1] AS store_name, invoice AS invoice_number, day AS date, '10:30 AM' AS time, {MONEY} AS total_amount,
    NULL::VARCHAR AS vat_amount, NULL::VARCHAR AS tin, n::INT AS item_count, false AS has_vat, 1.0::DOUBLE AS extraction_confidence,
    {KIND} AS receipt_type, {SURE} AS receipt_type_confidence, NULL::VARCHAR AS extraction_warning FROM rendered""")  # fmt: skip
def api2_receipts(spark, sf_dir):
    return receipts.extract(docs(spark, sf_dir)).drop("items")


@query("d6_items", f"""{WITH} SELECT doc_id, item_no::INT AS item_no, x.name AS name, x.price::DOUBLE AS price, 1 AS qty, NULL::DOUBLE AS unit_price,
    CASE WHEN kind = 0 THEN x.sku END AS sku FROM ({ITEMS})""")
def d6_items(spark, sf_dir):
    return receipts.item_rows(receipts.extract(docs(spark, sf_dir), ["doc_id", "items"]))


def _items_of(kind: int, layout: str):
    sql = f"{WITH} SELECT doc_id, item_no::INT AS item_no, x.name AS name, x.price::DOUBLE AS price FROM ({ITEMS}) WHERE kind = {kind} AND {KIND} = '{layout}'"

    def run(spark, sf_dir):
        own = docs(spark, sf_dir).where(F.col("layout") == layout)
        found = receipts.extract(own).where(F.col("receipt_type") == layout)
        return receipts.item_rows(found).select("doc_id", "item_no", "name", "price")

    return run, sql


for _name, _kind, _layout in (("itm29_pharmacy", 0, "pharmacy_column"), ("itm18_supermarket", 1, "supermarket"), ("itm9_fast_food", 2, "fast_food"), ("itm14_department", 3, "department_store"), ("itm7_inline_price", 4, "inline_price"), ("itm6_generic", 5, "generic")):
    QUERIES[_name], ORACLE[_name] = _items_of(_kind, _layout)


@query("src_line_table", f"{WITH} SELECT doc_id, len(lines)::INT AS n_lines, unnest(range(0, len(lines)))::INT AS line_no, unnest(lines) AS text FROM rendered")
def src_line_table(spark, sf_dir):
    return to_line_table(docs(spark, sf_dir))


@query("cls_classify", f"{WITH} SELECT doc_id, {KIND} AS receipt_type, {SURE} AS receipt_type_confidence FROM rendered")
def cls_classify(spark, sf_dir):
    return lined(spark, sf_dir).select("doc_id", classify.classify(F.col("lines")).alias("c")).select("doc_id", "c.*")


@query("cls2_chain", f"{WITH} SELECT doc_id, CASE WHEN kind < 4 THEN {KIND} END AS receipt_type FROM rendered")
def cls2_chain(spark, sf_dir):
    return lined(spark, sf_dir).select("doc_id", classify.by_chain(F.col("lines")).alias("receipt_type"))


@query("cls3_layout", f"{WITH} SELECT doc_id, CASE kind WHEN 0 THEN 'pharmacy_column' WHEN 1 THEN 'supermarket' WHEN 2 THEN 'fast_food' END AS receipt_type FROM rendered")
def cls3_layout(spark, sf_dir):
    return lined(spark, sf_dir).select("doc_id", classify.by_layout(F.col("lines")).alias("receipt_type"))


@query("cls5_line_shapes", rf"""{WITH} SELECT doc_id, len(list_filter(lines, lambda x: regexp_matches(x, '^[0-9,]+[.][0-9]{{2}}T?$')))::INT AS prices,
    len(list_filter(lines, lambda x: regexp_matches(x, '^.+  +[0-9,]+[.][0-9]{{2}}$')))::INT AS inline_prices FROM rendered""")
def cls5_line_shapes(spark, sf_dir):
    count = lambda test: F.size(F.filter("lines", test))
    return lined(spark, sf_dir).select("doc_id", count(classify.is_price_shape).alias("prices"), count(classify.is_inline_shape).alias("inline_prices"))


@query("fld1_store_name", f"{WITH} SELECT doc_id, lines[1] AS store_name FROM rendered")
def fld1_store_name(spark, sf_dir):
    return lined(spark, sf_dir).select("doc_id", fields.store_name(F.col("lines")).alias("store_name"))


@query("fld2_invoice", f"{WITH} SELECT doc_id, invoice AS invoice_number FROM rendered")
def fld2_invoice(spark, sf_dir):
    return lined(spark, sf_dir).select("doc_id", fields.invoice_number(F.col("lines")).alias("invoice_number"))


@query("fld3_date", f"{WITH} SELECT doc_id, day AS date FROM rendered")
def fld3_date(spark, sf_dir):
    return lined(spark, sf_dir).select("doc_id", fields.date(F.col("lines")).alias("date"))


@query("fld6_txn_date", f"{WITH} SELECT doc_id, strftime(strptime(day, '%m/%d/%Y'), '%m-%d-') || '25' AS date FROM rendered")
def fld6_txn_date(spark, sf_dir):
    day = F.regexp_extract(F.element_at("lines", -1), r"DATE (\d\d)/(\d\d)", 1), F.regexp_extract(F.element_at("lines", -1), r"DATE (\d\d)/(\d\d)", 2)
    squeezed = F.concat(F.lit("TXN#931799"), F.concat_ws("-", *day, F.lit("25")), F.lit(" 03:36P"))
    return lined(spark, sf_dir).select("doc_id", fields.txn_date(squeezed).alias("date"))


@query("fld8_time", f"{WITH} SELECT doc_id, '10:30 AM' AS time FROM rendered")
def fld8_time(spark, sf_dir):
    return lined(spark, sf_dir).select("doc_id", fields.time(F.col("lines")).alias("time"))


@query("fld9_total", f"{WITH} SELECT doc_id, owed::DOUBLE AS total FROM rendered")
def fld9_total(spark, sf_dir):
    price = fields.prices(F.col("lines"), F.lit("generic"))
    return lined(spark, sf_dir).withColumn("price", F.explode(F.array(price))).select("doc_id", fields.total(F.col("lines"), F.col("price")).alias("total"))


@query("fld11_vat", f"{WITH} SELECT doc_id, (cents % 9000 + 100) / 100.0::DOUBLE AS vat, '000-388-474-' || lpad((doc_id % 100000)::VARCHAR, 5, '0') AS tin FROM rendered")
def fld11_vat(spark, sf_dir):
    owed = F.pmod(F.regexp_replace(F.array_max(F.filter("lines", lambda x: x.rlike(r"^(GRAND TOTAL )?1\d{5}\.\d\d$"))), r"[^0-9]", "").cast("long"), F.lit(9000)) + 100
    tax = F.concat(F.lit("VAT - 12%  "), render.price_text(owed))
    tin = F.concat(F.lit("VAT REG TIN : 000-388-474-"), F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0"))
    more = lined(spark, sf_dir).select("doc_id", F.concat("lines", F.array(tax, tin)).alias("lines"))
    none = F.array_repeat(F.lit(None).cast("double"), F.size("lines"))
    return more.select("doc_id", fields.vat(F.col("lines"), none).alias("vat"), fields.tin(F.col("lines")).alias("tin"))


@query("fld14_confidence", f"{WITH} SELECT doc_id, round(0.8 - 0.1 * (doc_id % 2) - 0.25 * (doc_id % 3 = 0)::INT, 2)::DOUBLE AS confidence FROM rendered")
def fld14_confidence(spark, sf_dir):
    some = lambda test: F.when(test, "x")
    score = fields.confidence(F.lit("s"), some(F.col("doc_id") % 3 != 0), some(F.col("doc_id") % 2 == 0), F.lit(0), F.lit("i"))
    return docs(spark, sf_dir).select("doc_id", score.alias("confidence"))


@query("fld18_simple_metadata", f"{WITH} SELECT doc_id, lines[1] AS merchant_name, CASE WHEN kind >= 4 THEN owed::DOUBLE END AS total, day AS date, 0 AS items_count FROM rendered")
def fld18_simple_metadata(spark, sf_dir):
    return lined(spark, sf_dir).select("doc_id", fields.simple_metadata(F.col("lines")).alias("m")).select("doc_id", "m.*")


@query("val1_item_sum_warning", f"""{WITH} SELECT doc_id, CASE WHEN doc_id % 2 = 1 AND kind <> 5 AND cents - 10000007 > 150 THEN 'item_sum_exceeds_total' END AS extraction_warning FROM rendered""")
def val1_item_sum_warning(spark, sf_dir):
    """Receipts with one more total on odd keys, too small for their items; the generic layout takes the first total it sees."""
    less = F.when(F.col("doc_id") % 2 == 1, F.array(F.lit("GRAND TOTAL 1.00"))).otherwise(F.array().cast("array<string>"))
    return receipts.extract(docs(spark, sf_dir).select("doc_id", F.concat("lines", less).alias("lines")), ["doc_id", "extraction_warning"])


def _hits(text: str, words: list[str]) -> str:
    """SQL: how many of the words occur in upper-cased text."""
    listed = ", ".join("'" + w.upper().replace("'", "''") + "'" for w in words)
    return f"len(list_filter([{listed}], lambda k: contains({text}, k)))"


def _turned(lines: str) -> str:
    """SQL: 0 or 180, from the keywords in the first and the last third of the lines."""
    top, bottom = f"upper(array_to_string({lines}[1:len({lines}) // 3], ' '))", f"upper(array_to_string({lines}[len({lines}) * 2 // 3 + 1:], ' '))"
    header, footer = patterns.HEADER_KEYWORDS, patterns.FOOTER_KEYWORDS
    return f"CASE WHEN len({lines}) >= 4 AND {_hits(top, header)} = 0 AND ({_hits(top, footer)} >= 1 OR {_hits(bottom, header)} >= 1) THEN 180 ELSE 0 END"


@query("rot1_text_orientation", f"{WITH} SELECT doc_id, {_turned('r')} AS turned, {_turned('l')} AS upright FROM (SELECT doc_id, lines AS l, list_reverse(lines) AS r FROM rendered)")
def rot1_text_orientation(spark, sf_dir):
    own = lined(spark, sf_dir)
    return own.select("doc_id", orientation.text_orientation(F.reverse("lines")).alias("turned"), orientation.text_orientation(F.col("lines")).alias("upright"))


_CELLS = r"""SELECT doc_id, unnest([{'t': upper(regexp_extract(x, '^(.*?)(?:  +|$)', 1)), 'y': i * 40}] || CASE WHEN regexp_matches(x, '  +')
    THEN [{'t': upper(regexp_extract(x, '^.*?  +(.*)$', 1)), 'y': i * 40 + 3}] ELSE [] END) AS c FROM (SELECT doc_id, unnest(lines) AS x, unnest(range(0, len(lines))) AS i FROM rendered)"""


@query("rot3_spatial_orientation", f"""{WITH} SELECT doc_id, CASE WHEN ht = 0 AND (ft >= 1 OR hb >= 1) THEN 180 ELSE 0 END AS upright,
    CASE WHEN hb = 0 AND (fb >= 1 OR ht >= 1) THEN 180 ELSE 0 END AS turned FROM (SELECT doc_id,
    sum(CASE WHEN m < tall * 0.35::DOUBLE THEN h ELSE 0 END) AS ht, sum(CASE WHEN m > tall * 0.65::DOUBLE THEN h ELSE 0 END) AS hb,
    sum(CASE WHEN m < tall * 0.35::DOUBLE THEN f ELSE 0 END) AS ft, sum(CASE WHEN m > tall * 0.65::DOUBLE THEN f ELSE 0 END) AS fb
    FROM (SELECT doc_id, c.y + 11.0::DOUBLE AS m, max(c.y + 22.0::DOUBLE) OVER (PARTITION BY doc_id) AS tall, {_hits('c.t', patterns.HEADER_KEYWORDS)} AS h, {_hits('c.t', patterns.FOOTER_KEYWORDS)} AS f FROM ({_CELLS})) GROUP BY doc_id)""")  # fmt: skip
def rot3_spatial_orientation(spark, sf_dir):
    boxed = render.boxes(docs(spark, sf_dir))
    tall = F.array_max(F.transform("lines", lambda x: F.get(F.get(x["bbox"], 2), 1)))
    flip = lambda x: x.withField("bbox", F.transform(x["bbox"], lambda p: F.array(F.get(p, 0), tall - F.get(p, 1))))
    return boxed.select(
        "doc_id", orientation.spatial_orientation(F.col("lines"), tall).alias("upright"), orientation.spatial_orientation(F.transform("lines", flip), tall).alias("turned")
    )


ROWS = """SELECT doc_id, i + 1 AS row_number, x, regexp_split_to_array(x, '  +') AS cells, i FROM (SELECT doc_id, unnest(lines) AS x, unnest(range(0, len(lines))) AS i FROM rendered)"""


@query("geo_rows", f"""{WITH} SELECT doc_id, row_number::INT AS row_number, cells[1] || CASE WHEN len(cells) > 1 THEN '  ' || substr(x, length(cells[1]) + length(regexp_extract(x, '(  +)', 1)) + 1) ELSE '' END AS text,
    least(len(cells), 2)::INT AS item_count, least(len(cells), 2)::INT AS columns, CASE WHEN len(cells) > 1 THEN 0.925 ELSE 0.9 END::DOUBLE AS confidence, (i * 40)::DOUBLE AS y_position FROM ({ROWS})""")  # fmt: skip
def geo_rows(spark, sf_dir):
    boxed = render.boxes(docs(spark, sf_dir))
    return boxed.select("doc_id", F.explode(geometry.rows(F.col("lines"))).alias("r")).select("doc_id", "r.row_number", "r.text", "r.item_count", "r.columns", "r.confidence", "r.y_position")


@query("geo7_sections")
def geo7_sections(spark, sf_dir):
    boxed = render.boxes(docs(spark, sf_dir))
    return boxed.select("doc_id", F.explode(geometry.sections(geometry.rows(F.col("lines")))).alias("s")).select("doc_id", "s.type", "s.start_row", "s.end_row")


ORACLE["geo7_sections"] = f"""{WITH} SELECT doc_id, 'header' AS type, 1 AS start_row, least(5, len(lines))::INT AS end_row FROM rendered
    UNION ALL SELECT doc_id, 'footer', greatest(5, len(lines) - 5)::INT + 1, len(lines)::INT FROM rendered WHERE len(lines) > 5
        AND len(list_filter(lines[greatest(5, len(lines) - 5) + 1:], lambda x: contains(x, 'TOTAL'))) > 0
    UNION ALL SELECT doc_id, 'items', 6, (len(lines) - 5)::INT FROM rendered WHERE len(lines) > 10"""


@query("geo10_structure", f"""{WITH} SELECT doc_id, len(lines)::INT AS total_rows, (len(lines) > 10) AS has_items,
    ((len(lines) + len(list_filter(lines, lambda x: regexp_matches(x, '  +')))) / len(lines))::DOUBLE AS average_items_per_row FROM rendered""")
def geo10_structure(spark, sf_dir):
    done = geometry.format_receipts(render.boxes(docs(spark, sf_dir)))
    return done.select("doc_id", "structure.total_rows", "structure.has_items", "structure.average_items_per_row")


@query("geo8_merged_rows", rf"""{WITH} SELECT doc_id, count(*) FILTER (p AND NOT coalesce(nxt, true))::INT AS merged FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
    FROM (SELECT doc_id, i, regexp_matches(regexp_replace(x, ' {{2,}}([0-9])', '  $\1', 'g'), '[$][0-9]+[.][0-9]{{2}}') AS p
    FROM (SELECT doc_id, unnest(lines) AS x, unnest(range(0, len(lines))) AS i FROM rendered))) GROUP BY doc_id""")
def geo8_merged_rows(spark, sf_dir):
    """Receipts priced in dollars on tight rows: a row with a price takes in the row after it that has none."""
    own = docs(spark, sf_dir).select("doc_id", F.transform("lines", lambda x: F.regexp_replace(x, r" {2,}(\d)", r"  \$$1")).alias("lines"))
    tight = lambda x: x.withField("bbox", F.transform(x["bbox"], lambda p: F.array(F.get(p, 0), F.get(p, 1) * 0.75)))
    rows = geometry.rows(F.transform("lines", tight))
    merged = render.boxes(own).select("doc_id", F.explode(F.array(rows)).alias("rows")).select("doc_id", geometry.merged(F.col("rows")).alias("m"))
    return merged.select("doc_id", F.size(F.filter("m", lambda r: F.coalesce(r["merged"], F.lit(False)))).alias("merged"))


# --- Recognised pages: every seventh cannot be read; names and prices are lines of their own -----------

PAGE = "replace(array_to_string([regexp_replace(x, '  +', chr(10)) FOR x IN lines], chr(10)), 'BOOKSTORE', 'BOOK STORE')"
SEEN = "(len(lines) + len(list_filter(lines, lambda x: regexp_matches(x, '  +'))))::INT"
# What a page's receipt looks like once its lines have been corrected: the chain of kind 3 is no longer known.
PAGE_KIND = "CASE WHEN kind = 0 OR kind = 4 OR kind = 3 AND n = 1 THEN 'pharmacy_column' WHEN kind = 1 THEN 'supermarket' WHEN kind = 2 THEN 'fast_food' WHEN kind = 3 THEN 'inline_price' ELSE 'generic' END"
PAGE_SURE = "CASE WHEN kind < 3 THEN 'high' WHEN kind < 5 THEN 'medium' ELSE 'low' END"
HAS_ITEMS = "kind IN (0, 1, 2, 4)"
READ = f"""replace(lines[1], 'BOOKSTORE', 'BOOK STORE') AS store_name, invoice AS invoice_number, day AS date, '10:30 AM' AS time, {MONEY} AS total_amount,
    (CASE WHEN {HAS_ITEMS} THEN n ELSE 0 END)::INT AS item_count, {PAGE_KIND} AS receipt_type, {PAGE_SURE} AS receipt_type_confidence,
    (CASE WHEN {HAS_ITEMS} THEN 1.0 ELSE 0.8 END)::DOUBLE AS extraction_confidence"""
PAGE_ITEMS = f"""SELECT doc_id, item_no::INT AS item_no, CASE WHEN kind = 2 THEN '1 ' ELSE '' END || x.name AS name, x.price::DOUBLE AS price, 1 AS qty, CASE WHEN kind = 0 THEN x.sku END AS sku
    FROM ({ITEMS}) WHERE {HAS_ITEMS}"""
METADATA = ["store_name", "invoice_number", "date", "time", "total_amount", "item_count", "receipt_type", "receipt_type_confidence", "extraction_confidence"]


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    unread = F.when(F.col("doc_id") % 7 == 0, "unreadable")
    return render.boxes(docs(spark, sf_dir)).withColumns({"error": unread, "processing_time_ms": F.lit(3).cast("long")})


@query("api1_scan", f"""{WITH} SELECT doc_id, CASE WHEN bad THEN 'error' ELSE 'success' END AS status, CASE WHEN bad THEN '' ELSE {PAGE} END AS text,
    CASE WHEN bad THEN 0 ELSE {SEEN} END AS lines_detected, CASE WHEN bad THEN 'unreadable' END AS error FROM (SELECT *, doc_id % 7 = 0 AS bad FROM rendered)""")
def api1_scan(spark, sf_dir):
    return batch.scan(pages(spark, sf_dir)).select("doc_id", "status", "text", "lines_detected", "error")


@query("api2_scan_with_metadata", f"""{WITH} SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'error' ELSE 'success' END AS status, m.* EXCLUDE (doc_id, item_count), coalesce(item_count, 0) AS item_count FROM (SELECT doc_id FROM rendered) LEFT JOIN
    (SELECT doc_id, {READ} FROM rendered WHERE doc_id % 7 <> 0) m USING (doc_id)""")
def api2_scan_with_metadata(spark, sf_dir):
    read = batch.scan_with_metadata(pages(spark, sf_dir), ["doc_id"], METADATA).select("doc_id", "status", *(F.col(f"metadata.{c}").alias(c) for c in METADATA))
    return read.withColumn("item_count", F.coalesce("item_count", F.lit(0)))


@query("api2_scan_items", f"{WITH} {PAGE_ITEMS} AND doc_id % 7 <> 0")
def api2_scan_items(spark, sf_dir):
    read = batch.scan_with_metadata(pages(spark, sf_dir), ["doc_id"], ["items"]).where("metadata is not null").select("doc_id", "metadata.items")
    return receipts.item_rows(read).select("doc_id", "item_no", "name", "price", "qty", "sku")


@query("api3_scan_multiple", f"""{WITH} SELECT doc_id, {READ} FROM rendered WHERE doc_id % 5 <> 0 UNION ALL
    SELECT doc_id, NULL, NULL, NULL, NULL, NULL, 0, 'generic', 'low', 0.0 FROM rendered WHERE doc_id % 5 = 0""")
def api3_scan_multiple(spark, sf_dir):
    """Pages that come in two halves; every fifth comes in one, which is too few."""
    boxed = render.boxes(docs(spark, sf_dir))
    half = F.when(F.col("doc_id") % 5 == 0, F.size("lines")).otherwise(F.floor(F.size("lines") / 2).cast("int"))
    part = lambda no, lines: F.struct(F.lit(no).alias("part_no"), lines.alias("lines"))
    halves = F.array(part(1, F.slice("lines", 1, half)), part(2, F.slice("lines", half + 1, F.size("lines"))))
    parts = boxed.select("doc_id", F.explode(halves).alias("p")).select("doc_id", "p.*").where("size(lines) > 0")
    parts = parts.withColumns({"error": F.lit(None).cast("string"), "processing_time_ms": F.lit(2).cast("long")})
    read = parts.select("*", F.struct("doc_id", "part_no").alias("key")).drop("doc_id").withColumnRenamed("key", "doc_id")
    results = batch.scan(read).select("doc_id.doc_id", "doc_id.part_no", "status", "lines", "processing_time_ms")
    return batch.scan_multiple(results, METADATA)


@query("ocr2_second_pass", f"{WITH} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {SEEN} ELSE 1 END AS n FROM rendered")
def ocr2_second_pass(spark, sf_dir):
    """Pages whose small lines, on even keys, make the reader look again; the first look sees one row only."""
    boxed = render.boxes(docs(spark, sf_dir))
    small = F.col("doc_id") % 2 == 0
    sizes = [(boxed.where(small), 0.5, painting.CELL), (boxed.where(~small), 1.0, (22, 8))]
    read = [ocr.recognise(painting.photographs(painting.lined(b, scale)), painting.PageReader(cell, 1), painting.PageReader(cell)) for b, scale, cell in sizes]
    return read[0].unionByName(read[1]).select("doc_id", F.size("lines").alias("n"))


@query("api5_process", f"""{WITH} SELECT doc_id, CASE WHEN bad OR broken THEN 'error' ELSE 'success' END AS status, CASE WHEN bad THEN 'Invalid file extension: txt' WHEN broken THEN 'broken' END IS NOT NULL AS failed,
    CASE WHEN bad OR broken THEN 0 ELSE {SEEN} END AS lines_detected, CASE WHEN NOT bad AND NOT broken THEN replace(lines[1], 'BOOKSTORE', 'BOOK STORE') END AS merchant_name,
    CASE WHEN NOT bad AND NOT broken THEN {MONEY} END AS total FROM (SELECT *, doc_id % 9 = 0 AS bad, doc_id % 11 = 0 AS broken FROM rendered)""")
def api5_process(spark, sf_dir):
    """Files to receipts in a batch: a wrong extension or a broken image is that file's error only."""
    key = F.col("doc_id")
    pages = painting.photographs(painting.lined(render.boxes(docs(spark, sf_dir)), 0.5))
    torn = F.when(key % 11 == 0, F.substring("content", 1, 20)).otherwise(F.col("content"))
    images = pages.select("doc_id", F.concat(F.lit("/in/"), key.cast("string"), F.when(key % 9 == 0, ".txt").otherwise(".png")).alias("path"), torn.alias("content"))
    listed = batch.batch_items(batch.process_images(images, painting.PageReader(), fields=["store_name", "total_amount"]))
    return listed.select("doc_id", "status", F.col("error").isNotNull().alias("failed"), "lines_detected", "merchant_name", "total")


@query("ocr_assemble", f"""{WITH} SELECT doc_id, 'success' AS status, len(list_filter(cells, lambda c: c > 0))::INT AS rows_seen FROM (SELECT doc_id, [1 FOR x IN lines] AS cells FROM rendered)""")
def ocr_assemble(spark, sf_dir):
    boxed = render.boxes(docs(spark, sf_dir)).withColumns({"error": F.lit(None).cast("string"), "processing_time_ms": F.lit(1).cast("long")})
    done = ocr.assemble(boxed)
    rows = F.size(F.array_distinct(F.transform("lines", lambda x: F.floor((x["position"]["top"]) / 40))))
    return done.select("doc_id", "status", rows.alias("rows_seen"))


@query("ocr4_mean_height", f"{WITH} SELECT doc_id, 22.0::DOUBLE AS height, false AS retry FROM rendered")
def ocr4_mean_height(spark, sf_dir):
    boxed = render.boxes(docs(spark, sf_dir))
    return boxed.select("doc_id", ocr.mean_height(F.col("lines")).alias("height"), ocr.wants_retry(F.col("lines")).alias("retry"))


@query("ocr5_better_pass", f"{WITH} SELECT doc_id, (CASE WHEN doc_id % 2 = 0 THEN len(lines) + len(list_filter(lines, lambda x: regexp_matches(x, '  +'))) ELSE 1 END)::INT AS n FROM rendered")
def ocr5_better_pass(spark, sf_dir):
    """Small boxes on even keys call for the second pass, which finds all lines where the first found one."""
    boxed = render.boxes(docs(spark, sf_dir))
    small = lambda x: x.withField("bbox", F.transform(x["bbox"], lambda p: F.array(F.get(p, 0), F.get(p, 1) * F.when(F.col("doc_id") % 2 == 0, 0.5).otherwise(1.0))))
    plain = F.slice(F.transform("lines", small), 1, 1)
    return boxed.select("doc_id", F.size(ocr.better_pass(plain, F.col("lines"))).alias("n"))


@query("ocr10_merge_results", f"""{WITH} SELECT doc_id, 'success' AS status, (len(lines) + len(list_filter(lines, lambda x: regexp_matches(x, '  +'))))::INT AS lines_detected, 5::BIGINT AS processing_time_ms, 3::BIGINT AS merged_from FROM rendered""")
def ocr10_merge_results(spark, sf_dir):
    boxed = render.boxes(docs(spark, sf_dir))
    part = lambda no, lines, status, ms: F.struct(F.lit(no).alias("part_no"), F.lit(status).alias("status"), lines.alias("lines"), F.lit(ms).cast("long").alias("processing_time_ms"))
    half = F.floor(F.size("lines") / 2).cast("int")
    split = F.array(
        part(2, F.slice("lines", half + 1, F.size("lines")), "success", 3), part(1, F.slice("lines", 1, half), "success", 2), part(3, F.col("lines"), "error", 9)
    )
    parts = boxed.select("doc_id", F.explode(split).alias("p")).select("doc_id", "p.*")
    return ocr.merge_results(parts).select("doc_id", "status", "lines_detected", "processing_time_ms", "merged_from")


@query("cor_symbols", f"""{WITH} SELECT doc_id, ['₱' || owed, '₱' || owed, '2 × ' || owed, '12-' || doc_id::VARCHAR, 'PDR ' || invoice, 'ID# : ' || invoice, 'MTN ' || owed] AS fixed FROM rendered""")
def cor_symbols(spark, sf_dir):
    owed, key, invoice = F.regexp_extract(F.array_join("lines", " "), r"(1\d{5}\.\d\d)", 1), F.col("doc_id").cast("string"), F.lpad(F.col("doc_id").cast("string"), 9, "0")
    c = F.concat
    broken = F.array(c(F.lit("P "), owed), c(F.lit("¥"), owed), c(F.lit("2 x "), owed), c(F.lit("12_"), key), c(F.lit("PDR "), invoice), c(F.lit("ID#"), invoice), c(F.lit("MIN "), owed))
    return lined(spark, sf_dir).select("doc_id", correct.correct_lines(broken).alias("fixed"))


@query("cor5_confusions", f"{WITH} SELECT doc_id, '2' || regexp_replace(doc_id::VARCHAR, '.', '0', 'g') || '5 1' || CASE WHEN length(doc_id::VARCHAR) % 2 = 1 THEN '0' ELSE '0' END || '0A' AS fixed FROM rendered")
def cor5_confusions(spark, sf_dir):
    """Runs of O after a digit are repaired one by one only where a digit follows: odd runs keep their letters."""
    broken = F.concat(F.lit("2"), F.regexp_replace(F.col("doc_id").cast("string"), ".", "0"), F.lit("5 1O0A"))
    return docs(spark, sf_dir).select("doc_id", correct.confusions(broken).alias("fixed"))


@query("cor_words", f"""{WITH} SELECT doc_id, ['BOOK STORE ' || n, 'Mc Donald''s', 'SAN Fernando', 'Salamat po', 'Telephone ' || n, doc_id + 10000 || ' Bitty'] AS fixed FROM rendered""")
def cor_words(spark, sf_dir):
    n, key = F.size(F.filter("lines", lambda x: x.rlike(" K[A-Z](   | *$|  1  )"))).cast("string"), (F.col("doc_id") + 10000).cast("string")
    c = F.concat
    broken = F.array(c(F.lit("BOOKSTORE "), n), F.lit("McDonald's"), F.lit("SANFernando"), F.lit("Sa lamat po"), c(F.lit("Tele phone "), n), c(key, F.lit("Bitty")))
    return lined(spark, sf_dir).select("doc_id", correct.correct_lines(broken).alias("fixed"))


@query("cor19_report", f"{WITH} SELECT doc_id, 3 AS total_lines, 2 AS lines_corrected, (2 / 3)::DOUBLE AS correction_rate, [1, 3] AS line_numbers, ['spacing_added', 'character_swap_O_0'] AS change_types FROM rendered")
def cor19_report(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    lines = F.array(F.lit("Tel eFax"), key, F.concat(F.lit("2O5"), key))
    found = correct.correction_report(docs(spark, sf_dir).select("doc_id", lines.alias("lines")))
    return found.select("doc_id", "total_lines", "lines_corrected", "correction_rate", F.transform("corrections", lambda c: c["line_number"]).alias("line_numbers"), F.transform("corrections", lambda c: c["change_type"]).alias("change_types"))


@query("enh_lines", f"""{WITH} SELECT doc_id, ['TEL NO : (044) 815-1340', '** ' || n || ' item(s) **', 'VAT 12%', 'PWD ID# : 7', 'NIDO5+PDR', '5% x 1220', 'Acct''d No.:8042', 'MTN : 7'] AS fixed FROM rendered""")
def enh_lines(spark, sf_dir):
    n = F.size(F.filter("lines", lambda x: x.rlike(" K[A-Z](   | *$|  1  )"))).cast("string")
    raw = F.array(F.lit("TELNO044815-1340"), F.concat(F.lit("**"), n, F.lit("items **")), F.lit("VAT-12%"), F.lit("PWDID#7"), F.lit("NID05+PDR"), F.lit("5%x1220"), F.lit("Accred No.:8042"), F.lit("MIN : 7"))
    return lined(spark, sf_dir).select("doc_id", correct.enhance_lines(raw).alias("fixed"))


@query("enh24_report", f"{WITH} SELECT doc_id, true AS enhanced, 2 AS total_lines, [0, 1] AS changes FROM rendered")
def enh24_report(spark, sf_dir):
    return correct.enhancement_report(docs(spark, sf_dir).select("doc_id", F.array(F.lit("ABC"), F.lit("VAT-12%")).alias("lines")))


@query("utl11_display", f"{WITH} SELECT doc_id, owed::DOUBLE AS total, n::INT AS units FROM rendered")
def utl11_display(spark, sf_dir):
    got = receipts.extract(docs(spark, sf_dir), ["doc_id", "total_amount", "items", "item_count"])
    return got.select("doc_id", files.display_total(F.col("total_amount"), F.col("items")).alias("total"), files.display_units(F.col("item_count"), F.col("items")).alias("units"))


@query("snk1_json", f"""{WITH} SELECT doc_id, '{{"doc_id":' || doc_id || ',"receipt_type":"' || {KIND} || '","item_count":' || n || '}}' AS json FROM rendered""")
def snk1_json(spark, sf_dir):
    return as_json(receipts.extract(docs(spark, sf_dir), ["doc_id", "receipt_type", "item_count"]))
