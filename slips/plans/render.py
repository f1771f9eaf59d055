"""Receipts rendered from the star schema, so that parsing them back can be compared with plain SQL.

Each order becomes one receipt in one of six layouts, chosen by its key. Order lines are taken in a total order,
and prices are whole cents derived from the line, so that no item's price can equal the total or the tender.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slips.session import spread, table

STORES = ["MERCURY DRUG TAYTAY", "PUREGOLD CAINTA", "JOLLIBEE ORTIGAS", "NATIONAL BOOKSTORE MAIN", "CORNER TRADING", "SUNRISE GOODS"]
LAYOUTS = ["pharmacy_column", "supermarket", "fast_food", "department_store", "inline_price", "generic"]


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with a name and a price in cents, numbered within their order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    named = lines.join(part, lines.l_partkey == part.p_partkey)
    cents = F.pmod(F.round(F.col("l_extendedprice") * 100).cast("long"), F.lit(90_000)) + 100
    return named.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", F.upper("p_name").alias("name"), cents.alias("cents")).alias("x"))


def price_text(cents: Column) -> Column:
    return F.format_string("%d.%02d", F.floor(cents / 100).cast("long"), F.pmod(cents, F.lit(100)).cast("int"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, layout and lines: one shuffle by order key, then expressions over each order's own lines."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    grouped = spread(spark, order_lines(spark, sf_dir), "l_orderkey", table(spark, sf_dir, "lineitem").select("l_orderkey")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    total = F.aggregate(F.transform("xs", lambda x: x["cents"]), F.lit(0).cast("long"), lambda a, c: a + c)
    whole = grouped.join(orders, grouped.l_orderkey == orders.o_orderkey).withColumn("total", total + 10_000_007)
    kind = F.pmod("o_orderkey", F.lit(6)).cast("int")
    layout, store = F.get(F.array(*map(F.lit, LAYOUTS)), kind), F.get(F.array(*map(F.lit, STORES)), kind)

    def name(x):
        return F.concat(F.translate(x["name"], "0123456789", ""), F.lit(" K"), F.chr(x["l_linenumber"] % 26 + 65))

    def each(f) -> Column:
        return F.flatten(F.transform("xs", f))

    price = lambda x: price_text(x["cents"])
    body = (
        F.when(kind == 0, F.concat(F.array(F.lit("MOBILE/VIBER"), F.lit("PA99S/S")), each(lambda x: F.array(F.concat(price(x), F.lit("T")), name(x), F.lpad(x["l_partkey"].cast("string"), 12, "4")))))
        .when(kind == 1, F.concat(F.array(F.lit("PHP")), each(lambda x: F.array(name(x), price(x)))))
        .when(kind == 2, F.concat(F.array(F.lit("ORDER # 12"), F.lit("DINE IN")), each(lambda x: F.array(F.concat(F.lit("1 "), name(x), F.lit("   "), price(x))))))
        .when(kind == 3, each(lambda x: F.array(F.concat_ws("  ", name(x), F.lit("1"), price(x)))))
        .otherwise(each(lambda x: F.array(F.concat(name(x), F.lit("   "), price(x)))))
    )
    padding = F.when(kind == 5, F.array_repeat(F.lit("come see us at the corner"), F.size("xs") * 6)).otherwise(F.array().cast("array<string>"))
    end = F.array(F.lit("SUBTOTAL"))
    owed = price_text(F.col("total"))
    due = F.when(kind < 4, F.array(F.lit("GRAND TOTAL"), owed)).otherwise(F.array(F.concat(F.lit("GRAND TOTAL "), owed)))
    foot = F.array(F.concat(F.lit("INVOICE#"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")), F.concat(F.lit("DATE "), F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit(" 10:30 AM")))
    return whole.select(
        F.col("o_orderkey").alias("doc_id"), layout.alias("layout"),
        F.concat(F.array(store), F.when(kind == 5, F.array(F.lit("our thanks"))).otherwise(F.array().cast("array<string>")), body, end, padding, due, foot).alias("lines"),
    )


def boxes(docs: DataFrame) -> DataFrame:
    """Recognised lines with boxes for rendered receipts: one row of the page each, prices in a column of their own."""
    split = F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.split(x, " {2,}", 2).alias("cells")))
    cells = F.flatten(
        F.transform(split, lambda r: F.transform(r["cells"], lambda t, k: F.struct(r["i"].alias("row"), k.alias("col"), t.alias("text"))))
    )

    def box(c):
        x, y = (50 + c["col"] * 400).cast("double"), (c["row"] * 40 + c["col"] * 3).cast("double")
        right = x + F.char_length(c["text"]) * 8
        point = lambda a, b: F.array(a, b)
        return F.struct(
            (c["row"] * 2 + c["col"]).alias("line_no"), c["text"].alias("text"), (F.lit(0.9) + c["col"] * 0.05).alias("confidence"),
            F.array(point(x, y), point(right, y), point(right, y + 22), point(x, y + 22)).alias("bbox"),
        )

    return docs.select("doc_id", F.transform(cells, box).alias("lines"))


#: The same receipts in DuckDB: rendered(doc_id, kind, n, cents, lines) and ordered lines in ``xs`` (n, c, sku).
RENDER_SQL = """
    ol AS (SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_extendedprice AS ep, l_quantity AS q, upper(p_name) AS nm,
                  round(l_extendedprice * 100)::BIGINT % 90000 + 100 AS c FROM lineitem JOIN part ON l_partkey = p_partkey),
    op AS (SELECT k, ln, pk, sk, ep, q, nm, c, regexp_replace(nm, '[0-9]', '', 'g') || ' K' || chr((ln % 26 + 65)::INT) AS name,
                  (c // 100)::VARCHAR || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS price, lpad(pk::VARCHAR, 12, '4') AS sku FROM ol),
    og AS (SELECT k, list({'name': name, 'price': price, 'sku': sku} ORDER BY ln, pk, sk, ep, q, nm, c) AS xs, count(*) AS n, sum(c)::BIGINT + 10000007 AS cents FROM op GROUP BY k),
    oh AS (SELECT k AS doc_id, (k % 6)::INT AS kind, xs, n, cents, (cents // 100)::VARCHAR || '.' || lpad((cents % 100)::VARCHAR, 2, '0') AS owed,
                  lpad(k::VARCHAR, 9, '0') AS invoice, strftime(o_orderdate, '%m/%d/%Y') AS day FROM og JOIN orders ON k = o_orderkey),
    rendered AS (SELECT *, list_concat(
        [['MERCURY DRUG TAYTAY', 'PUREGOLD CAINTA', 'JOLLIBEE ORTIGAS', 'NATIONAL BOOKSTORE MAIN', 'CORNER TRADING', 'SUNRISE GOODS'][kind + 1]],
        CASE kind WHEN 0 THEN ['MOBILE/VIBER', 'PA99S/S'] WHEN 1 THEN ['PHP'] WHEN 2 THEN ['ORDER # 12', 'DINE IN'] WHEN 5 THEN ['our thanks'] ELSE [] END,
        CASE kind WHEN 0 THEN flatten([[x.price || 'T', x.name, x.sku] FOR x IN xs]) WHEN 1 THEN flatten([[x.name, x.price] FOR x IN xs])
                  WHEN 2 THEN ['1 ' || x.name || '   ' || x.price FOR x IN xs] WHEN 3 THEN [x.name || '  1  ' || x.price FOR x IN xs]
                  ELSE [x.name || '   ' || x.price FOR x IN xs] END,
        ['SUBTOTAL'], CASE kind WHEN 5 THEN ['come see us at the corner' FOR i IN range(n * 6)] ELSE [] END,
        CASE WHEN kind < 4 THEN ['GRAND TOTAL', owed] ELSE ['GRAND TOTAL ' || owed] END,
        ['INVOICE#' || invoice, 'DATE ' || day || ' 10:30 AM']) AS lines FROM oh)
"""
