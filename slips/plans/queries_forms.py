"""Receipts whose lines take the form that each order line's own numbers choose, and whose sums are true.

Names and prices stand on one line or on two, with a count, a quantity line or a barcode; the tender's change may equal an
item's price, which then counts as no item; a pharmacy's receipt may state fewer items than it has, or lack one price. SQL
derives from the tables what each layout's plan must read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slips.functions.text import clean_lines
from slips.operators import correct, fields, items
from slips.plans import receipts, render
from slips.session import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return register


def bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, kind, v and the order's lines ``xs`` in order: name, sku, form, count, amount in cents; and total, change and paid."""
    grouped = render.order_lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    seen = grouped.select("k", "xs", F.pmod("k", F.lit(6)).alias("kind"), F.pmod(F.floor(F.col("k") / 6), F.lit(3)).alias("v"))

    def one(x):
        form, q = F.pmod(x["l_partkey"], F.lit(4)), x["l_quantity"].cast("int")
        mark = F.when((F.col("kind") == 0) & (F.col("v") == 2) & (F.pmod(x["l_partkey"], F.lit(2)) == 0), " #").otherwise(" K")
        return F.struct(
            F.concat(F.translate(x["name"], "0123456789", ""), mark, F.chr(x["l_linenumber"] % 26 + 65)).alias("name"),
            F.lpad(x["l_partkey"].cast("string"), 12, "4").alias("sku"), form.alias("form"), q.alias("q"), x["cents"].alias("unit"),
            F.when((F.col("kind") == 1) & (form == 3), x["cents"] * q).otherwise(x["cents"]).alias("cents"),
        )

    priced = seen.withColumn("xs", F.transform("xs", one))
    total = F.aggregate("xs", F.lit(0).cast("long"), lambda a, x: a + x["cents"])
    summed = priced.withColumns({"total": total, "change": F.when(F.pmod(F.floor(F.col("k") / 18), F.lit(2)) == 0, F.get("xs", 0)["cents"]).otherwise(0)})
    return summed.withColumn("paid", F.col("total") + F.col("change"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, receipt_type and lines."""
    kind, v, k, n = F.col("kind"), F.col("v"), F.col("k"), F.size("xs")
    price = lambda x: render.price_text(x["cents"])
    joined = lambda x: F.concat(x["name"], F.lit("   "), price(x))
    on_two = lambda x: F.array(x["name"], price(x))

    def form(*of) -> Column:
        """Lines of each order line: the form that its part's key chooses."""
        chosen = lambda x: F.coalesce(*(F.when(x["form"] == i, f(x)) for i, f in enumerate(of)), of[0](x))
        return F.flatten(F.transform("xs", chosen))

    coded = lambda x: F.array(x["name"], x["sku"])
    body = (
        F.when((kind == 0) & (v == 0), form(lambda x: F.concat(F.array(price(x)), coded(x))))
        .when((kind == 0) & (v == 1), F.flatten(F.transform("xs", lambda x, i: F.concat(F.when(i + 1 < n, F.array(F.concat(price(x), F.lit("T")))).otherwise(F.array().cast("array<string>")), coded(x)))))
        .when(kind == 0, form(lambda x: F.concat(F.array(F.concat(price(x), F.lit("T"))), coded(x))))
        .when(kind == 1, form(lambda x: F.array(joined(x)), on_two, lambda x: F.array(x["name"], x["sku"], price(x)), lambda x: F.array(x["name"], F.concat(x["q"], F.lit(" @ "), render.price_text(x["unit"])), price(x))))
        .when(kind == 2, form(lambda x: F.array(F.concat(x["q"], F.lit(" "), joined(x))), on_two, lambda x: F.array(joined(x))))
        .when(kind == 3, form(lambda x: F.array(F.concat_ws("  ", x["name"], x["q"].cast("string"), price(x))), on_two, lambda x: F.array(joined(x))))
        .when(kind == 4, form(lambda x: F.array(joined(x)), on_two, lambda x: F.array(x["name"], price(x), x["sku"])))
        .otherwise(form(lambda x: F.array(joined(x))))
    )
    head = F.when(kind == 0, F.array(F.lit("MOBILE/VIBER"), F.lit("PA99S/S"))).when(kind == 1, F.array(F.lit("PHP"))).when(kind == 2, F.array(F.lit("ORDER # 12"), F.lit("DINE IN"))).otherwise(F.array().cast("array<string>"))
    due = F.array(F.lit("SUBTOTAL"), F.lit("GRAND TOTAL"), render.price_text(F.col("total")))
    tender = F.array(F.lit("CASH"), render.price_text(F.col("paid")), F.lit("CHANGE"), render.price_text(F.col("change")))
    stated, style = F.greatest(n - 1, F.lit(1)).cast("string"), F.pmod(F.floor(k / 18), F.lit(4))
    count = (
        F.when(style == 0, F.array(F.concat(F.lit("** "), stated, F.lit(" item(s) **"))))
        .when(style == 1, F.array(F.lit("*"), F.concat(stated, F.lit(" item")), F.lit("*")))
        .when(style == 2, F.array(F.concat(stated, F.lit("item"))))
        .otherwise(F.array(F.concat(F.lit("ITEMS PURCHASED: "), stated)))
    )
    foot = F.when((kind > 0) | (v == 0), tender).when(v == 2, count).otherwise(F.array().cast("array<string>"))
    store, layout = (F.get(F.array(*map(F.lit, x)), kind.cast("int")) for x in (render.STORES, render.LAYOUTS))
    return bought(spark, sf_dir).select(k.alias("doc_id"), layout.alias("receipt_type"), F.concat(F.array(store), head, body, due, foot).alias("lines"))


#: Order lines in DuckDB with what the receipts above print of them; ``i`` numbers them, ``skipped`` are no items by their price.
FORMS_SQL = f"""
    {render.RENDER_SQL},
    fl AS (SELECT k, k % 6 AS kind, k // 6 % 3 AS v, name, sku, pk % 4 AS form, q::INT AS q, c AS unit, pk,
                  CASE WHEN k % 6 = 1 AND pk % 4 = 3 THEN c * q::INT ELSE c END AS a,
                  row_number() OVER (PARTITION BY k ORDER BY ln, pk, sk, ep, q, nm, c) AS i FROM op),
    ft AS (SELECT *, sum(a) OVER w::BIGINT AS total, count(*) OVER w AS n, CASE WHEN k // 18 % 2 = 0 THEN min_by(a, i) OVER w ELSE 0 END AS change FROM fl WINDOW w AS (PARTITION BY k)),
    fs AS (SELECT *, a IN (change, total, total + change) AS skipped FROM ft),
    plain AS (SELECT k, kind, i, name, a, CASE WHEN form = 3 AND kind = 1 OR form IN (0, 3) AND kind IN (2, 3) THEN q ELSE 1 END AS qty,
                     CASE WHEN form = 3 AND kind = 1 THEN unit END AS unit, CASE WHEN form = 2 AND kind IN (1, 4) THEN sku END AS sku
              FROM fs WHERE kind > 0 AND NOT skipped)
"""
LAYOUT_NAMES = "['" + "', '".join(render.LAYOUTS) + "']"


def read(spark: SparkSession, sf_dir: str, where: Column) -> DataFrame:
    """Items that each layout's plan reads."""
    seen = pages(spark, sf_dir).where(where).select("doc_id", clean_lines(F.col("lines")).alias("lines"), "receipt_type")
    return receipts.item_rows(receipts.with_items(seen)).drop("src")


def pharmacy(v: int) -> Column:
    return (F.col("receipt_type") == "pharmacy_column") & (F.pmod(F.floor(F.col("doc_id") / 6), F.lit(3)) == v)


@query("itm_forms", f"""WITH {FORMS_SQL} SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY i)::INT AS item_no, name, a / 100.0::DOUBLE AS price, qty::INT AS qty,
    unit / 100.0::DOUBLE AS unit_price, sku FROM plain""")  # fmt: skip
def itm_forms(spark, sf_dir):
    """Every layout but the pharmacies': items on one line and on several, and amounts of the tender that are none."""
    return read(spark, sf_dir, F.col("receipt_type") != "pharmacy_column")


@query("itm30_skip_prices", f"""WITH {FORMS_SQL},
    mine AS (SELECT * FROM fs WHERE kind = 0 AND v = 0),
    lone AS (SELECT k, any_value(total) AS total, any_value(change) AS change, any_value(a) AS a, any_value(name) AS name, any_value(sku) AS sku
             FROM mine WHERE skipped GROUP BY k HAVING count(*) = 1),
    amounts AS (SELECT k, a FROM mine UNION ALL SELECT k, unnest([total, total + change, change]) FROM mine WHERE i = 1),
    least AS (SELECT lone.k, min(amounts.a) AS m FROM lone JOIN amounts ON lone.k = amounts.k AND amounts.a > 0 AND amounts.a >= lone.total - lone.a GROUP BY lone.k),
    found AS (SELECT k, 0 AS late, i, name, a, sku FROM mine WHERE NOT skipped
              UNION ALL SELECT k, 1, 0, name, m - (total - a), sku FROM lone JOIN least USING (k) WHERE m - (total - a) > 0 AND m - (total - a) < m)
    SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY late, i)::INT AS item_no, name, a / 100.0::DOUBLE AS price, 1 AS qty, NULL::DOUBLE AS unit_price, sku FROM found""")  # fmt: skip
def itm30_skip_prices(spark, sf_dir):
    """Pharmacy receipts without tax marks: prices next to the tender's words are no items', but the one name left without a
    price gets what the others leave of the least amount that covers them."""
    return read(spark, sf_dir, pharmacy(0))


@query("itm38_orphan", f"""WITH {FORMS_SQL} SELECT k AS doc_id, i::INT AS item_no, name, a / 100.0::DOUBLE AS price, 1 AS qty, NULL::DOUBLE AS unit_price, sku
    FROM fs WHERE kind = 0 AND v = 1 AND n > 1""")  # fmt: skip
def itm38_orphan(spark, sf_dir):
    """Pharmacy receipts whose last item lacks its price: it is what the others leave of the total."""
    return read(spark, sf_dir, pharmacy(1))


@query("itm40_stated_count", f"""WITH {FORMS_SQL},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN n = 1 THEN 0 ELSE pk % 2 END, i) AS r FROM fs WHERE kind = 0 AND v = 2)
    SELECT k AS doc_id, r::INT AS item_no, CASE WHEN pk % 2 = 0 THEN regexp_replace(name, ' K(.)$', ' #\\1') ELSE name END AS name, a / 100.0::DOUBLE AS price,
           1 AS qty, NULL::DOUBLE AS unit_price, sku FROM ranked WHERE r <= greatest(n - 1, 1)""")  # fmt: skip
def itm40_stated_count(spark, sf_dir):
    """Pharmacy receipts that state one item fewer than they list, in four styles: the most doubtful names stay."""
    return read(spark, sf_dir, pharmacy(2))


@query("itm39_stated_count", f"""WITH {FORMS_SQL} SELECT k AS doc_id, greatest(n - 1, 1)::INT AS stated FROM fs WHERE kind = 0 AND v = 2 AND i = 1""")
def itm39_stated_count(spark, sf_dir):
    own = pages(spark, sf_dir).where(pharmacy(2))
    return own.select("doc_id", items.stated_count(clean_lines(F.col("lines")), "pharmacy_column").alias("stated"))


@query("itm4_skip_prices", f"""WITH {FORMS_SQL} SELECT k AS doc_id, list_sort(list_distinct([total / 100.0::DOUBLE, (total + change) / 100.0::DOUBLE] || CASE WHEN change > 0 THEN [change / 100.0::DOUBLE] ELSE [] END)) AS amounts
    FROM fs WHERE kind > 0 AND i = 1""")  # fmt: skip
def itm4_skip_prices(spark, sf_dir):
    """The amounts of totals and tender that each layout rules out, all but the pharmacies'."""
    seen = pages(spark, sf_dir).where(F.col("receipt_type") != "pharmacy_column").select("doc_id", clean_lines(F.col("lines")).alias("lines"), "receipt_type")
    plans = {k: items.skip_prices(F.col("lines"), k) for k in render.LAYOUTS if k != "pharmacy_column"}
    return seen.select("doc_id", F.array_sort(F.array_distinct(receipts.by_type(F.col("receipt_type"), plans, "generic"))).alias("amounts"))


@query("fld7_date_guard", "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%m/%d/%Y') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%m/%d/%Y') END AS date FROM orders")
def fld7_date_guard(spark, sf_dir):
    """A date that a dash follows is none, and hides a second one on its line, but not one on a line of its own."""
    orders, key = table(spark, sf_dir, "orders"), F.pmod("o_orderkey", F.lit(3))
    day, after = F.date_format("o_orderdate", "MM/dd/yyyy"), F.date_format(F.date_add("o_orderdate", 1), "MM/dd/yyyy")
    lines = (
        F.when(key == 0, F.array(F.concat(F.lit("PAID "), day, F.lit("-1")), F.concat(F.lit("PAID "), after)))
        .when(key == 1, F.array(F.concat(F.lit("PAID "), day, F.lit(" "), after, F.lit("-1"))))
        .otherwise(F.array(F.concat(F.lit("PAID "), day, F.lit("-1 "), after)))
    )
    return orders.select(F.col("o_orderkey").alias("doc_id"), fields.date(lines).alias("date"))


@query("cor18_originals", f"""WITH {render.RENDER_SQL}, seen AS (SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY ln, pk, sk, ep, q, nm, c) AS line_no, pk, price FROM op)
    SELECT doc_id, line_no::INT AS line_no, CASE pk % 3 WHEN 2 THEN price ELSE '₱' || price END AS text, CASE WHEN pk % 3 < 2 THEN true END AS pattern_corrected,
           CASE pk % 3 WHEN 0 THEN 'P ' || price WHEN 1 THEN '¥' || price END AS original_text FROM seen""")  # fmt: skip
def cor18_originals(spark, sf_dir):
    """Misread currency signs of prices, chosen by the part: repaired lines are flagged and keep their original."""
    grouped = render.order_lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))

    def line(x, i):
        sign = F.get(F.array(F.lit("P "), F.lit("¥"), F.lit("")), F.pmod(x["l_partkey"], F.lit(3)).cast("int"))
        return F.struct((i + 1).alias("line_no"), F.concat(sign, render.price_text(x["cents"])).alias("text"))

    mended = grouped.select(F.col("l_orderkey").alias("doc_id"), F.explode(correct.correct_ocr_lines(F.transform("xs", line))).alias("x"))
    return mended.select("doc_id", "x.*")
