"""One rule for each receipt: its key chooses a line that one rule changes or reads, or nearly does, and varies the digits in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slips.operators import correct, fields
from slips.plans import receipts, render

QUERIES: dict = {}
ORACLE: dict = {}
WITH = f"WITH {render.RENDER_SQL}"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


# In the lines below {d} stands for the last digit of the key and {s} for its last four.
def filled(texts: list[str], key: Column) -> Column:
    """The text that the key chooses, with its digits."""
    text = F.get(F.array(*map(F.lit, texts)), F.pmod(F.floor(key / 6), F.lit(len(texts))).cast("int"))
    text = F.replace(text, F.lit("{d}"), F.pmod(key, F.lit(10)).cast("string"))
    return F.replace(text, F.lit("{s}"), F.lpad(F.pmod(key, F.lit(10_000)).cast("string"), 4, "0"))


def filled_sql(texts: list[str | None]) -> str:
    quoted = ", ".join("NULL" if t is None else "'" + t.replace("'", "''") + "'" for t in texts)
    chosen = f"([{quoted}])[doc_id // 6 % {len(texts)} + 1]"
    return f"replace(replace({chosen}, '{{d}}', (doc_id % 10)::VARCHAR), '{{s}}', lpad((doc_id % 10000)::VARCHAR, 4, '0'))"


ENHANCED = [
    ("1234 5678-901{d}", "1234 5678-901{d}"),  # joined by one rule and parted by a later one
    ("MOBILE/VIBER N0123{d})", "MOBILE/VIBER NO : (0123{d})"),
    ("MOBILE/VIBER NO123{d})", "MOBILE/VIBER NO123{d})"),
    ("Phil  logix {d}", "Phillogix {d}"),
    ("Sa lamat {d}", "Salamat {d}"),
    ("000-388-474-007{d}8", "000-388-474-007{d}8"),
    ("000-388474-007{d}8", "000-388 474-007{d}8"),
    ("MOBILE5VIBER {d}", "MOBILE/VIBER {d}"),
    ("MOBILEVIBER {d}", "MOBILE/VIBER {d}"),
    ("MOBILE VIBER {d}", "MOBILE VIBER {d}"),
    ("{d}item", "{d} item"),
    ("{d}   items", "{d} items"),
    ("LESS BPDISC {d}", "LESS : BP DISC {d}"),
    ("AMT:{d}", "AMT : {d}"),
    ("A:{d}", "A:{d}"),
    ("MIN : {d}", "MTN : {d}"),
    ("PWD ID#:{d}", "PWD ID# : {d}"),
    ("nothing to mend {d}", "nothing to mend {d}"),
]
CORRECTED = [
    ("SANFernando {d}", "SAN Fernando {d}"),
    ("SANTACruz {d}", "SANTA Cruz {d}"),
    ("STMary {d}", "ST Mary {d}"),
    ("AVEMaria {d}", "AVE Maria {d}"),
    ("BRGYPantok {d}", "BRGY Pantok {d}"),
    ("HEALTHCARE {d}", "HEALTH CARE {d}"),
    ("TECHSUPPORT {d}", "TECH SUPPORT {d}"),
    ("FOODSERVICE {d}", "FOOD SERVICE {d}"),
    ("SHOPCENTER {d}", "SHOP CENTER {d}"),
    ("BOOKSTORE {d}", "BOOK STORE {d}"),
    ("NOCARE {d}", "NOCARE {d}"),  # two capitals are too few
    ("BOOKSTORES {d}", "BOOKSTORES {d}"),
    ("milkTea {d}", "milk Tea {d}"),
    ("{s}Bitty", "{s} Bitty"),
    ("Sa lamat {d}", "Salamat {d}"),
    ("Sa PO {d}", "Sa PO {d}"),
    ("Inter national {d}", "International {d}"),
    ("MIN {d}", "MTN {d}"),
    ("MINI {d}", "MINI {d}"),
    ("2O{d} and 1l{d}", "20{d} and 11{d}"),
    ("B0OK and P1NE {d}", "BOOK and PINE {d}"),
    ("2O O{d}", "2O O{d}"),
    ("¥ 1,20{d}.00", "₱1,20{d}.00"),
    ("UP 12{d}.00", "UP 12{d}.00"),
]
CHANGES = [
    ("milkTea {d}", "spacing_added"),
    ("P 12{d}.00", "peso_sign_restored"),
    ("2O{d}", "character_swap_O_0"),
    ("B0OK", "character_swap_0_O"),
    ("MIN {d}", "systematic_error_MIN_MTN"),
    ("Sa lamat {d}", "other"),
]
FIELDS = [  # line and what it gives: field, value
    ("SALESINVOICE 12{s}", "invoice_number", "12{s}"),
    ("INVOICE # AB12{s}", "invoice_number", "AB12{s}"),
    ("INVOICE #{s}", "invoice_number", "{s}"),
    ("INVOICE # A-{s}", "invoice_number", "A-{s}"),
    ("OR # X{s}", "invoice_number", "X{s}"),
    ("O.R. # : {s}", "invoice_number", "{s}"),
    ("OFFICIAL RECEIPT # A{s}", "invoice_number", "A{s}"),
    ("SI No : {s}", "invoice_number", "{s}"),
    ("TXN # T{s}", "invoice_number", "T{s}"),
    ("CONTROL NO. : C-{s}", "invoice_number", "C-{s}"),
    ("INVOICE # A{d}", None, None),
    ("03/1{d}/2026", "date", "03/1{d}/2026"),
    ("2026-03-1{d}", "date", "2026-03-1{d}"),
    ("1{d} Mar. 2026", "date", "1{d} Mar. 2026"),
    ("March 1{d}, 2026", "date", "March 1{d}, 2026"),
    ("The 1{d}th of March, 2026", "date", "The 1{d}th of March, 2026"),
    ("03/1{d}/26", "date", "03/1{d}/26"),
    ("1{d} Mar 26", "date", "1{d} Mar 26"),
    ("Mar '2{d}", "date", "Mar '2{d}"),
    ("03/202{d}", "date", "03/202{d}"),
    ("Mar 202{d}", "date", "Mar 202{d}"),
    ("date 2/1{d}", "date", "2/1{d}"),
    ("paid 2/1{d}", None, None),
    ("1{d}:30 AM", "time", "1{d}:30 AM"),
    ("1{d}:30", None, None),
    ("VAT REG TIN : 000-388-474-0{d}", "tin", "000-388-474-0{d}"),
    ("TIN: 12345678{d}", "tin", "12345678{d}"),
    ("GRAND TOTAL 1{d}.00", "total", "1{d}.0"),
    ("TOTAL AMOUNT DUE: 1{d}.00", "total", "1{d}.0"),
    ("AMOUNT DUE ₱1{d}.00", "total", "1{d}.0"),
    ("TOTAL PAYMENT 1{d}.00", "total", "1{d}.0"),
    ("TOTAL SALES - 1{d}.00", "total", "1{d}.0"),
    ("NET AMOUNT 1{d}.00", "total", "1{d}.0"),
    ("NET SALES 1{d}.00", "total", "1{d}.0"),
    ("TOTAL 1{d}.00", "total", "1{d}.0"),
    ("SUBTOTAL 1{d}.00", None, None),
    ("VAT 12% 1{d}.50", "vat", "1{d}.5"),
    ("12% VAT 1{d}.50", "vat", "1{d}.5"),
    ("OUTPUT TAX : 1{d}.50", "vat", "1{d}.5"),
    ("VAT AMOUNT 1{d}.50", "vat", "1{d}.5"),
    ("VAT 1{d}.50", "vat", "1{d}.5"),
]


@query("enh_rules", f"{WITH} SELECT doc_id, {filled_sql([a for a, _ in ENHANCED])} AS line, {filled_sql([b for _, b in ENHANCED])} AS fixed FROM rendered")
def enh_rules(spark, sf_dir):
    line = filled([a for a, _ in ENHANCED], F.col("doc_id"))
    return render.receipts(spark, sf_dir).select("doc_id", line.alias("line")).select("doc_id", "line", correct.enhance_line(F.col("line")).alias("fixed"))


@query("cor_rules", f"{WITH} SELECT doc_id, {filled_sql([a for a, _ in CORRECTED])} AS line, {filled_sql([b for _, b in CORRECTED])} AS fixed FROM rendered")
def cor_rules(spark, sf_dir):
    line = filled([a for a, _ in CORRECTED], F.col("doc_id"))
    return render.receipts(spark, sf_dir).select("doc_id", line.alias("line")).select("doc_id", "line", correct.correct_line(F.col("line")).alias("fixed"))


@query("cor20_change_types", f"{WITH} SELECT doc_id, {filled_sql([a for a, _ in CHANGES])} AS line, {filled_sql([b for _, b in CHANGES])} AS change_type FROM rendered")
def cor20_change_types(spark, sf_dir):
    lines = render.receipts(spark, sf_dir).select("doc_id", F.array(filled([a for a, _ in CHANGES], F.col("doc_id"))).alias("lines"))
    seen = correct.correction_report(lines).select("doc_id", F.explode("corrections").alias("c"))
    return seen.select("doc_id", F.col("c.original").alias("line"), "c.change_type")


NAMES = ["invoice_number", "date", "time", "tin", "total", "vat"]


@query("fld_rules", f"{WITH} SELECT doc_id, {', '.join(f'{filled_sql([v if f == name else None for _, f, v in FIELDS])} AS {name}' for name in NAMES)} FROM rendered")
def fld_rules(spark, sf_dir):
    """Each field pattern alone on a line, or a line that just misses one; amounts are compared as text."""
    lines = F.array(filled([a for a, _, _ in FIELDS], F.col("doc_id")))
    own = render.receipts(spark, sf_dir).select("doc_id", lines.alias("lines")).withColumn("price", F.array(F.lit(None).cast("double")))
    line, price = F.col("lines"), F.col("price")
    return own.select(
        "doc_id", fields.invoice_number(line).alias("invoice_number"), fields.date(line).alias("date"), fields.time(line).alias("time"), fields.tin(line).alias("tin"),
        fields.total(line, price).cast("string").alias("total"), fields.vat(line, price).cast("string").alias("vat"),
    )


PHARMACY, SUPERMARKET = ["WATSONS", "MOBILE 1", "PA99S/S"], ["PUREGOLD TAYTAY", "PHP"]
END = ["SUBTOTAL", "GRAND TOTAL 900{d}.00"]
# Lines of a receipt, and the items that one pass makes of them: name, price, quantity, unit price, barcode.
RECEIPTS = [
    (PHARMACY + ["COTTON BALLS", "480036140524", "2 @ 2{d}.00", "8{d}.00"] + END, [("COTTON BALLS", "8{d}.0", 2, "2{d}.0", "480036140524")]),
    (PHARMACY + ["4{d}.00T", "GREEN TEA", "48003614052{d}"] + END, [("GREEN TEA", "4{d}.0", 1, None, "48003614052{d}")]),
    (PHARMACY + ["4{d}.00", "GREEN TEA", "48003614052{d}"] + END, [("GREEN TEA", "4{d}.0", 1, None, "48003614052{d}")]),
    (PHARMACY + ["GREEN TEA", "4{d}.00"] + END, [("GREEN TEA", "4{d}.0", 1, None, None)]),
    (PHARMACY + ["GREEN TEA", "4{d}.00T", "48003614052{d}", "2 @ 2{d}.00"] + END, [("GREEN TEA", "4{d}.0", 2, "2{d}.0", "48003614052{d}")]),
    (PHARMACY + ["GREEN TEA   4{d}.00", "48003614052{d}"] + END, [("GREEN TEA", "4{d}.0", 1, None, "48003614052{d}")]),
    (PHARMACY + ["BIOGESIC TAB", "3 @ 1{d}.25", "480036140523", "4{d}.75T", "-----"] + END, [("BIOGESIC TAB", "4{d}.75", 3, "1{d}.25", "480036140523")]),
    (PHARMACY + ["BIOGESIC TAB", "1 @ 4{d}.75", "480036140523", "9{d}.75T"] + END, [("BIOGESIC TAB", "4{d}.75", 1, "4{d}.75", "480036140523")]),  # before a total
    (SUPERMARKET + ["RICE {d}KG", "25{d}.25"] + END, [("RICE {d}KG", "25{d}.25", 1, None, None)]),
    (SUPERMARKET + ["SOAP BAR  3{d}.25"] + END, [("SOAP BAR", "3{d}.25", 1, None, None)]),
    (SUPERMARKET + ["WATER", "2 @ 1{d}.00", "3{d}.00"] + END, [("WATER", "3{d}.0", 2, "1{d}.0", None)]),
    (SUPERMARKET + ["WATER", "3{d}.00", "2 @ 1{d}.00", "48003614052{d}"] + END, [("WATER", "3{d}.0", 2, "1{d}.0", "48003614052{d}")]),
    (SUPERMARKET + ["WATER", "48003614052{d}", "3{d}.00"] + END, [("WATER", "3{d}.0", 1, None, "48003614052{d}")]),
    (SUPERMARKET + ["SOAP BAR  3{d}.25", "2 @ 1{d}.75", "48003614052{d}"] + END, [("SOAP BAR", "3{d}.25", 2, "1{d}.75", "48003614052{d}")]),
    (SUPERMARKET + ["RICE BAG", "25{d}.00", "SALT", "1{d}.00", "** 1 item(s) **"] + END, [("SALT", "1{d}.0", 1, None, None)]),  # the most doubtful stays
]


def _shown(items: list[tuple]) -> str:
    return "; ".join("|".join("-" if v is None else str(v) for v in x) for x in items)


@query("itm_rules", f"{WITH} SELECT doc_id, {filled_sql([_shown(items) for _, items in RECEIPTS])} AS items FROM rendered")
def itm_rules(spark, sf_dir):
    """Small receipts, each for one pass of the pharmacy or supermarket layout."""
    text = filled(["\n".join(lines) for lines, _ in RECEIPTS], F.col("doc_id"))
    read = receipts.extract(render.receipts(spark, sf_dir).select("doc_id", F.split(text, "\n").alias("lines")))
    shown = lambda v: F.coalesce(v.cast("string"), F.lit("-"))
    line = F.transform("items", lambda x: F.concat_ws("|", *(shown(x[c]) for c in ("name", "price", "qty", "unit_price", "sku"))))
    return read.select("doc_id", F.array_join(line, "; ").alias("items"))
