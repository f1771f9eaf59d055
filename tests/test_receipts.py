"""Hand-traced receipts and field rules."""

import random
import re
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from slips.functions import patterns
from slips.functions.text import matches, rx
from slips.operators import classify, correct, fields, geometry, items, orientation, pairing
from slips.plans import queries_parts, queries_receipts, receipts
from pyspark.sql import functions as F

PHARMACY = "MERCURY DRUG - RIZAL BANANGONAN EM COMPLEX ¦ EM Complex, Manila East Road, ¦ Brgy.Pantok,Binangonan, Rizal ¦ VAT REG TIN : 000-388-474-00778 ¦ MOBILE/VIBER NO : 0908813-2818 ¦ TOSHIBA4900 41CRD20R003 01070 ¦ PA99S/S ¦ 1220.00T ¦ NIDO5+PDR MLK2kg ¦ 480036140523 ¦ 90.00T ¦ GREEN COF MX219 ¦ TOTAL ¦ 1310.00 ¦ AMOUNT TENDERED ¦ CASH ¦ 2000.00 ¦ CHANGE ¦ 690.00 ¦ ** 2 item(s) ** ¦ VAT - 12%  140.36 ¦ TXN#110855 11-13-25 02:15P EJ ¦ INVOICE#110703137533"
FAST_FOOD = "JOLLIBEE ¦ SM MALL OF ASIA ¦ ORDER # 4521 ¦ DINE IN ¦ 1 CHICKENJOY 1PC   79.00 ¦ 1 JOLLY SPAGHETTI   65.00 ¦ FRIES REGULAR   55.00 ¦ SUBTOTAL ¦ 199.00 ¦ TOTAL ¦ 199.00 ¦ CASH  200.00 ¦ CHANGE  1.00"
SUPERMARKET = "PUREGOLD TAYTAY ¦ SI# 0012345 ¦ 03/14/2026 ¦ PHP ¦ RICE 5KG ¦ 250.00 ¦ SOAP BAR  35.50 ¦ WATER 500ML ¦ 2 @ 15.00 ¦ 30.00 ¦ SUBTOTAL ¦ 315.50 ¦ TOTAL ¦ 315.50 ¦ CASH ¦ 500.00 ¦ CHANGE ¦ 184.50"
DEPARTMENT = "NATIONAL BOOKSTORE ¦ NOTEBOOK A5  2  120.00 ¦ BLUE PEN  15.00 ¦ TOTAL AMOUNT ¦ 135.00"
GENERIC = "ACME TRADING ¦ line one ¦ line two ¦ line three ¦ line four ¦ WIDGET  12.50"

EXPECTED = {
    "pharmacy": (PHARMACY, "pharmacy_column", "high", "110703137533", "11-13-25", "02:15P", "₱1,310.00", "₱140.36", 2, 1.0, None, [("NIDO5+PDR MLK2kg", 1220.0, 1, None, "480036140523"), ("GREEN COF MX219", 90.0, 1, None, None)]),
    "fast_food": (FAST_FOOD, "fast_food", "high", None, None, None, "₱199.00", None, 3, 0.85, None, [("CHICKENJOY 1PC", 79.0, 1, None, None), ("JOLLY SPAGHETTI", 65.0, 1, None, None), ("FRIES REGULAR", 55.0, 1, None, None)]),
    "supermarket": (SUPERMARKET, "supermarket", "high", "0012345", "03/14/2026", None, "₱315.50", None, 4, 1.0, None, [("RICE 5KG", 250.0, 1, None, None), ("SOAP BAR", 35.5, 1, None, None), ("WATER 500ML", 30.0, 2, 15.0, None)]),
    "department": (DEPARTMENT, "department_store", "high", None, None, None, "₱135.00", None, 3, 0.85, "item_sum_exceeds_total", [("NOTEBOOK A5", 120.0, 2, None, None), ("BLUE PEN", 15.0, 1, None, None)]),
    "generic": (GENERIC, "generic", "low", None, None, None, None, None, 1, 0.6, None, [("WIDGET", 12.5, 1, None, None)]),
    "empty": (" ¦ ", "generic", "low", None, None, None, None, None, 0, 0.0, None, []),
    # A coded name past filler, and the discount that stands in for its missing price.
    "coded": ("ROSE PHARMACY ¦ MOBILE 1 ¦ PA99S/S ¦ BIOGESIC TAB ¦ 3 @ 5.00 ¦ 480036140523 ¦ 15.00T ¦ TOTAL ¦ 15.00", "pharmacy_column", "high", None, None, None, "₱15.00", None, 3, 0.85, "item_sum_exceeds_total", [("BIOGESIC TAB", 15.0, 3, 5.0, "480036140523")]),
    # Adjacent name, barcode, count and price.
    "adjacent": ("WATSONS ¦ MOBILE 1 ¦ PHP ¦ COTTON BALLS ¦ 480036140524 ¦ 2 @ 20.00 ¦ 40.00 ¦ SUBTOTAL ¦ GRAND TOTAL ¦ 40.50", "pharmacy_column", "high", None, None, None, "₱40.50", None, 2, 0.85, "item_sum_exceeds_total", [("COTTON BALLS", 40.0, 2, 20.0, "480036140524")]),
}


@pytest.fixture(scope="module")
def extracted(spark):
    docs = spark.createDataFrame([(k, v[0].split(" ¦ ")) for k, v in EXPECTED.items()], "doc_id string, lines array<string>")
    return {r.doc_id: r for r in receipts.extract(docs).collect()}


@pytest.mark.parametrize("name", EXPECTED)
def test_golden(extracted, name):
    r, e = extracted[name], EXPECTED[name]
    got = (r.receipt_type, r.receipt_type_confidence, r.invoice_number, r.date, r.time, r.total_amount, r.vat_amount, r.item_count, r.extraction_confidence, r.extraction_warning)
    assert got == e[1:11]
    assert [tuple(i) for i in r["items"]] == e[11]


def test_null_lines_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, None, "x", 2.0), (None, [None, "JOLLIBEE"], "y", 3.0)], "doc_id long, lines array<string>, items string, price double")
    got = {r.doc_id: r for r in receipts.extract(docs).collect()}
    assert got[1].extraction_confidence == 0.0 and got[None].receipt_type == "fast_food"


@pytest.mark.parametrize(
    ("lines", "total", "date", "time"),
    [
        (["TOTAL 5.00", "GRAND TOTAL 9.00"], 9.0, None, None),
        (["SUB TOTAL 9.00"], 9.0, None, None),
        (["SUBTOTAL 9.00"], None, None, None),
        (["09:11:22 PM"], None, None, "11:22 PM"),
        (["09:11"], None, None, None),
        (["TXN#93179911-13-25 03:36P"], None, "11-13-25", "03:36P"),
        (["08/01/20-07/31/25"], None, None, None),
        (["Issued 28th of nothing", "DATE: 28/2"], None, "28/2", None),
        (["paid 28th February, 2026 here and there"], None, "28th February, 2026", None),
    ],
)
def test_fields(spark, lines, total, date, time):
    row = spark.createDataFrame([(lines,)], "lines array<string>").select(
        fields.total(F.col("lines"), fields.prices(F.col("lines"), F.lit("generic"))).alias("total"), fields.date(F.col("lines")).alias("date"), fields.time(F.col("lines")).alias("time")
    )
    assert tuple(row.first()) == (total, date, time)


def test_chain_over_line_break_and_priority(spark):
    rows = spark.createDataFrame([(["MERCURY", "DRUG", "JOLLIBEE"],), (["PHP", "ORDER # 1"],), ([],)], "lines array<string>")
    got = [tuple(r.c) for r in rows.select(classify.classify(F.col("lines")).alias("c")).collect()]
    assert got == [("pharmacy_column", "high"), ("supermarket", "high"), ("generic", "low")]


def slow_type(lines):
    """Chain names over the whole text, then markers line by line, then the shares of price lines."""
    block = "\n".join(lines)
    for kind, (chains, _) in patterns.SIGNATURES.items():
        if any(re.search(p, block, re.I) for p in chains):
            return kind, "high"
    for kind, (_, markers) in patterns.SIGNATURES.items():
        if any(re.search(p, x, re.I) for p in markers for x in lines):
            return kind, "high"
    prices = [x for x in lines if re.search(patterns.SHAPE_PRICE, x)]
    inline = [x for x in lines if re.search(patterns.SHAPE_INLINE, x) and x not in prices]
    if lines and len(prices) / len(lines) >= patterns.STANDALONE_RATIO:
        return "pharmacy_column", "medium"
    if lines and len(inline) / len(lines) >= patterns.INLINE_RATIO:
        return "inline_price", "medium"
    return "generic", "low"


def test_documents_as_receipts(spark):
    """Every document is taken for some receipt; its type is what a slow version says."""
    folder = "/root/testdata/sf0.001"
    rows = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    got = {r.doc_id: r for r in queries_parts.doc_text_extract(spark, folder).collect()}
    assert len(got) == len(rows)
    for r in rows:
        lines = [x for x in (y.strip() for y in (r["text"] or "").split("\n")) if x]
        assert (got[r["doc_id"]].receipt_type, got[r["doc_id"]].receipt_type_confidence) == slow_type(lines), r["doc_id"]


def test_documents_read_only_what_is_wanted_in_many_tasks(spark):
    """What no wanted column needs is not read, and a file of one row group is not one task's work."""
    found = queries_parts.doc_text_extract(spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() >= 48
    assert "SALESINVOICE" not in found._jdf.queryExecution().optimizedPlan().toString()
    lines = [["ROSE PHARMACY", "SI# 12345678", "01/02/2024", "BIOGESIC 500MG", "4800000000001", "12.50T", "TOTAL 12.50"], ["A STORE", "TEA  3.00", "VAT 1.20", "TOTAL", "1.00"], []]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id int, lines array<string>")
    keep = ["doc_id", "extraction_confidence", "extraction_warning", "has_vat", "item_count"]
    whole = {r.doc_id: r for r in receipts.extract(docs).collect()}
    for names in (keep, ["doc_id", "store_name", "items"]):
        assert all(tuple(r) == tuple(whole[r.doc_id][c] for c in names) for r in receipts.extract(docs, names).collect())


def test_misread_characters_are_repaired_from_left_to_right(spark):
    """Against the rule told character by character."""
    rand = random.Random(3)
    texts = ["".join(rand.choice("O0l1I25AÉb ") for _ in range(rand.randrange(0, 14))) for _ in range(3000)]

    def slow(t):
        out = list(t)
        for i in range(1, len(t) - 1):
            a, b = out[i - 1], t[i + 1]
            if a in "0125" and b in "0125":
                out[i] = {"O": "0", "l": "1"}.get(t[i], t[i])
            elif a.isupper() and b.isupper():
                out[i] = {"0": "O", "1": "I"}.get(t[i], t[i])
        return "".join(out)

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r.got == slow(r.t) for r in df.select("t", correct.confusions(F.col("t")).alias("got")).collect())


def test_register_layout(spark):
    from slips.operators import items

    plan = lambda lines: F.transform(F.filter(lines, lambda x: x.startswith("+")), lambda x, i: items.item(i, F.substring(x, 2, 99), F.lit(1.0)))
    receipts.register_layout("kiosk", ["KIOSK"], [], plan)
    try:
        docs = spark.createDataFrame([(1, ["KIOSK 7", "+TEA", "+CAKE"])], "doc_id long, lines array<string>")
        r = receipts.extract(docs).first()
        assert r.receipt_type == "kiosk" and [i.name for i in r["items"]] == ["TEA", "CAKE"]
    finally:
        classify.SIGNATURES.pop("kiosk")
        receipts.EXTRA.pop("kiosk")


def test_features_come_as_lists():
    """Columns of features become Python values column by column, nulls and nested structs included."""
    kind = pa.list_(pa.struct([("a", pa.bool_()), ("b", pa.float64()), ("c", pa.int32()), ("d", pa.struct([("n", pa.string()), ("q", pa.int32())]))]))
    one = {"a": True, "b": 1.5, "c": None, "d": {"n": "x", "q": None}}
    two = {"a": False, "b": None, "c": 7, "d": None}
    rows = [[one, two], [], [two], [one, one, two]]
    assert pairing.nested(pa.array(rows, kind)) == rows
    assert pairing.nested(pa.array(rows, kind).slice(2)) == rows[2:]


def test_rows_are_found_once(spark):
    """Sections and orientation evaluate what they are given once, however often they look at it."""
    made = geometry.sections(geometry.rows(F.col("lines"))), orientation.spatial_orientation(F.reverse("own"), F.array_max("own"))
    assert [str(c._jc.toString()).count(name) for c, name in zip(made, ("lines", "own"), strict=True)] == [1, 2]


def test_receipts_keep_their_partitions(spark):
    """Adaptive execution doesn't join the partitions of rendered receipts, whose work is long for their bytes."""
    assert queries_receipts.docs(spark, "/root/testdata/sf0.001").select("doc_id").rdd.getNumPartitions() >= 48


def test_anchored_alternatives_match_as_before(spark):
    every = [patterns.RX_JUNK, patterns.RX_METADATA, patterns.RX_PAYMENT, patterns.RX_MODE, rf"^\d+$|{patterns.SEPARATOR}|{patterns.BANNER}", r"a\|b|[|]c|(d|e)"]
    lines = ["*AB", "SALE LESS BP DISC", "433 Lt. Artiaga", "x [1.2.3]", "MEMBER NA", "see MEMBER NA", "PA 12 S/S", "a PA 12 S/S", "12", "**x**", "-- ", "a|b", "|c", "d", "", None]
    seen = spark.createDataFrame([(x,) for x in lines], "x string").select(*(F.array(matches(F.col("x"), p), F.col("x").rlike(rx(p))) for p in every)).collect()
    assert all(a == b for row in seen for a, b in row)


def test_long_receipt_takes_time_in_proportion(spark):
    """The end of the items was sought anew for every line."""
    docs = spark.createDataFrame([(1, ["STORE", *(f"BREAD {'ABCDEFGHIJ'[k % 10]}   {k}.50" for k in range(1, 8001)), "CHANGE"])], "doc_id long, lines array<string>")
    begun = time.time()
    found = docs.select(F.size(items.neighbour_items(F.col("lines"), "generic")).alias("n")).collect()
    assert found[0].n == 8000 and time.time() - begun < 12
