"""Header fields of a receipt. Every function takes the cleaned lines (array<string>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slips.functions import patterns as P
from slips.functions.text import amount, candidates, first, first_by_line, first_by_pattern, found, holding, let, matches, money, rx, strip

PLAIN_TYPES = ("fast_food", "department_store")


def repaired(line: Column) -> Column:
    """Price-like lines with O for 0 and I or L for 1."""
    return F.when(line.rlike(rx(P.PRICE_LIKE)), F.translate(F.upper(line), "OIL", "011")).otherwise(line)


def price_of(line: Column, layout: str) -> Column:
    """The amount of a line that is a price and nothing else, as the layout reads it; every price has a point."""
    return F.when(line.contains("."), _price_of(line, layout))


def _price_of(line: Column, layout: str) -> Column:
    if layout in PLAIN_TYPES:
        return amount(found(line, rx(P.PRICE_PLAIN, False)))
    if layout == "pharmacy_column":
        at = line.contains("@") & line.rlike(rx(P.QTY_AT_PRICE, False))
        return F.when(~at, amount(found(repaired(line), rx(P.PRICE_TAXED, False))))
    if layout == "base":
        at = line.rlike(rx(r"^\d+\s*@\s*[\d,]+\.\d{2}$", False))
        fixed = F.regexp_replace(repaired(line), rx(r"(\d[\d,]+\.\d{2})1$", False), "$1T")
        return F.when(~at, amount(found(fixed, rx(P.PRICE_TAXED, False))))
    return amount(found(line, rx(P.PRICE_TAXED, False)))


def prices(lines: Column, receipt_type: Column) -> Column:
    """Standalone prices of all lines, read as the receipt's type does."""
    of = lambda layout: F.transform(lines, lambda x: price_of(x, layout))
    return F.when(receipt_type.isin(*PLAIN_TYPES), of("fast_food")).when(receipt_type == "pharmacy_column", of("pharmacy_column")).otherwise(of("generic"))


def store_name(lines: Column) -> Column:
    def fits(x):
        odd = matches(x, rf"^\d+$|{P.SEPARATOR}|{P.BANNER}|^\d+\.\d{{2}}", False)
        return (F.char_length(x) >= 3) & ~odd

    return F.get(F.filter(F.slice(lines, 1, 8), fits), 0)


def invoice_number(lines: Column) -> Column:
    def one(p):
        return lambda x: F.when(x.rlike(rx(p)), let(strip(found(x, rx(p))), lambda v: F.when(F.char_length(v) >= 4, v)))

    def both(some):
        return F.coalesce(first_by_line(some, [one(p) for p in P.INVOICES]), first_by_line(some, [one(p) for p in P.TRANSACTIONS]))

    return let(F.filter(lines, lambda x: holding(x, P.GATE_INVOICE)), both)


def _dated(pattern: str):
    """First match of a date, unless a hyphen follows it: that is a range."""
    ranged = rx(pattern + "(-?)")
    return lambda x: F.when(x.rlike(ranged), F.when(F.regexp_extract(x, ranged, 2) == "", strip(found(x, ranged))))


def txn_date(line: Column) -> Column:
    """mm-dd-yy from a transaction line, wherever it sits among other digits."""
    parts = F.regexp_extract_all(line, F.lit(r"(\d{2}-\d{2}-\d{2})"), F.lit(1))
    number = lambda x, a: F.substring(x, a, 2).cast("int")
    real = F.filter(parts, lambda x: number(x, 1).between(1, 12) & number(x, 4).between(1, 31) & (number(x, 7) >= 20))
    bit = lambda g: F.regexp_extract(line, P.TXN_SQUASHED, g)
    squashed = F.when(
        line.rlike(P.TXN_SQUASHED) & bit(1).try_cast("int").between(1, 12) & bit(2).try_cast("int").between(1, 31), F.concat_ws("-", bit(1), bit(2), bit(3))
    )
    return F.when(line.rlike(rx(P.TXN_LINE)), F.coalesce(F.get(real, 0), squashed))


def date(lines: Column) -> Column:
    sure = [_dated(p) for p in P.DATES_FULL + P.DATES_SHORT_YEAR]
    told = lambda x: x.rlike(rx(P.DATE_CONTEXT))

    def tried(some):
        return F.coalesce(
            first_by_line(F.filter(some, lambda x: F.char_length(x) <= 25), sure),
            first_by_line(some, sure),
            first_by_line(F.filter(some, lambda x: (F.char_length(x) <= 20) | told(x)), [_dated(p) for p in P.DATES_PARTIAL]),
            first_by_line(F.filter(some, told), [_dated(p) for p in P.DATES_LAST]),
            first_by_line(some, [txn_date]),
        )

    return let(F.filter(lines, lambda x: x.rlike(rx(P.GATE_DATE, False)) | holding(x, P.GATE_MONTH)), tried)


def time(lines: Column) -> Column:
    return first_by_line(candidates(lines, P.GATE_TIME), [lambda x: strip(found(x, rx(P.TIME)))])


def before_price(lines: Column, price: Column, gate: tuple[str, ...]) -> Column:
    """Gated lines with the positive price that stands on the line after: array<struct<x, p>>."""
    after = F.transform(lines, lambda x, i: F.struct(x.alias("x"), F.get(price, i + 1).alias("p")))
    return F.filter(after, lambda r: (r["p"] > 0) & holding(r["x"], gate))


def after_keyword(pairs: Column, keyword: str) -> Column:
    """The price after the first of ``before_price``'s lines that is the keyword."""
    return F.get(F.filter(pairs, lambda r: r["x"].rlike(rx(keyword))), 0)["p"]


def with_point(lines: Column, gate: tuple[str, ...]) -> Column:
    """Gated lines that may hold an amount, which has a point."""
    return F.filter(lines, lambda x: x.contains(".") & holding(x, gate))


def total(lines: Column, price: Column) -> Column:
    def one(p):
        return lambda x: amount(found(x, rx(p + P.AMOUNT_AFTER)))

    def split(pairs):
        return F.coalesce(*[after_keyword(pairs, rf"^{p}\s*[:\-]?\s*$") for p in P.TOTAL_LINES])

    inline = let(with_point(lines, P.GATE_TOTAL), lambda some: first_by_pattern(some, [one(p) for p in P.TOTAL_NAMES]))
    return F.coalesce(inline, let(before_price(lines, price, P.GATE_TOTAL), split))


def vat(lines: Column, price: Column) -> Column:
    def positive(p):
        return lambda x: let(amount(found(x, rx(p + P.AMOUNT_AFTER))), lambda v: F.when(v > 0, v))

    inline = let(with_point(lines, P.GATE_VAT), lambda some: first_by_pattern(some, [positive(p) for p in P.VAT_NAMES]))
    return F.coalesce(inline, after_keyword(before_price(lines, price, P.GATE_VAT), P.VAT_LINE))


def tin(lines: Column) -> Column:
    def one(p):
        return lambda x: strip(found(x, rx(p)))

    return let(candidates(lines, P.GATE_TIN), lambda some: first_by_pattern(some, [one(p) for p in P.TINS]))


def confidence(store: Column, total_: Column, date_: Column, n_items: Column, invoice: Column) -> Column:
    less = lambda missing, by: F.when(missing, by).otherwise(0.0)
    score = 1.0 - less(store.isNull(), 0.15) - less(total_.isNull(), 0.25) - less(date_.isNull(), 0.10) - less(n_items == 0, 0.20) - less(invoice.isNull(), 0.05)
    return F.round(F.greatest(F.lit(0.0), score), 2)


def simple_metadata(lines: Column) -> Column:
    """The fallback: first line, last total, last date."""
    last = lambda a: F.element_at(a, -1)
    hits = lambda f: F.filter(F.transform(lines, f), lambda x: x.isNotNull())
    totals = hits(lambda x: F.when(F.lower(x).contains("total"), found(x, r"\$?\s*(\d+\.\d{2})").try_cast("double")))
    dates = hits(lambda x: found(x, r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", 0))
    return F.struct(
        F.when(F.char_length(F.get(lines, 0)) > 3, strip(F.get(lines, 0))).alias("merchant_name"),
        F.when(F.size(totals) > 0, last(totals)).alias("total"),
        F.when(F.size(dates) > 0, last(dates)).alias("date"),
        F.lit(0).alias("items_count"),
    )


def money_or_null(value: Column) -> Column:
    return F.when(value.isNotNull(), money(value))
