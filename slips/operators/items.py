"""Line items, layout by layout.

Layouts whose passes only look at a line and its neighbour (generic, fast food, department store) are column
expressions. Layouts whose passes compete for lines (inline price, supermarket, pharmacy) share their line
features with those, computed by the same expressions, and leave only the matching of positions to
``pairing``, in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from slips.functions import patterns as P
from slips.functions.text import amount, first, found, holding, index_of, let, matches, rx, strip

from .fields import price_of

ITEM = "struct<name:string,price:double,qty:int,unit_price:double,sku:string>"
SOURCED = "struct<src:int,name:string,price:double,qty:int,unit_price:double,sku:string>"


@dataclass(frozen=True)
class Layout:
    """What differs between layouts: how lines end the items, what is no name, how prices are read."""

    name: str
    zone_end: str
    definitive: str
    skip_words: str
    inline: str
    least: int = 2
    header: str | None = None
    inline_qty: str | None = None
    qty_first: bool = False


LAYOUTS = {
    "generic": Layout("generic", P.ZONE_END, P.DEFINITIVE, P.SKIP_WORDS, P.INLINE_TAXED, 3),
    "inline_price": Layout("inline_price", P.ZONE_END, P.DEFINITIVE, P.SKIP_WORDS, P.INLINE_TAXED, 3),
    "fast_food": Layout("fast_food", P.FF_END, P.NARROW_DEFINITIVE, P.FF_SKIP, P.INLINE_PLAIN, 2, P.FF_HEADER, P.FF_QTY, True),
    "department_store": Layout("department_store", P.DS_END, P.NARROW_DEFINITIVE, P.DS_SKIP, P.INLINE_PLAIN, 2, None, P.DS_QTY),
    "supermarket": Layout("supermarket", P.ZONE_END, P.DEFINITIVE, P.SM_SKIP, P.INLINE_TAXED),
    "pharmacy_column": Layout("pharmacy_column", P.ZONE_END, P.DEFINITIVE, P.RX_SKIP, P.INLINE_TAXED),
}
PAIRED = ("inline_price", "supermarket", "pharmacy_column")


def folded(line: Column, layout: str) -> Column:
    """Upper case with the digits that are misread letters."""
    pairs = {"supermarket": ("01|", "OII"), "pharmacy_column": ("01|5", "OIIS")}.get(layout, ("01", "OI"))
    return F.translate(F.upper(line), *pairs)


def is_name(line: Column, layout: str, late: Column | None = None) -> Column:
    """Whether a stripped line can name an item; ``late`` marks lines near a receipt's end."""
    possible, barred, product = naming(line, layout)
    return possible & ~barred if product is None else possible & ~(barred & (~product | (F.lit(False) if late is None else late)))


def naming(line: Column, layout: str, price: Column | None = None) -> tuple[Column, Column, Column | None]:
    """What decides whether a line can name an item: its length and shape, words that bar it, and, where a product outweighs
    those unless it stands late, whether it is one. ``price``: what the line is as a price, if that is known."""
    how = LAYOUTS[layout]
    price = price_of(line, layout) if price is None else price
    long_enough = F.char_length(line) >= how.least
    skipped = folded(line, layout).rlike(rx(how.skip_words))
    if layout in ("generic", "inline_price"):
        odd = matches(line, rf"^\d+$|{P.SEPARATOR}|{P.FINANCIAL}|{P.PAYMENT}|{P.PERCENT_LINE}")
    elif layout == "supermarket":
        odd = price.isNotNull() | matches(line, rf"^\d+$|{P.SEPARATOR}|{P.BANNER}|{P.SM_FINANCIAL}|{P.SM_PAYMENT}|{P.PERCENT_LINE}")
    elif layout == "pharmacy_column":
        coded = line.rlike(rx(P.RX_SHORT_CODE)) & (F.char_length(line) <= 8)
        reduced = line.rlike(rx(r"^LESS\b")) & line.contains("%")
        odd = price.isNotNull() | coded | reduced | matches(line, "|".join((
            r"^\d+$", P.QTY_LINE, P.RX_MODE, P.SEPARATOR, P.BANNER, P.RX_FINANCIAL, P.RX_JUNK, P.RX_PAYMENT, P.RX_METADATA, P.RX_PERCENT)))
        product = line.rlike(rx(P.RX_UNITS)) | line.rlike(rx(P.RX_CODE))
        return long_enough & ~odd, skipped, product
    else:
        shapes = rf"^\d+$|{P.SEPARATOR}" + (f"|{how.header}" if how.header else "")
        odd = price.isNotNull() | matches(line, shapes)
    return long_enough & ~odd, skipped, None


def built(name: Column) -> Column:
    """struct<name, qty>: a count written before or after the name goes into the quantity."""
    lead, tail = rx(r"^(\d+)\s*[xX]\s+(.+)$", False), rx(r"^(.+?)\s+[xX](\d+)\s*$", False)
    leads = name.rlike(lead)
    plain = F.struct(name.alias("name"), F.lit("1").try_cast("int").alias("qty"))
    counted = (name.contains("x") | name.contains("X")) & name.rlike(rx(r"^\d+\s*[xX]\s|\s[xX]\d+\s*$", False))
    return F.when(~counted, plain).otherwise(_built(name, lead, tail, leads))


def _built(name: Column, lead: str, tail: str, leads: Column) -> Column:
    return let(
        F.struct(F.when(leads, strip(F.regexp_extract(name, lead, 2))).otherwise(name).alias("n"), F.when(leads, found(name, lead)).otherwise("1").alias("q")),
        lambda v: F.struct(
            F.when(v["n"].rlike(tail), strip(F.regexp_extract(v["n"], tail, 1))).otherwise(v["n"]).alias("name"),
            F.coalesce(F.when(v["n"].rlike(tail), F.regexp_extract(v["n"], tail, 2)), v["q"]).try_cast("int").alias("qty"),
        ),
    )


def skip_prices(lines: Column, layout: str) -> Column:
    """Amounts of totals and tender, which are no item's price."""
    how = LAYOUTS[layout]
    if layout == "pharmacy_column":
        taxed = F.filter(F.transform(lines, lambda x: F.when(x.rlike(rx(P.RX_TAXED, False)), price_of(x, layout))), lambda x: x.isNotNull())
        odd = f"{how.definitive}|{P.RX_JUNK}"
        inline = rx(r"[₱P]?\s*([\d,]+\.\d{2})", False)
        around = lambda x, i: F.when(
            matches(x, odd),
            F.array(amount(found(x, inline)), F.when(i > 0, price_of(F.get(lines, i - 1), layout)), price_of(F.get(lines, i + 1), layout)),
        )
        every = F.flatten(F.filter(F.transform(lines, around), lambda a: a.isNotNull()))
        return F.array_except(F.filter(every, lambda p: p.isNotNull()), taxed)
    after = F.transform(lines, lambda x, i: F.when(x.rlike(rx(how.definitive)), price_of(F.get(lines, i + 1), layout)))
    return F.filter(after, lambda p: p > 0)


def item(src: Column, name: Column, price: Column, qty: Column | None = None) -> Column:
    none = lambda t: F.lit(None).cast(t)
    return let(
        built(strip(name)),
        lambda b: F.struct(
            src.alias("src"), b["name"].alias("name"), F.round(price, 2).alias("price"), (b["qty"] if qty is None else F.coalesce(qty, b["qty"])).alias("qty"),
            none("double").alias("unit_price"), none("string").alias("sku"),
        ),
    )


def neighbour_items(lines: Column, layout: str) -> Column:
    """Items of a layout that needs no more than a line and the next open one: array<SOURCED>."""
    how = LAYOUTS[layout]

    def inline_item(x, i, skip):
        """An item written on one line, with a count if the layout has one."""

        def kept(v):
            ok = (v["price"] > 0) & ~F.array_contains(skip, v["price"]) & is_name(v["name"], layout)
            if layout == "generic":
                ok = ok & (F.char_length(v["name"]) >= 3) & v["name"].rlike("^[A-Za-z]")
            return F.when(ok, item(i, v["name"], v["price"], v["qty"]))

        def tried(pattern, name_at, price_at, qty_at=None):
            p = rx(pattern, False)
            qty = F.lit(None).cast("int") if qty_at is None else found(x, p, qty_at).try_cast("int")
            parts = F.struct(strip(found(x, p, name_at)).alias("name"), amount(found(x, p, price_at)).alias("price"), qty.alias("qty"))
            return F.when(x.contains(".") & x.rlike(p), let(parts, kept))

        tries = [tried(how.inline, 1, 2)]
        if how.inline_qty:
            tries.insert(0, tried(how.inline_qty, 2, 3, 1) if how.qty_first else tried(how.inline_qty, 1, 3, 2))
        return F.coalesce(*tries)

    def scan(v):
        """The zone of items, whose bounds are found once."""
        heads = F.transform(v["lines"], lambda x: x.rlike(rx(how.header))) if how.header else F.array().cast("array<boolean>")
        end = F.coalesce(index_of(F.transform(v["lines"], lambda x: x.rlike(rx(how.zone_end)))), F.size(v["lines"]))
        start = lambda e: F.coalesce(F.array_max(F.filter(F.transform(heads, lambda h, i: F.when(h, i)), lambda i: i < e)) + 1, F.lit(0))
        bounds = let(end, lambda e: F.struct(start(e).alias("start"), e.alias("end")))
        numbered = F.transform(v["lines"], lambda x, i: F.struct(i.alias("i"), x.alias("x")))
        zone = let(bounds, lambda b: F.filter(numbered, lambda r: (r["i"] >= b["start"]) & (r["i"] < b["end"])))
        return let(F.struct(zone.alias("zone"), skip_prices(v["lines"], layout).alias("skip")), split)

    def split(v):
        return let(
            F.struct(
                F.transform(v["zone"], lambda r: F.struct(r["i"].alias("i"), r["x"].alias("x"), inline_item(r["x"], r["i"], v["skip"]).alias("item"))).alias("all"),
                v["skip"].alias("skip"),
            ),
            lambda w: F.array_sort(F.concat(whole(w), pairs(w))) if layout != "generic" else whole(w),
        )

    def whole(w):
        return F.filter(F.transform(w["all"], lambda r: r["item"]), lambda x: x.isNotNull())

    def pairs(w):
        """A name and the price on the next line that is no item of its own."""
        left = F.filter(w["all"], lambda r: r["item"].isNull())
        seen = F.transform(left, lambda r: F.struct(r["i"].alias("i"), r["x"].alias("x"), price_of(r["x"], layout).alias("p")))
        return let(
            F.struct(seen.alias("seen"), w["skip"].alias("skip")),
            lambda u: F.filter(F.transform(u["seen"], lambda r, k: pair(r, F.get(u["seen"], k + 1)["p"], u["skip"])), lambda x: x.isNotNull()),
        )

    def pair(r, price, skip):
        return F.when((price > 0) & ~F.array_contains(skip, price) & is_name(r["x"], layout), item(r["i"], r["x"], price))

    return let(F.struct(lines.alias("lines")), scan)


def line_features(lines: Column, layout: str) -> Column:
    """What ``pairing`` needs to know of each line, as array<struct>."""
    n = F.size(lines)

    def test(pattern, ignore_case=True):
        return lambda x: matches(x, pattern, ignore_case)

    no = lambda x: F.lit(False)
    pharmacy = layout == "pharmacy_column"
    sep = rf"{P.SEPARATOR}|{P.BANNER}" if layout != "inline_price" else P.SEPARATOR
    marks = {
        "barcode": test(P.BARCODE, False),
        "taxed": test(P.RX_TAXED, False) if pharmacy else no,
        "junk": test(P.RX_JUNK) if pharmacy else no,
        "separator": test(sep, False) if pharmacy else no,
        "mode": test(P.RX_MODE) if pharmacy else no,
        "payment": test(P.RX_PAYMENT) if pharmacy else no,
        "number": test(r"^\d{3,5}$", False) if pharmacy else no,
        "head": test(P.RX_HEADER) if pharmacy else no,
        "total": test(P.RX_TOTAL_LABEL) if pharmacy else no,
        "start": test(f"{P.RX_MODE}|{P.RX_START}" if pharmacy else P.SM_START) if layout != "inline_price" else no,
        "end": test(LAYOUTS[layout].zone_end),
    }
    inline, inline_qty = rx(P.INLINE_TAXED, False), rx(P.SM_INLINE_QTY, False)
    qty_line, discount = rx(P.QTY_LINE, False), rx(P.RX_DISCOUNT_PRICE)
    none = lambda t: F.lit(None).cast(t)
    kinds = "struct<name:string,qty:int>"

    def named(x, pattern, late):
        """The built name before a price or count on the same line, if it can name an item."""
        return F.when(x.contains(".") & x.rlike(pattern), let(strip(found(x, pattern)), lambda name: F.when(is_name(name, layout, late), built(name))))

    def names(x, late, price):
        """struct<strict, loose>: whether the line can name an item, and whether it could if it did not stand late."""
        possible, barred, product = naming(x, layout, price)
        if product is None:
            return let(possible & ~barred, lambda v: F.struct(v.alias("strict"), F.lit(False).alias("loose")))
        kind = F.when(possible, F.when(~barred, 0).when(product, 1))
        return let(kind, lambda k: F.struct(F.coalesce((k == 0) | ((k == 1) & ~late), F.lit(False)).alias("strict"), k.isNotNull().alias("loose")))

    pointed = lambda x, value: F.when(x.contains("."), value)

    def one(x, i):
        return let(price_of(x, layout), lambda price: features(x, i, price))

    def features(x, i, price):
        late = (n > 8) & (i > 0) & (i / n > 0.75)
        parts = lambda: found(x, inline_qty, 2)
        counted = layout == "supermarket"
        can_name = F.lit(True) if layout == "inline_price" else price.isNull()
        return F.struct(
            *(f(x).alias(k) for k, f in marks.items()),
            F.char_length(x).alias("length"),
            F.when(can_name, built(x)).otherwise(none(kinds)).alias("item"),
            names(x, late, price).alias("names"),
            price.alias("price"),
            pointed(x, found(x, qty_line).try_cast("int")).alias("qty"),
            pointed(x, amount(found(x, qty_line, 2))).alias("unit"),
            named(x, inline, late).alias("inline"),
            pointed(x, amount(found(x, inline, 2))).alias("inline_price"),
            (named(x, inline_qty, None) if counted else none(kinds)).alias("counted"),
            (pointed(x, found(parts(), qty_line).try_cast("int")) if counted else none("int")).alias("counted_qty"),
            (pointed(x, amount(found(parts(), qty_line, 2))) if counted else none("double")).alias("counted_unit"),
            (F.when(holding(x, ("LESS", "BP")), amount(found(x, discount))) if pharmacy else none("double")).alias("discount"),
        )

    return F.transform(lines, one)


def stated_count(lines: Column, layout: str) -> Column:
    """How many items the receipt says it has."""
    starred = first(F.transform(lines, lambda x: found(x, rx(P.ITEM_COUNT)).try_cast("int")))
    if layout != "pharmacy_column":
        return starred if layout == "supermarket" else F.lit(None).cast("int")
    stars = lambda x: F.coalesce(x.isin("*", "**", "***"), F.lit(False))
    bare = F.transform(
        lines,
        lambda x, i: F.when(
            x.rlike(rx(r"^\d+item")) | (x.rlike(rx(r"^\d+\s*item")) & ((F.when(i > 0, stars(F.get(lines, i - 1))).otherwise(False)) | stars(F.get(lines, i + 1)))),
            found(x, rx(r"^(\d+)\s*item")).try_cast("int"),
        ),
    )
    bought = first(F.transform(lines, lambda x: found(x, rx(P.RX_ITEMS_PURCHASED)).try_cast("int")))
    return F.coalesce(starred, first(bare), bought)
