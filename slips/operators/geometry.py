"""Rows, columns and sections from the boxes of recognised lines.

Documents carry ``lines``: array<struct<text, confidence, bbox, ...>> with four corner points from the top left,
clockwise. Each document is worked on within its own row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slips.functions.text import let

#: Least tolerance, bounds of a plausible line height, gap that starts a column, distance that joins two rows.
TOLERANCE, LOWEST, HIGHEST, COLUMN_GAP, MERGE_GAP = 15, 10.0, 50.0, 100.0, 40.0
PRICE = r"\$\d+\.\d{2}"


def _corner(box: Column, point: int, axis: int) -> Column:
    return F.get(F.get(box, point), axis)


def has_box(line: Column) -> Column:
    return F.coalesce(F.size(line["bbox"]), F.lit(0)) == 4


def y_of(line: Column) -> Column:
    return F.when(has_box(line), (_corner(line["bbox"], 0, 1) + _corner(line["bbox"], 1, 1)) / 2).otherwise(0.0)


def x_of(line: Column) -> Column:
    return F.when(has_box(line), (_corner(line["bbox"], 0, 0) + _corner(line["bbox"], 3, 0)) / 2).otherwise(0.0)


def _axis(box: Column, axis: int) -> Column:
    return F.transform(box, lambda p: F.get(p, axis))


def height(line: Column) -> Column:
    return let(_axis(line["bbox"], 1), lambda ys: F.array_max(ys) - F.array_min(ys))


def position(line: Column) -> Column:
    """struct<top, left, width, height> of a box, in whole pixels."""
    span = lambda a: F.struct(F.array_min(a).alias("low"), F.array_max(a).alias("high"))
    whole = lambda c: c.cast("int")
    spans = F.struct(let(_axis(line["bbox"], 0), span).alias("x"), let(_axis(line["bbox"], 1), span).alias("y"))
    return let(
        spans,
        lambda s: F.struct(
            whole(s["y"]["low"]).alias("top"), whole(s["x"]["low"]).alias("left"),
            whole(s["x"]["high"] - s["x"]["low"]).alias("width"), whole(s["y"]["high"] - s["y"]["low"]).alias("height"),
        ),
    )


def tolerance(lines: Column) -> Column:
    """Half the median height of plausible lines, but no less than the base."""
    tall = F.sort_array(F.filter(F.transform(F.filter(lines, has_box), height), lambda h: h.between(LOWEST, HIGHEST)))
    return let(
        tall,
        lambda h: F.when(
            F.size(h) > 0,
            F.greatest(F.lit(TOLERANCE), ((F.get(h, F.floor((F.size(h) - 1) / 2).cast("int")) + F.get(h, F.floor(F.size(h) / 2).cast("int"))) / 4).cast("int")),
        ).otherwise(TOLERANCE),
    )


def _rows_of(lines: Column) -> Column:
    """struct<placed, breaks>: lines from top to bottom, and where rows begin, with the end of the last one. A line within
    tolerance of the row's first line joins it."""

    def place(own):
        placed = F.sort_array(F.transform(own, lambda x, i: F.struct(y_of(x).alias("y"), x_of(x).alias("x"), i.alias("i"), x.alias("line"))))
        return let(F.struct(placed.alias("placed"), tolerance(own).alias("tolerance")), number)

    def number(v):
        start = F.struct(F.lit(0).alias("k"), F.lit(None).cast("double").alias("anchor"), F.array().cast("array<int>").alias("out"))

        def step(acc, p):
            same = acc["anchor"].isNotNull() & (F.abs(p["y"] - acc["anchor"]) <= v["tolerance"])
            joined = F.struct((acc["k"] + 1).alias("k"), acc["anchor"].alias("anchor"), acc["out"].alias("out"))
            opened = F.struct((acc["k"] + 1).alias("k"), p["y"].alias("anchor"), F.array_append(acc["out"], acc["k"]).alias("out"))
            return F.when(same, joined).otherwise(opened)

        return F.aggregate(v["placed"], start, step, lambda acc: F.struct(v["placed"].alias("placed"), F.array_append(acc["out"], acc["k"]).alias("breaks")))

    return let(lines, place)


def _row(items: Column, number: Column) -> Column:
    """One formatted row from its items in reading order."""
    right = lambda p: F.array_max(_axis(p["line"]["bbox"], 0))
    left = lambda p: F.array_min(_axis(p["line"]["bbox"], 0))
    gaps = F.transform(items, lambda p, i: F.when(i > 0, left(p) - right(F.get(items, i - 1)) >= COLUMN_GAP).otherwise(False))

    def told(opens):
        pieces = F.transform(
            items,
            lambda p, i: F.concat(F.when(i == 0, "").when(F.get(opens, i), "  ").otherwise(" "), p["line"]["text"]),
        )
        confidence = F.aggregate(items, F.lit(0.0), lambda a, p: a + F.coalesce(p["line"]["confidence"], F.lit(0.0))) / F.size(items)
        return _formatted(number, F.array_join(pieces, ""), F.size(items), F.size(F.filter(opens, lambda o: o)) + 1, confidence, F.get(items, 0)["y"])

    return let(gaps, told)


def _formatted(number: Column, text: Column, items: Column, columns: Column, confidence: Column, y: Column) -> Column:
    return F.struct(
        number.alias("row_number"), text.alias("text"), items.alias("item_count"), columns.alias("columns"),
        F.round(confidence, 3).alias("confidence"), y.alias("y_position"), F.lit(None).cast("boolean").alias("merged"),
    )


def _lone(p: Column, number: Column) -> Column:
    """The formatted row of one item."""
    return _formatted(number, F.coalesce(p["line"]["text"], F.lit("")), F.lit(1), F.lit(1), F.coalesce(p["line"]["confidence"], F.lit(0.0)), p["y"])


def rows(lines: Column) -> Column:
    """array<struct<row_number, text, item_count, columns, confidence, y_position, merged>>"""

    def cut(v):
        def of(start, k):
            n = F.get(v["breaks"], k + 1) - start
            across = F.sort_array(F.transform(F.slice(v["placed"], start + 1, n), lambda p, i: F.struct(p["x"].alias("x"), i.alias("i"), p["y"].alias("y"), p["line"].alias("line"))))
            return F.when(n == 1, let(F.get(v["placed"], start), lambda p: _lone(p, k + 1))).otherwise(let(across, lambda items: _row(items, k + 1)))

        return F.transform(F.slice(v["breaks"], 1, F.size(v["breaks"]) - 1), of)

    return let(_rows_of(lines), cut)


def contains_price(text: Column) -> Column:
    return text.rlike(PRICE)


def sections(rows_: Column) -> Column:
    """array<struct<type, start_row, end_row, description>>: header, footer if it has totals, items between."""
    return let(rows_, _sections)


def _sections(rows_: Column) -> Column:
    n = F.size(rows_)
    head = F.least(F.lit(5), n)
    foot = F.greatest(head, n - 5)
    totals = F.exists(F.slice(rows_, foot + 1, F.greatest(n - foot, F.lit(0))), lambda r: F.upper(r["text"]).rlike("TOTAL|TAX"))
    one = lambda t, a, b, d: F.struct(F.lit(t).alias("type"), a.alias("start_row"), b.alias("end_row"), F.lit(d).alias("description"))
    return F.array_compact(
        F.array(
            F.when(n > 0, one("header", F.lit(1), head, "Merchant info, date, address")),
            F.when(n > foot, F.when(totals, one("footer", foot + 1, n, "Totals, payment, change"))),
            F.when(foot > head, one("items", head + 1, foot, "Line items and products")),
        )
    )


def merged(rows_: Column) -> Column:
    """A row with a price takes in a close next row without one."""
    def heads(r, i):
        after = F.get(rows_, i + 1)
        return F.coalesce(contains_price(r["text"]) & ~contains_price(after["text"]) & (after["y_position"] - r["y_position"] < MERGE_GAP), F.lit(False))

    def join(r, i):
        after = F.get(rows_, i + 1)
        return (
            r.withField("text", F.concat_ws(" ", r["text"], after["text"]))
            .withField("item_count", r["item_count"] + after["item_count"])
            .withField("columns", F.lit(None).cast("int"))
            .withField("confidence", (r["confidence"] + after["confidence"]) / 2)
            .withField("merged", F.lit(True))
        )

    # A head has a price and what it takes in has none, so no row is both.
    def kept(heads_):
        return F.transform(rows_, lambda r, i: F.when(F.get(heads_, i), join(r, i)).when((i > 0) & F.get(heads_, i - 1), None).otherwise(r))

    return F.array_compact(let(F.transform(rows_, heads), kept))


def structure(rows_: Column, sections_: Column) -> Column:
    n = F.size(rows_)
    has = lambda t: F.exists(sections_, lambda s: s["type"] == t)
    items = F.aggregate(rows_, F.lit(0), lambda a, r: a + r["item_count"])
    return F.struct(
        n.alias("total_rows"), F.size(sections_).alias("sections_count"), F.transform(sections_, lambda s: s["type"]).alias("section_types"),
        has("header").alias("has_header"), has("footer").alias("has_footer"), has("items").alias("has_items"),
        F.size(F.filter(rows_, lambda r: F.coalesce(r["merged"], F.lit(False)))).alias("multi_line_items"),
        F.size(F.filter(rows_, lambda r: contains_price(r["text"]))).alias("rows_with_prices"),
        F.when(n > 0, items / n).otherwise(0.0).alias("average_items_per_row"),
    )


def format_receipts(docs: DataFrame) -> DataFrame:
    """doc_id and lines to formatted_text, rows (merged), sections (of the rows before merging) and structure."""
    first = docs.select("doc_id", F.explode(F.array(rows(F.col("lines")))).alias("plain"))
    second = first.select("doc_id", F.explode(F.array(F.struct(merged(F.col("plain")).alias("rows"), sections(F.col("plain")).alias("sections")))).alias("v"))
    out = second.select("doc_id", "v.*")
    return out.select(
        "doc_id", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("formatted_text"), "rows", "sections",
        structure(F.col("rows"), F.col("sections")).alias("structure"),
    )


