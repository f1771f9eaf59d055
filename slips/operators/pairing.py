"""Matching of names, prices, quantities and barcodes that stand on lines of their own.

A receipt is a strip of lines. Rules run over it in order; each is a sequence of kinds that starts at an open line, and
takes the lines it uses. The kinds are those of ``items.line_features`` and of ``KINDS``; nothing here reads text.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: Kinds that follow from the features of a line ``x`` and the prices ``skip`` that are totals.
KINDS: dict[str, Callable[[dict, set], bool]] = {
    "amount": lambda x, skip: x["price"] is not None,
    "bare_amount": lambda x, skip: x["price"] is not None and not x["barcode"],
    "any_price": lambda x, skip: (x["price"] or 0) > 0,
    "price": lambda x, skip: (x["price"] or 0) > 0 and x["price"] not in skip,
    "taxed_price": lambda x, skip: x["taxed"] and KINDS["price"](x, skip),
    "plain_price": lambda x, skip: not x["taxed"] and KINDS["price"](x, skip),
    "qty": lambda x, skip: x["qty"] is not None,
    "filler": lambda x, skip: x["junk"] or x["separator"] or x["number"] or x["length"] <= 2,
    "pause": lambda x, skip: KINDS["filler"](x, skip) or x["mode"] or x["payment"],
    "qty_or_filler": lambda x, skip: x["qty"] is not None or KINDS["filler"](x, skip),
    "qty_or_junk": lambda x, skip: x["qty"] is not None or x["junk"] or x["separator"],
}
PRICES = {"amount", "any_price", "price", "taxed_price", "plain_price"}


class Step(NamedTuple):
    """A kind that comes next: on the next open line, or past up to ``most`` open lines of the kind ``past``."""

    kind: str
    #: The rule goes on without it; or: the rule fails if it is there.
    optional: bool = False
    absent: bool = False
    #: No taken line may lie between; the line must be in the zone.
    strict: bool = False
    zoned: bool = False
    past: str | None = None
    most: int = 0
    #: Looked for only where this kind has been found.
    given: str | None = None


class Places(dict):
    """Where the steps were found, by kind, and the lines that were passed on the way."""

    def __init__(self):
        self.passed: list[int] = []

    def lines(self) -> list[int]:
        return [*self.values(), *self.passed]


class Rule(NamedTuple):
    """An item: a line of kind ``head`` with ``steps`` below it, without ``above`` over it, if ``holds`` agrees."""

    head: str
    steps: tuple[Step, ...]
    above: tuple[Step, ...] = ()
    holds: Callable[[Strip, Places], bool] = lambda s, got: True


class Strip:
    def __init__(self, lines: list[dict], skip: list[float], texts: list[str]):
        self.texts, self.lines, self.skip, self.n = texts, lines, set(skip or ()), len(lines)
        self.open = [True] * self.n
        self.start, self.end = 0, self.n
        self.items: list[dict] = []

    def next(self, i: int) -> int | None:
        while i < self.n and not self.open[i]:
            i += 1
        return i if i < self.n else None

    def take(self, *places: int | None) -> None:
        for i in places:
            if i is not None:
                self.open[i] = False

    def is_(self, kind: str, i: int) -> bool:
        rule = KINDS.get(kind)
        return self.lines[i][kind] if rule is None else rule(self.lines[i], self.skip)

    def look(self, i: int, step: Step, way: int = 1) -> tuple[int, list[int]] | None:
        """Where a step that starts at line ``i`` ends, going down (``way`` 1) or up to the start of the zone (-1), and what it passed."""
        k, passed, least, end = i + way, [], self.start if way < 0 else 0, self.end if step.zoned else self.n
        while least <= k < end:
            if self.open[k]:
                if self.is_(step.kind, k):
                    return k, passed
                if len(passed) >= step.most or not self.is_(step.past, k):
                    return None
                passed.append(k)
            elif step.strict:
                return None
            k += way
        return None

    def follow(self, i: int, steps: tuple[Step, ...], way: int = 1) -> Places | None:
        """Places of the steps from line ``i`` on, or None."""
        got = Places()
        for step in steps:
            if step.given is not None and step.given not in got:
                continue
            found = self.look(i, step, way)
            if step.absent:
                if found is not None:
                    return None
            elif found is not None:
                i, passed = found
                got[step.kind] = i
                got.passed += passed
            elif not step.optional:
                return None
        return got

    def add(self, src: int, named: dict, price: float, sku: int | None = None, qty: int | None = None, unit: float | None = None) -> None:
        self.items.append({
            "src": src, "name": named["name"], "price": round(price, 2), "qty": named["qty"] if qty is None else qty,
            "unit_price": unit, "sku": None if sku is None else self.texts[sku],
        })

    def zone(self) -> Iterator[int]:
        return (i for i in range(self.start, self.end) if self.open[i])

    def apply(self, *rules: Rule) -> None:
        for rule in rules:
            for i in self.zone():
                if not self.is_(rule.head, i) or (rule.above and self.follow(i, rule.above, -1) is not None):
                    continue
                got = self.follow(i, rule.steps)
                if got is not None and rule.holds(self, got):
                    at = {rule.head: i, **got}
                    name, price = at.get("name", i), next(k for kind, k in at.items() if kind in PRICES)
                    self.add(name, self.lines[name]["item"], self.lines[price]["price"], got.get("barcode"), *self.count(got))
                    self.take(i, *got.lines())

    def count(self, got: dict[str, int]) -> tuple[int | None, float | None]:
        """Quantity and unit price of the quantity line, if there is one."""
        q = got.get("qty")
        return (None, None) if q is None else (self.lines[q]["qty"], self.lines[q]["unit"])

    def inline(self, steps: tuple[Step, ...]) -> None:
        """A pass: items that have name and price on one line."""
        for i in self.zone():
            x = self.lines[i]
            if not self.open[i] or not x["inline"] or (x["inline_price"] or 0) <= 0 or x["inline_price"] in self.skip:
                continue
            got = self.follow(i, steps) or {}
            self.add(i, x["inline"], x["inline_price"], got.get("barcode"), *self.count(got))
            self.take(i, *got.values())

    def done(self, stated: int | None = None, doubt=None) -> list[dict]:
        self.items.sort(key=lambda x: x["src"])
        if stated and len(self.items) > stated:  # keeps the most doubtful, as specified
            self.items = sorted(self.items, key=doubt, reverse=True)[:stated]
        return self.items


MAYBE_BARCODE, MAYBE_QTY = Step("barcode", optional=True), Step("qty", optional=True)


def first_end(s: Strip, begin: int) -> int:
    return next((i for i in range(begin, s.n) if s.lines[i]["end"]), s.n)


def inline_price(s: Strip, stated: int | None) -> list[dict]:
    s.end = first_end(s, 0)
    next_barcode = Step("barcode", optional=True, strict=True)
    s.inline((next_barcode,))
    s.apply(Rule("name", (Step("price", zoned=True), next_barcode)))
    return s.done()


def supermarket(s: Strip, stated: int | None) -> list[dict]:
    s.end = first_end(s, 0)
    head = next((i for i in range(s.end) if s.lines[i]["start"]), None)
    if head is not None:
        s.take(head)
        s.start = head + 1
    # Items on one line: with the count and unit price there and the price after it, or with the price itself.
    for i in s.zone():
        x = s.lines[i]
        if not s.open[i]:
            continue
        if x["counted"] and x["counted_qty"] is not None and (got := s.follow(i, (Step("price"), MAYBE_BARCODE))) is not None:
            s.add(i, x["counted"], s.lines[got["price"]]["price"], got.get("barcode"), x["counted_qty"], x["counted_unit"])
            s.take(i, *got.values())
        elif x["inline"] and (x["inline_price"] or 0) > 0 and x["inline_price"] not in s.skip:
            got = s.follow(i, (MAYBE_QTY, MAYBE_BARCODE)) or {}
            s.add(i, x["inline"], x["inline_price"], got.get("barcode"), *s.count(got))
            s.take(i, *got.values())
    s.apply(
        Rule("name", (Step("qty"), Step("price"), MAYBE_BARCODE)),
        Rule("name", (Step("price", zoned=True), Step("qty", optional=True, zoned=True), MAYBE_BARCODE)),
        Rule("name", (Step("barcode", strict=True), Step("price", strict=True))),
    )
    return s.done(stated, lambda x: 5 * (not x["sku"]) + 3 * (len(x["name"]) <= 4))


#: Lines before the mode or currency line that may name an item already.
NAMES_ABOVE = 7


def pharmacy_zone(s: Strip) -> None:
    """Items begin with the first name in a window above the mode or currency line, under the window's last header or
    separator, or else with that line; they end with the next end line. A zone from line 0 on counts as none."""
    for mark in (i for i in range(s.n) if s.lines[i]["start"]):
        window = range(max(0, mark - NAMES_ABOVE), mark)
        under = max((i for i in window if s.lines[i]["head"] or s.lines[i]["separator"]), default=window.start - 1)
        s.take(mark)
        s.start = min((i for i in window if i > under and s.lines[i]["name"]), default=mark)
        if s.start > 0:
            s.end = first_end(s, max(mark, s.start + 1))
            return


#: A quantity counts after a price only behind the item's barcode.
QTY_OF_BARCODE = Step("qty", optional=True, given="barcode")
#: Above a price: a name with its barcode, close enough for the price to be theirs.
CODED_ABOVE = (Step("barcode", strict=True, past="qty_or_junk", most=2), Step("name"))
#: Above a name: a price that may be its own, whatever barcodes lie between.
AMOUNT_ABOVE = (Step("bare_amount", past="barcode", most=sys.maxsize),)

#: Rules before and after the names whose barcode comes ahead of the price.
PHARMACY = (
    Rule("name", (Step("barcode", strict=True), Step("qty", strict=True), Step("price", strict=True))),
    Rule(
        "name",
        (Step("amount", past="pause", most=2), MAYBE_BARCODE, QTY_OF_BARCODE),
        holds=lambda s, got: s.is_("price", got["amount"]) and (s.lines[got["amount"]]["taxed"] or "barcode" in got or bool(got.passed)),
    ),
    Rule("taxed_price", (Step("name"), MAYBE_QTY, MAYBE_BARCODE), above=CODED_ABOVE),
    Rule("plain_price", (Step("name"), Step("price", absent=True), MAYBE_BARCODE)),
)
PHARMACY_LEFT = (Rule("loose", (Step("any_price"), MAYBE_BARCODE, QTY_OF_BARCODE)),)


def pharmacy(s: Strip, stated: int | None) -> list[dict]:
    pharmacy_zone(s)
    s.apply(*PHARMACY)
    for i in s.zone():
        if s.lines[i]["name"] and s.follow(i, AMOUNT_ABOVE, -1) is None:
            coded_name(s, i)
    s.apply(*PHARMACY_LEFT)
    s.inline((MAYBE_BARCODE,))
    s.items.sort(key=lambda x: x["src"])
    orphan(s)
    if stated and len(s.items) > stated:
        doubt = lambda x: 10 * (not x["sku"]) + 5 * (len(x["name"]) <= 6) + 8 * any(c in x["name"] for c in "#:*")
        s.items = sorted(s.items, key=doubt, reverse=True)[:stated]
    return s.items


def coded_name(s: Strip, i: int) -> None:
    """An item whose barcode follows its name, past filler or a quantity, and whose price follows the barcode."""
    L = s.lines
    found = s.look(i, Step("barcode", strict=True, past="qty_or_filler", most=4))
    if found is None:
        return
    b, between = found
    q = max((k for k in between if L[k]["qty"] is not None), default=None)
    after = L[b + 1] if b + 1 < s.n and s.open[b + 1] else None
    price = after and after["price"]
    if price is None:  # a discount may stand in for the price, but only of a name that is not followed by its barcode at once
        saved = [x["discount"] for x in L if (x["discount"] or 0) > 0]
        if between and saved:
            s.add(i, L[i]["item"], saved[0], b)
            s.take(i, b, *between)
    elif q is not None and b + 2 < s.n and L[b + 2]["total"]:  # the price is the total's
        s.add(i, L[i]["item"], round(L[q]["qty"] * L[q]["unit"], 2), b, *s.count({"qty": q}))
        s.take(i, b, *between)
    elif s.is_("price", b + 1):
        s.add(i, L[i]["item"], price, b, *s.count({"qty": q}))
        s.take(i, b, b + 1, *between)


def orphan(s: Strip) -> None:
    """The one name with a barcode but no price gets what the other items leave of the total."""
    left = []
    for i in s.zone():
        if s.lines[i]["name"]:
            j = s.next(i + 1)
            if j is not None and j < s.end and s.lines[j]["barcode"]:
                left.append((i, j))
    if len(left) != 1:
        return
    spent = sum(x["price"] for x in s.items)
    totals = [x["price"] for x in s.lines if x["price"] and x["price"] >= spent and not x["taxed"]]
    if totals and 0 < round(min(totals) - spent, 2) < min(totals):
        i, j = left[0]
        s.add(i, s.lines[i]["item"], round(min(totals) - spent, 2), j)


PASSES = {"inline_price": inline_price, "supermarket": supermarket, "pharmacy_column": pharmacy}
ITEMS = pa.list_(pa.struct([("src", pa.int32()), ("name", pa.string()), ("price", pa.float64()), ("qty", pa.int32()), ("unit_price", pa.float64()), ("sku", pa.string())]))


def plain(column: pa.Array) -> list:
    """Values of a column without nested lists, as ``to_pylist`` gives them, but made by the column."""
    if pa.types.is_struct(column.type):
        names = [f.name for f in column.type]
        made = [dict(zip(names, row, strict=True)) for row in zip(*map(plain, column.flatten()), strict=True)]
        return made if not column.null_count else [x if ok else None for x, ok in zip(made, column.is_valid().to_numpy(zero_copy_only=False).tolist(), strict=True)]
    if not column.null_count or pa.types.is_string(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    values = column.fill_null(False if pa.types.is_boolean(column.type) else 0).to_numpy(zero_copy_only=False).astype(object)
    values[column.is_null().to_numpy(zero_copy_only=False)] = None
    return values.tolist()


def nested(column: pa.Array) -> list[list]:
    """Values of a column of lists."""
    values, ends = plain(column.flatten()), np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    return [values[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def strips(batch: pa.RecordBatch) -> Iterator[tuple[str, Strip, int | None]]:
    """Type, strip and stated count of each row."""
    features = nested(batch.column("features"))
    for lines in features:
        for x in lines:
            x["name"], x["loose"] = x["names"]["strict"], x["names"]["loose"]
    kinds, stated = plain(batch.column("receipt_type")), plain(batch.column("stated"))
    for kind, lines, skip, texts, count in zip(kinds, features, nested(batch.column("skip")), nested(batch.column("lines")), stated, strict=True):
        yield kind, Strip(lines, skip, texts), count


def pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fill ``items`` of the rows with ``features`` and drop what only they have; other rows keep the items they have."""
    for batch in batches:
        names = batch.schema.names
        kept = [c for c in names if c not in ("features", "skip", "stated", "items")]
        open_, given = batch.filter(batch.column("features").is_valid()), batch.column("items").cast(ITEMS)
        found = pa.array([PASSES[kind](strip, stated) for kind, strip, stated in strips(open_)], ITEMS)
        at = pc.if_else(batch.column("features").is_valid(), pc.add(pc.cumulative_sum(batch.column("features").is_valid().cast(pa.int64())), len(batch) - 1), pa.array(range(len(batch)), pa.int64()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.concat_arrays([given, found]).take(at)], names=[*kept, "items"])
