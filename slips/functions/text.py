"""Column helpers for lines of text: regex, first hits, amounts."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PESO = "₱"


def rx(pattern: str, ignore_case: bool = True) -> str:
    """A pattern with Unicode classes, and case-insensitive unless told otherwise."""
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def either(patterns: Iterable[str]) -> str:
    return "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def alternatives(pattern: str) -> list[str]:
    """What stands between the bars of a pattern that are in no group and no class."""
    parts, depth, listed, k = [""], 0, False, 0
    while k < len(pattern):
        c = pattern[k : k + 2] if pattern[k] == "\\" else pattern[k]
        if c == "|" and not depth and not listed:
            parts.append("")
        else:
            depth += (c == "(") - (c == ")") if not listed else 0
            listed = c == "[" or (listed and c != "]")
            parts[-1] += c
        k += len(c)
    return parts


def matches(line: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Whether a pattern is found in a line. Alternatives that begin at its start share one anchor, as a pattern whose bars
    stand outside it would try all of them at every place of the line."""
    every = alternatives(pattern)
    anchored, free = [p[1:] for p in every if p.startswith("^")], [p for p in every if not p.startswith("^")]
    tests = [line.rlike(rx(p, ignore_case)) for p in (*(["^" + either(anchored)] if anchored else []), *(["|".join(free)] if free else []))]
    return tests[0] if len(tests) == 1 else tests[0] | tests[1]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: What ``\s`` matches with Unicode classes.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def clean_lines(lines: Column) -> Column:
    """Stripped lines without the blank ones; null lines of a null document are none."""
    return F.filter(F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != "")


def found(line: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without a match (the group itself must not be empty)."""
    return let(F.regexp_extract(line, pattern, group), lambda v: F.when(v != "", v))


def first(values: Column) -> Column:
    """First non-null element of an array, or null."""
    return F.get(F.filter(values, lambda x: x.isNotNull()), 0)


def first_by_line(lines: Column, tries: list[Callable[[Column], Column]]) -> Column:
    """The first line with a hit decides; within a line the tries go in order."""
    return first(F.transform(lines, lambda x: F.coalesce(*[t(x) for t in tries])))


def first_by_pattern(lines: Column, tries: list[Callable[[Column], Column]]) -> Column:
    """The first try with a hit on any line decides; within a try the lines go in order."""
    return F.coalesce(*[first(F.transform(lines, t)) for t in tries])


def candidates(lines: Column, gate: str) -> Column:
    """Lines that a cheap pattern lets through; it must hold for every line that the costly ones would match."""
    return F.filter(lines, lambda x: x.rlike(rx(gate)))


def holding(line: Column, parts: Iterable[str]) -> Column:
    """Whether a line holds one of some parts in capitals, in whatever case it is written. No part may have a K or an I, which
    match signs that are not their small letters."""
    return let(F.upper(line), lambda x: reduce(lambda a, b: a | b, map(x.contains, parts)))


def amount(text: Column) -> Column:
    """Digits with thousands separators as a number; null if they are none."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def money(value: Column) -> Column:
    return F.concat(F.lit(PESO), F.format_number(value, 2))


def index_of(flags: Column) -> Column:
    """Position (from 0) of the first true element, or null."""
    return F.nullif(F.array_position(flags, True), F.lit(0)).cast("int") - 1


def spaced_price(decimals: str = r"\d{2}", suffix: str = "") -> str:
    return rf"[{PESO}P]?\s*([\d,]+\.{decimals}){suffix}"
