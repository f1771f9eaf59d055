"""Receipt type from chain names, layout markers or the shape of the lines."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from slips.functions import patterns as P
from slips.functions.text import either, let, matches, rx, strip

#: Chain and layout patterns by type, in order of priority. ``register_layout`` adds to it.
SIGNATURES = dict(P.SIGNATURES)


def needed(pattern: str) -> str | None:
    """The longest run of capitals that every match of a pattern holds; None where it cannot be told simply."""
    if re.search(r"[|()\[\]{}*^$.]", pattern):
        return None
    pieces = [x for x in re.split(r"\\.\+?|.\?|[^A-Z]", pattern) if len(x) > 2]
    return max(pieces, key=len, default=None)


def folded(text: Column) -> Column:
    """Upper case, also of the two signs that match K and I without regard to case but are no small letters."""
    return F.upper(F.replace(F.replace(text, F.lit("\u212a"), F.lit("K")), F.lit("\u0130"), F.lit("I")))


def by_chain(lines: Column) -> Column:
    """Type whose chain name occurs; blanks in a name may be a line break. A pattern is tried only on texts that hold the
    capitals it needs."""
    def named(v):
        def occurs(chains):
            words = [needed(c) for c in chains]
            found = v["block"].rlike(rx(either(chains)))
            return found if None in words else reduce(lambda a, b: a | b, (v["folded"].contains(w) for w in words)) & found

        return F.coalesce(*[F.when(occurs(chains), name) for name, (chains, _) in SIGNATURES.items()])

    return let(F.array_join(lines, "\n"), lambda block: let(F.struct(block.alias("block"), folded(block).alias("folded")), named))


def by_layout(lines: Column) -> Column:
    def marked(stripped, markers):
        return F.exists(stripped, lambda x: matches(x, "|".join(markers)))

    return let(F.transform(lines, strip), lambda stripped: F.coalesce(*[F.when(marked(stripped, markers), name) for name, (_, markers) in SIGNATURES.items() if markers]))


def is_price_shape(line: Column) -> Column:
    return line.rlike(rx(P.SHAPE_PRICE, False))


def is_inline_shape(line: Column) -> Column:
    return line.rlike(rx(P.SHAPE_INLINE, False)) & ~is_price_shape(line)


def by_shape(lines: Column) -> Column:
    share = lambda test: F.size(F.filter(lines, lambda x: test(strip(x)))) / F.size(lines)
    return F.when(share(is_price_shape) >= P.STANDALONE_RATIO, "pharmacy_column").when(share(is_inline_shape) >= P.INLINE_RATIO, "inline_price")


def classify(lines: Column) -> Column:
    """struct<receipt_type, receipt_type_confidence> of cleaned lines."""
    def told(v):
        kind = F.coalesce(v["sure"], v["shape"], F.lit("generic"))
        sure = F.when(v["sure"].isNotNull(), "high").when(v["shape"].isNotNull(), "medium").otherwise("low")
        return F.struct(kind.alias("receipt_type"), sure.alias("receipt_type_confidence"))

    some = F.size(lines) > 0
    known = F.when(some, F.coalesce(by_chain(lines), by_layout(lines)))
    return let(known, lambda sure: let(F.struct(sure.alias("sure"), F.when(some & sure.isNull(), by_shape(lines)).alias("shape")), told))
