"""From lines to receipts: clean, classify, read fields, extract items, validate. One narrow plan without a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slips.functions.text import clean_lines, let
from slips.operators import classify, fields, items, pairing

COLUMNS = ["doc_id", "store_name", "invoice_number", "date", "time", "total_amount", "vat_amount", "tin", "item_count", "has_vat", "items", "extraction_confidence", "receipt_type", "receipt_type_confidence", "extraction_warning"]

#: Item plans of layouts added by ``register_layout``: cleaned lines to array<items.SOURCED>.
EXTRA: dict = {}


def register_layout(name: str, chains: list[str], markers: list[str], plan) -> None:
    """Add a receipt type: its chain and layout patterns, and ``plan(lines) -> array<items.SOURCED>``."""
    classify.SIGNATURES[name] = (chains, markers)
    EXTRA[name] = plan


def supported_types() -> list[str]:
    return [*items.LAYOUTS, *EXTRA]


def read_header(docs: DataFrame) -> DataFrame:
    """doc_id and lines to cleaned lines, type and header fields, each in one evaluation."""
    seen = docs.select("doc_id", clean_lines(F.col("lines")).alias("lines"))
    seen = seen.select("doc_id", F.explode(F.array(F.struct("lines", classify.classify(F.col("lines")).alias("type")))).alias("v"))
    seen = seen.select("doc_id", F.col("v.lines").alias("lines"), "v.type.*")
    priced = seen.withColumn("price", F.explode(F.array(fields.prices(F.col("lines"), F.col("receipt_type")))))
    lines, price = F.col("lines"), F.col("price")
    return priced.select(
        "doc_id", "lines", "receipt_type", "receipt_type_confidence",
        fields.store_name(lines).alias("store_name"), fields.invoice_number(lines).alias("invoice_number"),
        fields.date(lines).alias("date"), fields.time(lines).alias("time"),
        fields.total(lines, price).alias("total"), fields.vat(lines, price).alias("vat"), fields.tin(lines).alias("tin"),
    )


def by_type(receipt_type: Column, plans: dict, default: str) -> Column:
    chain = reduce(lambda c, kv: c.when(receipt_type == kv[0], kv[1]) if c is not None else F.when(receipt_type == kv[0], kv[1]), plans.items(), None)
    return chain.otherwise(plans[default])


def with_items(head: DataFrame, all_lines: bool = True) -> DataFrame:
    """Items of every receipt by its type's plan, each line evaluated once: types whose passes compete for lines leave the
    matching of positions to Python, to which the others' items pass through. Without ``all_lines``, only rows
    that Python looks at keep their lines."""
    lines, kind = F.col("lines"), F.col("receipt_type")
    plans = {k: items.neighbour_items(lines, k) for k in ("generic", "fast_food", "department_store")} | {k: f(lines) for k, f in EXTRA.items()}
    paired = kind.isin(*items.PAIRED)
    wide = head.select(
        *(F.when(paired, lines).otherwise(F.array().cast("array<string>")).alias(c) if c == "lines" and not all_lines else c for c in head.columns),
        F.when(~paired, by_type(kind, plans, "generic")).alias("items"),
        F.when(paired, by_type(kind, {k: items.line_features(lines, k) for k in items.PAIRED}, "inline_price")).alias("features"),
        F.when(paired, by_type(kind, {k: items.skip_prices(lines, k) for k in items.PAIRED}, "inline_price")).alias("skip"),
        F.when(paired, by_type(kind, {k: items.stated_count(lines, k) for k in items.PAIRED}, "inline_price")).alias("stated"),
    )
    out = T.StructType([*head.schema.fields, T.StructField("items", T.ArrayType(T._parse_datatype_string(items.SOURCED)))])
    return wide.mapInArrow(pairing.pair_batches, out)


def validated(found: DataFrame, sourced: bool = False) -> DataFrame:
    """Receipts with counts, confidence and the warning about items that exceed the total."""
    counts = F.transform("items", lambda x: F.coalesce(F.nullif(x["qty"], F.lit(0)), F.lit(1)))
    count = F.aggregate(counts, F.lit(0), lambda a, q: a + q)
    spent = F.aggregate(F.transform("items", lambda x: x["price"] * F.coalesce(F.nullif(x["qty"], F.lit(0)), F.lit(1))), F.lit(0.0), lambda a, p: a + p)
    some = F.size("lines") > 0
    sure = fields.confidence(F.col("store_name"), F.col("total"), F.col("date"), F.size("items"), F.col("invoice_number"))
    plain = F.transform("items", lambda x: F.struct(*(x[c].alias(c) for c in ("name", "price", "qty", "unit_price", "sku"))))
    return found.select(
        "doc_id", "store_name", "invoice_number", "date", "time",
        fields.money_or_null(F.col("total")).alias("total_amount"), fields.money_or_null(F.col("vat")).alias("vat_amount"), "tin",
        count.alias("item_count"), F.col("vat").isNotNull().alias("has_vat"), (F.col("items") if sourced else plain).alias("items"),
        F.when(some, sure).otherwise(0.0).alias("extraction_confidence"), "receipt_type", "receipt_type_confidence",
        F.when((F.size("items") > 0) & (spent > F.col("total") * 1.5), "item_sum_exceeds_total").alias("extraction_warning"),
    )


#: What columns of a receipt need of what is read before the items, if that is not a field of their own name.
NEEDS = {"total_amount": ["total"], "vat_amount": ["vat"], "has_vat": ["vat"], "extraction_warning": ["total"], "extraction_confidence": ["lines", "store_name", "total", "date", "invoice_number"]}


def extract(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Receipts (one per document) from doc_id and lines (array<string>); documents without lines give the empty record.

    ``keep`` names the columns that are wanted: fields that only others need are not read and don't go to Python and back.
    """
    head = read_header(docs)
    if keep is None:
        return validated(with_items(head))
    needed = {"doc_id", "lines", "receipt_type", *keep, *(f for c in keep for f in NEEDS.get(c, []))}
    found = with_items(head.select(*(c for c in head.columns if c in needed)), "extraction_confidence" in keep)
    return validated(found.withColumns({f.name: F.lit(None).cast(f.dataType) for f in head.schema if f.name not in needed})).select(*keep)


def item_rows(receipts: DataFrame) -> DataFrame:
    """Items as a relation: doc_id, item_no and the item's fields."""
    return receipts.select("doc_id", F.posexplode("items").alias("item_no", "x")).select("doc_id", (F.col("item_no") + 1).alias("item_no"), "x.*")


__all__ = ["COLUMNS", "extract", "item_rows", "let", "register_layout", "supported_types"]
