"""Balanced shards by sampled splitters.

Records are ordered by the hash of their text. A size-weighted sample of keys gives quantile boundaries, and
the boundaries part the records into many more ranges than shards. Of an overfull range the keys that are
themselves heavier than a range are set apart, and the rest is subdivided by a second hash of the key, so equal
texts stay together; only a key of over an eighth of a shard is subdivided by the hash of its record's id. The
exact bytes of the resulting cells are summed, and the cells are dealt to shards, the largest first, each to the
shard that is lightest so far: shards differ by no more than the cells that are dealt last, or than one record or
group of equal texts that is larger than a cell.

Null texts weigh one byte and hash as the empty text; null ids are ordered like any other; repeated rows are
placed one by one; an empty table gives an empty result; further columns are ignored. Everything runs as
DataFrame operations. What reaches the driver is the sample, the ranges, the keys heavier than a range and the
cells; their number is fixed by the number of ranges, whatever the rows.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, read_table, stash

#: Ranges for each shard, keys drawn for each range, ranges that one key may fill unsplit, and rows that a task numbers.
RANGES_PER_SHARD, DRAWS_PER_RANGE, RANGES_OF_KEY, ROWS_PER_SLICE = 256, 8, 32, 200_000


def draw_keys(rows: DataFrame, step: float) -> DataFrame:
    """Keys drawn in proportion to size: one draw for each full ``step`` bytes, the rest by chance."""
    share = F.col("size") / F.lit(step)
    unit = F.pmod(F.xxhash64("tie", "h", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.floor(share) + F.when(unit < share - F.floor(share), 1).otherwise(0)
    return rows.select("h", times.alias("draws")).where("draws > 0").groupBy("h").agg(F.sum("draws").alias("draws"))


def splitters(drawn: list[tuple[int, int]], n_ranges: int) -> list[int]:
    """First keys of the ranges after the first; a key that fills a quantile alone is set apart."""
    total, bounds, seen, passed = sum(n for _, n in drawn), set(), 0, 0
    for key, n in sorted(drawn):
        seen += n
        due = seen * n_ranges // max(total, 1)
        if due > passed:
            bounds.add(key)
        if due > passed + 1:
            bounds.add(key + 1)
        passed = due
    return sorted(b for b in bounds if b < 1 << 63)


def table(values: list[int]) -> Column:
    """A constant array; as one string it is one node of the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds that are not above the key, by binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    known, steps = table(bounds), F.lit([1 << i for i in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda low, s: low + F.when(F.coalesce(F.get(known, low + s - 1) <= key, F.lit(False)), s).otherwise(0)
    )


def pack(weights: dict[int, int], n_shards: int) -> dict[int, int]:
    """Shard of each cell: the largest first, to the lightest shard."""
    shards, placed = [(0, s) for s in range(n_shards)], {}
    for cell in sorted(weights, key=lambda c: (-weights[c], c)):
        load, s = heapq.heappop(shards)
        placed[cell] = s
        heapq.heappush(shards, (load + weights[cell], s))
    return placed


def cells(rows: DataFrame, n_ranges: int, total: int, count: int) -> DataFrame:
    """``rows`` with the cell of each: its range, or the part of an overfull range or heavy key that it falls into."""
    step = max(total / (n_ranges * DRAWS_PER_RANGE), 1e-9)
    bounds = splitters([(r.h, r.draws) for r in draw_keys(rows, step).collect()], n_ranges)
    ranged = rows.withColumn("range", range_of(F.col("h"), bounds).cast("int"))
    load = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    full = total / n_ranges
    loads = {r.range: max(r.bytes, r.n * total / count) for r in load}
    over = [k for k, x in loads.items() if x > 2 * full]
    # Of overfull ranges: the keys that are heavier than a range, of which there are fewer than ranges.
    heavy: list = []
    if over:
        flags = table([int(k in set(over)) for k in range(len(bounds) + 1)])
        each = ranged.where(F.get(flags, F.col("range")) == 1).groupBy("range", "h")
        heavy = sorted((r.h, r.range, r.bytes) for r in each.agg(F.sum("size").alias("bytes")).where(F.col("bytes") > F.lit(full)).collect())
    for _, k, size in heavy:
        loads[k] = max(0, loads[k] - size)
    # Cells are numbered range by range, then heavy key by heavy key.
    parts = [math.ceil(loads[k] / full) if loads.get(k, 0) > 2 * full else 1 for k in range(len(bounds) + 1)]
    parts += [max(1, math.ceil(size / (RANGES_OF_KEY * full))) for _, _, size in heavy]
    first = [0]
    for p in parts:
        first.append(first[-1] + p)
    keys = [h for h, _, _ in heavy]
    at = range_of(F.col("h"), keys) if keys else F.lit(0)
    alone = F.coalesce(F.get(table(keys), at - 1) == F.col("h"), F.lit(False)) if keys else F.lit(False)

    def numbered(v: Column) -> Column:
        chance = F.when(v["alone"], F.xxhash64("tie", F.lit("part"))).otherwise(F.xxhash64("h", F.lit("part")))
        return F.get(table(first), v["i"]) + F.pmod(chance, F.get(table(parts), v["i"]))

    place = F.when(alone, F.lit(len(bounds)) + at).otherwise(F.col("range"))
    return ranged.withColumn("cell", let(F.struct(place.cast("int").alias("i"), alone.alias("alone")), numbered).cast("int")).drop("range")


def shard(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law (``bytes``), shard, slot and grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stash(
        docs.select(F.col(id_col).alias("id"), text.alias("t")).select(
            "id",
            (F.octet_length("t") + F.lit(1).cast("long")).alias("size"),
            F.crc32(F.col("t").cast("binary")).alias("crc"),
            F.xxhash64("t").alias("h"),
            F.xxhash64("id", F.lit("tie")).alias("tie"),
        ),
        "shard-rows",
    )
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    n_ranges = n_shards * RANGES_PER_SHARD
    celled = stash(cells(rows, n_ranges, total, max(1, count)), "shard-cells")
    loads = {r.cell: (r.bytes, r.n) for r in celled.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
    packed = pack({c: size for c, (size, _) in loads.items()}, n_shards)
    known = range(max(loads, default=0) + 1)
    shards, slices = table([packed.get(c, 0) for c in known]), table([-(-loads.get(c, (0, 1))[1] // ROWS_PER_SLICE) for c in known])

    # Slots: rows of the shard in earlier slices of cells, then the place within the slice.
    placed = celled.withColumns({"shard": F.get(shards, F.col("cell")).cast("int"), "slice": F.pmod(F.xxhash64("tie", F.lit("slice")), F.get(slices, F.col("cell")))})
    earlier = Window.partitionBy("shard").orderBy("cell", "slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "cell", "slice").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("cell", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    within = Window.partitionBy("cell", "slice").orderBy("h", "tie", "id", "crc")
    return (
        placed.join(counts, ["cell", "slice"])
        .withColumn("slot", F.col("first") + F.row_number().over(within) - 1)
        .select(
            F.col("id").alias(id_col),
            "size",
            F.col("crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            "shard",
            "slot",
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read_table(spark, sf_dir, "documents"))


QUERIES = {"op3_sharding": op3_sharding}
ORACLE: dict = {}
