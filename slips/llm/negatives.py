"""Hard negatives by bit-sliced integer products.

For each anchor the positives are its best other rows of the same label; for each positive the negatives are the best
rows of another label whose score lies between a share ``low`` and a share ``high`` of the positive's. A score is the
integer inner product of components floor(``scale`` * x).

Rows are packed into blocks of vectors, anchors into blocks of their own, and every pair of blocks is one tile, a task's
unit of work; nothing is broadcast or collected. In a tile the rows' components are cut into bit-planes, of which the
most significant (the sign) comes first. After each plane a score is known to lie in an interval: what has been summed,
and at least and at most what the anchor's negative and positive components can add below. Pairs whose interval cannot
reach the least of the best so far, or the range asked for, are dropped. Dense tiles are narrowed to the rows and
anchors that are left; few pairs are carried on one by one. Planes are summed in full for all that is left, so scores
are exact. A tile returns its best for each anchor or positive, and a window takes the best of all tiles.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Shorter vectors count as
padded with zeros. Components saturate so that a score fits 62 bits (at 2**28 for 64 of them). Higher scores come first,
of equal ones the smaller id. Rows that repeat an id are rows of their own: each is an anchor and a candidate of the
other. Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stash

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Vectors of a block of rows and of a block of anchors.
ROWS, ANCHORS = 4096, 1024
#: Share of a tile's pairs below which they are carried on one by one.
SPARSE = 1 / 32
PACKED = "n int, wide boolean, uid binary, id binary, label binary, vector binary"
MISSING = -(1 << 62)


def quantised(rows: DataFrame, anchor: Column, id_col: str, label_col: str, vector_col: str, scale: float) -> DataFrame:
    """id, label, q (whole components), anchor and uid of the rows that take part."""
    x = F.col(vector_col)
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    kept = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & fine)
    return kept.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.cast("array<long>").alias("q"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("uid"))


def packed(rows: DataFrame, size: int, more: bool = False) -> DataFrame:
    """Blocks of up to ``size`` rows, one row each; ``more``: the rows have a list of scores of that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(table: pa.Table) -> pa.RecordBatch:
            parts = table.column("q").combine_chunks()
            lengths = pc.list_value_length(parts).to_numpy()
            d = int(lengths.max())
            most = 1 << ((62 - max(d - 1, 0).bit_length()) // 2)
            vector = np.zeros((len(table), d), np.int64)
            vector[np.arange(d) < lengths[:, None]] = parts.flatten().to_numpy()
            vector = np.clip(vector, -most, most - 1)
            small = np.abs(vector).max(initial=0) < 1 << 15
            columns = {"n": pa.array([len(table)], pa.int32()), "wide": pa.array([not small])}
            columns |= {c: pa.array([table.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in ("uid", "id", "label")}
            columns["vector"] = pa.array([vector.astype(np.int16 if small else np.int64).tobytes()], pa.binary())
            if more:
                columns["more"] = pa.array([table.column("more").to_pylist()], pa.list_(pa.list_(pa.int64())))
            return pa.RecordBatch.from_pydict(columns)

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            while n >= size:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, size))
                held, n = table.slice(size).to_batches(), n - size
        if n:
            yield block(pa.Table.from_batches(held))

    return rows.select("uid", "id", "label", "q", *(["more"] if more else [])).mapInArrow(run, PACKED + (", more array<array<bigint>>" if more else ""))


def unpacked(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """uid, id, label and vectors (rows by components) of a block."""
    uid, ids, label = (np.frombuffer(block[c], np.int64) for c in ("uid", "id", "label"))
    vector = np.frombuffer(block["vector"], np.int64 if block["wide"] else np.int16)
    return uid, ids, label, vector.reshape(block["n"], -1) if vector.size else np.zeros((block["n"], 0), np.int16)


class Planes:
    """Bit-planes of the rows of a tile, and products of anchors with them.

    Component c is -2**(w-1) b[w-1] + sum of 2**k b[k]; plane 0 is that of the sign.
    """

    def __init__(self, vectors: np.ndarray):
        top = int(np.where(vectors < 0, ~vectors, vectors).max(initial=0))
        self.width = top.bit_length() + 1
        self.vectors = vectors.astype(np.int64)

    def weight(self, plane: int) -> int:
        return -(1 << (self.width - 1)) if plane == 0 else 1 << (self.width - 1 - plane)

    def bits(self, plane: int, rows: np.ndarray) -> np.ndarray:
        return self.vectors[rows] >> (self.width - 1 - plane) & 1

    def below(self, plane: int) -> int:
        """Most that the planes after this one can say of a component."""
        return (1 << (self.width - 1 - plane)) - 1


def kind_for(anchors: np.ndarray, width: int) -> type:
    """A number type in which all sums are exact; single precision, where it is enough, is the fastest."""
    most = int(np.abs(anchors).sum(axis=1).max(initial=0)) << width
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def sliced(anchors: np.ndarray, rows: Planes, alive: np.ndarray, possible) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row) that stay possible to the last plane, and their scores.

    ``alive``: the pairs that take part. ``possible(a, lower, upper, alive)`` says which pairs still qualify, given the
    bounds of their scores. Arrays are shaped (anchor, row) with ``a`` one column, as long as many pairs are left; then
    they are flat, and ``alive`` is None.
    """
    kind = kind_for(anchors, rows.width)
    typed = anchors.astype(kind)
    more, less = np.maximum(typed, 0).sum(axis=1), np.minimum(typed, 0).sum(axis=1)
    a, r = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
    alive = alive[np.ix_(a, r)]
    score, plane = np.zeros(alive.shape, kind), 0
    while plane < rows.width and np.count_nonzero(alive) > SPARSE * alive.size:
        score += kind(rows.weight(plane)) * (typed[a] @ rows.bits(plane, r).astype(kind).T)
        left = kind(rows.below(plane))
        alive &= possible(a[:, None], score + (left * less[a])[:, None], score + (left * more[a])[:, None], alive)
        plane += 1
        keep_a, keep_r = alive.any(axis=1), alive.any(axis=0)
        if keep_a.sum() * keep_r.sum() < 0.7 * alive.size:
            score, alive, a, r = score[np.ix_(keep_a, keep_r)], alive[np.ix_(keep_a, keep_r)], a[keep_a], r[keep_r]
    i, j = np.nonzero(alive)
    score, i, j = score[i, j], a[i], r[j]
    step = max(1, (1 << 22) // max(1, anchors.shape[1]))
    while plane < rows.width and len(i):
        parts = [np.einsum("pd,pd->p", typed[i[k : k + step]], rows.bits(plane, j[k : k + step]).astype(kind)) for k in range(0, len(i), step)]
        score = score + kind(rows.weight(plane)) * np.concatenate(parts)
        left = kind(rows.below(plane))
        stay = possible(i, score + left * less[i], score + left * more[i], None)
        i, j, score, plane = i[stay], j[stay], score[stay], plane + 1
    return i, j, score.astype(np.int64)


def raised(floor: np.ndarray, a: np.ndarray, lower: np.ndarray, sure: np.ndarray, n: int) -> None:
    """Raise each anchor's floor to the n-th best of the lower bounds of its ``sure`` pairs."""
    if lower.shape[1] >= n:
        bounds = np.where(sure, lower, lower.dtype.type(MISSING))
        least = np.partition(bounds, bounds.shape[1] - n, axis=1)[:, bounds.shape[1] - n].astype(np.int64)
        floor[a[:, 0]] = np.maximum(floor[a[:, 0]], least)


def best_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Which rows are among the first ``most`` of their group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    ordered = group[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < most]


def same_width(a: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a tile's two sides with as many components, whole numbers of 64 bits."""
    d = max(a.shape[1], r.shape[1])
    return tuple(np.pad(x.astype(np.int64), ((0, 0), (0, d - x.shape[1]))) for x in (a, r))


def joined(found: list[tuple]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def best_positives(anchors: dict, rows: dict, most: int) -> dict:
    """The best rows of each anchor's own label: anchor's uid, row's id and score."""
    a_uid, _, a_label, a = unpacked(anchors)
    r_uid, r_id, r_label, r = unpacked(rows)
    a, r = same_width(a, r)
    found = [(np.zeros(0, np.int64),) * 3]
    for label in np.intersect1d(a_label, r_label):
        own, like = np.flatnonzero(a_label == label), np.flatnonzero(r_label == label)
        floor = np.full(len(own), MISSING)

        def possible(i, lower, upper, alive, floor=floor):
            if alive is not None:
                raised(floor, i, lower, alive, most)
            return upper >= floor[i].astype(upper.dtype)

        i, j, score = sliced(a[own], Planes(r[like]), a_uid[own][:, None] != r_uid[like], possible)
        first = best_of(i, score, r_id[like[j]], most)
        found.append((a_uid[own[i[first]]], r_id[like[j[first]]], score[first]))
    return dict(zip(("uid", "id", "score"), joined(found), strict=True))


def best_negatives(anchors: dict, rows: dict, most: int, low: int, high: int) -> dict:
    """For each positive of an anchor (by place) the best rows of another label in the positive's range of scores."""
    a_uid, _, a_label, a = unpacked(anchors)
    _, r_id, r_label, r = unpacked(rows)
    a, r = same_width(a, r)
    positives = anchors["more"]
    k = max(map(len, positives), default=0)
    found = [(np.zeros(0, np.int64),) * 4]
    if k:
        # Without a positive: a range without scores. Products with a share are Python's, which don't overflow.
        lows, highs = np.full((len(a), k), -MISSING), np.full((len(a), k), MISSING)
        for n, own in enumerate(positives):
            lows[n, : len(own)] = [-(-low * s // 100) for s in own]
            highs[n, : len(own)] = [high * s // 100 for s in own]
        empty = lows > highs
        lows[empty], highs[empty] = -MISSING, MISSING
        least, most_of_all = lows.min(axis=1), highs.max(axis=1)
        narrow = np.where(empty, -MISSING, highs).min(axis=1)  # a score from ``floor`` to here is in every range that starts below
        floor = least.copy()

        def possible(i, lower, upper, alive):
            bound = lambda x: x[i].astype(lower.dtype)  # noqa: E731  a bound beyond the type's exact numbers stays beyond all scores
            if alive is not None:
                raised(floor, i, lower, alive & (lower >= bound(least)) & (upper <= bound(narrow)), most)
            return (upper >= bound(floor)) & (lower <= bound(most_of_all))

        i, j, score = sliced(a, Planes(r), (a_label[:, None] != r_label) & (least <= most_of_all)[:, None], possible)
        for p in range(k):
            fits = np.flatnonzero((score >= lows[i, p]) & (score <= highs[i, p]))
            first = fits[best_of(i[fits], score[fits], r_id[j[fits]], most)]
            found.append((a_uid[i[first]], np.full(len(first), p), r_id[j[first]], score[first]))
    return dict(zip(("uid", "place", "id", "score"), joined(found), strict=True))


def tiled(anchors: DataFrame, rows: DataFrame, work, schema: str) -> DataFrame:
    """``work(anchor block, row block)`` for every pair of blocks.

    Anchor blocks have a number ``i``. Row blocks go to each number, anchor blocks to each salt that row blocks are given,
    so a pair meets once and no key holds more than its share of the row blocks.
    """
    spark = rows.sparkSession
    n, blocks = (anchors.agg(F.max("i")).first()[0] or 0) + 1, rows.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    salts = max(1, min(blocks, -(-4 * parts // n)))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = anchors.select("i", each(salts).alias("salt"), F.struct(*[c for c in anchors.columns if c != "i"]).alias("anchors"))
    right = rows.select(each(n).alias("i"), F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int").alias("salt"), F.struct(*rows.columns).alias("rows"))
    met = left.repartition(parts, "i", "salt").join(right.repartition(parts, "i", "salt"), ["i", "salt"]).select("anchors", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                yield pa.RecordBatch.from_pydict(work(batch.column(0)[k].as_py(), batch.column(1)[k].as_py()))

    return met.mapInArrow(run, schema)


def first_of(found: DataFrame, most: int, *group: str) -> DataFrame:
    """The first ``most`` rows of each group, with their place from 0."""
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: float = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score; ``anchor`` says which rows are
    anchors, ``low`` and ``high`` are the range of negatives in hundredths of the positive's score."""
    fit = stash(quantised(rows, anchor, id_col, label_col, vector_col, scale), "negatives-rows")
    blocks = stash(packed(fit, ROWS), "negatives-blocks")
    asking = fit.where("anchor")
    parts = -(-asking.count() // ANCHORS) or 1
    ask = lambda df, more: stash(packed(df.repartition(parts), ANCHORS, more).withColumn("i", F.spark_partition_id()), "negatives-anchors")

    near = tiled(ask(asking, False), blocks, lambda a, r: best_positives(a, r, positives), "uid long, id long, score long")
    best = first_of(near, positives, "uid").select("uid", (F.col("rank") - 1).cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    best = stash(best, "negatives-positives")
    scores = best.groupBy("uid").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("more"))
    known = stash(asking.join(scores, "uid"), "negatives-known")

    hard = tiled(ask(known, True), blocks, lambda a, r: best_negatives(a, r, negatives, low, high), "uid long, place long, id long, score long")
    found = first_of(hard, negatives, "uid", "place").join(best, ["uid", "place"]).join(asking.select("uid", F.col("id").alias("anchor_id")), "uid")
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return mine(moved, F.col("vec_id") % 50 == 0)


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLE = {
    "op12_hard_negatives": """
        WITH fit AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
                   CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
            FROM fit a JOIN fit r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
        positives AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
        negatives AS (
            SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
                   CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
            FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
             AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
    """
}
