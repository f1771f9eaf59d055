"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; bit k is 1 if more than half of the text's shingle hashes have it. Two fingerprints are
linked if they differ in at most ``radius`` bits, and linked rows share a component.

Tables of structured masks find the links. Every bit position is given a vector of radius + 1 bits, and each non-zero
vector v has a table, whose mask holds the positions with an odd product with v. Up to ``radius`` vectors always
leave some v that is even with all of them, so two fingerprints that differ in those positions agree under its mask:
every linked pair meets in some table, none by chance alone.

Equal fingerprints are one node. Rows are shuffled by (table, masked fingerprint). A bucket of more than ``BLOCK``
nodes is cut into blocks, and each pair of blocks is compared by a task of its own. Out of a task come the edges of a
spanning forest, never its pairs, so rows stay in proportion to members and no link is lost.

Shingles are three words (split at blanks and the controls 9 to 13, A-Z lower-cased), repeats included. A text of one
or two words has one shingle of all of them; a text without words (empty, blank or null) has fingerprint zero, which is
linked like any other. Rows with null ids take part but never name a component unless all its ids are null. Repeated
rows are copies of each other. Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, once, read_table, stash, with_groups, without
from .near import components
from .texts import FOLD_BLANKS, text_buffer

SHINGLE, SEED, BITS, RADIUS = 3, 42, 64, 3
#: Most nodes of a bucket that one task compares as a whole; larger ones go in pairs of blocks of so many.
BLOCK = 1024
#: Words hashed at once; nodes of a bucket that are compared by shifting instead of by a square.
WORDS_AT_ONCE, SHIFTED = 1 << 16, 16


def masks(radius: int = RADIUS) -> list[int]:
    """One mask for each non-zero vector of radius + 1 bits."""
    vectors = (1 << (radius + 1)) - 1
    own = [1 + k % vectors for k in range(BITS)]
    return [sum(1 << k for k, a in enumerate(own) if (a & v).bit_count() & 1) for v in range(1, vectors + 1)]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Fingerprint of one text, in bounded memory besides a few times its bytes."""
    folded = np.frombuffer(text.translate(FOLD_BLANKS), np.uint8)
    inside = folded != 32
    before = np.concatenate(([False], inside[:-1]))
    flat = folded[inside | before]  # words with one blank after each
    if not len(flat):
        return 0
    body = flat.tobytes()
    ends = np.flatnonzero(flat == 32)
    if flat[-1] != 32:
        ends = np.append(ends, len(flat))
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(starts))
    n, votes, digest = len(starts) - size + 1, np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for low in range(0, n, WORDS_AT_ONCE):
        high = min(n, low + WORDS_AT_ONCE)
        pairs = zip(starts[low:high].tolist(), ends[low + size - 1 : high + size - 1].tolist(), strict=True)
        h = np.array([digest(body[s:e], SEED) for s, e in pairs], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def printed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, fp (the fingerprint as a signed long) and key (digest of the text) of each row; no shuffle."""
    narrow = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("key"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, at = text_buffer(batch.column(2))
            found = np.array([fingerprint(body[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["id", "key", "fp"])

    return narrow.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, key binary, fp long")


def segments(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and number of rows of each run of equal keys."""
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))) if len(keys) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(keys)))


def close_pairs(prints: np.ndarray, first: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one run whose prints differ in at most ``radius`` bits."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    few = sizes <= SHIFTED
    room = np.repeat(np.where(few, first + sizes, 0), sizes)  # end of the run of a row, for small runs
    for k in range(1, SHIFTED):
        i = np.flatnonzero(np.arange(len(prints)) + k < room)
        if not len(i):
            break
        i = i[np.bitwise_count(prints[i] ^ prints[i + k]) <= radius]
        left.append(i)
        right.append(i + k)
    for low, n in zip(first[~few].tolist(), sizes[~few].tolist(), strict=True):
        own = prints[low : low + n]
        for row in range(0, n, 256):
            i, j = np.nonzero(np.bitwise_count(own[row : row + 256, None] ^ own[None]) <= radius)
            i += row
            left.append(low + i[i < j])
            right.append(low + j[i < j])
    return np.concatenate(left), np.concatenate(right)


def roots_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least row of each row's component."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, least)
        np.minimum.at(after, j, least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    return label


def met(nodes: DataFrame, radius: int) -> DataFrame:
    """(h, i, j, fp): each node once for each table, or for each pair of blocks of a crowded bucket."""
    tables = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("part")) for t, m in enumerate(masks(radius))]
    dealt = nodes.select("fp", F.explode(F.array(*tables)).alias("b")).select("fp", F.xxhash64("b.t", "b.part").alias("h"))
    crowded = stash(dealt.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK), "simhash-crowded")
    none = F.lit(0)
    if (n := crowded.count()) == 0:
        return dealt.select("h", none.alias("i"), none.alias("j"), "fp")
    if n <= BROADCAST_ROWS:
        told = dealt.join(F.broadcast(crowded), "h", "left")
    else:
        told = with_groups(dealt, crowded, "h", "n", nodes.count() * len(tables))
    blocks: Column = F.ceil(F.col("n") / BLOCK).cast("int")
    few = told.where("n is null").select("h", none.alias("i"), none.alias("j"), "fp")
    many = told.where("n is not null").select("h", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own"))
    tiled = many.select("h", "fp", "own", F.explode(F.sequence(none, F.col("blocks") - 1)).alias("other")).where("own <> other")
    # Two blocks are compared as one run, which covers the pairs within either.
    return few.unionByName(tiled.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"))


def forests(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) between linked fingerprints that keep every component of every bucket together."""
    placed = met(nodes, radius).repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            first, sizes = segments(keys)
            root = roots_of(len(prints), *close_pairs(prints, first, sizes, radius))
            moved = np.flatnonzero(root != np.arange(len(root)))
            values = prints.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(values[moved]), pa.array(values[root[moved]])], names=["u", "v"])

        kept_keys, kept_prints = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)], axis=1)
            keys, prints = np.concatenate((kept_keys, keys)), np.concatenate((kept_prints, batch.column(3).to_numpy().view(np.uint64)))
            if not len(keys):
                continue
            cut = segments(keys)[0][-1]  # the last run may go on
            if cut:
                yield done(keys[:cut], prints[:cut])
            kept_keys, kept_prints = keys[cut:], prints[cut:]
        if len(kept_keys):
            yield done(kept_keys, kept_prints)

    return placed.mapInArrow(run, "u long, v long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, keep_key: bool = False) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (least id of its component), n_same (other
    rows with the same fingerprint) and n_fingerprints (of its component)."""
    seen = stash(printed(docs, id_col, text_col), "simhash-prints")
    nodes = stash(seen.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")), "simhash-nodes")
    roots = components(stash(forests(nodes, radius), "simhash-edges"))
    told = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    told = stash(told, "simhash-told")
    named = stash(told.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n_fingerprints")), "simhash-named")
    told = with_groups(told, named, "root", "n_fingerprints", told.count())
    told = stash(told.select("fp", "component_id", "n_fingerprints", "copies"), "simhash-components")
    out = with_groups(seen, told, "fp", "copies", seen.count())
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    out = out.select(F.col("id").alias(id_col), "key", digits.alias("fingerprint"), "component_id", (F.col("copies") - 1).alias("n_same"), "n_fingerprints")
    return out if keep_key else out.drop("key")


def thin(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with the least id."""
    found = classes(docs, id_col, text_col, keep_key=True)
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    keys = {id_col: F.col(id_col), "key": digest}
    kept = F.col(id_col).eqNullSafe(F.col("component_id"))
    repeated = found.where(kept & (F.col("n_same") > 0)).groupBy(id_col, "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return once(without(docs, found.where(~kept), **keys), repeated, **keys)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read_table(spark, sf_dir, "documents"))


QUERIES = {"op13_simhash": op13_simhash}
ORACLE: dict = {}
