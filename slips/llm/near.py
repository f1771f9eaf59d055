"""N-gram Jaccard join by MinHash banding, and the near-duplicate classes it links.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is at least 0.8. Band
and row counts are chosen for a target recall at that similarity. Texts are shuffled on their band hashes,
and candidates are verified on full shingle sets.

Exact copies are one node. Small buckets (nodes with one band hash in common) emit their pairs, which are
verified one by one. Crowded buckets never do: their members are cut into blocks, and each pair of blocks is
one tile that a task compares as a whole. Out of a tile come each member's number of links and a spanning
forest of them, so rows stay in proportion to members while no link is lost. A pair that meets in several
buckets is counted in one: in the small-bucket path if any of its buckets is small, else in its first band.

A text of fewer than five words, but not none, has one shingle of all its words. Texts without words
(empty or null) have no links; equal ones are copies of each other and share a class. Rows with null ids take part
but never name a class unless all its ids are null. Rows that repeat id and text are copies of each other,
of which ``thin`` keeps one. Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, maybe_in, once, read_table, stash, with_groups, without
from .texts import mix, powers, slices, text_buffer, word_hashes

SHINGLE, SIMILAR = 5, 0.8
#: Chance of finding a pair at the threshold, and the most hashes of a signature.
RECALL, MOST_HASHES = 0.9999, 150
#: Most nodes of a bucket that emits pairs; nodes of a block of a crowded one.
SMALL, BLOCK = 16, 512


def banding(similar: float = SIMILAR, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows whose bands reach the recall within the number of hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similar**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def shingles(body: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of consecutive texts, with repeats, and how many each text has."""
    h, counts = word_hashes(body, at)
    if not len(h):
        return h, counts
    weights = powers(64)[33 : 33 + size]
    padded = np.concatenate((h, np.zeros(size - 1, np.uint64)))
    sums = np.zeros(len(h), np.uint64)
    for k in range(size):
        sums += padded[k : k + len(h)] * weights[k]
    end = np.repeat(np.cumsum(counts), counts)
    full = np.arange(len(h)) + size <= end
    first = np.cumsum(counts) - counts
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        own = h[first[i] : first[i] + counts[i]]
        sums[first[i]] = np.uint64(counts[i]) + (own * weights[: len(own)]).sum(dtype=np.uint64)
        full[first[i]] = True
    owner = np.repeat(np.arange(len(counts)), counts)
    return mix(sums[full]), np.bincount(owner[full], minlength=len(counts))


def signatures(hashes: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of texts, one row each; rows of texts without shingles mean nothing."""
    has = counts > 0
    first = (np.cumsum(counts) - counts)[has]
    out = np.zeros((len(counts), bands), np.uint64)
    if not len(first):
        return out
    factors = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    for b in range(bands):
        total = np.full(len(first), b + 1, np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            least = np.minimum.reduceat(mix_light(hashes * factors[k]), first)
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + least)
        out[has, b] = total
    return out


def mix_light(h: np.ndarray) -> np.ndarray:
    return h ^ (h >> np.uint64(29))


def signed(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """id, key (128-bit digest of the text) and band hashes of each row; one pass over the texts, no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, at = text_buffer(batch.column(2))
            for low, high in slices(at):
                hashes, counts = shingles(body, at[low : high + 1])
                found = signatures(hashes, counts, bands, rows).view(np.int64).reshape(-1)
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(np.where(counts > 0, bands, 0)))).astype(np.int32), np.ascontiguousarray(found.reshape(-1, bands)[counts > 0]).reshape(-1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), lists], names=["id", "key", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, key binary, bands array<bigint>")


def similarity(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Exact Jaccard similarity of pairs (a, b) of nodes, on their full shingle sets."""
    side = lambda c: texts.select(F.col("nid").alias(c), F.col("t").alias(f"t{c}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(ids: list, column: pa.Array, kept: dict) -> list[np.ndarray]:
            body, at = text_buffer(column)
            out = []
            for k, i in enumerate(ids):
                if i not in kept:
                    if len(kept) > 500:
                        kept.clear()
                    kept[i] = np.unique(shingles(body, at[k : k + 2])[0])
                out.append(kept[i])
            return out

        kept: dict = {}
        for batch in batches:
            left, right = sets(batch.column(0).to_pylist(), batch.column(2), kept), sets(batch.column(1).to_pylist(), batch.column(3), kept)
            shared = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)]
            j = [s / max(1, len(x) + len(y) - s) for s, x, y in zip(shared, left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(j, pa.float64())], names=["a", "b", "j"])

    return joined.mapInArrow(run, "a long, b long, j double")


def nodes_texts(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """One text for each wanted node (nid, key); copies meet within their tasks before a text is shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(text.alias("t")).withColumn("key", F.unhex(F.md5(F.col("t").cast("binary"))))
    if wanted.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(wanted), "key").select("nid", "t").dropDuplicates(["nid"])
    listed = maybe_in(rows, wanted, key=F.col("key")).where("__maybe").groupBy("key").agg(F.min("t").alias("t"))
    return listed.join(wanted, "key").select("nid", "t")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each pair of sets has in common."""
    n = len(sets)
    shingle, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.lexsort((owner, shingle))
    shingle, owner = shingle[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1]))) if len(shingle) else np.zeros(0, int)
    count = np.diff(np.append(first, len(shingle)))
    out = np.zeros((n, n), np.float32)
    for c in range(2, 8):  # shingles of few sets, pair by pair
        at = first[count == c]
        for i in range(c):
            for j in range(i + 1, c):
                np.add.at(out, (owner[at + i], owner[at + j]), 1)
    out += out.T
    often, sizes = first[count >= 8], count[count >= 8]
    for low in range(0, len(often), 2048):  # the others by matrix product
        k = sizes[low : low + 2048]
        grid = np.zeros((n, len(k)), np.float32)
        column = np.repeat(np.arange(len(k)), k)
        grid[owner[np.repeat(often[low : low + 2048], k) + np.arange(len(column)) - np.repeat(np.cumsum(k) - k, k)], column] = 1
        out += grid @ grid.T
    return out


def tile_links(sets: list[np.ndarray], bands: np.ndarray, crowded: np.ndarray, band: int, sides: np.ndarray, similar: float) -> np.ndarray:
    """Which pairs of a tile's members are links that no other bucket counts (symmetric mask).

    ``crowded`` (member by band) says whose bucket is crowded; ``sides`` parts the two blocks of a tile.
    """
    sizes = np.array([len(x) for x in sets], np.float32)
    shared = shared_counts(sets)
    mask = shared >= np.float32(similar) * (sizes[:, None] + sizes[None] - shared) - 1e-3
    close = np.argwhere(np.triu(mask, 1))  # decided in whole numbers
    i, j = close[:, 0], close[:, 1]
    both = shared[i, j].astype(np.int64)
    exact = both / np.maximum(1, sizes[i].astype(np.int64) + sizes[j].astype(np.int64) - both) >= similar
    if sides.any():
        exact &= sides[i] != sides[j]
    for b in range(bands.shape[1]):
        elsewhere = ~crowded[i, b] | (b < band)
        exact &= ~((bands[i, b] == bands[j, b]) & elsewhere) if b != band else True
    out = np.zeros_like(mask)
    out[i[exact], j[exact]] = True
    return out | out.T


def forest(mask: np.ndarray) -> np.ndarray:
    """Least member of each member's component."""
    label = np.arange(len(mask))
    while True:
        least = np.minimum(label, np.where(mask, label[None], len(mask)).min(axis=1))
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def crowded_links(members: DataFrame, texts: DataFrame, nodes: DataFrame, similar: float) -> DataFrame:
    """nid, links and root of members of crowded buckets, a row for each tile they are in."""
    masks = members.where("crowded").groupBy("nid").agg(F.collect_set("band").alias("mask"))  # one entry for each band at most
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = members.where("crowded").select("h", "band", "nid", blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))
    tiled = own.select("h", "band", "nid", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiled = tiled.select("h", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "nid")
    known = masks.join(nodes.select("nid", "bands"), "nid").join(texts, "nid")
    rows = tiled.join(known, "nid").select("h", "i", "j", "band", "side", "nid", "mask", "bands", "t")
    placed = rows.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "nid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            tile = pa.Table.from_batches(held)
            body, at = text_buffer(tile.column("t"))
            sets = [np.unique(shingles(body, at[k : k + 2])[0]) for k in range(len(tile))]
            bands = np.array(tile.column("bands").to_pylist(), np.int64)
            crowded = np.zeros(bands.shape, bool)
            own = tile.column("mask").combine_chunks()
            crowded[np.repeat(np.arange(len(tile)), own.value_lengths().to_numpy()), own.flatten().to_numpy()] = True
            mask = tile_links(sets, bands, crowded, tile.column("band")[0].as_py(), tile.column("side").to_numpy(), similar)
            nid = tile.column("nid").to_numpy()
            return pa.RecordBatch.from_arrays([pa.array(nid), pa.array(mask.sum(axis=1).astype(np.int64)), pa.array(nid[forest(mask)])], names=["nid", "links", "root"])

        held, last = [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)], axis=1)
            ends = [*(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(batch)] if len(batch) else []
            low = 0
            for high in ends:
                now = tuple(key[low])
                if held and now != last:
                    yield done(held)
                    held = []
                held.append(batch.slice(low, high - low))
                last, low = now, high
        if held:
            yield done(held)

    return placed.mapInArrow(run, "nid long, links long, root long")


def components(edges: DataFrame) -> DataFrame:
    """node and root (least node) of the connected components of undirected edges (u, v)."""
    both = stash(edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).distinct(), "near-edges")
    links = both.count()
    degrees = stash(both.groupBy(F.col("u").alias("v")).agg(F.count(F.lit(1)).alias("degree")), "near-degrees")
    roots = stash(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")), "near-roots")
    n, before = roots.count(), None
    while True:
        told = degrees.join(roots.withColumnRenamed("u", "v"), "v")
        seen = with_groups(both, told, "v", "degree", links).groupBy("u").agg(F.min("root").alias("seen"))
        hooked = stash(roots.join(seen, "u").select("u", F.least("root", "seen").alias("root")), "near-hooked")
        followers = hooked.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        above = followers.join(hooked.select(F.col("u").alias("root"), F.col("root").alias("above")), "root")
        roots = stash(with_groups(hooked, above, "root", "n", n).select("u", F.col("above").alias("root")), "near-roots")
        total = roots.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return roots.select(F.col("u").alias("node"), "root")
        before = total


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, recall: float = RECALL, keep_key: bool = False) -> DataFrame:
    """One row per input row: id, class_id (least id of its class), n_links (other texts linked to
    this one) and n_copies (other rows with the same text)."""
    bands, rows = banding(similar, recall)
    seen = stash(signed(docs, id_col, text_col, bands, rows), "near-signed")
    grouped = seen.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    nodes = stash(grouped.withColumn("nid", F.monotonically_increasing_id()), "near-nodes")

    # Members of buckets that hold several nodes.
    banded = nodes.select("nid", F.posexplode("bands").alias("band", "h"))
    shared = stash(banded.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-shared")
    members = with_groups(banded, shared, "h", "n", bands * nodes.count()).where("n is not null")
    members = stash(members.withColumn("crowded", F.col("n") > SMALL), "near-members")
    texts = stash(nodes_texts(docs, nodes.join(members.select("nid").distinct(), "nid", "left_semi").select("key", "nid"), text_col), "near-texts")

    few = members.where("not crowded").select("h", "nid")
    pairs = few.select("h", F.col("nid").alias("a")).join(few.select("h", F.col("nid").alias("b")), "h").where("a < b").select("a", "b").distinct()
    links = stash(similarity(pairs, texts).where(F.col("j") >= similar).select("a", "b"), "near-links")
    tiles = stash(crowded_links(members, texts, nodes, similar), "near-tiles")

    ends = links.select(F.col("a").alias("nid"), F.lit(1).cast("long").alias("links")).unionAll(links.select("b", F.lit(1).cast("long"))).unionAll(tiles.select("nid", "links"))
    counted = ends.groupBy("nid").agg(F.sum("links").alias("n_links"))
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(tiles.where("nid <> root").select("nid", "root")))
    linked = counted.join(roots.withColumnRenamed("node", "nid"), "nid", "left").select("nid", F.coalesce("root", "nid").alias("root"), "n_links")
    told = nodes.select("nid", "key", "least", "copies").join(linked, "nid", "left")
    told = stash(told.select("key", "least", "copies", F.coalesce("root", "nid").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "near-told")
    named_class = stash(told.groupBy("root").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("members")), "near-classes")
    told = with_groups(told, named_class, "root", "members", told.count())
    told = stash(told.select("key", "class_id", "n_links", "copies"), "near-named")
    out = with_groups(seen.select(F.col("id").alias(id_col), "key"), told, "key", "copies", seen.count())
    out = out.select(id_col, "key", "class_id", "n_links", (F.col("copies") - 1).alias("n_copies"))
    return out if keep_key else out.drop("key")


def thin(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class, the one with the least id."""
    found = classes(docs, id_col, text_col, keep_key=True)
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    keys = {id_col: F.col(id_col), "key": digest}
    kept = F.col(id_col).eqNullSafe(F.col("class_id"))
    repeated = found.where(kept & (F.col("n_copies") > 0)).groupBy(id_col, "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return once(without(docs, found.where(~kept), **keys), repeated, **keys)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read_table(spark, sf_dir, "documents"))


QUERIES = {"op10_ngram_jaccard_join": op10_ngram_jaccard_join}
ORACLE: dict = {}
