"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are covered by overlapping chunks. Learned filters run over each chunk's embedded
bytes, each filter's largest value is kept, and the chunks' maxima are averaged over the whole text
and combined by a small dense layer into one probability. Training uses a documented, bounded sample of
labelled texts, and, like scoring, every byte of each.

Null texts count as empty: one chunk of padding. Labels that are null are not learned from. Without both
labels among the training rows every score is the share of label 1 (0.5 without any). A null id counts
as the empty text in the fold rule. Repeated rows score alike; further columns, of either table, are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, read_table, stash
from .texts import slices, text_buffer

#: Bytes of a chunk and from one chunk to the next; width and stride of filters; filters; embedding; hidden.
CHUNK, HOP, WIDTH, STRIDE, FILTERS, EMBED, HIDDEN = 256, 192, 8, 2, 24, 8, 16
#: Most labelled texts of each label that training sees, most bytes of their chunks, and most bytes of a text among them.
SAMPLE, SAMPLE_BYTES, LONGEST = 2_000, 64 << 20, 4 << 20
#: Chunks that the gradient unrolls at once.
UNROLLED = 256
STEPS, BATCH, RATE, SEED = 400, 32, 6e-3, 7


def chunks(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of consecutive texts (rows of bytes, zero-padded) and the text of each."""
    size = np.diff(at)
    count = np.maximum(1, -(-np.maximum(size - (CHUNK - HOP), 1) // HOP))
    owner = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    first = at[:-1][owner] + nth * HOP
    where = first[:, None] + np.arange(CHUNK)
    inside = where < at[1:][owner][:, None]
    rows = np.zeros((len(owner), CHUNK), np.uint8)
    if len(body):
        rows = np.where(inside, body[np.minimum(where, len(body) - 1)], 0).astype(np.uint8)
    return rows, owner


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray
    offset: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls) -> Network:
        r = np.random.default_rng(SEED)
        draw = lambda scale, *shape: (r.standard_normal(shape) * scale).astype(np.float32)
        return cls(
            draw(0.5, 256, EMBED), draw((WIDTH * EMBED) ** -0.5, WIDTH * EMBED, FILTERS), np.zeros(FILTERS, np.float32),
            draw(FILTERS**-0.5, FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32), draw(HIDDEN**-0.5, HIDDEN), np.zeros(1, np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.offset, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def unrolled(self, rows: np.ndarray) -> np.ndarray:
        seen = np.lib.stride_tricks.sliding_window_view(rows, WIDTH, axis=1)[:, ::STRIDE]
        return self.embed[seen].reshape(len(rows), seen.shape[1], WIDTH * EMBED)

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """Each filter's largest value in each chunk."""
        tables = np.einsum("be,kef->kbf", self.embed, self.filters.reshape(WIDTH, EMBED, FILTERS))
        out = np.empty((len(rows), FILTERS), np.float32)
        for low in range(0, len(rows), 32):
            part = rows[low : low + 32]
            steps = (CHUNK - WIDTH) // STRIDE + 1
            total = tables[0][part[:, 0 : 0 + steps * STRIDE : STRIDE]]
            for k in range(1, WIDTH):
                total += tables[k][part[:, k : k + steps * STRIDE : STRIDE][:, :steps]]
            out[low : low + 32] = total.max(axis=1)
        return np.maximum(out + self.offset, 0)

    def probability(self, mean: np.ndarray) -> np.ndarray:
        z = np.maximum(mean @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        rows, owner = chunks(body, at)
        n = len(at) - 1
        sums = np.zeros((n, FILTERS), np.float64)
        first = np.searchsorted(owner, np.arange(n))
        sums = np.add.reduceat(self.pooled(rows).astype(np.float64), first, axis=0) if n else sums
        return self.probability(sums / np.bincount(owner, minlength=n)[:, None])

    def learn(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        """Adam on the logistic loss; ``texts`` are matrices of chunks."""
        order, weights = np.random.default_rng(SEED), self.parts()
        first, second, left = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], np.zeros(0, int)
        for step in range(1, STEPS + 1):
            if len(left) < min(BATCH, len(texts)):
                left = order.permutation(len(texts))
            picked, left = left[:BATCH], left[BATCH:]
            rows = np.concatenate([texts[i] for i in picked])
            sizes = np.array([len(texts[i]) for i in picked])
            rate = RATE * (1 - step / (STEPS + 1))
            for w, g, m, v in zip(weights, self.gradient(rows, sizes, labels[picked]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)

    def largest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's place of its largest value in each chunk, and that value."""
        value = self.unrolled(rows) @ self.filters
        at = value.argmax(axis=1)
        return at, np.take_along_axis(value, at[:, None], axis=1)[:, 0]

    def gradient(self, rows: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, owner = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
        parts = [rows[low : low + UNROLLED] for low in range(0, len(rows), UNROLLED)]
        at, top = (np.concatenate(x) for x in zip(*map(self.largest, parts), strict=True))
        top += self.offset
        act = np.maximum(top, 0)
        mean = np.add.reduceat(act, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        pre = mean @ self.hidden + self.hidden_bias
        h = np.maximum(pre, 0)
        p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.out_bias, -30, 30)))
        dz = ((p - y) / n).astype(np.float32)
        dh = np.outer(dz, self.out) * (pre > 0)
        dact = ((dh @ self.hidden.T) / sizes[:, None])[owner] * (top > 0)
        # Only the place of each filter's maximum has a gradient.
        dfilters, dembed = np.zeros_like(self.filters), np.zeros((256, EMBED))
        for k, part in enumerate(parts):
            own = slice(k * UNROLLED, k * UNROLLED + len(part))
            bytes_at = part[np.arange(len(part))[:, None, None], (at[own] * STRIDE)[:, :, None] + np.arange(WIDTH)]
            seen = self.embed[bytes_at].reshape(len(part), FILTERS, WIDTH * EMBED)
            dfilters += np.einsum("nfk,nf->kf", seen, dact[own])
            dseen = (dact[own][:, :, None] * self.filters.T[None]).reshape(-1, WIDTH, EMBED).reshape(-1, EMBED)
            dembed += np.stack([np.bincount(bytes_at.reshape(-1), dseen[:, e], 256) for e in range(EMBED)], axis=1)
        return [g.astype(np.float32) for g in (dembed, dfilters, dact.sum(0), mean.T @ dh, dh.sum(0), h.T @ dz, dz.sum(keepdims=True))]


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[list[tuple[bytes, int]], dict[int, int]]:
    """All chunks and label of up to ``sample`` texts of each label and up to SAMPLE_BYTES of chunks of each, and how many
    rows of ``docs`` have each label.

    Labelled rows are ranked by a hash of row and text, so that rows that repeat an id are drawn apart. Rows are taken in
    that order for as long as both bounds hold; a text is taken whole, or not at all if it is longer than LONGEST. Only ids
    and lengths are ranked, of about twice the sample.
    """
    marked = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id is not null and __y in (0, 1)")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), F.octet_length(text).cast("long").alias("__size"), F.md5(text.cast("binary")).alias("__key"))
    # Repeated labels of an id and repeated rows of a text are told apart by a number of their own.
    own = stash(rows.join(marked, "__id").select("__y", "__size", "__id", "__key", F.monotonically_increasing_id().alias("__row")), "quality-labelled")
    counts = {r["__y"]: r["count"] for r in own.groupBy("__y").count().collect()}
    lot = F.xxhash64("__id", "__key", "__row")
    share = F.when(F.col("__y") == 1, min(1.0, 2 * sample / max(1, counts.get(1, 0)))).otherwise(min(1.0, 2 * sample / max(1, counts.get(0, 0))))
    drawn = own.where(F.col("__size") <= LONGEST).withColumn("__lot", lot).where(F.pmod("__lot", F.lit(1 << 30)) / float(1 << 30) < share)
    order = Window.partitionBy("__y").orderBy("__lot", "__row")
    # A text of n bytes has up to n / HOP + 1 chunks.
    ranked = drawn.withColumns({"__rank": F.row_number().over(order), "__sum": F.sum(F.floor(F.col("__size") / HOP) * CHUNK + CHUNK).over(order)})
    chosen = ranked.where((F.col("__rank") <= sample) & (F.col("__sum") <= SAMPLE_BYTES))
    picked = stash(chosen.groupBy("__id", "__key", "__y").agg(F.count(F.lit(1)).alias("__times")), "quality-picked")  # at most twice the sample
    wanted = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.md5(text.cast("binary")).alias("__key")).join(F.broadcast(picked), ["__id", "__key"])
    one = wanted.groupBy("__id", "__key", "__y", "__times").agg(F.any_value("__text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, at = text_buffer(batch.column(1))
            found = []
            for low, high in zip(at[:-1], at[1:], strict=True):
                own, _ = chunks(body[low:high], np.array([0, high - low]))
                found.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2), batch.column(3)], names=["id", "seen", "y", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = one.select("__id", "__text", "__y", "__times").mapInArrow(run, f"id {kind}, seen binary, y int, times long").collect()
    ordered = sorted(got, key=lambda r: (r["id"], bytes(r["seen"]), r["y"]))
    return [(bytes(r["seen"]), r["y"]) for r in ordered for _ in range(r["times"])], counts


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Network:
    """A network trained on the labelled rows of ``docs``; the sample's shares of the labels are corrected to those of all rows."""
    got, counts = training_rows(docs, labels, id_col, text_col, label_col, sample)
    net = Network.fresh()
    y = np.array([label for _, label in got], np.float32)
    if len(set(y.tolist())) < 2:
        share = float(y[0]) if len(y) else 0.5
        net.out[:] = 0
        net.out_bias[:] = np.log((share * 0.98 + 0.01) / (1 - share * 0.98 - 0.01))
        return net
    net.learn([np.frombuffer(b, np.uint8).reshape(-1, CHUNK) for b, _ in got], y)
    net.out_bias += np.float32(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return net


def score(docs: DataFrame, net: Network, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of each row, with score and predicted."""
    narrow = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, at = text_buffer(batch.column(len(keep)))
            found = [net.score(body[at[low] : at[high]], at[low : high + 1] - at[low]) for low, high in slices(at, 1 << 18)]
            p = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    return narrow.mapInArrow(run, schema)


def accepted(docs: DataFrame, net: Network, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` less the rows that score below the threshold; all columns stay."""
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, at = text_buffer(batch.column(at_text))
            found = [net.score(body[at[low] : at[high]], at[low : high + 1] - at[low]) for low, high in slices(at, 1 << 18)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *found]) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", crc_mod(F.col("doc_id"), 3) == 1)
    net = fit(docs.where(~F.col("held_out")), read_table(spark, sf_dir, "labels"))
    return score(docs, net, ["doc_id", "held_out"])


QUERIES = {"op9_quality": op9_quality}
ORACLE: dict = {}
