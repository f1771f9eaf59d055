"""Benchmark decontamination by a prefix-filtered join of word windows.

A window is 13 consecutive words of a benchmark item, or the whole item if it has fewer. Exact
containment of a window needs every one of its tokens, so its rarest token (by corpus frequency)
is the necessary prefix: documents are joined with windows on that token alone, length and positional
bounds drop candidates that cannot fit, and the window is then compared word by word. Texts are split into words
twice: to count the tokens of a block of windows, and to find the windows. Which items have a window is a relation of
its own, so what is broadcast is bounded however many items share one.

Null and empty texts have no words and are never contaminated. Rows that repeat id and text give equal
results. Items without words have no windows; an empty benchmark leaves all documents clean. Further
columns of either table are ignored. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, read_table, stash, without, words

WINDOW = 13
#: Windows of a block that is broadcast (about 100 bytes each); a larger benchmark takes more blocks.
WINDOWS_PER_BLOCK = 200_000


def windows(w: Column, size: int = WINDOW) -> Column:
    n = F.size(w)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.slice(w, i, size))
    return F.when(n > 0, many).otherwise(F.array().cast("array<array<string>>"))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct pairs of a window (win, and key, its digest) and the id (item, as string) of an item that has it."""
    split = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    each = split.select("item", F.explode(windows(F.col("w"))).alias("win")).distinct()
    return each.withColumn("key", F.md5(F.array_join("win", " ").cast("binary")))


def covered(spans: Column) -> Column:
    """Words within any of the spans (struct of first, end)."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))

    def step(acc, s):
        begin = F.greatest(acc["upto"], s["first"])
        return F.struct(F.greatest(acc["upto"], s["end"]).alias("upto"), (acc["n"] + F.greatest(s["end"] - begin, F.lit(0))).alias("n"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def prefix_index(split: DataFrame, wins: DataFrame) -> DataFrame:
    """Windows keyed by their rarest token: token, offset, win, key."""
    tokens = wins.select("win", "key", F.posexplode("win").alias("offset", "token"))
    vocabulary = tokens.select("token").distinct()
    seen = split.select(F.explode("w").alias("token")).join(F.broadcast(vocabulary), "token").groupBy("token").count()
    ranked = tokens.join(F.broadcast(seen), "token", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    rarest = F.min_by(F.struct("token", "offset"), F.struct("count", "token", "offset")).alias("p")
    return ranked.groupBy("win", "key").agg(rarest).select("p.token", "p.offset", "win", "key")


def ending(spark: SparkSession) -> DataFrame:
    """The index of the empty window, which stands once in every document: behind its last word, at the token that is no word."""
    return spark.range(1).select(F.lit("").alias("token"), F.lit(0).alias("offset"), F.array().cast("array<string>").alias("win"), F.lit("").alias("key"))


def hits(split: DataFrame, index: DataFrame) -> DataFrame:
    """Verified occurrences: id, h, first word, end, key. The words are only referred to until a candidate is found."""
    each = split.select("id", "h", "w", F.posexplode(F.array_append("w", F.lit(""))).alias("pos", "token"))
    found = each.join(F.broadcast(index), "token")
    first, n = F.col("pos") - F.col("offset"), F.size("win")
    fits = (first >= 0) & (first + n <= F.size("w"))
    same = F.slice("w", F.greatest(first + 1, F.lit(1)), n) == F.col("win")
    return found.where(fits & same).select("id", "h", first.alias("first"), (first + n).alias("end"), "key")


def named(found: DataFrame, owners: DataFrame) -> DataFrame:
    """The items of each document's windows: id, h, item. Owners are broadcast in blocks, so a window that many documents have is not shuffled."""
    blocks = max(1, -(-owners.count() // BROADCAST_ROWS))
    dealt = owners.withColumn("block", F.pmod(F.xxhash64("key", "item"), F.lit(blocks)))
    parts = [found.join(F.broadcast(dealt.where(F.col("block") == b).drop("block")), "key").select("id", "h", "item") for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def repeated(rows: DataFrame, copies: str) -> DataFrame:
    """Every row ``copies`` times; the arrays that this takes are bounded."""
    step = 1024
    runs = rows.withColumn("__run", F.explode(F.sequence(F.lit(0), F.floor((F.col(copies) - 1) / step))))
    within = F.least(F.lit(step), F.col(copies) - F.col("__run") * step)
    return runs.withColumn("__copy", F.explode(F.sequence(F.lit(1), within))).drop(copies, "__run", "__copy")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, h (hash of id and text), n_words, n_hit, n_items, items_sha256, contaminated."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Documents are told apart by id and text hash, so ids that repeat or are null do no harm.
    split = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("h"), words(F.col(text_col)).alias("w"))
    owners = stash(item_windows(items), "decontam-owners")
    wins = stash(owners.select("win", "key").distinct(), "decontam-windows")
    blocks = max(1, -(-wins.count() // WINDOWS_PER_BLOCK))
    parts = []
    for b in range(blocks):
        index = prefix_index(split, wins.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b))
        # The first block also finds where each document ends, so lengths cost no pass of their own.
        parts.append(hits(split, stash(index if b else index.unionByName(ending(docs.sparkSession)), "decontam-index")))
    found = stash(reduce(DataFrame.unionByName, parts), "decontam-hits")
    whole = F.col("key") == ""
    places = found.select("id", "h", F.struct("first", "end").alias("span"), whole.cast("long").alias("rows"), F.lit(None).cast("string").alias("item"))
    names = named(found.where(~whole), owners.where("item is not null").select("key", "item"))
    names = names.select("id", "h", F.lit(None).cast(places.schema["span"].dataType).alias("span"), F.lit(0).cast("long").alias("rows"), "item")
    per_doc = places.unionByName(names).groupBy("id", "h").agg(
        F.max("span.end").cast("long").alias("n_words"),
        covered(F.collect_set("span")).cast("long").alias("n_hit"),
        F.sort_array(F.collect_set("item")).alias("items"),
        F.sum("rows").alias("rows"),
    )
    return repeated(per_doc, "rows").select(
        F.col("id").alias(id_col),
        "h",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less the contaminated ones."""
    dropped = decontaminate(docs, items, id_col, text_col).where("contaminated")
    return without(docs, dropped, **{id_col: F.col(id_col), "h": F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))})


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("h")


QUERIES = {"op6_benchmark_decontamination": op6_benchmark_decontamination}
ORACLE = {
    "op6_benchmark_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS g
                FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        lens AS (SELECT DISTINCT n FROM win),
        dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
        h AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN win ON dw.g = win.g AND dw.n = win.n),
        p AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
              FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
    """
}
