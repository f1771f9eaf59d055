"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Equal texts are texts with the same code points after no change; null counts as empty. Of a group
the row with the largest id stays. Rows with a null id can only stay if no other row of the group
has an id. Rows that repeat both id and text are one document given twice: ``refine`` gives them the
same verdict, ``unique`` keeps one of them. An empty table gives an empty result; further columns of the
input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, maybe_in, once, read_table, stash, with_groups, without

#: Code points of the prefix that the second level hashes.
PREFIX = 64


def refine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, digest_all: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept and the text's SHA-256.

    The digest is null for rows that an earlier level has already shown to be unique, unless
    ``digest_all`` asks for it. Only narrow keys are shuffled, never texts: surviving groups beyond
    ``BROADCAST_ROWS`` reach the texts as a bitmap, so that some unique rows are hashed as well.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).select(
        "id", "t", F.octet_length("t").alias("len"), F.xxhash64(F.substring("t", 1, prefix)).alias("prefix")
    )
    # Levels 1 and 2: lengths, then (length, prefix) groups within the surviving lengths.
    keys = stash(rows.select("len", "prefix"), "dedup-keys")
    lengths = keys.groupBy("len").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("len")
    groups = keys.groupBy("len", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = stash(groups.join(lengths, "len", "left_semi").select("len", "prefix", F.lit(True).alias("open")), "dedup-open")
    small = groups.count() <= BROADCAST_ROWS
    # Level 3: the full content of rows in surviving groups.
    if small:
        marked = rows.join(F.broadcast(groups), ["len", "prefix"], "left").withColumn("open", F.col("open").isNotNull())
    else:
        marked = maybe_in(rows, groups, len=F.col("len"), prefix=F.col("prefix")).withColumnRenamed("__maybe", "open")
    digest = F.sha2(F.col("t"), 256)
    hashed = stash(
        marked.select(
            "id",
            "open",
            F.unhex(digest if digest_all else F.when(F.col("open"), digest)).alias("sha"),
        ),
        "dedup-sha",
    )
    found = (
        hashed.where("open")
        .groupBy("sha")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )
    found = stash(found, "dedup-groups")
    opened = hashed.where("open")
    opened = with_groups(opened, found, "sha", "group_size", opened.count())
    alone = hashed.where("not open").select("*", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("group_size"))
    both = opened.unionByName(alone)
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return both.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less the rows that another row of equal text replaces."""
    found = refine(docs, id_col, text_col)
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    keys = {id_col: F.col(id_col), "text_sha256": digest}
    # Rows whose text is found once cannot repeat.
    repeated = found.where("kept and group_size > 1").groupBy(id_col, "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return once(without(docs, found.where("not kept"), **keys), repeated, **keys)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine(read_table(spark, sf_dir, "documents"), digest_all=True)


ORACLE = {
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        WINDOW g AS (PARTITION BY t)
    """
}
QUERIES = {"op5_exact_dedup": op5_exact_dedup}
