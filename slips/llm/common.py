"""Helpers of the training-data operators: shared storage and word splitting."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Everything outside 0-9, a-z (after lower-casing A-Z) and the non-ASCII range separates words.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: Rows and bytes of text that go to a Python worker at once; Spark's own 10,000 rows may be hundreds of MB.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; sessions that say nothing of Arrow batches get small ones."""
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folder for sessions whose cluster names none: local runs and tests.
_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where the cluster names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN_DIR:
            _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="slips-"))
        folder = _OWN_DIR[0]
    return folder


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write a narrow intermediate to shared storage and read it back.

    Cuts the lineage like ``checkpoint()`` but keeps columnar, compressed files, so later
    branches prune columns and lost executors cost no recomputation. The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/slips-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """Words of a text, in order; null and empty texts have none."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), WORD_BREAK, -1)
    return F.filter(parts, lambda w: w != "")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id's decimal text modulo ``m``; a null id counts as the empty text (0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


#: Most rows (about 50 bytes each) that are broadcast; what goes beyond is joined by a shuffle.
BROADCAST_ROWS = 500_000


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """``rows`` joined with their groups, at most one for each key; ``size`` says how many of the ``n`` rows a group has.

    Groups of more than n / BROADCAST_ROWS rows are broadcast: there are fewer than BROADCAST_ROWS of them. The others are
    joined by a shuffle, in which no key has more rows than that.
    """
    most = max(1, n // BROADCAST_ROWS)
    hot = F.broadcast(groups.where(F.col(size) > most).select(F.col(key).alias("__hot"), F.struct(*groups.columns).alias("__group")))
    told = rows.join(hot, F.col(key) == F.col("__hot"), "left")
    more = [c for c in groups.columns if c != key]
    found = told.where("__hot is not null").select(*rows.columns, *(F.col(f"__group.{c}").alias(c) for c in more))
    rest = told.where("__hot is null").select(*rows.columns).join(groups.where(F.col(size) <= most), key, "left")
    return found.unionByName(rest)


#: Bits of a filter: 2**18 rows of 64.
FILTER_BITS = 24


def maybe_in(rows: DataFrame, listed: DataFrame, **keys: Column) -> DataFrame:
    """``rows`` with ``__maybe``: false only where ``keys`` (name in ``listed`` to expression over rows) are not listed.

    The list is broadcast as a bitmap of 2**FILTER_BITS hashes, whose size does not grow with it; the longer the list, the more
    rows are taken for listed ones. Nothing of ``rows`` is shuffled.
    """
    place = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(1 << FILTER_BITS))
    set_bits = listed.select(place([F.col(k) for k in keys]).alias("__p"))
    bitmap = set_bits.groupBy(F.shiftright("__p", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__p % 64 as int))")).alias("__bits"))
    seen = rows.withColumn("__p", place(list(keys.values()))).withColumn("__word", F.shiftright("__p", 6))
    seen = seen.join(F.broadcast(bitmap), "__word", "left")
    hit = F.coalesce(F.expr("shiftrightunsigned(__bits, cast(__p % 64 as int)) & 1L"), F.lit(0)) == 1
    return seen.withColumn("__maybe", hit).drop("__p", "__word", "__bits")


def without(docs: DataFrame, dropped: DataFrame, **keys: Column) -> DataFrame:
    """``docs`` less the rows whose ``keys`` (name in ``dropped`` to expression over docs) are listed; nulls match nulls.

    Texts are not shuffled as long as the list fits ``BROADCAST_ROWS``.
    """
    listed = stash(dropped.select(*keys).distinct(), "dropped")
    return docs.join(*_listed(listed, keys), "left_anti")


def _listed(listed: DataFrame, keys: dict[str, Column]) -> tuple[DataFrame, list[Column]]:
    small = listed.count() <= BROADCAST_ROWS
    named = listed.select(*(F.col(k).alias(f"__{k}") for k in keys))
    return F.broadcast(named) if small else named, [e.eqNullSafe(F.col(f"__{k}")) for k, e in keys.items()]


def once(docs: DataFrame, repeated: DataFrame, **keys: Column) -> DataFrame:
    """``docs`` with one row (the least) for each of the listed ``keys``, as in ``without``; other rows stay.

    Rows are summed up in each task before they are shuffled, so a row that fills the table meets itself once a task.
    """
    on = _listed(stash(repeated.select(*keys).distinct(), "repeated"), keys)
    several = docs.withColumns({f"__of_{k}": e for k, e in keys.items()}).join(*on, "left_semi")
    least = several.groupBy(*(f"__of_{k}" for k in keys)).agg(F.min(F.struct(*docs.columns)).alias("__row"))
    return docs.join(*on, "left_anti").unionByName(least.select("__row.*"))
