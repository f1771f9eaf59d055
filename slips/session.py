"""Session and table helpers shared by every part of the engine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A small local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("slips")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Partitions for each one in which a table is read, where what is made of its rows is many times larger.
GROWTH = 32


def spread(spark: SparkSession, rows: DataFrame, key: str, source: DataFrame | None = None, growth: int = GROWTH) -> DataFrame:
    """Rows by key in a number of partitions that adaptive execution leaves alone, for work that is long for its bytes.

    Their number grows with that of ``source``, the table that the rows come from, so that what a task sorts stays in memory.
    """
    least = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), 48)
    return rows.repartition(least if source is None else max(least, growth * source.rdd.getNumPartitions()), key)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir; it goes when the driver ends.

    Only a local session may do without such a folder.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="slips-")
    path = f"{top}/slips-{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path
