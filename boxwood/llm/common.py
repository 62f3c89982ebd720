"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the generated tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    It is set to a folder of our own only where the session has none, as in
    local tests.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(configured or "file:///tmp/checkpoints/boxwood")
    return sc.getCheckpointDir()


#: Rows of an Arrow batch. Spark's default of 10000 makes batches of some 35 MB of
#: text, which are held several times over on either side.
ARROW_ROWS, _SPARKS_OWN = "1000", "10000"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session was told to send small Arrow batches to Python
    workers, unless it has a setting of its own. Rows and results are the same."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key, _SPARKS_OWN) == _SPARKS_OWN:
        conf.set(key, ARROW_ROWS)
    return df


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    and what a lost executor held is read again rather than computed again. The
    folder goes when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", str(8 << 20)).parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write in here go when it ends. Else they stay until the
    driver happens to collect its garbage, beside those of the writes that follow.
    A Spark that has no such setting goes on as before."""
    conf, key = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        yield
    finally:
        conf.set(key, before)


#: A stored table of numbers is broadcast up to so many rows (8 bytes a number).
BROADCAST_ROWS = 500_000


def sized(df: DataFrame) -> DataFrame:
    """``df``, a stored table of a few numeric columns, marked for broadcast if its
    counted rows allow it. Beyond, Catalyst shuffles both sides of the join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z and nothing else. ``lower`` has a fast ASCII path, so
    strings without multi-byte characters take it."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Content key of a row. Rows that agree in id and text agree in every
    per-document result, so joining on it is safe for repeated ids."""
    return F.xxhash64(F.col(id_col), F.col(text_col))
