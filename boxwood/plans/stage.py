"""Written stages: results kept in the folder that driver and executors share; small
tables of the driver's own."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints/boxwood")
    return sc.getCheckpointDir()


def local_rows(spark: SparkSession, rows: list[tuple], schema: str | StructType) -> DataFrame:
    """The driver's own ``rows`` as a DataFrame. They go as Arrow to the JVM; by
    ``createDataFrame(rows)`` each executor would start Python processes for them,
    beside those of the grouped passes."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not rows:
        return spark.createDataFrame([], kind)
    arrow = to_arrow_schema(kind)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow), kind)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back. Later uses share the result, lineage
    ends here, and a lost executor costs a read instead of a rebuild."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
