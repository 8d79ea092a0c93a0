"""Saving tables without leaving behind what was shuffled for them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrameWriter, SparkSession

#: Spark's setting by which the shuffle files of a query go when it ends.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_clean(spark: SparkSession, writer: DataFrameWriter, path: str) -> None:
    """Write Parquet and drop its shuffle files at once; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.unset(FILE_CLEANUP) if before is None else spark.conf.set(FILE_CLEANUP, before)


def scratch(spark: SparkSession) -> str:
    """A folder for saved tables that driver and executors share: spark.checkpoint.dir; in a local session a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(folder or 'file://' + tempfile.gettempdir()).rstrip('/')}/inkspan-index-{uuid.uuid4().hex}"


def discard(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
