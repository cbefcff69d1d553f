"""A frame that several jobs read, computed once and under a short plan."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a temporary one only on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tideline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder until the application ends: for frames that are returned to a caller."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept/{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settled(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` (of one column at least) as a table in the shared folder, for the length of a ``with``.

    Unlike a persisted frame it outlives lost executors, and its plan is a scan: what is built on it isn't planned
    through all that made it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled/{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        df.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        system.delete(place, True)
