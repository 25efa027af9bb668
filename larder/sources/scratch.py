"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where none is set and the master is local."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if held := spark.sparkContext.getCheckpointDir():
        return held.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    spark.sparkContext.setCheckpointDir(own)
    return own


def fresh_path(spark: SparkSession) -> str:
    """A path for one table, deleted when the application ends."""
    path = f"{shared_folder(spark)}/larder-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def kept(df: DataFrame) -> DataFrame:
    """df written once and read back, so that what follows starts from files; they go when the application ends."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over all cores by keys: for rows of few bytes and much work, which one split of a file would hold and adaptive execution would put together."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)
