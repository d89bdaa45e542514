"""Written tables that cut lineage, in the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder


def folder(spark: SparkSession) -> str:
    """A fresh folder in the one that the cluster shares (`session.shared_folder`)."""
    base = shared_folder(spark)
    path = f"{base.rstrip('/')}/veilspark-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def save(df: DataFrame, path: str) -> DataFrame:
    """Writes df as compressed Parquet and reads it back; what lies before is never run again."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that no later step reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
