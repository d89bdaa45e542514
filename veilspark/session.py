"""Session helpers shared by queries, bench and tests."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cpus: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("veilspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Makes the package importable on the executors when PYTHONPATH doesn't name it."""
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    sc = spark.sparkContext
    if ROOT in map(os.path.abspath, filter(None, paths)) or getattr(sc, "_veilspark_shipped", False):
        return
    stage = tempfile.mkdtemp(prefix="veilspark-")
    tree = os.path.join(stage, "tree")
    shutil.copytree(
        os.path.join(ROOT, "veilspark"), os.path.join(tree, "veilspark"), ignore=shutil.ignore_patterns("__pycache__")
    )
    sc.addPyFile(shutil.make_archive(os.path.join(stage, "veilspark"), "zip", tree))
    sc._veilspark_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the whole cluster shares.

    Only a session on one machine, as in tests, gets a folder of its own where that is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc()
    if not base and held.getCheckpointDir().isDefined():
        base = held.getCheckpointDir().get()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veilspark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not held.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """df read back from the shared folder; what lies before is never run again, and survives a lost executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by hash over at least four tasks a core, however few files or row groups it comes from.

    For rows of few bytes that much work follows on; a stated number also keeps them from being put together by size.
    """
    spark = df.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; a file or a folder of parquet."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
