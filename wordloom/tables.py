"""Intermediate results as tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: set[str] = set()


def sound_unions(spark: SparkSession) -> None:
    """Turns off what gives wrong results in Spark 4.1.2: a union of shuffled inputs said to be partitioned as they are.

    Adaptive execution may have merged their partitions differently, and an aggregation by the same key then
    works without an exchange on parts of a key (``tests/test_decisions.py`` has a case).
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder in ``spark.checkpoint.dir``, removed when the driver ends.

    Only a local session may do without that setting: it gets a temporary folder.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="wordloom-shared-")
        sc.setCheckpointDir(where)
    own = f"{where.rstrip('/')}/wordloom-tables-{sc.applicationId}"
    if own not in _folders:
        _folders.add(own)
        atexit.register(_remove, spark, own)
    return own


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, what: str = "rows") -> DataFrame:
    """The rows written once and read again: what follows is planned from those files, and survives lost executors."""
    sound_unions(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
