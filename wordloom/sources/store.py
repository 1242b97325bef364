"""A store of results by content: keys from what a result was made of, written once, kept for a while.

A store is a folder of batches, each a Parquet table of (key, at, value). ``put`` writes a batch beside the
store and renames it into place, which is atomic: readers see all of it or nothing, and a task or driver that
dies leaves nothing that counts. Two writers of one key give two equal rows, of which readers take the one of the
least batch. All is done by joins and aggregations over the batches, whatever their number of rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators.levels import retained

#: Settings that change how a result is made but not the result.
NEUTRAL = ("use_cache", "cpu_threads", "device", "compute_type")


def key(source: Column, size: Column, modified: Column, settings: dict, version: str) -> Column:
    """Twenty characters of the hash of a source (path, bytes, whole seconds of its last change), what settings matter, and the version."""
    told = ";".join(f"{k}={settings[k]!r}" for k in sorted(settings) if k not in NEUTRAL)
    seconds = F.unix_timestamp(modified).cast("string")
    return F.substring(F.sha2(F.concat_ws("|", source, F.coalesce(size.cast("string"), F.lit("")), F.coalesce(seconds, F.lit("")), F.lit(told), F.lit(version)), 256), 1, 20)


class Store:
    """A store at ``path``, in any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str, value: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), f"key string, at timestamp, value {value}"

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def batches(self) -> list[str]:
        fs, p = self._fs(self.path)
        return sorted(f.getPath().toString() for f in fs.listStatus(p) if f.getPath().getName().startswith("batch-")) if fs.exists(p) else []

    def rows(self) -> DataFrame:
        """(key, at, value, batch): one row a key."""
        names = self.batches()
        if not names:
            return self.spark.createDataFrame([], f"{self.schema}, batch string")
        own = self.spark.read.schema(self.schema).parquet(*names).withColumn("batch", F.regexp_extract("_metadata.file_path", r"/(batch-[^/]+)/", 1))
        best = own.groupBy("key").agg(F.min_by(F.struct("at", "value", "batch"), F.struct("batch", "at")).alias("b"))
        return best.select("key", "b.at", "b.value", "b.batch")

    def get(self, wanted: DataFrame) -> DataFrame:
        """The wanted rows (key and more) with ``value`` and ``hit``."""
        return wanted.join(self.rows().select("key", "value", F.lit(True).alias("hit")), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))

    def missing(self, wanted: DataFrame) -> DataFrame:
        return wanted.join(self.rows().select("key"), "key", "left_anti")

    def put(self, made: DataFrame) -> str | None:
        """Writes the rows (key, at, value) whose keys the store lacks as one batch, once each; its name, null if there are none."""
        staged, name = f"{self.path}/_staged-{uuid.uuid4().hex}", f"{self.path}/batch-{uuid.uuid4().hex}"
        self.missing(made.select("key", "at", "value")).groupBy("key").agg(F.min_by(F.struct("at", "value"), "at").alias("b")).select("key", "b.at", "b.value").write.parquet(staged)
        fs, p = self._fs(staged)
        if self.spark.read.schema(self.schema).parquet(staged).isEmpty():
            fs.delete(p, True)
            return None
        fs.rename(p, self._fs(name)[1])
        return name

    def purge(self, newest: int = 60, days: int = 120) -> tuple[int, int]:
        """Leaves what ``levels.retained`` keeps; (entries kept, entries removed).

        What is kept is written as a new batch before the old ones are deleted, so that a reader finds every kept key at any time.
        """
        old, own = self.batches(), self.rows()
        kept = own.join(F.broadcast(retained(own.select(F.col("key").alias("id"), "at"), newest, days).select(F.col("id").alias("key"))), "key", "left_semi")  # `newest` rows at most
        staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
        before = own.count()
        kept.select("key", "at", "value").write.parquet(staged)
        after = self.spark.read.schema(self.schema).parquet(staged).count()
        fs, p = self._fs(staged)
        if after:
            fs.rename(p, self._fs(f"{self.path}/batch-{uuid.uuid4().hex}")[1])
        else:
            fs.delete(p, True)
        for name in old:
            fs.delete(self._fs(name)[1], True)
        return after, before - after


__all__ = ["NEUTRAL", "Store", "key"]
