"""Levels over time: reference percentiles, sessions, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reference_levels(rows: DataFrame, key: str, level: str, low: float = 0.08, high: float = 0.88) -> DataFrame:
    """Exact percentiles, linear between neighbours."""
    return rows.groupBy(key).agg(F.percentile(level, low).alias("floor"), F.percentile(level, high).alias("speech"), F.count(F.lit(1)).alias("n"))


def gap_sessions(rows: DataFrame, key: str, at: Column, gap: int) -> DataFrame:
    """Sessions that a gap of ``gap`` or more parts; at is a whole number."""
    w = W.partitionBy(key).orderBy("at", "id")
    own = rows.withColumn("at", at).withColumn("new", F.when(F.col("at") - F.lag("at").over(w) >= gap, 1).otherwise(0)).withColumn("session", F.sum("new").over(w))
    return own.groupBy(key, "session").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def retained(entries: DataFrame, newest: int = 60, days: int = 120) -> DataFrame:
    """Entries (id, at) that a cache keeps: the newest, and none older than ``days`` before the newest of all.

    The newest are taken by a bounded top-k, so no single task sorts all entries.
    """
    top = entries.orderBy(F.desc("at"), "id").limit(newest)
    last = entries.agg(F.max("at").alias("last"))
    return top.join(F.broadcast(last), F.col("at") >= F.col("last") - F.expr(f"INTERVAL {days} DAYS")).drop("last")
