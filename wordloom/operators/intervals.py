"""Interval algebra per key, and greedy choice with a spacing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.tables import sound_unions


def merge(rows: DataFrame, key: str, tolerance: int = 0) -> DataFrame:
    """Unions of intervals (key, start, end) that touch or lie within the tolerance."""
    before = W.partitionBy(key).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    order = W.partitionBy(key).orderBy("start", "end")
    own = rows.where("end > start").withColumn("far", F.max("end").over(before))
    own = own.withColumn("new", F.when(F.col("far").isNull() | (F.col("start") > F.col("far") + tolerance), 1).otherwise(0)).withColumn("island", F.sum("new").over(order))
    return own.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def subtract(base: DataFrame, holes: DataFrame, key: str) -> DataFrame:
    """What of the base is in no hole: one sweep over the ends of both, counting how many intervals are open (one shuffle by key)."""
    sound_unions(base.sparkSession)
    step = lambda t, by: F.struct(F.col(t).alias("t"), F.lit(by).alias("by"))
    ends = lambda d, name: d.where("end > start").select(key, F.explode(F.array(step("start", 1), step("end", -1))).alias("e")).select(key, "e.t", F.col("e.by").alias(name))
    both = ends(base, "b").unionByName(ends(holes, "h"), allowMissingColumns=True)
    at = both.groupBy(key, "t").agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("h"), F.lit(0)).alias("h"))
    order = W.partitionBy(key).orderBy("t")
    at = at.withColumn("in_b", F.sum("b").over(order)).withColumn("in_h", F.sum("h").over(order)).withColumn("to", F.lead("t").over(order))
    return merge(at.where("in_b > 0 and in_h = 0").select(key, F.col("t").alias("start"), F.col("to").alias("end")), key)


def total(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("start"))).alias("total"))


def spaced_top(rows: DataFrame, key: str, spacing: float, k: int) -> DataFrame:
    """Greedy choice of up to k of (key, t, score, id) by score, then id, each at least ``spacing`` from those chosen.

    k rounds, each an aggregation with partial results that takes the best row still free, so no key's
    rows ever meet in one task. Rows without time or score are never chosen.
    """
    own = rows.select(F.col(key).alias("_k"), "id", "t", "score").where("t is not null and score is not null")
    row = F.struct((-F.col("score")).alias("s"), "id", "t")
    chosen = own.groupBy("_k").agg(F.array(F.min(row)).alias("got")).withColumnRenamed("_k", "_c")
    for _ in range(k - 1):
        free = F.forall("got", lambda g: F.abs(g["t"] - F.col("t")) >= spacing)
        round_ = own.join(chosen, F.col("_k").eqNullSafe(F.col("_c"))).groupBy("_c").agg(F.min(F.when(free, row)).alias("next"), F.any_value("got").alias("got"))
        chosen = round_.select("_c", F.when(F.col("next").isNull(), F.col("got")).otherwise(F.array_append("got", F.col("next"))).alias("got"))
    return chosen.select(F.col("_c").alias(key), F.posexplode("got").alias("rank", "x")).select(key, "rank", "x.id", "x.t")
