"""What reports and summaries say of recordings: counts, shares and orders, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranks of severities in lists.
SEVERITIES = {"high": 0, "medium": 1, "low": 2}


def speech(words: DataFrame) -> DataFrame:
    """(rush_id, speech): milliseconds that are spoken."""
    return words.groupBy("rush_id").agg(F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("speech"))


def zoom_counts(zooms: DataFrame, durations: DataFrame) -> DataFrame:
    """(rush_id, zooms, direct, progressive, launched, per_minute) for each recording (rush_id, duration in ms of the result)."""
    each = zooms.groupBy("rush_id").agg(F.count(F.lit(1)).alias("zooms"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("direct", "progressive", "launched")))
    out = durations.select("rush_id", "duration").join(each, "rush_id", "left").na.fill(0, ["zooms", "direct", "progressive", "launched"])
    return out.withColumn("per_minute", F.when(F.col("duration") > 0, F.col("zooms") * 60000 / F.col("duration")).otherwise(0.0)).drop("duration")


def shares(statistics: DataFrame) -> DataFrame:
    """(rush_id, kept, silence, hesitation, speech, gained_ms, gained): parts of what the bar of a report shows, which add up to 1; all 0 without a source."""
    parts = {"kept": "final_ms", "silence": "silence_ms", "hesitation": "hesitation_ms", "speech": "speech_ms"}
    total = sum(F.greatest(F.lit(0), F.col(c)) for c in parts.values())
    gained = F.greatest(F.lit(0), F.col("source_ms") - F.col("final_ms"))
    part = lambda c: F.coalesce(F.try_divide(F.greatest(F.lit(0), F.col(c)), total), F.lit(0.0))
    return statistics.select("rush_id", *(part(c).alias(name) for name, c in parts.items()), gained.alias("gained_ms"), F.coalesce(F.try_divide(gained, "source_ms"), F.lit(0.0)).alias("gained"))


def gap_kinds(gaps: DataFrame) -> DataFrame:
    """(kind, n, removed) of gaps (kind, removed), the most removed first."""
    return gaps.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("removed").alias("removed")).orderBy(F.desc("removed"), "kind")


def ranked(checks: DataFrame, most: int | None = None) -> DataFrame:
    """Checks (rush_id, timeline_t, category, severity) with their ``rank`` in a list: severity, then time; ``most`` of a recording for a summary."""
    worth = F.coalesce(F.create_map(*(F.lit(x) for item in SEVERITIES.items() for x in item))[F.col("severity")], F.lit(3))
    own = checks.withColumn("rank", F.row_number().over(W.partitionBy("rush_id").orderBy(worth, "timeline_t", "category")))
    return own if most is None else own.where(F.col("rank") <= most)


def taken(attempts: DataFrame, removals: DataFrame) -> DataFrame:
    """Attempts (rush_id, utt_id) with ``removed``: whether an applied removal (rush_id, utt_id, applied) is of them."""
    gone = removals.where("applied").select("rush_id", "utt_id", F.lit(True).alias("removed")).distinct()
    return attempts.join(gone, ["rush_id", "utt_id"], "left").withColumn("removed", F.coalesce("removed", F.lit(False)))


def census(files: DataFrame) -> DataFrame:
    """(n, bytes) of stored transcripts (size)."""
    return files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def surest(removals: DataFrame) -> DataFrame:
    """(rush_id, source, n, confidence): removals of each source and the surest."""
    return removals.groupBy("rush_id", "source").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))
