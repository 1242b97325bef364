"""From kept intervals to shots and frames, and curves between two values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.operators.intervals import subtract


def shots(words: DataFrame, removals: DataFrame, key: str = "rush_id") -> DataFrame:
    """(key, shot, start, end, timeline_start): what of [0, last end] no removal (key, start, end) takes, laid end to end."""
    base = words.groupBy(key).agg(F.max("end_ms").alias("end")).select(key, F.lit(0).cast("long").alias("start"), "end")
    kept = subtract(base, removals, key)
    order = W.partitionBy(key).orderBy("start")
    kept = kept.withColumn("shot", F.row_number().over(order) - 1)
    return kept.withColumn("timeline_start", F.sum(F.col("end") - F.col("start")).over(order) - (F.col("end") - F.col("start")))


def shots_between(words: DataFrame, cuts: DataFrame, key: str = "rush_id") -> DataFrame:
    """The same for cuts that are apart from each other, as gaps between words are: one window over the cuts."""
    ends = words.groupBy(key).agg(F.max("end_ms").alias("start")).withColumn("end", F.lit(None).cast("long"))
    order = W.partitionBy(key).orderBy("start", F.col("end").asc_nulls_last())
    own = cuts.select(key, "start", "end").unionByName(ends).withColumn("from", F.coalesce(F.lag("end").over(order), F.lit(0).cast("long"))).where("start > from")
    length, by = F.col("start") - F.col("from"), W.partitionBy(key).orderBy("start")
    return own.select(key, F.col("from").alias("start"), F.col("start").alias("end"), (F.row_number().over(by) - 1).alias("shot"), (F.sum(length).over(by) - length).alias("timeline_start"))


def frame_clips(kept: DataFrame, fps: int, key: str = "rush_id") -> DataFrame:
    """Whole frames, one at least, contiguous in the result."""
    frame = lambda c: F.rint(F.col(c) * fps / 1000.0).cast("long")
    own = kept.withColumn("in_frame", frame("start")).withColumn("out_frame", F.greatest(frame("end"), frame("start") + 1))
    order = W.partitionBy(key).orderBy("start")
    own = own.withColumn("start_frame", F.sum(F.col("out_frame") - F.col("in_frame")).over(order) - (F.col("out_frame") - F.col("in_frame")))
    return own.select(key, "shot", "in_frame", "out_frame", "start_frame")


def to_timeline(points: DataFrame, kept: DataFrame, key: str = "rush_id") -> DataFrame:
    """Source times (key, t) on the timeline; closed bounds, null where cut, the first shot on ties."""
    k = kept.select(F.col(key).alias("_k"), F.col("start").alias("_a"), F.col("end").alias("_b"), F.col("shot").alias("_s"), F.col("timeline_start").alias("_at"))
    each = points.select(key, "t").distinct()
    hit = each.join(k, (F.col(key) == F.col("_k")) & F.col("t").between(F.col("_a"), F.col("_b")))
    found = hit.groupBy(key, "t").agg(F.min_by(F.col("_at") + F.col("t") - F.col("_a"), "_s").alias("timeline_t"))
    return points.join(found, [key, "t"], "left")


def shot_at(points: DataFrame, kept: DataFrame, key: str = "rush_id") -> DataFrame:
    """The points (key, t on the timeline) with their ``shot``; the last one past the end."""
    at = kept.select(key, F.col("timeline_start").alias("t"), F.struct("shot").alias("s"))
    own = points.withColumn("p", F.lit(1)).unionByName(at, allowMissingColumns=True)
    order = W.partitionBy(key).orderBy("t", F.col("p").asc_nulls_first())
    return own.withColumn("shot", F.last("s", ignorenulls=True).over(order)["shot"]).where("p = 1").drop("p", "s")


def long_enough(kept: DataFrame, ends: DataFrame, least: int = 420, most_changes: int = 60, key: str = "rush_id") -> DataFrame:
    """Kept intervals (key, start, end) of ``least`` at least, within [0, total] of ``ends`` (key, total).

    The first that is too short grows into the gaps beside it, half on each side if there is room, else
    joins the nearer neighbour (the earlier of equally near ones); then the search begins anew, up to
    ``most_changes`` times. One recording is one task here, in order.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total = pdf["total"].iloc[0]
        shots = sorted([int(a), int(b)] for a, b in zip(pdf["start"], pdf["end"], strict=True))
        for _ in range(most_changes):
            k = next((k for k, (a, b) in enumerate(shots) if b - a < least), None)
            if k is None:
                break
            a, b = shots[k]
            left, right = a - (shots[k - 1][1] if k else 0), (shots[k + 1][0] if k + 1 < len(shots) else total) - b
            left, right, short = max(0, left), max(0, right), least - (b - a)
            if left + right >= short:
                grow = max(min(left, short // 2), short - right)
                shots[k] = [a - grow, b + short - grow]
                continue
            del shots[k]
            if k and (k == len(shots) or left <= right):
                shots[k - 1][1] = b
            elif k < len(shots):
                shots[k][0] = a
        return pd.DataFrame([(pdf[key].iloc[0], a, b) for a, b in shots if b > a], columns=[key, "start", "end"])

    kind = kept.schema[key].dataType.simpleString()
    return kept.join(ends.select(key, "total"), key).groupBy(key).applyInPandas(run, f"`{key}` {kind}, start long, end long")


def curve(name: str, x: Column, stiffness: float = 4.0, overshoot: float = 0.11, peak: float = 0.55) -> Column:
    """Progress at x of a named curve; x is held to [0, 1], and unknown names are ``progressive``.

    ``ballistic`` shoots past its aim by ``overshoot`` at ``peak`` and settles.
    """
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    soft = lambda t: t * t * t * (t * (t * 6 - 15) + 10)
    expo = lambda t: (1 - F.exp(-stiffness * t)) / (1 - F.exp(F.lit(-stiffness)))
    thrown = F.when(x <= peak, (1 + overshoot) * expo(x / peak)).otherwise(1 + overshoot - overshoot * soft((x - peak) / (1 - peak)))
    known = {"linear": x, "smoothstep": x * x * (3 - 2 * x), "smootherstep": soft(x), "ease_out_expo": expo(x), "ballistic": thrown}
    return known.get(name, 0.72 * x + 0.28 * soft(x))


def smpte(ms: Column, fps: int) -> Column:
    """``HH:MM:SS:FF`` of milliseconds, to the nearest frame (half to even)."""
    n = F.rint(ms * fps / 1000.0).cast("long")
    return F.format_string("%02d:%02d:%02d:%02d", F.floor(n / (3600 * fps)), F.floor(n / (60 * fps)) % 60, F.floor(n / fps) % 60, n % fps)


def edit_list(kept: DataFrame, title: str, fps: int = 25, reel: str = "AX", key: str = "rush_id") -> DataFrame:
    """(key, edl): the shots of a recording as one CMX3600 text of whole-number frame rates."""
    end = F.col("timeline_start") + F.col("end") - F.col("start")
    times = F.concat_ws(" ", *(smpte(c, fps) for c in (F.col("start"), F.col("end"), F.col("timeline_start"), end)))
    line = F.concat(F.format_string("%03d  %-8s AA/V  C        ", F.col("shot") + 1, F.lit(reel)), times, F.lit("\n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("shot", line.alias("line")))), lambda x: x["line"])
    return kept.groupBy(key).agg(F.concat(F.lit(f"TITLE: {title}\nFCM: NON-DROP FRAME\n\n"), F.array_join(lines, "\n")).alias("edl"))
