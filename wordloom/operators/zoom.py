"""Zooms: scores of shots, pace by intensity, keyframes of curves."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions import numbers as N
from wordloom.functions import text as T
from wordloom.functions import vocabulary as V
from wordloom.operators.seams import words_in_shots


def tagged(shots: DataFrame, words: DataFrame, long_ms: int = 6000) -> DataFrame:
    """The shots (rush_id, shot, start, end, timeline_start) with ``said`` (their words in order) and ``tags``.

    ``silent`` without words; else ``sentence start`` (first shot, after a silent one, after a full stop or
    suspension) or ``after cut`` (words went before it), ``sentence end``, ``long``.
    """
    own = words_in_shots(words.select("rush_id", "idx", "text", "norm", "start_ms", "end_ms"), shots)
    said = own.groupBy("rush_id", "shot").agg(F.array_sort(F.collect_list(F.struct("idx", "text", "norm"))).alias("said"))
    s = shots.join(said, ["rush_id", "shot"], "left")
    order = W.partitionBy("rush_id").orderBy("shot")
    s = s.withColumn("last", F.element_at("said", F.lit(-1))).withColumn("before", F.lag("last").over(order)).withColumn("first", F.element_at("said", F.lit(1)))
    fresh = F.col("before").isNull() | T.ends_sentence("before.text") | T.ends_suspension("before.text")
    spoken = F.col("said").isNotNull()
    tags = [
        F.when(~spoken, "silent"), F.when(spoken & fresh, "sentence start").when(spoken & (F.col("first.idx") != F.col("before.idx") + 1), "after cut"),
        F.when(spoken & T.ends_sentence("last.text"), "sentence end"), F.when(spoken & (F.col("end") - F.col("start") >= long_ms), "long"),
    ]
    return s.withColumn("tags", F.array_compact(F.array(*tags))).drop("last", "before", "first")


def shot_scores(shots: DataFrame, least_ms: int = 800, avoid_after_cut: bool = True) -> DataFrame:
    """(rush_id, shot, score): how well a zoom would stand at a tagged shot; ``energy`` and ``onset`` (0 to 1) where shots have them.

    Silent and too short shots have -5.
    """
    null = F.lit(None).cast("double")
    energy, onset = (F.col(c) if c in shots.columns else null for c in ("energy", "onset"))
    seconds, has = (F.col("end") - F.col("start")) / 1000.0, lambda tag: F.array_contains("tags", tag)
    norms = F.transform("said", lambda w: w["norm"])
    some = lambda words, vocabulary: F.coalesce(F.exists(words, lambda w: w.isin(*vocabulary)), F.lit(False))
    score = (
        F.coalesce(1.00 * onset, F.lit(0.0)) + F.coalesce(0.55 * energy, F.lit(0.0))
        + F.when(some(F.slice(norms, 1, 4), V.IDEA_SHIFTS), 0.50).otherwise(0.0) + F.when(some(norms, V.EMPHASIS), 0.45).otherwise(0.0)
        + F.when(has("sentence start"), 0.30).otherwise(0.0)
        + F.when(seconds >= 5, F.least(F.lit(0.50), 0.50 * (seconds - 5) / 12 + 0.16)).otherwise(0.0)
        + F.when(has("after cut"), -0.45 if avoid_after_cut else 0.20).otherwise(0.0)
        + F.when(energy.isNull() & onset.isNull(), 0.25 * F.least(F.lit(1.0), seconds / 6)).otherwise(0.0)
    )
    return shots.select("rush_id", "shot", F.when(has("silent") | (seconds * 1000 < least_ms), -5.0).otherwise(score).alias("score"))


def pace(intensity: float, minutes: Column, spacing: float = 6.5, per_minute: float = 5.5, delta: tuple[float, float] = (4.0, 20.0)) -> Column:
    """(spacing, most, delta) of zooms for an intensity of 0 to 100: seconds between them, their number, their amplitude."""
    x = F.lit(float(min(100.0, max(0.0, intensity))))
    most = F.greatest(F.lit(1), F.rint(per_minute * N.remap(x, 0, 100, 0.40, 1.30) * minutes).cast("int"))
    return F.struct((spacing * N.remap(x, 0, 100, 1.55, 0.62)).alias("spacing"), most.alias("most"), N.remap(x, 0, 100, *delta).alias("delta"))


def widest_static(zooms: DataFrame, durations: DataFrame) -> DataFrame:
    """(rush_id, start, end): the longest stretch of the result (rush_id, duration) in which no zoom (rush_id, t) starts; the first of equal ones."""
    ends = durations.select("rush_id", F.lit(0.0).alias("t")).unionByName(durations.select("rush_id", F.col("duration").cast("double").alias("t")))
    at = ends.unionByName(zooms.select("rush_id", F.col("t").cast("double").alias("t")))
    at = at.withColumn("to", F.lead("t").over(W.partitionBy("rush_id").orderBy("t"))).where("to is not null")
    best = at.groupBy("rush_id").agg(F.max(F.struct((F.col("to") - F.col("t")).alias("d"), (-F.col("t")).alias("m"), "to")).alias("x"))
    return best.select("rush_id", (-F.col("x.m")).alias("start"), F.col("x.to").alias("end"))


def _at(name: str, x: float, stiffness: float = 4.0, overshoot: float = 0.11, peak: float = 0.55) -> float:
    soft = lambda t: t * t * t * (t * (6 * t - 15) + 10)
    expo = lambda t: (1 - math.exp(-stiffness * t)) / (1 - math.exp(-stiffness))
    if name == "ballistic":
        return (1 + overshoot) * expo(x / peak) if x <= peak else 1 + overshoot - overshoot * soft((x - peak) / (1 - peak))
    known = {"linear": x, "smoothstep": x * x * (3 - 2 * x), "smootherstep": soft(x), "ease_out_expo": expo(x)}
    return known.get(name, 0.72 * x + 0.28 * soft(x))


def thinned(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """The fewest of the points, halving at the worst, between which straight lines miss no other by more than the tolerance."""

    def between(a: int, b: int) -> list[int]:
        (t0, v0), (t1, v1) = points[a], points[b]
        slope = (v1 - v0) / (t1 - t0) if t1 > t0 else 0.0
        off, k = max(((abs(points[k][1] - v0 - slope * (points[k][0] - t0)), -k) for k in range(a + 1, b)), default=(0.0, 0))
        return between(a, -k) + [-k] + between(-k, b) if off > tolerance else []

    last = len(points) - 1
    return [points[k] for k in [0, *between(0, last), last]] if last > 0 else list(points)


def keyframes(name: str, duration: float, start: float, end: float, fps: float = 30.0, most: int = 90, tolerance: float = 0.22, **shape: float) -> list[tuple[float, float]]:
    """(time, value) of a curve sampled at each frame and thinned; the tolerance grows until there are no more than ``most``; ``shape`` is of the curve."""
    if duration <= 0:
        return [(0.0, end)]
    steps = min(4000, max(2, round(duration * (fps if fps > 0 else 30.0))))
    points = [(round(k / steps * duration, 6), start + (end - start) * _at(name, k / steps, **shape)) for k in range(steps)] + [(round(duration, 6), end)]
    out = thinned(points, tolerance)
    while len(out) > most and tolerance < 50:
        tolerance *= 1.6
        out = thinned(points, tolerance)
    return out if len(out) <= most else [*out[:: max(1, len(out) // most)], points[-1]]


def curve_keyframes(name: Column, duration: Column, start: Column, end: Column, fps: float = 30.0, most: int = 90, tolerance: float = 0.22) -> Column:
    """Keyframes of each row; null where any of its values is."""

    def run(names: pd.Series, d: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        rows = zip(names, d, a, b, strict=True)
        return pd.Series([None if pd.isna([x, y, z]).any() or n is None else [{"t": t, "v": v} for t, v in keyframes(n, x, y, z, fps, most, tolerance)] for n, x, y, z in rows], dtype=object)

    return F.pandas_udf(run, "array<struct<t: double, v: double>>")(name, duration.cast("double"), start.cast("double"), end.cast("double"))


def between_keyframes(points: Column, t: Column) -> Column:
    """The value at t on straight lines between keyframes (t, v); the first or last value beyond them."""
    before = F.element_at(F.filter(points, lambda p: p["t"] <= t), -1)
    after = F.try_element_at(F.filter(points, lambda p: p["t"] > t), F.lit(1))
    inside = before["v"] + (after["v"] - before["v"]) * (t - before["t"]) / (after["t"] - before["t"])
    first = F.try_element_at(points, F.lit(1))
    return F.when(t < first["t"], first["v"]).otherwise(F.coalesce(inside, before["v"]))
