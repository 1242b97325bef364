"""Levels of sound: the envelope of samples and what is read off it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FLOOR = -90.0


def envelope(samples: DataFrame, rate: int = 16_000, hop: float = 0.010, window: float = 0.025) -> DataFrame:
    """(rush_id, i, db) from (rush_id, i, v): the level of the window that starts at every hop; the sound beyond the end is silent.

    Samples are summed by hop first, so only hops, not samples, are windowed.
    """
    step = max(1, round(hop * rate))
    wide = max(step, round(window * rate))
    cells = [k for k in range(-(-wide // step))]
    part = samples.select("rush_id", F.floor(F.col("i") / step).alias("hop"), (F.col("i") % step).alias("at"), (F.col("v").cast("double") * F.col("v")).alias("e"))
    rest = wide - (len(cells) - 1) * step  # of the last hop that a window touches, only its beginning
    sums = part.groupBy("rush_id", "hop").agg(F.sum("e").alias("whole"), F.sum(F.when(F.col("at") < rest, F.col("e")).otherwise(0.0)).alias("begin"))
    order = W.partitionBy("rush_id").orderBy("hop")
    ahead = lambda c, k: F.when(F.lead("hop", k).over(order) == F.col("hop") + k, F.lead(c, k).over(order)) if k else F.col(c)
    energy = sum((F.coalesce(ahead("begin" if k == cells[-1] else "whole", k), F.lit(0.0)) for k in cells[1:]), F.col("begin" if len(cells) == 1 else "whole"))
    rms = F.sqrt(F.greatest(F.lit(0.0), energy / wide))
    return sums.select("rush_id", F.col("hop").alias("i"), F.greatest(F.lit(FLOOR), 20 * F.log10(F.greatest(rms, F.lit(1e-10)))).alias("db"))


def references(levels: DataFrame, low: float = 0.08, high: float = 0.88, spread: float = 8.0, least: int = 10) -> DataFrame:
    """(rush_id, noise, speech): percentiles of the levels that are no silence, ``spread`` apart at least; defaults where there are few."""
    heard = F.when(F.col("db") > FLOOR + 1, F.col("db"))
    own = levels.groupBy("rush_id").agg(F.count(heard).alias("n"), F.percentile(heard, low).alias("p"), F.percentile(heard, high).alias("q"))
    few = F.col("n") < least
    noise = F.when(few, FLOOR).otherwise(F.col("p"))
    return own.select("rush_id", noise.alias("noise"), F.when(few, FLOOR + 30).otherwise(F.greatest("q", F.col("p") + spread)).alias("speech"))


def _hop(c: Column, hop: float, last: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.rint(c / hop).cast("long"), F.greatest(F.lit(0), last)))


def energies(spans: DataFrame, levels: DataFrame, hop: float = 0.010) -> DataFrame:
    """The spans (rush_id, id, start, end in seconds) with ``mean_db``, ``peak_db``, ``energy`` and ``peak_energy`` (0 to 1 between noise and speech).

    A span holds one hop at least; a recording without levels has nulls.
    """
    known = references(levels).join(levels.groupBy("rush_id").agg(F.max("i").alias("last")), "rush_id")
    s = spans.join(known, "rush_id", "left")
    s = s.withColumn("a", _hop(F.col("start"), hop, F.col("last"))).withColumn("b", F.greatest(_hop(F.col("end"), hop, F.col("last")), F.col("a") + 1))
    hit = s.join(levels.select("rush_id", "i", "db"), "rush_id", "left").where("i is null or (i >= a and i < b)")
    scale = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - F.col("noise")) / F.greatest(F.lit(1e-6), F.col("speech") - F.col("noise"))))
    out = hit.groupBy("rush_id", "id").agg(F.avg("db").alias("mean_db"), F.max("db").alias("peak_db"), F.first("noise").alias("noise"), F.first("speech").alias("speech"))
    out = out.select("rush_id", "id", "mean_db", "peak_db", scale("mean_db").alias("energy"), scale("peak_db").alias("peak_energy"))
    return spans.join(out, ["rush_id", "id"])


def is_breath(energy: Column, low: float = 0.055, high: float = 0.50) -> Column:
    """Between silence and speech."""
    return F.coalesce(energy.between(low, high), F.lit(False))


def is_silent(energy: Column, below: float = 0.055) -> Column:
    return energy < below


def onsets(points: DataFrame, levels: DataFrame, around: float = 0.35, hop: float = 0.010) -> DataFrame:
    """The points (rush_id, id, t in seconds) with ``onset``: by how much energy rises there, 0 to 1."""
    side = lambda a, b, k: points.select("rush_id", F.struct("id", F.lit(k).alias("side")).alias("id"), a.alias("start"), b.alias("end"))
    t = F.col("t")
    both = side(F.greatest(F.lit(0.0), t - around), t, 0).unionByName(side(t, t + around, 1))
    each = energies(both, levels, hop).groupBy("rush_id", F.col("id.id").alias("id")).agg(F.sum(F.when(F.col("id.side") == 1, F.col("energy")).otherwise(-F.col("energy"))).alias("rise"))
    return points.join(each.select("rush_id", "id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "rise")).alias("onset")), ["rush_id", "id"], "left")


def loudness_profile(spans: DataFrame, levels: DataFrame, steps: int = 8, hop: float = 0.010) -> DataFrame:
    """(rush_id, id, step, energy): the energy of each of ``steps`` equal parts of the spans."""
    d = (F.col("end") - F.col("start")) / steps
    parts = spans.where("end > start").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    parts = parts.select("rush_id", F.struct("id", "k").alias("id"), (F.col("start") + F.col("k") * d).alias("start"), (F.col("start") + (F.col("k") + 1) * d).alias("end"))
    return energies(parts, levels, hop).select("rush_id", F.col("id.id").alias("id"), F.col("id.k").alias("step"), "energy")
